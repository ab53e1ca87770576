"""Routing of change rows by a configuration that changes while the stream runs.

Facts and configuration changes go through one stateful operator, keyed by what a route is keyed by. Its
state begins with the configuration read in full at the start. A fact waits until the clock has passed
it, so that a change of configuration that happened before it has arrived, and then takes the route that
held at its own time; a deleted route takes its facts no longer.
"""

from __future__ import annotations

import json
import sys
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from lectern.functions.timefn import JSON_TIMES, from_micros, micros
from lectern.operators.routing import listed_columns, route_stage
from lectern.streaming.operators import LATE
from lectern.streaming.processors import marked

#: A key's facts are spread over that many parts of the state; the key's routes are in each.
SALTS = 8
#: Facts wait for the clock to pass the end of their step of this many seconds.
SETTLE_SECONDS = 60


class LiveRoutes(StatefulProcessor):
    """The route of each fact at the fact's time.

    State: the versions of the key's route by time, all of them, as they are few and a late fact may need an old
    one; and the waiting facts by the end of their step, a value per step, so that a timer touches its own only.
    """

    output = "at bigint, row string, route string"

    def __init__(self, settle_seconds: int = SETTLE_SECONDS) -> None:
        self.step = settle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.versions = handle.getMapState("versions", "at bigint, stage int", "route string")
        self.waiting = handle.getMapState("waiting", "due bigint", "facts string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for at, stage, route in initialState[["at", "stage", "row"]].itertuples(index=False):
            self.versions.updateValue((int(at), int(stage)), (route,))

    def _routed(self, facts: list[tuple[int, str]]) -> Iterator[pd.DataFrame]:
        versions = sorted((k[0], k[1], v[0]) for k, v in self.versions.iterator())
        times = [v[0] for v in versions]
        out = []
        for at, row in facts:
            held = bisect_right(times, at)
            if held and versions[held - 1][2] is not None:
                out.append((at, row, versions[held - 1][2]))
        if out:
            yield pd.DataFrame(out, columns=["at", "row", "route"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[-1] is None:  # marks only move the clock
            return
        now, late = timerValues.getCurrentWatermarkInMs(), []
        for chunk in rows:
            changes = chunk["stage"].notna()
            for at, stage, route in chunk.loc[changes, ["at", "stage", "row"]].itertuples(index=False):
                self.versions.updateValue((int(at), int(stage)), (None if pd.isna(route) else route,))
            facts = chunk.loc[~changes, ["at", "row"]]
            due = -(-facts["at"] // (self.step * 1000)) * self.step
            for end, some in facts.groupby(due):
                listed = list(zip(some["at"].tolist(), some["row"].tolist(), strict=True))
                if end <= now:
                    late += listed
                    continue
                before = self.waiting.getValue((int(end),))
                if before is None:
                    self.handle.registerTimer(int(end))
                self.waiting.updateValue((int(end),), (json.dumps((json.loads(before[0]) if before else []) + listed),))
        yield from self._routed(late)  # once all changes of the micro-batch are in

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = (expiredTimerInfo.getExpiryTimeInMs(),)
        held = self.waiting.getValue(end)
        if held is not None:
            self.waiting.removeKey(end)
            yield from self._routed([tuple(x) for x in json.loads(held[0])])

    def close(self) -> None:
        pass


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _versions(config: DataFrame, keys: list[str], at, salts: int) -> DataFrame:
    """Configuration rows as versions of their key, one copy for each part of the state."""
    rest = [F.col(f"_row.{c}").alias(c) for c in config.schema["_row"].dataType.names]
    route = F.when(F.col("op") != "d", F.to_json(F.struct(*rest)))
    return config.select(
        *[F.col(f"_row.{k}").alias(f"_k{i}") for i, k in enumerate(keys)],
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<string>")).alias("_salt"),
        at.alias("at"), route_stage().cast("string").alias("stage"), route.alias("row"))


def route_live(
    changes: DataFrame,
    config: DataFrame,
    initial: DataFrame | None,
    keys: dict[str, str],
    late: str = LATE,
    settle_seconds: int = SETTLE_SECONDS,
    salts: int = SALTS,
) -> DataFrame:
    """Change rows (a stream: ``table, type, data, ts`` as wall-clock time) with the route that holds at their time ->
    ``sink_table, sink_pk, _op, data, ts``; ``data`` has the columns the route lists.

    config: a stream of ``op, before, after, ts``; ``op`` is r, c, u or d. initial: the rows of the configuration at
    the start (a table; null: none). keys: columns of the changes and the columns of the configuration that they
    must equal: ``{"table": "source_table"}``, with ``"type": "source_type"`` for facts.

    No row is too late: the clock follows the latest row of either side, ``late`` behind it, and a fact that comes
    behind the clock goes out at once by the routes known then. Rows of one instant follow its changes; of changes of
    one instant an update follows a creation and a delete both. Facts of routes that are not there go away. The
    result comes from timers, so it ends a query.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    payload = F.to_json(F.struct("type", "data"), JSON_TIMES)
    facts = changes.select(
        *[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)],
        F.pmod(F.xxhash64("ts", "type", F.to_json("data")), F.lit(salts)).cast("string").alias("_salt"),
        micros("ts").alias("at"), F.lit(None).cast("string").alias("stage"), payload.alias("row"))
    known = lambda df: df.withColumn("_row", F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after")))
    versions = _versions(known(config), list(keys.values()), micros("ts"), salts)
    rows = facts.unionByName(versions)

    def with_marks(chunks):
        for chunk in chunks:
            yield marked(chunk, [*names, "_salt"])

    timed = rows.mapInPandas(with_marks, StructType([*rows.schema.fields, StructField("event_ts", TimestampType())])).withWatermark("event_ts", late)
    start = None
    if initial is not None:
        whole = initial.select(F.lit("r").alias("op"), F.struct(*initial.columns).alias("_row"))
        first = F.lit(-(1 << 62)).cast("bigint")
        start = _versions(whole, list(keys.values()), first, salts).groupBy(*names, "_salt")
    found = timed.groupBy(*names, "_salt").transformWithStateInPandas(
        LiveRoutes(settle_seconds), LiveRoutes.output, "Append", "EventTime", initialState=start)
    inner = StructType([StructField("type", StringType()), changes.schema["data"]])
    route = "sink_table string, sink_columns string, sink_pk string"
    read = found.select("at", F.from_json("row", inner, JSON_TIMES).alias("_r"), F.from_json("route", route).alias("_c"))
    flat = read.select("at", "_r.type", "_r.data", "_c.*")
    return flat.select(
        "sink_table", F.coalesce("sink_pk", F.lit("id")).alias("sink_pk"), F.col("type").alias("_op"),
        listed_columns("data", "sink_columns").alias("data"), from_micros("at").alias("ts"))
