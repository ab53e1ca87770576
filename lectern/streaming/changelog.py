"""Outer joins on streams that answer at once and take back what a later row corrects.

The result is a changelog: rows with a ``kind`` as streaming SQL names them, ``+I`` (new), ``-U`` (this row no
longer holds) and ``+U`` (this one holds instead), and ``seq``, which orders the changes of a row. ``folded``
gives the table that a changelog stands for, ``upsert_messages`` its form on a keyed topic, where a row that
no longer holds is a message without value.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessorHandle
from pyspark.sql.types import StructType

from lectern.functions.timefn import JSON_TIMES, micros
from lectern.streaming.operators import by_dealt_columns, payload_columns, without_payload
from lectern.streaming.processors import (
    Bucketed, Payload, _ipc, frame_of, gathered, greatest_of, numbers, packed_type, table_of, times, with_columns,
)

#: Parts of the state that a key's left rows are spread over; the key's right row is in each.
SALTS = 8
#: The time of a right row that is not there.
NO_TIME = -(1 << 62)


class LatestOuterJoin(Bucketed):
    """Each left row with the key's greatest right row so far, or none.

    All right rows of a micro-batch count before its left rows, and a key's left rows change once in it. A key's ``turn``
    is kept for good; its right row and its left rows for ``keep_ms``, if that is named.
    """

    def __init__(self, keys: list[str], left: Payload, right: Payload, cell: pa.Schema, keep_ms: int | None = None) -> None:
        super().__init__(keys)
        self.left, self.right, self.cell, self.keep = left, right, cell, keep_ms

    @property
    def output(self) -> str:
        return ", ".join(f"{c} {t}" for c, t in {"kind": "string", "seq": "bigint", **self.left.kinds, **self.right.kinds}.items())

    def init(self, handle: StatefulProcessorHandle) -> None:
        rights = "".join(f", {c} {t}" for c, t in self.right.kinds.items())
        self.best = self._value(handle, "best", f"turn bigint, at bigint, since bigint{rights}")
        self.left_kinds = {**dict.fromkeys(self.keys, "string"), **self.left.kinds}
        self.lefts = handle.getListState("lefts", packed_type(self.left_kinds),
                                         **({} if self.keep is None else {"ttlDurationMs": self.keep}))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = table_of(rows, self.cell)
        row = ["at", *self.right.names]
        held = self._held_table(self.best, frame.select([*self.keys, *row]))
        clock, size = 0 if self.keep is None else timerValues.getCurrentProcessingTimeInMs(), held.num_rows
        keys = pa.concat_tables([held.select(self.keys), frame.select(self.keys)])
        n = numbers(keys, self.keys)
        of, new = n[size:], np.unique(n, return_index=True)[1]  # entry i of the state is key i
        known = len(new)
        turn, since = np.zeros(known, np.int64), np.zeros(known, np.int64)
        turn[:size], since[:size] = held["turn"].to_numpy(), held["since"].to_numpy()
        turn[np.unique(of)] += 1
        before_at = np.full(known, NO_TIME)
        before_at[:size] = times(held, NO_TIME)
        if self.keep is not None:
            before_at[:size][since[:size] + self.keep <= clock] = NO_TIME
        # of the rows at hand, the state's and then the sent ones, each key's greatest; -1 stands for none
        right = np.flatnonzero(frame["at"].is_valid().to_numpy())
        all_rows = pa.concat_tables([held.select(row), frame.select(row).take(right)])
        before = np.where(before_at == NO_TIME, -1, np.arange(known))
        there = np.append(np.flatnonzero(before >= 0), size + np.arange(len(right)))
        of_row = np.append(np.arange(size), of[right])
        best = there[greatest_of(all_rows.take(there), of_row[there], self.right)]
        now = np.full(known, -1)
        now[of_row[best]] = best
        at = np.where(now < 0, NO_TIME, times(all_rows, NO_TIME)[now] if all_rows.num_rows else NO_TIME)
        changed = at != before_at
        again = np.flatnonzero(~changed & (now != before))  # another row of the same time: perhaps the same row
        if len(again):
            old, sent = (self.right.texts(all_rows.take(x[again])) for x in (before, now))
            changed[again] = [a != b for a, b in zip(old, sent, strict=True)]
        since[changed] = clock
        taken = all_rows.take(pa.array(now, mask=now < 0))
        self._keep_table(self.best, with_columns(pa.table({**{k: keys.take(new)[k] for k in self.keys}, **{c: taken[c] for c in taken.column_names}}),
                                                 turn=turn, at=at, since=since))
        if changed.any():
            parts = [pa.ipc.open_stream(bytes(part[0])).read_all() for part in self.lefts.get()]
            if parts:
                lefts = pa.concat_tables(parts)
                whose = numbers(pa.concat_tables([keys.take(new), lefts.select(self.keys)]), self.keys)[known:]  # the state's keys keep their numbers
                hit = np.flatnonzero(np.append(changed, False)[np.minimum(whose, known)])
                if len(hit):
                    whose, lefts = whose[hit], lefts.select(self.left.names).take(hit)
                    yield self._rows("-U", 2 * turn[whose], lefts, all_rows, before[whose])
                    yield self._rows("+U", 2 * turn[whose] + 1, lefts, all_rows, now[whose])
        added = np.flatnonzero(frame["at"].is_null().to_numpy())
        if len(added):
            lefts = frame.take(added)
            self.lefts.appendList([(_ipc(lefts.select(list(self.left_kinds)).combine_chunks()), None)])
            yield self._rows("+I", 2 * turn[of[added]] + 1, lefts.select(self.left.names), all_rows, now[of[added]])

    def _rows(self, kind: str, seq: np.ndarray, lefts: pa.Table, rights: pa.Table, which: np.ndarray) -> pd.DataFrame:
        right = rights.select(self.right.names).take(pa.array(which, mask=which < 0))
        head = {"kind": pa.array([kind]).take(pa.array(np.zeros(len(seq), np.int64))), "seq": pa.array(seq)}
        return frame_of(pa.table({**head, **{c: lefts[c] for c in self.left.names}, **{c: right[c] for c in self.right.names}}))


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def greatest_per_key(table: pa.Table, keys: list[str], payload: Payload) -> pa.Table:
    """The greatest row of each key within one chunk."""
    return table.take(greatest_of(table, numbers(table, keys), payload))


def latest_outer_join(
    left: DataFrame, right: DataFrame, on: dict[str, str], ts: str = "ts", keep_ms: int | None = None, salts: int = SALTS,
) -> DataFrame:
    """Left rows, each with the latest right row of its key, as a changelog: ``kind, seq``, the columns of the left and
    those of the right but its keys and ``ts``.

    Both are streams. on: columns of the left and those of the right that they equal; ts: the right's wall-clock time.
    A left row comes out at once, with nulls if no right row is there; when a later one arrives the old row is taken
    back and the new one follows. Null keys never match. With ``keep_ms`` the state forgets rows that long after they
    were written, as a join with a state of bounded age does; else it keeps them.

    Each task sends only the greatest right row per key of every chunk. A key's left rows are spread over ``salts``
    parts, and the right rows go to each.
    """
    names = [f"k{i}" for i in range(len(on))]
    taken = [c for c in right.columns if c not in (*on.values(), ts)]
    kinds = [Payload([(c, t) for c, t in side.dtypes if c in columns], prefix)
             for side, columns, prefix in ((left, left.columns, "l"), (right, taken, "r"))]
    lefts = left.select(*[F.col(c).cast("string").alias(n) for c, n in zip(on, names, strict=True)],
                        (F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in left.columns]), F.lit(salts)).cast("string") if salts > 1 else F.lit("0")).alias("salt"),
                        F.lit(None).cast("bigint").alias("at"), *payload_columns(left, left.columns, kinds[0]))
    rights = right.select(*[F.col(c).cast("string").alias(n) for c, n in zip(on.values(), names, strict=True)],
                          micros(ts).alias("at"), *payload_columns(right, taken, kinds[1])).dropna(subset=names)
    sent = kinds[1]

    def reduce_chunks(batches):
        for table in gathered(batches):
            yield from greatest_per_key(table, names, sent).to_batches()

    spread = rights.mapInArrow(reduce_chunks, rights.schema).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<string>")))
    keys = [*names, "salt"]
    both = lefts.unionByName(spread, allowMissingColumns=True)
    processor = LatestOuterJoin(keys, *kinds, to_arrow_schema(both.schema), keep_ms)
    found = by_dealt_columns(both, keys, processor.cell).transformWithStateInPandas(
        processor, processor.output, "Append", "None" if keep_ms is None else "ProcessingTime")
    return found.select("kind", "seq", *without_payload(kinds[0], StructType(left.schema.fields)),
                        *without_payload(kinds[1], StructType([f for f in right.schema if f.name in taken])))


def folded(changelog: DataFrame) -> DataFrame:
    """The table that a changelog stands for: rows as often as they were added and not taken back.

    One aggregate over the rows, partial before the shuffle; no order is needed.
    """
    columns = [c for c in changelog.columns if c not in ("kind", "seq")]
    net = F.sum(F.when(F.col("kind").startswith("+"), 1).otherwise(-1)).alias("_n")
    held = changelog.groupBy(*columns).agg(net).filter(F.col("_n") > 0)
    return held.withColumn("_n", F.explode(F.expr("array_repeat(1, cast(_n AS int))"))).drop("_n")


def takes_back(changelog: DataFrame) -> bool:
    """Whether any row of a stored changelog is taken back; if none is, its rows are the table that it stands for."""
    return not changelog.filter(~F.col("kind").startswith("+")).isEmpty()


def upsert_messages(changelog: DataFrame, keys: list[str]) -> DataFrame:
    """A changelog as messages of a keyed topic -> ``key, value, seq``: JSON texts; a row taken back has no value."""
    columns = [c for c in changelog.columns if c not in ("kind", "seq")]
    value = F.to_json(F.struct(*columns), JSON_TIMES)
    return changelog.select(F.to_json(F.struct(*keys)).alias("key"), F.when(F.col("kind").startswith("+"), value).alias("value"), "seq")


def upserted(messages: DataFrame) -> DataFrame:
    """The messages in force: of each key the last, unless it has no value."""
    last = Window.partitionBy("key").orderBy(F.col("seq").desc(), F.col("value").desc_nulls_last())
    return messages.withColumn("_rn", F.row_number().over(last)).filter((F.col("_rn") == 1) & F.col("value").isNotNull()).drop("_rn")
