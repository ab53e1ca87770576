"""Stateful operators on streaming DataFrames.

Each takes rows with a wall-clock ``ts`` and gives rows of the same columns. Operators that emit
straight away keep an event time, so a window may follow in the same query. Operators that emit from
timers (bounces, first logins, latest versions) end a query: write their rows to a layer and read
that layer in the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyarrow import Schema, Table, field, int64, list_
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lectern.functions.timefn import JSON_TIMES, as_instant, from_micros, micros
from lectern.operators.windows import WINDOW
from lectern.streaming.processors import (
    CELL, BounceDetector, DailyFirst, FirstLogin, FlagRepair, LatestByClock, LatestVersion, Payload, cells_of, dealt,
    first_rows, gathered, greatest_and_first_of, latest_per_key, marked_cells, typed, window_cells, window_sums,
)

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# How late rows may come, per job. Spark takes the greatest time over all partitions,
# so a job that expects rows in order still needs more than the partitions' lag.
LATE = "5 seconds"
LATE_WITH_BOUNCES = "15 seconds"
LATE_KEYWORDS = "3 seconds"

#: Buckets that a query's keys are dealt out to, unless the session names a number. A bucket's state is read and written
#: whole, so many rows need many; each costs a call of some 30 ms in every micro-batch, so few rows need few.
BUCKETS, STATE_BUCKETS = 512, "lectern.state.buckets"
#: Rows of the state that the keys of a window are dealt out to.
WINDOW_PARTS = 32


def _packed(df: DataFrame, keys: list[str], ts: str, **more: Column) -> DataFrame:
    others = [c for c in df.columns if c != ts]
    names = [F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]
    return df.select(*names, micros(ts).alias("at"), F.to_json(F.struct(*others), JSON_TIMES).alias("row"),
                     *[c.alias(n) for n, c in more.items()])


def _timed(packed: DataFrame, late: str) -> DataFrame:
    return packed.withColumn("event_ts", F.timestamp_micros("at")).withWatermark("event_ts", late)


def _unpacked(df: DataFrame, schema: StructType, ts: str, *others: str) -> DataFrame:
    inner = StructType([f for f in schema.fields if f.name != ts])
    read = df.withColumn("_r", F.from_json("row", inner, JSON_TIMES))
    return read.select(*[F.col("_r")[f.name].alias(f.name) if f.name != ts else from_micros("at").alias(ts)
                         for f in schema.fields], *others)


def _keys(n: int) -> list[str]:
    return [f"k{i}" for i in range(n)]


def by_bucket(df: DataFrame, keys: list[str]) -> GroupedData:
    """Rows grouped by buckets of keys, for processors that are ``Bucketed``. A query keeps the number that it began with."""
    return _bucketed(df, keys).groupBy("bucket")


def _bucketed(df: DataFrame, keys: list[str]) -> DataFrame:
    number = int(df.sparkSession.conf.get(STATE_BUCKETS, str(BUCKETS)))
    return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(number)).cast("int"))


def by_dealt_bucket(df: DataFrame, keys: list[str], late: str | None = None) -> GroupedData:
    """``by_bucket`` for rows without event time: a task sends the rows that a bucket has in a chunk as one cell. With
    ``late`` the watermark follows marks that every chunk sends along: Spark drops rows whose event time lies behind the
    watermark, so cells carry none, and no row is dropped."""
    kinds = dict(df.dtypes)

    def deal(chunks):
        for chunk in chunks:
            cells = dealt(chunk, kinds)
            yield cells if late is None else marked_cells(cells, chunk["at"], kinds)

    schema = f"bucket int, {CELL} binary" + ("" if late is None else ", event_ts timestamp")
    sent = _bucketed(df, keys).mapInPandas(deal, schema)
    return (sent if late is None else sent.withWatermark("event_ts", late)).groupBy("bucket")


def by_dealt_columns(
    df: DataFrame, keys: list[str], cell: Schema, late: str | None = None, reduce: Callable[[Table], Table] | None = None,
) -> GroupedData:
    """``by_dealt_bucket`` for processors that work on columns: cells of many rows, each column in its own type, as ``cell`` names
    them. ``reduce`` leaves those rows of a chunk that are to be sent."""
    def deal(batches):
        for table in gathered(batches):
            yield cells_of(table if reduce is None else reduce(table), cell, late is not None)

    sent = _bucketed(df, keys).mapInArrow(deal, f"bucket int, {CELL} binary, mark bigint")
    if late is None:
        return sent.drop("mark").groupBy("bucket")
    return sent.withColumn("event_ts", F.timestamp_micros("mark")).drop("mark").withWatermark("event_ts", late).groupBy("bucket")


def payload_columns(df: DataFrame, columns: list[str], payload: Payload) -> list[Column]:
    if payload.plain:
        return [F.col(c).alias(n) for c, n in zip(columns, payload.names, strict=True)]
    return [F.to_json(F.struct(*columns), JSON_TIMES).alias(payload.names[0])]


def without_payload(payload: Payload, schema: StructType) -> list[Column]:
    """The columns again that ``payload_columns`` has made a payload of; ``schema`` has them in their order."""
    if payload.plain:
        return [F.col(n).alias(f.name) for n, f in zip(payload.names, schema.fields, strict=True)]
    read = F.from_json(payload.names[0], schema, JSON_TIMES)
    return [read[f.name].alias(f.name) for f in schema.fields]


def _first_rows(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    names = _keys(len(keys))
    packed = _packed(df, keys, ts)

    def reduce_chunks(chunks):
        for chunk in chunks:
            yield first_rows(chunk, names)

    return packed.mapInPandas(reduce_chunks, packed.schema)


def daily_first(df: DataFrame, keys: list[str], ts: str = "ts", late: str | None = LATE, forget: bool = True) -> DataFrame:
    """First row of each key and day, plus ``last_day`` and, with ``late``, the event time ``event_ts``.

    Before the shuffle each task keeps only the earliest row per key and day of every chunk, so a
    hot key sends few rows to its state.

    With ``late`` a window may follow in the same query, and rows later than that are lost. A query
    that feeds a layer takes ``late=None``: no row is too late, and days count in the order in which
    they arrive. With ``forget`` a key's state goes away once the clock is a full day past its last day
    (see ``by_dealt_bucket`` for the clock); a row later than that counts as a first one again.
    """
    rows = _first_rows(df, keys, ts)
    names = _keys(len(keys))
    if late is None:
        grouped, mode = (by_dealt_bucket(rows, names, LATE), "EventTime") if forget else (by_dealt_bucket(rows, names), "None")
        first = grouped.transformWithStateInPandas(DailyFirst(names, forget, event_time=False), DailyFirst.plain, "Append", mode)
        return _unpacked(first, df.schema, ts, "last_day")
    first = by_bucket(_timed(rows, late), names).transformWithStateInPandas(
        DailyFirst(names, forget), DailyFirst.output, "Append", "EventTime", eventTimeColumnName="event_ts")
    return _unpacked(first, df.schema, ts, "last_day", "event_ts")


def repair_new_flag(df: DataFrame, key: str = "mid", ts: str = "ts", flag: str = "is_new") -> DataFrame:
    """The corrected flag of every row. It feeds a layer, so no row is ever too late: a key's first day
    is that of the earliest row of the first micro-batch that has the key."""
    packed = _packed(df, [key], ts, is_new=F.col(flag))
    fixed = by_dealt_bucket(packed, ["k0"]).transformWithStateInPandas(FlagRepair(["k0"]), FlagRepair.output, "Append", "None")
    rows = _unpacked(fixed.withColumnRenamed("is_new", "_fixed"), df.schema, ts, "_fixed")
    return rows.withColumn(flag, F.col("_fixed")).drop("_fixed")


def login_days(logins: DataFrame, user: str = "user_id", ts: str = "ts", away_days: int = 7) -> DataFrame:
    first = daily_first(logins.select(user, ts), [user], ts, forget=False)
    gap = micros(ts) - F.col("last_day") * 86_400_000_000
    back = F.coalesce((gap > away_days * 86_400_000_000).cast("bigint"), F.lit(0).cast("bigint"))
    return first.select(user, ts, F.lit(1).cast("bigint").alias("uv_count"), back.alias("back_count"), "event_ts")


def buyer_days(facts: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    first = daily_first(facts.select(user, ts), [user], ts, forget=False)
    new = F.col("last_day").isNull().cast("bigint")
    return first.select(user, ts, F.lit(1).cast("bigint").alias("uv_count"), new.alias("new_count"), "event_ts")


def bounces(page_log: DataFrame, within_seconds: int = 10, key: str = "mid", ts: str = "ts", late: str = LATE_WITH_BOUNCES) -> DataFrame:
    """Bounced entries. Rows more than ``late`` behind the latest of any device are lost: name a time above
    the lag between the source's partitions."""
    packed = _timed(_packed(page_log, [key], ts, entry=F.col("last_page_id").isNull()), late)
    found = by_bucket(packed, ["k0"]).transformWithStateInPandas(
        BounceDetector(["k0"], within_seconds), BounceDetector.output, "Append", "EventTime")
    return _unpacked(found, page_log.schema, ts)


def first_logins(log: DataFrame, hold_seconds: int = 10, key: str = "mid", ts: str = "ts", late: str = LATE) -> DataFrame:
    """First logged-in row per key and day, held back for a while so that an earlier one can still win.

    ``late`` moves the clock by which rows are held (see ``by_dealt_bucket``); no row is too late. A first row from
    behind the clock comes out at once, as its timer is due.
    """
    rows = _first_rows(log.filter(F.col("uid").isNotNull()), [key], ts)
    found = by_dealt_bucket(rows, ["k0"], late).transformWithStateInPandas(FirstLogin(["k0"], hold_seconds), FirstLogin.output, "Append", "EventTime")
    return _unpacked(found, log.schema, ts)


def latest_version(df: DataFrame, key: str, version: str, hold_ms: int = 5_000, keep_ms: int = 60_000) -> DataFrame:
    """Upsert compaction on the wall clock; ``version`` is a timestamp.

    Each task sends only the greatest version per key of every chunk.
    """
    packed = _packed(df.filter(F.col(key).isNotNull()), [key], version)

    def reduce_chunks(chunks):
        for chunk in chunks:
            yield latest_per_key(chunk, ["k0"])

    found = packed.mapInPandas(reduce_chunks, packed.schema).groupBy("k0").transformWithStateInPandas(
        LatestVersion(hold_ms, keep_ms), LatestVersion.output, "Append", "ProcessingTime")
    return _unpacked(found, df.schema, version)


def latest_by_clock(
    df: DataFrame, key: str, version: str, hold_seconds: int, late: str = LATE, keep_seconds: int | None = None,
) -> DataFrame:
    """Upsert compaction on event time, so that it repeats: each key's greatest ``version`` (a wall-clock time), once, when
    the clock is ``hold_seconds`` past the earliest version that came with its first micro-batch.

    The clock is ``late`` behind the latest version of any key (see ``by_dealt_bucket``); no row is too late to count, but once a
    key is out later versions of it are not. Of equal versions the greatest row stays. Rows without key go away. Each
    task sends the greatest version per key of every chunk. The result comes from timers, so it ends a query.
    """
    others = [c for c in df.columns if c != version]
    payload = Payload([(c, t) for c, t in df.dtypes if c != version], "v")
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k0"), micros(version).alias("at"),
                                                    *payload_columns(df, others, payload))
    processor = LatestByClock(["k0"], payload, to_arrow_schema(rows.schema).append(field("first", int64())), hold_seconds, keep_seconds)
    found = by_dealt_columns(rows, ["k0"], processor.cell, late, lambda table: greatest_and_first_of(table, ["k0"], payload)).transformWithStateInPandas(
        processor, processor.output, "Append", "EventTime")
    inner = StructType([f for f in df.schema.fields if f.name != version])
    return found.select(from_micros("at").alias(version), *without_payload(payload, inner)).select(*df.columns)


def with_event_time(df: DataFrame, ts: str = "ts", late: str = LATE) -> DataFrame:
    """Add the watermarked event time; needed before a window or a bounded join."""
    return df.withColumn("event_ts", as_instant(ts)).withWatermark("event_ts", late)


def tumbling(df: DataFrame, keys: list[str], measures: list[Column], width: str = WINDOW) -> DataFrame:
    """Closed windows, appended once -> ``stt, edt, keys, measures``; rows behind them are lost."""
    grouped = df.groupBy(F.window("event_ts", width).alias("_w"), *keys).agg(*measures)
    others = [c for c in grouped.columns if c != "_w"]
    return grouped.select(from_micros(F.unix_micros("_w.start")).alias("stt"),
                          from_micros(F.unix_micros("_w.end")).alias("edt"), *others)


def tumbling_sums(df: DataFrame, keys: list[str], sums: dict[str, Column], late: str, width: str = WINDOW) -> DataFrame:
    """``tumbling`` for windows of many keys: the sums, long or decimal, of rows whose event time ``event_ts`` has no watermark yet.

    Spark's state reads, writes and removes a row for each window and key. Here it has one for each window and part of the
    keys, with the sums of many keys in lists, and a closed window's row is taken apart and summed up.
    """
    schema = df.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()]).schema
    spark = df.sparkSession
    size = spark.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL {width})").first()[0]
    names = list(sums)
    rows = df.filter(F.col("event_ts").isNotNull()).select(
        F.unix_micros("event_ts").alias("at"),
        F.pmod(F.xxhash64(*keys), F.lit(WINDOW_PARTS)).cast("int").alias("part"), *keys, *[c.cast(schema[n].dataType).alias(n) for n, c in sums.items()])
    types = {f.name: pa_type.type for f, pa_type in zip(schema, to_arrow_schema(schema), strict=True)}

    def deal(batches):
        for table in gathered(batches):
            yield typed(window_cells(table, size, keys, names), {c: list_(t) for c, t in types.items()})

    def take_apart(batches):
        for batch in batches:
            yield from typed(window_sums(batch, keys, names), types).to_batches()

    listed = ", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in schema)
    cells = rows.mapInArrow(deal, f"part int, at bigint, {listed}").withColumn("event_ts", F.timestamp_micros("at")).withWatermark("event_ts", late)
    kept = cells.groupBy(F.window("event_ts", width).alias("_w"), "part").agg(*[F.collect_list(f.name).alias(f.name) for f in schema])
    closed = kept.select(*[from_micros(F.unix_micros(f"_w.{e}")).alias(n) for e, n in (("start", "stt"), ("end", "edt"))], *schema.names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return closed.mapInArrow(take_apart, f"stt timestamp_ntz, edt timestamp_ntz, {fields}")


def play_sessions(plays: DataFrame, gap_seconds: int = 3, key: str = "sid", ts: str = "ts", late: str = LATE) -> DataFrame:
    """Closed play sessions; same columns as the batch form."""
    keep = [c for c in plays.columns if c not in (key, ts, "play_sec", "position_sec")]
    timed = with_event_time(plays, ts, late)
    grouped = timed.groupBy(key, F.session_window("event_ts", f"{gap_seconds} seconds").alias("_s")).agg(
        F.sum("play_sec").alias("play_sec"),
        F.min(F.struct(ts, *keep)).alias("_head"), F.max(F.struct(ts, "position_sec")).alias("_tail"),
    )
    return grouped.select(key, *[F.col("_head")[c].alias(c) for c in keep], "play_sec",
                          F.col("_tail")["position_sec"].alias("position_sec"), F.col("_head")[ts].alias(ts))


def bounded_join(
    left: DataFrame, right: DataFrame, keys: list[str], after: str, before: str, how: str = "inner", salts: int = 4,
) -> DataFrame:
    """Stream-stream join of two sides that carry ``event_ts``.

    A right row matches if its time lies from ``before`` earlier to ``after`` later than the left
    row's. The bound and the watermarks let Spark drop old state; with ``left`` the unmatched rows
    come out when the watermark has passed them. A stream cannot count its hot keys beforehand, so
    every key is spread: a left row goes to one of ``salts`` parts, a right row to each of them.
    """
    spread = F.pmod(F.xxhash64(*[c for c in left.columns if c != "event_ts"]), F.lit(salts)).cast("int")
    left = left.withColumn("_salt", spread)
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keys = [*keys, "_salt"]
    other = right.select(*[F.col(c).alias("_r_" + c) if c in (*keys, "event_ts") else F.col(c) for c in right.columns])
    on = F.expr(f"_r_event_ts >= event_ts - interval {before} and _r_event_ts <= event_ts + interval {after}")
    for k in keys:
        on = on & (left[k] == other["_r_" + k])
    return left.join(other, on, how).drop(*["_r_" + k for k in keys], "_salt")


def order_details(details: DataFrame, orders: DataFrame, page_log: DataFrame, bound: str = "10 seconds", late: str = LATE) -> DataFrame:
    """Order details with their order (inner) and the session's source (left), as a bounded join.

    The left side of the outer join is the joined order, whose event time is the detail's.
    """
    d = with_event_time(details, "ts", late)
    o = with_event_time(orders.select(
        F.col("id").alias("order_id"), "out_trade_no", "trade_body", "session_id", "province_id", "ts"), "ts", late).drop("ts")
    joined = bounded_join(d, o, ["order_id"], bound, bound).drop("_r_event_ts")
    pages = page_log.filter((F.col("page_id") == "order") & F.col("sid").isNotNull())
    s = with_event_time(pages.select(F.col("sid").alias("session_id"), F.col("sc").alias("source_id"), "ts"), "ts", late).drop("ts")
    return bounded_join(joined, s, ["session_id"], bound, bound, "left").drop("_r_event_ts", "event_ts")


def paid_details(details: DataFrame, payments: DataFrame, within: str = "905 seconds", late: str = LATE, salts: int = 4) -> DataFrame:
    """Order details joined to successful payments no later than ``within``; ``salts`` as in ``bounded_join``."""
    d = with_event_time(details, "ts", late)
    p = with_event_time(payments.select(
        "order_id", "alipay_trade_no", "payment_type", "payment_status", "callback_content", "callback_time",
        F.col("ts").alias("pay_ts")), "pay_ts", late)
    joined = bounded_join(d, p, ["order_id"], within, "0 seconds", salts=salts)
    return joined.drop("_r_event_ts", "event_ts").withColumn("ts", F.col("pay_ts")).drop("pay_ts")
