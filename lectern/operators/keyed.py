"""Operators that remember something per key, in batch form.

Each gives the rows a state machine would give when it sees the rows in time order. Top-one-per-key
filters are written as ``row_number() = 1``, which Spark cuts down before the shuffle, so a hot key
sends one row per map task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.timefn import day, micros
from lectern.operators.neighbours import with_neighbours
from lectern.operators.skew import HOT_ROWS, SALTS, join_unique

DAY_MICROS = 86_400_000_000


def repair_new_flag(
    df: DataFrame,
    key: str = "mid",
    ts: str = "ts",
    flag: str = "is_new",
    hot_rows: int | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Correct the new-visitor flag of each row.

    A key's first day is the day of its earliest row, or the day before when that row already says
    "not new". A row that claims "new" on any other day becomes "not new".
    """
    # The earliest row's time and flag travel as one long, so this stays a hash aggregate:
    # twice the time in microseconds, plus 1 when the row claims to be new.
    earliest = F.min(micros(ts) * 2 + F.when(F.col(flag) == "1", 1).otherwise(0))
    per_key = df.groupBy(key).agg(earliest.alias("_e"), F.count(F.lit(1)).alias("_n"))
    hot = None if hot_rows is None else per_key.filter(F.col("_n") >= hot_rows).select(F.col(key).alias("_hot_" + key))
    start = F.floor(F.floor(F.col("_e") / 2) / F.lit(DAY_MICROS)) - (1 - F.pmod(F.col("_e"), F.lit(2)))
    first = per_key.select(key, F.date_from_unix_date(start.cast("int")).alias("_first_day"))
    joined = join_unique(df, first, [key], [ts], "left", hot, salts=salts)
    wrong = (F.col(flag) == "1") & (F.col("_first_day") != day(ts))
    return joined.withColumn(flag, F.when(wrong, F.lit("0")).otherwise(F.col(flag))).select(*df.columns)


def first_per(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key. ``order`` must be unique within a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def first_per_day(df: DataFrame, keys: list[str], ts: str, tie: list[str]) -> DataFrame:
    """The first row of each key on each calendar day."""
    return first_per(df, [*keys, day(ts)], [ts, *tie])


def unique_visitors(page_log: DataFrame, tie: list[str]) -> DataFrame:
    """Daily unique visitors: the first session-entry page of each device and day."""
    return first_per_day(page_log.filter(F.col("last_page_id").isNull()), ["mid"], "ts", tie)


def first_logins(log: DataFrame, tie: list[str]) -> DataFrame:
    """The first logged-in row of each device and day."""
    return first_per_day(log.filter(F.col("uid").isNotNull()), ["mid"], "ts", tie)


def bounces(
    page_log: DataFrame,
    tie: list[str],
    within_seconds: int = 10,
    key: str = "mid",
    ts: str = "ts",
    hot_rows: int = HOT_ROWS,
    slice_seconds: int = 600,
) -> DataFrame:
    """Entry pages with no further page of the same visit.

    An entry is a bounce unless the device's next row comes less than ``within_seconds`` later and
    is not itself an entry.
    """
    looked = with_neighbours(
        page_log, [key], ts, tie,
        after={"_next_ts": ts, "_next_last": "last_page_id"},
        hot_rows=hot_rows, slice_seconds=slice_seconds,
    )
    soon = micros("_next_ts") - micros(ts) < within_seconds * 1_000_000
    went_on = F.coalesce(soon & F.col("_next_last").isNotNull(), F.lit(False))
    return looked.filter(F.col("last_page_id").isNull() & ~went_on).drop("_next_ts", "_next_last")


def latest_version(df: DataFrame, keys: list[str], version: str, arrival: str | None = None) -> DataFrame:
    """Upsert compaction: the row with the greatest version of each key.

    Equal versions go to the later ``arrival`` if given, else to the greatest remaining columns, so
    the outcome never depends on the order of the input. Rows without a key (tombstones) go away.
    The whole row is one aggregate value: partial results shrink a hot key before the shuffle, and
    several readers of the result share one shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in (version, arrival)]
    lead = [version] + ([arrival] if arrival else [])
    best = F.max(F.struct(*lead, *rest)).alias("_best")
    kept = df.filter(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(best)
    return kept.select(*[F.col(c) if c in keys else F.col("_best")[c].alias(c) for c in df.columns])


def user_days(df: DataFrame, user: str, ts: str) -> DataFrame:
    """One row per user and day: ``user, _day, ts`` with the first time of that day."""
    return df.groupBy(user, day(ts).alias("_day")).agg(F.min(ts).alias(ts))


def login_days(logins: DataFrame, user: str = "uid", ts: str = "ts", away_days: int = 7) -> DataFrame:
    """Daily unique logins; ``back_count`` is 1 when the user stayed away for long.

    The gap runs from midnight of the last login day and must be greater than ``away_days``. The
    window sees user-days, not rows, so a user's group is bounded by the number of days.
    """
    days = user_days(logins, user, ts)
    last = F.lag("_day").over(Window.partitionBy(user).orderBy("_day"))
    gap = micros(ts) - micros(last.cast("timestamp_ntz"))
    back = F.coalesce((gap > away_days * DAY_MICROS).cast("bigint"), F.lit(0).cast("bigint"))
    return days.select(
        user, ts, F.lit(1).cast("bigint").alias("uv_count"), back.alias("back_count")
    )


def buyer_days(facts: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Daily unique buyers; ``new_count`` is 1 on a user's first day."""
    days = user_days(facts, user, ts)
    rank = F.row_number().over(Window.partitionBy(user).orderBy("_day"))
    return days.select(
        user, ts,
        F.lit(1).cast("bigint").alias("uv_count"),
        F.when(rank == 1, 1).otherwise(0).cast("bigint").alias("new_count"),
    )


def flag_first(
    df: DataFrame,
    keys: list[str],
    ts: str,
    tie: list[str],
    flag: str,
    per_day: bool = True,
) -> DataFrame:
    """Keep all rows; 1 on the first row of each key (and day), 0 on the others.

    The first row is a minimum, partial before the shuffle, that joins back by key and order: no key's
    rows are sorted or gathered. ``ts`` and ``tie`` must tell the rows of a key apart.
    """
    named = df.withColumn("_day", day(ts)) if per_day else df.withColumn("_day", F.lit(None).cast("date"))
    group = [*keys, "_day"]
    order = F.struct(ts, *tie)
    first = named.groupBy(*group).agg(F.min(order).alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in group])
    joined = named.withColumn("_order", order).alias("l").join(first.alias("r"), same)
    one = F.when(F.col("_order") == F.col("_first"), 1).otherwise(0).cast("bigint").alias(flag)
    return joined.select(*[F.col(f"l.{c}").alias(c) for c in df.columns], one)


def first_times(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The first time of each key and day, as rows ``keys, ts``; a hash aggregate on a long."""
    return df.groupBy(*keys, day(ts).alias("_day")).agg(F.min(ts).alias(ts)).select(*keys, ts)
