"""Tumbling windows and measure rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: every window table sums over ten seconds unless the caller asks otherwise.
WINDOW = "10 seconds"


def tumbling(df: DataFrame, keys: list[str], measures: list[Column], ts: str = "ts", width: str = WINDOW) -> DataFrame:
    """Aggregate per window and key -> ``stt, edt, keys, measures``.

    Also right without keys: partial sums per task meet in one small row per window.
    """
    grouped = df.groupBy(F.window(ts, width).alias("_w"), *keys).agg(*measures)
    others = [c for c in grouped.columns if c != "_w"]
    return grouped.select(F.col("_w.start").alias("stt"), F.col("_w.end").alias("edt"), *others)


def summed(*names: str) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def measure_rows(df: DataFrame, ts: str, keys: list[str], all_measures: list[str], **given: Column) -> DataFrame:
    """Facts as indicator rows: ``ts, keys, measures``, where measures not given are 0.

    Streams of different facts with the same measure columns can then be united and summed.
    """
    zero = F.lit(0).cast("bigint")
    return df.select(ts, *keys, *[given.get(m, zero).alias(m) for m in all_measures])


def stamped(df: DataFrame) -> DataFrame:
    """Add ``ts``, the time of writing in epoch milliseconds, as the last column."""
    return df.withColumn("ts", F.unix_millis(F.current_timestamp()))
