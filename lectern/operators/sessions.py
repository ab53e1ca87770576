"""Session windows over the play log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.timefn import micros
from lectern.operators.skew import HOT_ROWS, slice_hot


def play_sessions(
    plays: DataFrame,
    gap_seconds: int = 3,
    key: str = "sid",
    ts: str = "ts",
    tie: list[str] | None = None,
    hot_rows: int = HOT_ROWS,
    slice_seconds: int = 600,
) -> DataFrame:
    """One row per play session: summed ``play_sec``, last ``position_sec``, the rest of the first row.

    Rows at most ``gap_seconds`` apart belong together. A hot key is first put into sessions per
    time slice; the slices' sessions are then merged by a second session window whose gap is the
    length of each partial session.
    """
    tie = tie or []
    keep = [c for c in plays.columns if c not in (key, ts, "play_sec", "position_sec", *tie)]
    sliced = slice_hot(plays, [key], ts, slice_seconds, hot_rows)
    per_slice = (
        sliced.groupBy(key, "_slice", F.session_window(ts, f"{gap_seconds} seconds").alias("_s"))
        .agg(
            F.sum("play_sec").alias("play_sec"),
            F.min(F.struct(ts, *tie, *keep)).alias("_head"),
            F.max(F.struct(ts, *tie, "position_sec")).alias("_tail"),
        )
        .select(key, "_slice", F.col("_s.start").alias("_from"), F.col("_s.end").alias("_to"),
                "play_sec", "_head", "_tail")
    )
    whole = per_slice.filter(F.col("_slice").isNull())
    length = F.concat((micros("_to") - micros("_from")).cast("string"), F.lit(" microseconds"))
    merged = (
        per_slice.filter(F.col("_slice").isNotNull())
        .withColumn("_length", length)
        .groupBy(key, F.session_window("_from", F.col("_length")).alias("_s"))
        .agg(F.sum("play_sec").alias("play_sec"), F.min("_head").alias("_head"), F.max("_tail").alias("_tail"))
    )
    out = [key, "play_sec", "_head", "_tail"]
    both = whole.select(*out).unionByName(merged.select(*out))
    return both.select(
        key, *[F.col("_head")[c].alias(c) for c in keep], "play_sec",
        F.col("_tail")["position_sec"].alias("position_sec"), F.col("_head")[ts].alias(ts),
    )
