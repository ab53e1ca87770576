"""One key with a third of all rows: the split plan must give what the unsplit one gives."""

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lectern.operators import keyed, neighbours, sessions, skew
from lectern.plans import windows as w

NEVER, HOT = 10**9, 500


@pytest.fixture(scope="module")
def log(spark):
    made = spark.range(6000).select(
        F.col("id").alias("log_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 97).cast("string")).alias("mid"),
        F.timestamp_add("SECOND", F.pmod(F.xxhash64("id"), F.lit(200_000)), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")).alias("ts"),
        F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)) == 0, "home").alias("last_page_id"),
        F.pmod(F.xxhash64("id", F.lit(2)), F.lit(2)).cast("string").alias("is_new"),
        F.pmod(F.xxhash64("id", F.lit(3)), F.lit(9)).cast("int").alias("play_sec"),
        F.col("id").cast("int").alias("position_sec"), F.concat(F.lit("v"), "id").alias("video_id"),
    )
    return made.persist()


def same(a, b):
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_only_the_hot_key_is_hot(log):
    assert rows(skew.hot_keys(log, ["mid"], HOT)) == [("hot",)]
    sliced = skew.slice_hot(log, ["mid"], "ts", 3600, HOT)
    assert sliced.filter("mid = 'hot'").select("_slice").distinct().count() > 20
    assert sliced.filter("mid <> 'hot' and _slice is not null").isEmpty()


def test_split_plans_equal_unsplit_plans(log):
    for hot in (HOT, NEVER):
        args = {"hot_rows": hot}
        parts = (
            neighbours.with_neighbours(log, ["mid"], "ts", ["log_id"], {"p": "log_id"}, {"n": "log_id"}, slice_seconds=3600, **args),
            keyed.bounces(log, ["log_id"], 60, slice_seconds=3600, **args),
            keyed.repair_new_flag(log, salts=8, **args),
            keyed.flag_first(log, ["mid"], "ts", ["log_id"], "f"),
            sessions.play_sessions(log.select("mid", "log_id", "video_id", "play_sec", "position_sec", "ts"), 120, "mid",
                                   tie=["log_id"], slice_seconds=3600, **args),
        )
        if hot == HOT:
            split = parts
    for a, b in zip(split, parts):
        same(a, b)


def test_top_rows_are_cut_before_the_shuffle(log):
    plan = keyed.unique_visitors(log, ["log_id"])._jdf.queryExecution().toString()
    before = plan[plan.rindex("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in before and "Partial" in before


def test_compaction_shrinks_before_the_shuffle(log):
    plan = keyed.latest_version(log, ["mid"], "ts")._jdf.queryExecution().toString()
    assert "partial_max" in plan[plan.rindex("Exchange hashpartitioning"):]


def test_any_segmenter_fits_the_keyword_job(spark):
    @F.pandas_udf("array<string>")
    def letters(text: pd.Series) -> pd.Series:
        return text.map(list)

    log = spark.createDataFrame([("ab", "keyword"), ("b", "keyword"), ("zz", "other"), (None, "keyword"), ("", "keyword")],
                                "item string, item_type string").withColumn("ts", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:03.5'"))
    assert rows(w.keywords(log, tokenize=letters), "keyword", "keyword_count") == [("a", 1), ("b", 2)]
    assert rows(w.keywords(log), "keyword", "keyword_count") == [("ab", 1), ("b", 1)]
