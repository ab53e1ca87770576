"""Rows go through keyed state and windows as columns, many to a cell, and give what single rows give."""

import random
import time
from decimal import Decimal
from pathlib import Path

import pyarrow as pa
from conftest import rows
from pyspark.sql import functions as F
from test_streams import as_stream, at

from lectern.functions.timefn import JSON_TIMES
from lectern.plans.stream_registry import in_files
from lectern.session import scratch_dir
from lectern.sources.messages import table_stream
from lectern.streaming import operators as s
from lectern.streaming import processors as p
from lectern.streaming.changelog import folded, latest_outer_join, takes_back
from lectern.streaming.run import scratch_layer, to_layer

SCHEMA = "k string, j int, n bigint, d decimal(16,2), ts timestamp_ntz"


def some_rows(r, low, high, n):
    return [(r.choice(["a", "b", None, "ç"]), r.choice([1, 2, None]), r.choice([1, 5, None]), r.choice([Decimal("1.25"), None]),
             r.choice([None] + [at(r.randint(low, high))] * 20)) for _ in range(n)]


def streamed(spark, batches):
    path = scratch_dir(spark, "batches")
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)  # file order is by modification time
    return table_stream(spark, path, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)


def test_window_sums_lose_and_close_what_plain_windows_do(spark):
    r = random.Random(3)
    last = lambda second: [("x", 1, 2, Decimal("2.00"), at(second))]  # noqa: E731  the watermark ends where a window does
    batches = [some_rows(r, 0, 60, 80) + last(65), some_rows(r, 20, 100, 80) + last(105), some_rows(r, 90, 200, 50) + last(205)]
    sums = {"n": F.col("n"), "d": F.col("d"), "c": F.lit(1).cast("bigint")}
    got = scratch_layer(s.tumbling_sums(streamed(spark, batches).withColumn("event_ts", s.as_instant("ts")), ["k", "j"], sums, "5 seconds"), "sums")
    want = scratch_layer(s.tumbling(s.with_event_time(streamed(spark, batches)), ["k", "j"], [F.sum(c).alias(n) for n, c in sums.items()]), "plain")
    assert got.schema == want.schema and got.count() > 50
    assert rows(got) == rows(want)


def test_keys_of_a_window_share_rows_of_the_state(spark):
    df = spark.createDataFrame([(f"k{i % 4000}", None, 1, None, at(1)) for i in range(6000)], SCHEMA)
    root = scratch_dir(spark, "run")
    counts = s.tumbling_sums(as_stream(spark, df, 1).withColumn("event_ts", s.as_instant("ts")), ["k"], {"n": F.col("n")}, "5 seconds")
    to_layer(counts, f"{root}/data", f"{root}/checkpoint")
    assert spark.read.format("statestore").option("path", f"{root}/checkpoint").load().count() == s.WINDOW_PARTS


def test_texts_of_columns_are_those_that_spark_writes(spark):
    data = [('q"\\/\n\t\x01ü', 7, True, Decimal("-0.05"), at(1.25)), (None, None, None, None, None), ("", -1, False, Decimal("12345678901234.50"), at(0, 400))]
    df = spark.createDataFrame(data, "a string, `b c` bigint, d boolean, e decimal(16,2), f timestamp_ntz")
    payload = p.Payload(df.dtypes, "v")
    texts = payload.texts(pa.Table.from_batches(df.toDF(*payload.names).coalesce(1).toArrow().to_batches()))
    assert payload.plain and texts == [r[0] for r in df.select(F.to_json(F.struct(*df.columns), JSON_TIMES)).collect()]
    assert not p.Payload([("a", "string"), ("x", "double")], "v").plain


def test_compaction_of_columns_breaks_ties_by_text(spark):
    schema = "id string, amount decimal(16,2), x {}, v timestamp_ntz"
    data = [("a", Decimal("9.50"), 1, at(1)), ("a", Decimal("10.00"), 2, at(1)), ("b", None, 3, at(2)), ("b", Decimal("1.00"), 4, at(2)),
            (None, None, 5, at(3)), ("flush", None, 0, at(0, 9))]
    for kind in ("int", "double"):
        df = spark.createDataFrame([(i, a, float(x) if kind == "double" else x, v) for i, a, x, v in data], schema.format(kind))
        got = scratch_layer(s.latest_by_clock(as_stream(spark, df, 2, "v"), "id", "v", 60), "latest")
        assert got.schema == df.schema
        assert [(r["id"], int(r["x"])) for r in got.orderBy("id").collect()] == [("a", 1), ("b", 3)]


def test_a_changelog_keeps_types_and_says_whether_it_takes_back(spark):
    lefts = spark.createDataFrame([("1", "k1", Decimal("1.10"), at(1)), ("2", "k2", None, at(2)), ("3", None, Decimal("3.00"), at(3))],
                                  "id string, k string, amount decimal(16,2), ts timestamp_ntz")
    late = spark.createDataFrame([("k1", "s1", 0.5, at(1)), ("k1", "s2", 1.5, at(9))], "k string, source string, x double, ts timestamp_ntz")
    once = late.filter("source = 's2'")
    for rights, files, back in ((late, 2, True), (once, 1, False)):
        log = scratch_layer(latest_outer_join(as_stream(spark, lefts, 1), as_stream(spark, rights, files), {"k": "k"}, salts=2), "log")
        assert takes_back(log) == back
        want = lefts.join(once.select("k", "source", "x"), "k", "left").select(*lefts.columns, "source", "x")
        assert rows(folded(log)) == rows(want)


def test_slices_and_ended_queries_leave_no_second_copy(spark):
    df = spark.createDataFrame([(str(i), None, i, None, at(i)) for i in range(60)], SCHEMA)
    source = scratch_dir(spark, "table")
    df.write.parquet(source)
    top = Path(scratch_dir(spark, "x").removeprefix("file:")).parent
    before = set(top.iterdir())
    path = in_files(spark.read.parquet(source), F.unix_micros(s.as_instant("ts")), "n")
    assert rows(spark.read.parquet(path)) == rows(df)
    assert [f.name for f in set(top.iterdir()) - before] == [Path(path).name]
    scratch_layer(s.tumbling(s.with_event_time(as_stream(spark, df, 2)), ["k"], [F.count(F.lit(1)).alias("n")]), "gone")
    root = next(f for f in top.iterdir() if f.name.startswith("gone-"))
    assert not [f for f in (root / "checkpoint" / "state").rglob("*") if f.is_file() and not f.name.startswith(".")]
