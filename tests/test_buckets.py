"""Keys of a bucket are handled together: few calls of a processor for many keys, with the rows of each."""

import pandas as pd
from conftest import rows
from pyspark.sql import functions as F
from test_streams import as_stream, at

from lectern.session import scratch_dir
from lectern.streaming import operators as s
from lectern.streaming.changelog import folded, latest_outer_join
from lectern.streaming.processors import packed, packed_type, unpacked
from lectern.streaming.run import scratch_layer, state_partitions, to_layer

LOG = "mid string, uid string, ts timestamp_ntz"


def test_many_keys_share_a_state_value(spark):
    keys = 3 * s.BUCKETS
    df = spark.createDataFrame([(f"k{i}", f"k{i}", at(i % 50 + 60 * n)) for i in range(keys) for n in range(2)] + [(None, "u", at(3))], LOG)
    root = scratch_dir(spark, "run")
    got = to_layer(s.daily_first(as_stream(spark, df, 2), ["mid"], late=None, forget=False).select("mid", "ts"), f"{root}/data", f"{root}/checkpoint")
    assert rows(got) == rows(df.filter("mid IS NOT NULL").groupBy("mid").agg(F.min("ts").alias("ts")))
    values = spark.read.format("statestore").option("path", f"{root}/checkpoint").option("stateVarName", "last_day").load()
    assert 0 < values.count() <= s.BUCKETS


def test_null_keys_are_a_key_where_the_window_follows(spark):
    df = spark.createDataFrame([(None, "u", at(3)), (None, "u", at(1)), ("a", "u", at(2)), ("a", None, at(9, 1))], LOG)
    got = scratch_layer(s.daily_first(as_stream(spark, df, 1), ["mid", "uid"]).select("mid", "uid", "ts", "last_day"), "nulls")
    assert rows(got) == sorted([(None, "u", at(1), None), ("a", "u", at(2), None), ("a", None, at(9, 1), None)], key=str)


def test_a_changelog_of_many_keys(spark):
    lefts = spark.createDataFrame([(str(i), f"k{i % 900}", at(i)) for i in range(1800)], "id string, k string, ts timestamp_ntz")
    rights = spark.createDataFrame([(f"k{i % 1000}", f"s{i}", at(i)) for i in range(2000)], "k string, source string, ts timestamp_ntz")
    log = scratch_layer(latest_outer_join(as_stream(spark, lefts, 2), as_stream(spark, rights, 2), {"k": "k"}, salts=2), "log")
    want = lefts.join(rights.groupBy("k").agg(F.max_by("source", "ts").alias("source")), "k", "left")
    assert rows(folded(log), "id", "source") == rows(want, "id", "source")


def test_a_state_value_is_one_cell_whatever_its_entries():
    kinds = {"k0": "string", "day": "bigint", "sent": "boolean"}
    frame = pd.DataFrame({"k0": ["a", None, ""], "day": [1, -(1 << 62), 1 << 62], "sent": [True, False, True]}, index=[7, 3, 5])
    value = packed(kinds, frame)
    assert isinstance(value[0], bytes) and value[1] is None
    back = unpacked(kinds, value)
    assert back.to_dict("list") == frame.to_dict("list") and list(back.dtypes) == ["object", "int64", "bool"]
    assert list(unpacked(kinds, None).dtypes) == ["object", "int64", "bool"]
    assert packed_type(kinds) == "entries binary, columns struct<k0: string, day: bigint, sent: boolean>"


def test_parts_of_the_state_go_by_the_cores(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    cores = spark.sparkContext.defaultParallelism
    try:
        for named, parts in ((4, 4), (3 * cores, 3 * cores), (10_000, 3 * cores)):
            spark.conf.set("spark.sql.shuffle.partitions", str(named))
            assert state_partitions(spark) == str(parts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
