"""Live routing and changelogs on streams of several micro-batches against the batch answer."""

import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from lectern.operators import routing
from lectern.plans.stream_registry import file_stream, in_files
from lectern.functions.timefn import micros
from lectern.session import scratch_dir
from lectern.sources.messages import table_stream
from lectern.streaming.changelog import folded, latest_outer_join, upsert_messages, upserted
from lectern.streaming.live_routing import route_live
from lectern.streaming.run import scratch_layer

DAY0 = dt.datetime(2024, 1, 1)
ROUTE = "struct<source_table:string,source_type:string,sink_table:string,sink_columns:string>"
KEYS = {"table": "source_table", "type": "source_type"}


def at(seconds):
    return DAY0 + dt.timedelta(seconds=seconds)


def batches(spark, parts, schema):
    """One folder of files, a file for each list of rows, in that order."""
    path = scratch_dir(spark, "files")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return table_stream(spark, path, spark.createDataFrame([], schema).schema, files_per_batch=1)


def fact(n, table="cart", kind="insert"):
    return (table, kind, {"id": str(n), "x": "y"}, at(n))


FACTS = "table string, type string, data map<string,string>, ts timestamp_ntz"
CONFIG = f"op string, before {ROUTE}, after {ROUTE}, ts timestamp_ntz"


def route(sink, columns="id", table="cart", kind="insert"):
    return (table, kind, sink, columns)


def test_routes_apply_in_event_order(spark):
    facts = [[fact(10), fact(20), fact(30, "user"), fact(31, None)], [fact(40), fact(5), fact(41, "cart", "update")], [fact(60), fact(61), fact(80)], [fact(1000)]]
    config = [
        [("u", None, route("second", "id,x"), at(20))],
        [("d", route("second", "id,x"), None, at(60)), ("u", None, route("never"), at(60)), ("c", None, route("users", "x", "user"), at(30))],
        [("c", None, route("third"), at(70))],
        [],
    ]
    initial = spark.createDataFrame([route("first")], "source_table string, source_type string, sink_table string, sink_columns string")
    found = scratch_layer(route_live(batches(spark, facts, FACTS), batches(spark, config, CONFIG), initial, KEYS, settle_seconds=10), "live")
    got = sorted((r.sink_table, r.data.get("id"), sorted(r.data), r.ts) for r in found.collect())
    # the user's fact waits for its route; the late one (5) takes what held then; that of 1000 still waits
    assert got == [
        ("first", "10", ["id"], at(10)), ("first", "5", ["id"], at(5)), ("second", "20", ["id", "x"], at(20)),
        ("second", "40", ["id", "x"], at(40)), ("third", "80", ["id"], at(80)), ("users", None, ["x"], at(30))]


def test_live_routing_is_routing_by_time(spark):
    changes = [("u", None, route("b", "id,x"), at(300)), ("d", route("b"), None, at(500)), ("c", None, route("c"), at(700))]
    config = spark.createDataFrame(changes, CONFIG)
    initial = spark.createDataFrame([route("a")], "source_table string, source_type string, sink_table string, sink_columns string")
    facts = spark.createDataFrame([(*fact(n), n) for n in range(1000)] + [("mark", "insert", None, at(9000), 1)], FACTS + ", n bigint")
    path = in_files(facts, micros("ts"), "n")
    start = initial.select(F.lit("r").alias("op"), F.struct("*").alias("after"), F.lit("0001-01-01").cast("timestamp_ntz").alias("ts"))
    spans = routing.config_spans(config.unionByName(start, allowMissingColumns=True), list(KEYS.values()))
    want = routing.route_by_time(facts.drop("n"), spans, KEYS)
    stream = file_stream(spark, path, facts).drop("n")
    got = scratch_layer(route_live(stream, batches(spark, [changes], CONFIG), initial, KEYS, settle_seconds=5), "live")
    picked = ["sink_table", "_op", F.to_json("data").alias("data"), "ts"]
    assert want.count() == 800
    assert rows(got, *picked) == rows(want, *picked)


def test_no_route_at_all(spark):
    found = route_live(batches(spark, [[fact(1)], [fact(500)]], FACTS), batches(spark, [[], []], CONFIG), None, KEYS)
    assert scratch_layer(found, "live").count() == 0


LEFT, RIGHT = "id string, k string, amount decimal(16,2), ts timestamp_ntz", "k string, source string, ts timestamp_ntz"


def order(n, k, seconds=0):
    return (str(n), k, None, at(seconds))


def changes(spark, lefts, rights, **more):
    return scratch_layer(latest_outer_join(batches(spark, lefts, LEFT), batches(spark, rights, RIGHT), {"k": "k"}, **more), "changes")


def test_a_row_without_match_comes_at_once_and_is_taken_back(spark):
    lefts = [[order(1, "a"), order(2, "b"), order(3, None)], [order(4, "a"), order(1, "a")], [order(5, "c")], []]
    rights = [[("b", "s1", at(5))], [("a", "s2", at(9)), ("a", "s0", at(1)), ("b", "old", at(4))], [("a", "s3", at(10)), (None, "n", at(1))], [("c", "s4", at(1))]]
    log = changes(spark, lefts, rights)
    story = lambda n: [(r.kind, r.source) for r in sorted(log.filter(F.col("id") == n).collect(), key=lambda r: r.seq)]
    assert story("2") == [("+I", "s1")]  # an older right row changes nothing
    assert story("3") == [("+I", None)]
    assert story("5") == [("+I", None), ("-U", None), ("+U", "s4")]
    # the batch left join, equal rows as often as they are there
    want = [("1", "s3"), ("1", "s3"), ("2", "s1"), ("3", None), ("4", "s3"), ("5", "s4")]
    assert sorted(map(tuple, folded(log).select("id", "source").collect()), key=str) == want
    messages = upsert_messages(log, ["id"])
    assert messages.filter("value IS NULL").count() == log.filter("kind = '-U'").count() > 0
    assert rows(upserted(messages), F.get_json_object("key", "$.id"), F.get_json_object("value", "$.source")) == sorted({w for w in want}, key=str)


def test_a_key_with_most_rows_is_spread_and_folds_to_the_join(spark):
    lefts = [[order(100 * b + i, "hot" if i % 3 else f"k{i}", i) for i in range(100)] for b in range(3)]
    rights = [[("hot", f"h{b}", at(b * 10 + i)) for i in range(10)] + [(f"k{b * 9}", "x", at(b))] for b in range(3)]
    log = changes(spark, lefts, rights, salts=4)
    flat = spark.createDataFrame([r for part in rights for r in part], RIGHT)
    last = flat.groupBy("k").agg(F.max_by("source", "ts").alias("source"))
    want = spark.createDataFrame([r for part in lefts for r in part], LEFT).join(last, "k", "left")
    assert rows(folded(log), "id", "k", "source") == rows(want, "id", "k", "source")


def test_nothing_folds_to_nothing(spark):
    log = changes(spark, [[]], [[]])
    assert log.count() == folded(log).count() == upserted(upsert_messages(log, ["id"])).count() == 0
