import json

from conftest import rows
from pyspark.sql import functions as F

from lectern.operators import routing
from lectern.plans import reports
from lectern.session import scratch_dir
from lectern.sinks import dimensions, layers
from lectern.sources import tables


def routed(spark, *items):
    data = [("dim_a", "id", op, d, ts) for op, d, ts in items]
    return spark.createDataFrame(data, "sink_table string, sink_pk string, _op string, data map<string,string>, ts string")


def test_dimension_upserts_keep_the_latest_and_survive_a_retry(spark):
    path = scratch_dir(spark, "dims")
    config = spark.createDataFrame([("dim_a", "id,name", None)], "sink_table string, sink_columns string, sink_pk string")
    first = routed(spark, ("insert", {"id": "1", "name": "a"}, "1"), ("update", {"id": "1", "name": "b"}, "2"),
                   ("insert", {"id": "2"}, "1"))
    dimensions.upsert_batch(spark, first, config, path, 0)
    dimensions.upsert_batch(spark, first, config, path, 0)  # the same batch again
    later = routed(spark, ("delete", {"id": "2", "name": "gone"}, "5"), ("update", {"id": "1", "name": "old"}, "1"))
    dimensions.upsert_batch(spark, later, config, path, 1)
    assert rows(dimensions.read_dimension(spark, path, "dim_a"), "id", "name") == [("1", "b"), ("2", "gone")]
    assert rows(dimensions.read_dimension(spark, path, "dim_a", drop_deleted=True), "id") == [("1",)]
    target = scratch_dir(spark, "compacted")
    dimensions.compact(spark, path, target, "dim_a")
    assert rows(dimensions.read_dimension(spark, target, "dim_a"), "id", "name") == [("1", "b"), ("2", "gone")]


def test_layer_batches_count_once(spark):
    path = scratch_dir(spark, "layer")
    write = layers.append_batch(path)
    df = spark.range(3)
    write(df, 0)
    write(df, 0)
    write(df, 1)
    assert layers.read_layer(spark, path, df.schema).count() == 6


def test_window_table_has_its_columns_and_prunes_by_time(spark):
    path = scratch_dir(spark, "dws")
    df = spark.sql("""select timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(n) as stt,
        timestamp_ntz'2024-01-01 00:00:10' + make_dt_interval(n) as edt, 1L as back_count, 2L as uv_count, 'x' as extra
        from values (0), (1), (40) as t(n)""")
    layers.write_window_table(df, path, "dws_user_login_window")
    table = layers.read_window_table(spark, path, "dws_user_login_window")
    assert table.columns == ["stt", "edt", "back_count", "uv_count", "ts", "month"]
    day = reports.on_date(table, "2024-01-02")
    assert day.count() == 1
    plan = day._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "GreaterThanOrEqual(stt" in plan


def test_message_values(spark):
    df = spark.createDataFrame([("t1", 1, None), ("t2", 2, "x")], "sink_table string, id int, body string")
    got = {r.topic: json.loads(r.value) for r in layers.message_values(df, "sink_table").collect()}
    assert got == {"t1": {"id": 1}, "t2": {"id": 2, "body": "x"}}
    pair = layers.upsert_values(df.filter("id = 2"), "id").first()
    assert json.loads(pair.key) == {"id": 2} and json.loads(pair.value)["body"] == "x"
    path = scratch_dir(spark, "topics")
    bad = spark.createDataFrame([("{bad",)], "value string")
    for number in (0, 1, 1):  # a batch that comes again counts once
        layers.write_by_topic(df, path, number=number)
        layers.write_dead_letters(bad, path + "-dirty", number)
    got = layers.read_lines(spark, path).filter("topic = 't2'").select(F.get_json_object("value", "$.id"))
    assert rows(got) == [("2",), ("2",)]
    assert rows(layers.read_lines(spark, path + "-dirty")) == [("{bad",), ("{bad",)]


def test_of_equal_versions_the_later_arrival_stays(spark):
    path = scratch_dir(spark, "dims")
    config = spark.createDataFrame([("dim_a", "id,name", None)], "sink_table string, sink_columns string, sink_pk string")
    both = routed(spark, ("update", {"id": "1", "name": "B"}, "7"), ("update", {"id": "1", "name": "A"}, "7"))
    numbered = both.withColumn(dimensions.ARRIVAL, F.when(F.col("data")["name"] == "A", 2).otherwise(1))
    dimensions.upsert_batch(spark, numbered, config, path, 0)
    assert rows(dimensions.read_dimension(spark, path, "dim_a"), "name") == [("A",)]


def test_of_one_instant_an_update_follows_a_creation(spark):
    kind = "op string, ts_ms bigint, before struct<id:string,v:string>, after struct<id:string,v:string>"
    changes = spark.createDataFrame([("u", 5, ("1", "old"), ("1", "new")), ("c", 5, None, ("1", "old")),
                                     ("c", 5, None, ("2", "x")), ("d", 5, ("2", "x"), None)], kind)
    assert rows(routing.current_config(changes, ["id"])) == [("1", "new")]


def test_sources(spark):
    path = scratch_dir(spark, "table")
    spark.range(2).write.parquet(path + "/t.parquet")
    assert tables.read_table(spark, path, "t").count() == 2
    assert tables.rows(spark, [(1,)], "a int").count() == 1
    assert routing.sink_schema("id, name") == ["id", "name"]
