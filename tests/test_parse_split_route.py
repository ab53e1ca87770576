from conftest import rows
from pyspark.sql import functions as F

from lectern.operators import joins, parse, routing, split
from lectern.plans import model
from lectern.sources import messages, schemas


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_good_and_dirty_lines(spark):
    ok = '{"common":{"mid":"1"},"page":{"page_id":"home"},"ts":10}'
    bad = ["not json", '{"a":', "[1,2]", "null", ""]
    good, dirty = parse.parse_or_divert(lines(spark, ok, *bad), schemas.TOPIC_LOG)
    assert rows(good, "common.mid", "page.page_id", "ts") == [("1", "home", 10)]
    assert rows(dirty) == sorted((b,) for b in bad)
    assert parse.non_empty(lines(spark, ok, "", None)).count() == 1


def test_five_way_split(spark):
    log = parse.parse_or_drop(lines(
        spark,
        '{"common":{"mid":"s"},"start":{"entry":"icon"},"err":{"code":1},"ts":1}',
        '{"common":{"mid":"v"},"appVideo":{"video_id":"7","play_sec":3,"position_sec":9},"ts":2}',
        '{"common":{"mid":"p"},"page":{"page_id":"home"},"displays":[{"item":"a"},{"item":"b"}],"actions":[{"item":"c"}],"ts":3}',
        '{"common":{"mid":"q"},"page":{"page_id":"list"},"err":{"code":2},"displays":[],"ts":4}',
    ), schemas.TOPIC_LOG)
    parts = split.split_log(log)
    assert rows(parts["error"]) == [('{"code":1}',), ('{"code":2}',)]
    assert rows(parts["start"], "common.mid") == [("s",)]
    assert rows(parts["video"], "common.mid", "appVideo.play_sec") == [("v", 3)]
    assert rows(parts["page"], "common.mid") == [("p",), ("q",)]
    assert rows(parts["display"], "display", "common.mid") == [('{"item":"a"}', "p"), ('{"item":"b"}', "p")]
    assert rows(parts["action"], "action") == [('{"item":"c"}',)]
    assert "err" not in parts["page"].columns and "err" not in parts["start"].columns


def changes(spark):
    return messages.change_rows(lines(
        spark,
        '{"database":"edu","table":"base_source","type":"bootstrap-start","data":{},"ts":"1"}',
        '{"database":"edu","table":"base_source","type":"bootstrap-insert","data":{"id":1,"source_site":"web","x":2},"ts":"2"}',
        '{"database":"edu","table":"unlisted","type":"insert","data":{"id":1},"ts":"3"}',
        '{"database":"edu","table":"base_source","data":{"id":9},"ts":"4"}',
        '{"database":"edu","table":"cart_info","type":"insert","data":{"id":5,"user_id":6},"ts":"5"}',
        '{"database":"edu","table":"cart_info","type":"update","data":{"id":5,"user_id":6},"ts":"6"}',
    ))


def test_config_folds_to_last_change(spark):
    config = routing.current_config(
        model.config_changes(spark, model.DIM_CONFIG_CHANGES, model.DIM_CONFIG_TYPE), ["source_table"])
    assert rows(config, "source_table", "sink_columns") == [
        ("base_province", "id,name"), ("base_source", "id,source_site"), ("course_info", "id,course_name,subject_id")]


def test_routing_drops_what_is_not_listed(spark):
    dim = routing.current_config(
        model.config_changes(spark, model.DIM_CONFIG_CHANGES, model.DIM_CONFIG_TYPE), ["source_table"])
    routed = routing.route_dimensions(parse.dimension_changes(changes(spark)), dim)
    assert rows(routed, "sink_table", "_op", F.to_json("data")) == [
        ("dim_base_source", "bootstrap-insert", '{"id":"1","source_site":"web"}')]
    fact = routing.current_config(
        model.config_changes(spark, model.FACT_CONFIG_CHANGES, model.FACT_CONFIG_TYPE), ["source_table", "source_type"])
    facts = routing.route_facts(parse.fact_changes(changes(spark)), fact)
    assert rows(facts, "sink_table", F.to_json("data"), "ts") == [("dwd_trade_cart_add", '{"user_id":"6"}', "5")]


def test_routes_go_to_the_changes(spark):
    """Changes of one table are not dealt out by its name, however large Spark takes the routes to be."""
    route = ("cart_info", "insert", "to", "id")
    columns = "source_table string, source_type string, sink_table string, sink_columns string"
    config = spark.createDataFrame([(*route, None)], columns + ", sink_pk string")
    spans = routing.config_spans(spark.createDataFrame([("c", None, route, 0)], f"op string, before struct<{columns}>, after struct<{columns}>, ts bigint"), ["source_table"])
    lines = spark.range(40).select(F.when(F.col("id") >= 0, "cart_info").alias("table"), F.when(F.col("id") >= 0, "insert").alias("type"), F.create_map(F.lit("id"), F.col("id").cast("string")).alias("data"), F.col("id").alias("ts"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for routed in (routing.route_dimensions(lines, config), routing.route_facts(lines, config),
                       routing.route_by_time(lines, spans, {"table": "source_table", "type": "source_type"})):
            plan = routed._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "SortMergeJoin" not in plan
            assert rows(routed, F.col("data")["id"].cast("int")) == sorted(((i,) for i in range(40)), key=lambda t: str(t[0]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lookup_keeps_rows_without_a_match_at_either_hop(spark):
    facts = spark.createDataFrame([("1",), ("2",), ("3",), (None,)], "course_id string")
    courses = spark.createDataFrame([("1", "a", "10"), ("2", "b", "99")], "id string, name string, subject_id string")
    subjects = spark.createDataFrame([("10", "s")], "id string, name string")
    named = joins.lookup(facts, courses, {"course_id": "id"}, {"course": "name", "subject_id": "subject_id"})
    named = joins.lookup(named, subjects, {"subject_id": "id"}, {"subject": "name"})
    assert rows(named, "course_id", "course", "subject") == [
        ("1", "a", "s"), ("2", "b", None), ("3", None, None), (None, None, None)]
