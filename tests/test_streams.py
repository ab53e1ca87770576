"""Streams over several files must give the batch answer; a late flush row moves the watermark."""

import datetime as dt
import time

from conftest import rows
from pyspark.sql import functions as F

from lectern.operators import joins as batch_joins
from lectern.operators import keyed, sessions
from lectern.operators.windows import summed, tumbling
from lectern.session import scratch_dir
from lectern.sources.messages import line_messages, table_stream
from lectern.streaming import operators as s
from lectern.streaming import jobs
from lectern.streaming.run import scratch_layer, start
from lectern.sinks.layers import append_batch, read_layer

DAY0 = dt.datetime(2024, 1, 1)


def at(seconds=0.0, days=0):
    return DAY0 + dt.timedelta(days=days, seconds=seconds)


def as_stream(spark, df, parts, ts="ts"):
    """Rows in event-time order over several files, one file per micro-batch."""
    path = scratch_dir(spark, "files")
    data = sorted(df.collect(), key=lambda r: r[ts])
    size = -(-len(data) // parts)
    for i in range(0, len(data), size):
        part = spark.createDataFrame(data[i:i + size], df.schema)
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)  # file order is by modification time
    return table_stream(spark, path, df.schema, files_per_batch=1)


def log(spark):
    data = [
        ("101", "u1", "home", None, "1", at(10)), ("102", "u2", "home", None, "1", at(12)),
        ("102", "u2", "list", None, "1", at(15)), ("102", None, "list", "detail", "0", at(30)),
        ("103", "u3", "home", None, "0", at(40)), ("103", "u3", "list", "home", "1", at(45)),
        ("101", "u1", "home", None, "1", at(50, 1)), ("103", None, "home", None, "1", at(60, 1)),
        ("101", "u1", "home", None, "1", at(70, 8)),
        ("flush", "f", "home", None, "1", at(0, 20)),
    ]
    return spark.createDataFrame(data, "mid string, uid string, page_id string, last_page_id string, is_new string, ts timestamp_ntz")


REAL = "mid <> 'flush'"


def test_repair_and_daily_first(spark):
    df = log(spark)
    got = scratch_layer(s.repair_new_flag(as_stream(spark, df, 4)), "t1")
    assert rows(got, "mid", "ts", "is_new") == rows(keyed.repair_new_flag(df), "mid", "ts", "is_new")
    entries = F.col("last_page_id").isNull()
    uv = scratch_layer(s.daily_first(as_stream(spark, df, 4).filter(entries), ["mid"]).select("mid", "ts"), "t2")
    assert rows(uv) == rows(keyed.unique_visitors(df, []), "mid", "ts")


def test_bounces_and_first_logins(spark):
    df = log(spark)
    got = scratch_layer(s.bounces(as_stream(spark, df, 4)), "t4")
    assert rows(got.filter(REAL), "mid", "ts") == rows(keyed.bounces(df, []).filter(REAL), "mid", "ts")
    first = scratch_layer(s.first_logins(as_stream(spark, df, 3)), "t5")
    assert rows(first.filter(REAL), "mid", "ts") == rows(keyed.first_logins(df, []).filter(REAL), "mid", "ts")


def in_order(spark, df, parts):
    """The rows as they are, one file each of the given numbers of rows, one file per micro-batch."""
    path, data = scratch_dir(spark, "files"), df.collect()
    for n in parts:
        spark.createDataFrame(data[:n], df.schema).coalesce(1).write.mode("append").parquet(path)
        data = data[n:]
        time.sleep(0.05)
    return table_stream(spark, path, df.schema, files_per_batch=1)


def test_late_rows_reach_their_layer(spark):
    """Rows far behind the clock, in later micro-batches: none is lost, and the rules see them as they arrive."""
    data = [("a", "u", "home", None, "1", at(100)), ("b", "u", "home", None, "1", at(50, 3)),
            ("c", "u", "home", None, "1", at(10)), ("a", "u", "home", None, "1", at(20)), ("d", "u", "x", None, "1", at(0, 9)),
            ("e", "u", "home", None, "0", at(5, 1)), ("a", "u", "home", None, "1", at(7, 1)), ("b", "u", "home", None, "1", at(1, 2))]
    df = spark.createDataFrame(data, log(spark).schema)
    parts = [2, 3, 3]
    fixed = scratch_layer(s.repair_new_flag(in_order(spark, df, parts)), "t1")
    assert rows(fixed, "mid", "ts", "is_new") == rows(
        df.withColumn("is_new", F.when(F.col("mid").isin("e") | F.col("ts").isin([at(7, 1), at(1, 2)]), "0").otherwise("1")), "mid", "ts", "is_new")
    first = scratch_layer(s.daily_first(in_order(spark, df, parts), ["mid"], late=None, forget=False), "t2")
    assert rows(first, "mid", "ts") == sorted([("a", at(100)), ("a", at(7, 1)), ("b", at(50, 3)), ("c", at(10)), ("d", at(0, 9)), ("e", at(5, 1))], key=str)
    logins = scratch_layer(s.first_logins(in_order(spark, df, parts)), "t5")
    assert rows(logins, "mid", "ts") == sorted([
        ("a", at(20)), ("a", at(7, 1)), ("b", at(50, 3)), ("b", at(1, 2)), ("c", at(10)), ("e", at(5, 1))], key=str)


def test_returns_buyers_and_a_window(spark):
    users = log(spark).filter("uid is not null").select(F.col("uid").alias("user_id"), "ts")
    days = scratch_layer(s.login_days(as_stream(spark, users, 4)).drop("event_ts"), "t7")
    assert rows(days) == rows(keyed.login_days(users, "user_id"))
    buyers = scratch_layer(s.buyer_days(as_stream(spark, users, 4)).drop("event_ts"), "t9")
    assert rows(buyers) == rows(keyed.buyer_days(users))
    windows = scratch_layer(s.tumbling(s.login_days(as_stream(spark, users, 4)), [], summed("uv_count", "back_count")), "a4")
    want = tumbling(keyed.login_days(users.filter("user_id <> 'f'"), "user_id"), [], summed("uv_count", "back_count"))
    assert rows(windows) == rows(want)


def test_sessions(spark):
    df = spark.createDataFrame([
        ("s", "v1", 1, 10, at(0)), ("s", "v2", 2, 20, at(2)), ("t", "v9", 5, 1, at(3)), ("s", "v3", 4, 30, at(5)),
        ("s", "v4", 8, 40, at(9)), ("flush", "x", 0, 0, at(500)),
    ], "sid string, video_id string, play_sec int, position_sec int, ts timestamp_ntz")
    got = scratch_layer(s.play_sessions(as_stream(spark, df, 3)), "a0")
    assert rows(got) == rows(sessions.play_sessions(df).filter("sid <> 'flush'"), *got.columns)


def test_latest_version_waits_and_emits_once(spark):
    df = spark.createDataFrame([
        ("1", "a", at(1)), ("1", "c", at(3)), ("1", "b", at(2)), ("2", "x", at(1)), (None, "t", at(9)),
    ], "id string, body string, row_op_ts timestamp_ntz")
    root = scratch_dir(spark, "t6")
    found = s.latest_version(as_stream(spark, df, 2, "row_op_ts"), "id", "row_op_ts", hold_ms=2000)
    query = start(found, append_batch(root + "/data"), root + "/checkpoint", every="1 second")
    try:
        for _ in range(60):
            time.sleep(1)
            got = rows(read_layer(spark, root + "/data", found.schema)) if query.lastProgress else []
            if len(got) >= 2:
                break
        assert got == rows(keyed.latest_version(df, ["id"], "row_op_ts"))
    finally:
        query.stop()


def test_stream_joins(spark):
    details = spark.createDataFrame([("d1", "o1", at(0)), ("d2", "o1", at(1)), ("d3", "o2", at(4)), ("x", "x", at(900)), ("y", "y", at(9000))],
                                    "id string, order_id string, ts timestamp_ntz")
    orders = spark.createDataFrame([("o1", "s1", "7", at(0)), ("o2", "s2", "8", at(5)), ("x", "x", "1", at(900)), ("y", "y", "1", at(9000))],
                                   "id string, session_id string, province_id string, ts timestamp_ntz") \
        .withColumns({"out_trade_no": F.lit("n"), "trade_body": F.lit("b")})
    pages = spark.createDataFrame([("s1", "order", "3", at(1)), ("z", "order", "4", at(900)), ("z", "order", "4", at(9000))],
                                  "sid string, page_id string, sc string, ts timestamp_ntz")
    got = scratch_layer(s.order_details(as_stream(spark, details, 3), as_stream(spark, orders, 3), as_stream(spark, pages, 2)), "j1")
    real = F.col("id").isin("d1", "d2", "d3")
    want = batch_joins.order_details(details, orders, pages)
    assert rows(got.filter(real), "id", "province_id", "source_id") == rows(want.filter(real), "id", "province_id", "source_id")

    pay = spark.createDataFrame([("o1", at(905)), ("o2", at(1000))], "order_id string, ts timestamp_ntz").withColumns(
        {c: F.lit(c) for c in ("alipay_trade_no", "payment_type", "payment_status", "callback_content", "callback_time")})
    paid = scratch_layer(s.paid_details(as_stream(spark, details, 1), as_stream(spark, pay, 1)), "j3")
    assert rows(paid, "id", "ts") == rows(batch_joins.paid_details(details, pay), "id", "ts")


def test_log_job_splits_and_diverts(spark):
    src = scratch_dir(spark, "lines")
    lines = [
        '{"common":{"mid":"s","is_new":"1"},"start":{"entry":"icon"},"err":{"code":1},"ts":1000}',
        '{"common":{"mid":"v","is_new":"1"},"appVideo":{"video_id":"7","play_sec":3,"position_sec":9},"ts":2000}',
        '{"common":{"mid":"p","is_new":"1"},"page":{"page_id":"home"},"displays":[{"i":1},{"i":2}],"actions":[{"i":3}],"ts":3000}',
        '{"common":{"mid":"p","is_new":"1"},"page":{"page_id":"home"},"ts":86403000}', '{"bad', "[1]",
    ]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(src)
    root = scratch_dir(spark, "dwd")
    jobs.run_log_split(line_messages(spark, src, stream=True), root)
    read = lambda name: spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}/batch_id=*")
    assert rows(read("dwd_traffic_page_log"), "common.mid", "common.is_new", "ts") == [("p", "0", 86403000), ("p", "1", 3000)]
    assert read("dwd_traffic_display_log").count() == 2 and read("dwd_traffic_action_log").count() == 1
    assert rows(read("dwd_traffic_error_log"), "err") == [('{"code":1}',)]
    assert rows(read("dwd_traffic_start_log"), "common.mid") == [("s",)]
    assert rows(read("play_pre_process"), "appVideo.video_id") == [("7",)]
    assert rows(read("dirty_data"), "value") == [("[1]",), ('{"bad',)]


def test_dimension_and_fact_jobs(spark):
    src = scratch_dir(spark, "changes")
    lines = [
        '{"database":"e","table":"base_source","type":"bootstrap-insert","data":{"id":1,"source_site":"web","x":1},"ts":"1"}',
        '{"database":"e","table":"base_source","type":"update","data":{"id":1,"source_site":"app"},"ts":"2"}',
        '{"database":"e","table":"cart_info","type":"insert","data":{"id":5,"user_id":6},"ts":"3"}',
        '{"database":"e","table":"other","type":"insert","data":{"id":5},"ts":"3"}',
    ]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(src)
    root = scratch_dir(spark, "sinks")
    dim = spark.createDataFrame([("base_source", "dim_base_source", "id,source_site", None, None)],
                                "source_table string, sink_table string, sink_columns string, sink_pk string, sink_extend string")
    fact = spark.createDataFrame([("cart_info", "insert", "dwd_trade_cart_add", "user_id")],
                                 "source_table string, source_type string, sink_table string, sink_columns string")
    jobs.run_dimensions(line_messages(spark, src, stream=True), lambda: dim, root)
    jobs.run_facts(line_messages(spark, src, stream=True), lambda: fact, root)
    from lectern.sinks.dimensions import read_dimension
    assert rows(read_dimension(spark, root + "/dim", "dim_base_source"), "id", "source_site") == [("1", "app")]
    cart = spark.read.parquet(f"{root}/dwd/batch_id=*/sink_table=dwd_trade_cart_add")
    assert rows(cart, F.col("data")["user_id"], "ts") == [("6", "3")]
