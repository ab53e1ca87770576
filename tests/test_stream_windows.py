"""Window tables over compacted layers: the stream's closed sums against the batch form."""

from conftest import rows
from pyspark.sql import functions as F
from test_streams import as_stream, at

from lectern.plans import windows as w
from lectern.streaming import windows
from lectern.streaming.run import scratch_layer


def test_windows_over_compacted_facts(spark):
    facts = spark.createDataFrame([
        ("1", "o1", "u1", "s1", "c1", "10.50", at(1)), ("2", "o1", "u1", "s1", "c2", "2.25", at(3)),
        ("3", "o2", "u2", "s1", "c1", "4.00", at(14)), ("4", "o3", "u1", "s2", "c1", "1.00", at(15)),
        ("5", "o1", "u1", "s1", "c1", "8.00", at(5, 1)), ("6", "o4", "u2", None, "c9", "1.00", at(6, 1)),
        ("7", "flush", "f", "f", "f", "0.00", at(0, 5)),
    ], "id string, order_id string, user_id string, source_id string, course_id string, final_amount string, ts timestamp_ntz")
    facts = facts.withColumn("row_op_ts", F.col("ts"))
    real = facts.filter("id <> '7'")
    none = spark.createDataFrame([], "id string, source_site string")
    source = lambda: as_stream(spark, facts, 3)

    keys = ["stt", "source_id", *w.TRADE_MEASURES]
    got = scratch_layer(windows.source_orders(source()), "a11")
    assert rows(got, *keys) == rows(w.source_orders(real, none), *keys)

    names = ["stt", "order_uv_count", "new_order_user_count"]
    assert rows(scratch_layer(windows.order_buyers(source()), "a8"), *names) == rows(w.order_buyers(real), *names)
    names = ["stt", "pay_suc_uv_count", "pay_suc_new_user_count"]
    assert rows(scratch_layer(windows.payers(source()), "a9"), *names) == rows(w.payers(real), *names)

    got = scratch_layer(windows.course_orders(source()), "a12")
    want = real.groupBy(F.window("ts", "10 seconds").start.alias("stt"), "course_id").agg(
        F.sum(F.col("final_amount").cast("decimal(16,2)")).alias("order_total_amount"))
    assert rows(got, "stt", "course_id", "order_total_amount") == rows(want, "stt", "course_id", "order_total_amount")

    users = real.groupBy("user_id").agg(F.max("ts").alias("ts"), F.max("row_op_ts").alias("row_op_ts"))
    every = users.unionByName(facts.filter("id = '7'").select("user_id", "ts", "row_op_ts"))
    got = scratch_layer(windows.user_registrations(as_stream(spark, every, 2)), "a5")
    assert rows(got, "stt", "register_count") == rows(w.user_registrations(users), "stt", "register_count")
