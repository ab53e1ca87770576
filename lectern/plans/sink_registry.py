"""Registered queries that go through the sinks: written to the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.timefn import JSON_TIMES
from lectern.operators import keyed, parse, routing
from lectern.plans import model as m
from lectern.plans import reports as r
from lectern.plans.registry import (
    PROPS, _changes, _dim_config, _fact_config, _props_lines, _province_orders, query,
)
from lectern.session import scratch_dir
from lectern.sinks import dimensions, layers


def _routed_facts(spark, sf):
    return routing.route_facts(parse.fact_changes(_changes(spark, sf)), _fact_config(spark))


@query("k1_message_values")
def _(spark, sf):
    return layers.message_values(_routed_facts(spark, sf).filter(F.col("sink_table") == "dwd_trade_cart_add"), "sink_table")


@query("k2_messages_by_topic")
def _(spark, sf):
    path = scratch_dir(spark, "topics")
    layers.write_by_topic(_routed_facts(spark, sf), path)
    return layers.read_lines(spark, path).groupBy("topic").agg(F.count(F.lit(1)).alias("message_count"))


@query("k3_upsert_messages")
def _(spark, sf):
    """Versions sent as key and value, then read and compacted by their key."""
    rows = m.details(spark, sf).select("id", "row_op_ts", "final_amount")
    sent = layers.upsert_values(rows, "id")
    back = sent.select(F.from_json("value", rows.schema, JSON_TIMES).alias("r")).select("r.*")
    return keyed.latest_version(back, ["id"], "row_op_ts")


@query("k4_dimension_upsert")
def _(spark, sf):
    """All dimension changes as one batch, then renamed courses as the next."""
    path, config = scratch_dir(spark, "dims"), _dim_config(spark)
    first = routing.route_dimensions(parse.dimension_changes(_changes(spark, sf)), config)
    dimensions.upsert_batch(spark, first, config, path, 0)
    renamed = m.table(spark, sf, "supplier").filter(F.col("s_acctbal") > 5000).select(
        F.lit("course_info").alias("table"), F.lit("update").alias("type"),
        F.create_map(
            F.lit("id"), F.col("s_suppkey").cast("string"), F.lit("subject_id"), F.col("s_nationkey").cast("string"),
            F.lit("course_name"), F.concat("s_name", F.lit(" v2"))).alias("data"),
        F.lit("2").alias("ts"))
    dimensions.upsert_batch(spark, routing.route_dimensions(renamed, config), config, path, 1)
    return dimensions.read_dimension(spark, path, "dim_course_info")


@query("k5_dimension_columns")
def _(spark, sf):
    """A dimension table has the configured columns, all text."""
    path, config = scratch_dir(spark, "dims"), _dim_config(spark)
    routed = routing.route_dimensions(parse.dimension_changes(_changes(spark, sf)), config)
    dimensions.upsert_batch(spark, routed, config, path, 0)
    return dimensions.read_dimension(spark, path, "dim_base_province")


@query("k6_k7_stored_window_table")
def _(spark, sf):
    """A window table written by day; the report reads one day's folder."""
    path, name = scratch_dir(spark, "dws"), "dws_trade_province_order_window"
    layers.write_window_table(_province_orders(spark, sf).withColumn("user_id", F.lit("-")), path, name)
    return r.amount_by_province(layers.read_window_table(spark, path, name), "1998-03-02").na.fill("-")


@query("k8_dead_letters")
def _(spark, sf):
    path = scratch_dir(spark, "dirty")
    layers.write_dead_letters(parse.parse_or_divert(_props_lines(spark, sf), PROPS)[1], path)
    return layers.read_lines(spark, path)
