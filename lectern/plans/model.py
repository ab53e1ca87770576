"""The star-schema test tables as a learning platform.

Events are the behaviour log, orders and line items the trade facts, and parts, suppliers, nations
and regions the dimensions. Everything is computed from the stored tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.measures import money
from lectern.functions.timefn import datetime_text, from_micros, micros, to_millis
from lectern.operators.joins import order_details, paid_details, registrations
from lectern.operators.keyed import first_logins, repair_new_flag
from lectern.operators.neighbours import with_neighbours
from lectern.operators.sessions import play_sessions
from lectern.operators.skew import HOT_ROWS
from lectern.session import stored
from lectern.sources.schemas import PAID

# Which page an event of each type stands for.
PAGE_OF_EVENT = {
    "view": "home", "click": "course_list", "signup": "course_detail", "purchase": "order", "error": "search",
}
VISIT_GAP_HOURS = 4
BOUNCE_SECONDS = 3 * 3600
PLAY_GAP_SECONDS = 6 * 3600
HOUR = "1 hour"
TIE = ["log_id"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _text(c: Column) -> Column:
    return c.cast("string")


def key_number(props: str = "props") -> Column:
    """The number ``k`` in an event's properties."""
    return F.get_json_object(props, "$.k").cast("int")


def event_rows(events: DataFrame, *others: str) -> DataFrame:
    """Events with the device columns of the log; also used on streams."""
    user = F.col("user_id")
    page = F.create_map(*[F.lit(x) for pair in PAGE_OF_EVENT.items() for x in pair])[F.col("event_type")]
    return events.select(
        F.col("event_id").alias("log_id"), _text(user).alias("mid"),
        F.when(F.col("event_type") != "error", _text(user)).alias("uid"), _text(user).alias("sid"), "ts",
        page.alias("page_id"), F.floor(F.col("value") * 1000).cast("bigint").alias("during_time"),
        F.when(F.col("event_id") % 3 != 0, "1").otherwise("0").alias("is_new"),
        _text(F.col("event_id") % 2).alias("vc"), _text(user % 5).alias("sc"), _text(user % 25).alias("ar"),
        F.concat(F.lit("ch"), user % 3).alias("ch"), F.concat(F.lit("ba"), user % 4).alias("ba"),
        F.concat(F.lit("md"), user % 6).alias("md"), F.concat(F.lit("os"), user % 2).alias("os"), *others,
    )


def raw_page_log(spark: SparkSession, sf: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Page log with ``last_page_id``: the device's previous page if it is at most four hours old."""
    rows = event_rows(table(spark, sf, "events"))
    linked = with_neighbours(rows, ["mid"], "ts", TIE, before={"_ts": "ts", "_page": "page_id"},
                             hot_rows=hot_rows, slice_seconds=VISIT_GAP_HOURS * 3600)
    near = micros("ts") - micros("_ts") <= VISIT_GAP_HOURS * 3_600_000_000
    return linked.withColumn("last_page_id", F.when(near, F.col("_page"))).drop("_ts", "_page")


def page_log(spark: SparkSession, sf: str) -> DataFrame:
    """Page log after the repair of the new-visitor flag, stored as a layer for its readers."""
    return stored(repair_new_flag(stored(raw_page_log(spark, sf), "raw_page_log")), "page_log")


def plays(spark: SparkSession, sf: str, read=table) -> DataFrame:
    events = read(spark, sf, "events").filter(F.col("event_type") == "view")
    number = key_number()
    return events.select(
        F.col("event_id").alias("log_id"), _text(F.col("user_id")).alias("uid"),
        _text(F.col("user_id")).alias("sid"), _text(F.col("user_id") % 5).alias("sc"),
        _text(number).alias("video_id"), F.floor("value").cast("int").alias("play_sec"),
        number.alias("position_sec"), "ts",
    )


def raw_log_lines(spark: SparkSession, sf: str, *others: str) -> DataFrame:
    """The behaviour log as JSON text; every tenth key number gives a broken line."""
    rows = event_rows(table(spark, sf, "events"), "event_type", "value", "props")
    kind, number = F.col("event_type"), key_number()
    common = F.struct("mid", "uid", "sid", "is_new", "ar", "ba", "ch", "md", "os", "sc", "vc")
    page = F.struct("page_id", "during_time")
    item = F.struct(F.col("page_id").alias("item"), number.alias("pos_id"))
    line = F.to_json(F.struct(
        common.alias("common"),
        F.when(kind.isin("click", "purchase", "error"), page).alias("page"),
        F.when(kind == "signup", F.struct(F.lit("icon").alias("entry"))).alias("start"),
        F.when(kind == "view", F.struct(
            _text(number).alias("video_id"), F.floor("value").cast("int").alias("play_sec"),
            number.alias("position_sec"))).alias("appVideo"),
        F.when(kind == "click", F.array(item, item)).alias("displays"),
        F.when(kind == "click", F.array(item)).alias("actions"),
        F.when(kind == "error", F.struct(number.alias("error_code"))).alias("err"),
        to_millis("ts").alias("ts"),
    ))
    cut = F.expr("substring(line, 2)")
    return rows.withColumn("line", line).select(
        F.when(number % 10 == 0, cut).otherwise(F.col("line")).alias("value"), *others)


def search_log(spark: SparkSession, sf: str, read=table) -> DataFrame:
    """Whole document texts as searched keywords, one per minute."""
    at = F.timestamp_add("MINUTE", F.col("doc_id"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"))
    return read(spark, sf, "documents").select(
        F.col("text").alias("item"), F.lit("keyword").alias("item_type"), at.alias("ts")
    )


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Order heads; the province is the buyer's nation."""
    head = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    who = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    # Two stored tables, one row per customer: Spark broadcasts by size, or shuffles and splits a
    # skewed part by what it measures at run time.
    return head.join(who, "o_custkey").select(
        _text(F.col("o_orderkey")).alias("id"), _text(F.col("o_custkey")).alias("user_id"),
        _text(F.col("o_custkey")).alias("session_id"), _text(F.col("c_nationkey")).alias("province_id"),
        F.concat(F.lit("trade-"), "o_orderkey").alias("out_trade_no"), F.col("o_orderpriority").alias("trade_body"),
        money("o_totalprice").alias("final_amount"), F.col("o_orderdate").alias("ts"),
    )


def details(spark: SparkSession, sf: str, read=table) -> DataFrame:
    """Order details as versions: the same order line comes more than once."""
    price = F.col("l_extendedprice").cast("decimal(16,2)")
    off = F.col("l_discount").cast("decimal(4,2)")
    final = money(price * (F.lit(1).cast("decimal(1,0)") - off))
    return read(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), _text(F.col("l_suppkey")).alias("course_id"),
        F.concat(F.lit("course "), "l_suppkey").alias("course_name"), _text(F.col("l_orderkey")).alias("order_id"),
        price.alias("origin_amount"), (price - final).cast("decimal(16,2)").alias("coupon_reduce"),
        final.alias("final_amount"), datetime_text("l_shipdate").alias("create_time"),
        F.col("l_shipdate").alias("row_op_ts"),
    )


def order_facts(spark: SparkSession, sf: str) -> DataFrame:
    return order_details(details(spark, sf), orders(spark, sf), event_rows(table(spark, sf, "events")))


def payments(spark: SparkSession, sf: str, read=table) -> DataFrame:
    """Payments: orders of status F are paid, some of them late."""
    o = read(spark, sf, "orders")
    paid_at = F.timestamp_add("SECOND", F.col("o_orderkey") % 1200, F.col("o_orderdate"))
    return o.select(
        F.concat(F.lit("pay-"), "o_orderkey").alias("id"), _text(F.col("o_orderkey")).alias("order_id"),
        F.concat(F.lit("ali-"), "o_orderkey").alias("alipay_trade_no"),
        F.col("o_orderpriority").alias("payment_type"),
        F.when(F.col("o_orderstatus") == "F", PAID).otherwise("1601").alias("payment_status"),
        F.lit(None).cast("string").alias("callback_content"), datetime_text(paid_at).alias("callback_time"),
        paid_at.alias("ts"),
    )


def paid_facts(spark: SparkSession, sf: str, facts: DataFrame | None = None) -> DataFrame:
    """Paid order details, from stored order facts if given."""
    good = payments(spark, sf).filter(F.col("payment_status") == PAID)
    return paid_details(order_facts(spark, sf) if facts is None else facts, good)


def users(spark: SparkSession, sf: str) -> DataFrame:
    """Registrations: signups, more than one version per user."""
    return table(spark, sf, "events").filter(F.col("event_type") == "signup").select(
        _text(F.col("user_id")).alias("id"), F.col("ts").alias("create_time"), "ts"
    )


def registered(spark: SparkSession, sf: str) -> DataFrame:
    facts = registrations(users(spark, sf), event_rows(table(spark, sf, "events")))
    return facts.withColumn("row_op_ts", F.col("ts"))


def logins(spark: SparkSession, sf: str) -> DataFrame:
    """The first-login facts: of a device and day the first logged-in row."""
    first = first_logins(event_rows(table(spark, sf, "events")), TIE)
    return first.select(F.col("uid").alias("user_id"), "ts")


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The play sessions, which the play windows count."""
    return play_sessions(plays(spark, sf), PLAY_GAP_SECONDS, tie=TIE)


def cart(spark: SparkSession, sf: str, read=table) -> DataFrame:
    return read(spark, sf, "events").filter(F.col("event_type") == "purchase").select(
        _text(F.col("user_id")).alias("user_id"), "ts")


def exams(spark: SparkSession, sf: str, read=table) -> DataFrame:
    return read(spark, sf, "lineitem").select(
        _text(F.col("l_partkey")).alias("paper_id"), (F.col("l_quantity") * 2).alias("score"),
        (F.col("l_linenumber") * 60).alias("duration_sec"), F.col("l_shipdate").alias("ts"))


def answers(spark: SparkSession, sf: str, read=table) -> DataFrame:
    return read(spark, sf, "events").select(
        _text(key_number()).alias("question_id"),
        F.when(F.col("value") > 50, "1").otherwise("0").alias("is_correct"), "ts")


def reviews(spark: SparkSession, sf: str, read=table) -> DataFrame:
    return read(spark, sf, "lineitem").select(
        _text(F.col("l_suppkey")).alias("course_id"),
        (F.col("l_quantity").cast("int") % 5 + 1).alias("review_stars"), F.col("l_shipdate").alias("ts"))


# Dimensions, all strings, unique on id.

def _dim(spark: SparkSession, sf: str, stored: str, /, **columns: str) -> DataFrame:
    return table(spark, sf, stored).select(*[_text(F.col(c)).alias(n) for n, c in columns.items()])


def sources(spark, sf):
    return _dim(spark, sf, "region", id="r_regionkey", source_site="r_name")


def provinces(spark, sf):
    return _dim(spark, sf, "nation", id="n_nationkey", name="n_name")


def courses(spark, sf):
    return _dim(spark, sf, "supplier", id="s_suppkey", course_name="s_name", subject_id="s_nationkey")


def subjects(spark, sf):
    return _dim(spark, sf, "nation", id="n_nationkey", subject_name="n_name", category_id="n_regionkey")


def categories(spark, sf):
    return _dim(spark, sf, "region", id="r_regionkey", category_name="r_name")


def papers(spark, sf):
    return _dim(spark, sf, "part", id="p_partkey", paper_title="p_name", course_id="p_size")


def questions(spark, sf):
    return _dim(spark, sf, "part", id="p_partkey", question_txt="p_name")


def videos(spark, sf):
    return _dim(spark, sf, "part", id="p_partkey", chapter_id="p_size")


def chapters(spark, sf):
    return _dim(spark, sf, "supplier", id="s_suppkey", chapter_name="s_name")


# Database change rows.

def _envelope(df: DataFrame, table_name: str, change: Column, ts: Column, /, **data: str | Column) -> DataFrame:
    cells = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in data.items()]
    return df.select(F.to_json(F.struct(
        F.lit("edu").alias("database"), F.lit(table_name).alias("table"), change.alias("type"),
        F.struct(*cells).alias("data"), ts.cast("string").alias("ts"),
    )).alias("value"))


def _seconds(ts: str) -> Column:
    return F.floor(to_millis(ts) / 1000).cast("bigint")


def change_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Orders, payments, users, events and dimension tables as change rows in JSON text."""
    o, e = table(spark, sf, "orders"), table(spark, sf, "events")
    order_change = F.when(F.col("o_orderkey") % 5 == 0, "update").otherwise("insert")
    parts = [
        _envelope(o, "order_info", order_change, _seconds("o_orderdate"), id="o_orderkey", user_id="o_custkey",
                  session_id="o_custkey", final_amount="o_totalprice", trade_body="o_orderpriority"),
        _envelope(o, "payment_info", F.lit("update"), _seconds("o_orderdate"), id="o_orderkey",
                  order_id="o_orderkey",
                  payment_status=F.when(F.col("o_orderstatus") == "F", PAID).otherwise("1601")),
        _envelope(e.filter(F.col("event_type") == "purchase"), "cart_info", F.lit("insert"), _seconds("ts"),
                  id="event_id", user_id="user_id", value="value"),
        _envelope(table(spark, sf, "customer"), "user_info", F.lit("bootstrap-insert"), F.lit(0), id="c_custkey",
                  name="c_name", nation="c_nationkey"),
        _envelope(table(spark, sf, "nation"), "base_province", F.lit("bootstrap-insert"), F.lit(0),
                  id="n_nationkey", name="n_name", region_id="n_regionkey"),
        _envelope(table(spark, sf, "region"), "base_source", F.lit("bootstrap-start"), F.lit(0),
                  id="r_regionkey", source_site="r_name"),
        _envelope(table(spark, sf, "supplier"), "course_info",
                  F.when(F.col("s_suppkey") % 4 == 0, "delete").otherwise("update"), F.lit(1), id="s_suppkey",
                  course_name="s_name", subject_id="s_nationkey", price="s_acctbal"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Routing rows as change rows (op, before, after, order); the last change of a key
# holds. One table is listed, deleted and listed again, one is deleted for good.
DIM_CONFIG_CHANGES = [
    ("r", None, ("base_source", "dim_base_source", "id,source_site", "id", None), 1),
    ("r", None, ("base_province", "dim_base_province", "id,region_id", None, None), 2),
    ("c", None, ("course_info", "dim_course_info", "id,course_name", "id", None), 3),
    ("u", None, ("base_province", "dim_base_province", "id,name", None, None), 4),
    ("d", ("course_info", "dim_course_info", "id,course_name", "id", None), None, 5),
    ("c", None, ("course_info", "dim_course_info", "id,course_name,subject_id", "id", None), 6),
    ("c", None, ("user_info", "dim_user_info", "id,name", "id", None), 7),
    ("d", ("user_info", "dim_user_info", "id,name", "id", None), None, 8),
]
FACT_CONFIG_CHANGES = [
    ("r", None, ("cart_info", "insert", "dwd_trade_cart_add", "user_id"), 1),
    ("r", None, ("order_info", "insert", "dwd_trade_order_head", "id,user_id"), 2),
    ("r", None, ("order_info", "update", "dwd_trade_order_change", "id,final_amount"), 3),
]
DIM_CONFIG_TYPE = "source_table string, sink_table string, sink_columns string, sink_pk string, sink_extend string"
FACT_CONFIG_TYPE = "source_table string, source_type string, sink_table string, sink_columns string"


def config_changes(spark: SparkSession, changes: list[tuple], row_type: str) -> DataFrame:
    return spark.createDataFrame(
        changes, f"op string, before struct<{_struct(row_type)}>, after struct<{_struct(row_type)}>, ts_ms bigint")


def _struct(columns: str) -> str:
    return ", ".join(c.strip().replace(" ", ":") for c in columns.split(","))


# Routes at the start, and changes of them (op, table, type, target, columns) with the hundredth of the
# events' time at which each happens. Of the two at one instant the delete is the later.
LIVE_ROUTES = [
    ("cart_info", "insert", "dwd_trade_cart_add", "id,user_id"),
    ("favor_info", "insert", "dwd_interaction_favor_add", "id,user_id,number"),
    ("user_info", "insert", "dwd_user_register", "id,user_id"),
]
LIVE_CHANGES = [
    ("c", "favor_info", "update", "dwd_interaction_favor_change", "id,number", 20),
    ("u", "cart_info", "insert", "dwd_trade_cart_add", "id,number", 35),
    ("d", "user_info", "insert", "dwd_user_register", "id,user_id", 50),
    ("u", "cart_info", "insert", "dwd_trade_cart", "id,user_id,number", 60),
    ("d", "favor_info", "insert", "dwd_interaction_favor_add", "id,user_id,number", 70),
    ("u", "favor_info", "insert", "dwd_interaction_favor_all", "id", 70),
    ("c", "user_info", "insert", "dwd_user_register_again", "id", 80),
]
LIVE_KEYS = {"table": "source_table", "type": "source_type"}
TABLE_OF_EVENT = {
    "view": "review_info", "click": "favor_info", "signup": "user_info", "purchase": "cart_info", "error": "comment_info",
}


def live_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as change rows (``table, type, data, ts, log_id``) and, among them by time, the changes of their routes
    (``op, before, after, ts``)."""
    events = table(spark, sf, "events")
    name = F.create_map(*[F.lit(x) for pair in TABLE_OF_EVENT.items() for x in pair])[F.col("event_type")]
    rows = events.select(
        name.alias("table"), F.when(F.col("event_id") % 5 == 0, "update").otherwise("insert").alias("type"),
        F.create_map(F.lit("id"), _text(F.col("event_id")), F.lit("user_id"), _text(F.col("user_id")),
                     F.lit("number"), _text(key_number())).alias("data"),
        "ts", F.col("event_id").alias("log_id"))
    low, high = events.agg(F.min(micros("ts")), F.max(micros("ts"))).first()
    kind = f"struct<{_struct(FACT_CONFIG_TYPE)}>"
    low, high = low or 0, high or 0
    changes = [(op, route if op == "d" else None, None if op == "d" else route, low + (high - low) * part // 100)
               for op, *route, part in LIVE_CHANGES]
    config = spark.createDataFrame(changes, f"op string, before {kind}, after {kind}, at bigint")
    return rows.unionByName(config.withColumn("ts", from_micros("at")).drop("at"), allowMissingColumns=True)


def live_routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LIVE_ROUTES, FACT_CONFIG_TYPE)
