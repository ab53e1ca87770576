"""Streaming forms of registered queries: the same tables read as streams, run to their end.

A table is first written to the shared scratch folder in slices of time, each of which is one
micro-batch of several files, so state goes over batches. Queries marked "late" move every seventeenth
row to the next slice. Each query writes closed results to a layer in the scratch folder and returns that layer.
Windows and timers that the watermark has not reached stay open, as they would in a running job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.measures import money
from lectern.functions.timefn import date_text, from_micros, micros
from lectern.operators import split
from lectern.plans import model as m
from lectern.plans import windows as w
from lectern.plans.registry import live_columns
from lectern.plans.registry import query as registered
from lectern.session import drop_files, scratch_dir, stored
from lectern.sinks.layers import read_window_table
from lectern.sources.messages import table_stream
from lectern.sources.schemas import DEVICE_FIELDS, PAID
from lectern.streaming import jobs, windows
from lectern.streaming import operators as s
from lectern.streaming.changelog import folded, latest_outer_join, takes_back, upsert_messages, upserted
from lectern.streaming.live_routing import route_live
from lectern.streaming.run import layer_stream, scratch_layer, to_layer, to_window_table
from lectern.streaming.state import kept_and_dropped, state_rows


#: Slices of time, rows that come a slice late, and files of a slice, which are one micro-batch.
PARTS, LATE_EVERY, FILES = 3, 17, 4
TIMES = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate", "documents": "doc_id"}
_written: dict[tuple, str] = {}
#: Rows of a table that share a bucket of keyed state, and the buckets that a core has at least.
ROWS_PER_BUCKET, BUCKETS_PER_CORE = 100_000, 8


@contextmanager
def buckets_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """Queries begun meanwhile deal their keys out to as many buckets as that many rows fill, but some for each core."""
    before = spark.conf.get(s.STATE_BUCKETS, None)
    spark.conf.set(s.STATE_BUCKETS, str(max(-(-rows // ROWS_PER_BUCKET), BUCKETS_PER_CORE * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(s.STATE_BUCKETS)
        else:
            spark.conf.set(s.STATE_BUCKETS, before)


def query(name: str, table: str = "events") -> Callable:
    """Register a query whose keyed state is sized by the rows of that table, the largest that it reads."""
    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        @registered(name)
        def _(spark, sf):
            with buckets_for(spark, m.table(spark, sf, table).count()):
                return build(spark, sf)
        return build
    return register


def in_parts(rows: DataFrame, parts: int) -> DataFrame:
    """Stored rows in that many parts. What is read in as many or more is put together without a shuffle; what is read in
    fewer is small."""
    return rows.coalesce(parts) if rows.rdd.getNumPartitions() >= parts else rows.repartition(parts)


def in_files(df: DataFrame, at: Column, late_id: str | None = None) -> str:
    """A new folder with the rows in ``PARTS`` slices of time, in that order. With ``late_id`` rows whose number
    divides by seventeen come a slice later, the last of them in a slice of their own.

    The rows are those of a stored table, which is read once per slice and not copied before. Each slice is ``FILES`` files, written
    by as many tasks; file sources read in the order of writing, so a micro-batch of that many files is a slice.
    """
    at, spark = at.cast("bigint"), df.sparkSession
    bounds = df.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    path = scratch_dir(spark, "files")
    if bounds["low"] is None:
        df.write.parquet(path)
        return path
    part = F.least(F.lit(PARTS - 1), F.floor((at - bounds["low"]) * PARTS / (bounds["high"] - bounds["low"] + 1)))
    if late_id:
        part = part + F.when(F.col(late_id) % LATE_EVERY == 0, 1).otherwise(0)
    part = F.coalesce(part, F.lit(0))
    for i in range(PARTS + bool(late_id)):
        in_parts(df.where(part == i), FILES).write.mode("append").parquet(path)
        for _ in range(len(spark.read.schema(df.schema).parquet(path).inputFiles()), FILES * (i + 1)):  # a slice of fewer rows
            spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(path)
    return path


def file_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return table_stream(spark, path, like.schema, files_per_batch=FILES)


def files_of(table: DataFrame) -> tuple:
    """What tells a table's files from those of another time: when the last was written, and their rows."""
    return tuple(table.select("_metadata.file_modification_time").agg(F.max("file_modification_time"), F.count("*")).first())


def stream(spark: SparkSession, sf: str, name: str, late_id: str | None = None) -> DataFrame:
    """A table in slices, written once per session and state of the table's files."""
    table = m.table(spark, sf, name)
    key = (spark.sparkContext.applicationId, sf, name, late_id, *files_of(table))
    if key not in _written:
        at = F.col(TIMES[name])
        _written[key] = in_files(table, at if name == "documents" else micros(at), late_id)
    return file_stream(spark, _written[key], table)


def event_stream(spark: SparkSession, sf: str, late: bool = False) -> DataFrame:
    return m.event_rows(stream(spark, sf, "events", "event_id" if late else None))


def users_of(spark: SparkSession, sf: str, event: str) -> DataFrame:
    events = stream(spark, sf, "events").filter(F.col("event_type") == event)
    return events.select(F.col("user_id").cast("string").alias("user_id"), "ts")


def page_log_files(spark: SparkSession, sf: str, late: bool = False) -> tuple[str, DataFrame]:
    """The page log written in files by time for the streams that read it."""
    log = stored(m.raw_page_log(spark, sf), "page_log")
    return in_files(log, micros("ts"), "log_id" if late else None), log


@query("stream_t1_new_visitor_repair")
def _(spark, sf):
    """Late."""
    return scratch_layer(s.repair_new_flag(event_stream(spark, sf, late=True)).select("log_id", "mid", "is_new"), "t1")


@query("stream_t2_daily_unique_visitor")
def _(spark, sf):
    """Late."""
    path, log = page_log_files(spark, sf, late=True)
    entries = split.entry_pages(file_stream(spark, path, log))
    return scratch_layer(s.daily_first(entries, ["mid"], late=None, forget=False).select("mid", "log_id", "page_id", "ts"), "t2")


@query("stream_t3_unique_visitor_per_page")
def _(spark, sf):
    """Late."""
    views = split.view_pages(event_stream(spark, sf, late=True))
    return scratch_layer(s.daily_first(views, ["mid", "page_id"], late=None, forget=False).select("mid", "page_id", "log_id"), "t3")


@query("stream_t4_bounces")
def _(spark, sf):
    path, log = page_log_files(spark, sf)
    found = s.bounces(file_stream(spark, path, log), m.BOUNCE_SECONDS)
    return scratch_layer(found.select("mid", "log_id", "page_id", "ts"), "t4")


@query("stream_t5_first_logins")
def _(spark, sf):
    """Late."""
    return scratch_layer(s.first_logins(event_stream(spark, sf, late=True)).select("mid", "uid", "log_id", "ts"), "t5")


@query("stream_p15_log_split")
def _(spark, sf):
    """Late. Rows of each layer and of the dirty lines, and of the flags that stay "new"; no line is lost."""
    lines = m.raw_log_lines(spark, sf, "log_id", "ts")
    path = in_files(stored(lines, "lines"), micros("ts"), "log_id")
    root = scratch_dir(spark, "split")
    jobs.run_log_split(file_stream(spark, path, lines).select("value"), root)
    layers = []
    for kind, name in {**jobs.LOG_LAYERS, "dirty": jobs.DIRTY_LAYER}.items():
        rows = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}/batch_id=*")
        new = (F.col("common.is_new") == "1").cast("bigint") if "common" in rows.columns else F.lit(0).cast("bigint")
        layers.append(rows.agg(F.count("*").alias("line_count"), F.coalesce(F.sum(new), F.lit(0)).alias("new_count")).withColumn("layer", F.lit(kind)))
    return reduce(DataFrame.unionByName, layers)


SETTLE_SECONDS = 3600


@query("stream_j5_live_routing")
def _(spark, sf):
    """Late. Routes come, change and go while the facts stream; the state begins with the routes in force."""
    rows = stored(m.live_changes(spark, sf), "live")
    path = in_files(rows, micros("ts"), "log_id")
    changes = file_stream(spark, path, rows).filter(F.col("table").isNotNull()).select("table", "type", "data", "ts")
    config = file_stream(spark, path, rows).filter(F.col("op").isNotNull()).select("op", "before", "after", "ts")
    routed = route_live(changes, config, m.live_routes(spark), m.LIVE_KEYS, settle_seconds=SETTLE_SECONDS)
    return live_columns(scratch_layer(routed, "j5"))


def order_source_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the source of their session's last order page so far, as a changelog. Late."""
    heads = stream(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("session_id"),
        money("o_totalprice").alias("final_amount"), F.col("o_orderdate").alias("ts"))
    pages = split.order_pages(event_stream(spark, sf, late=True)).select(F.col("sid").alias("session_id"), F.col("sc").alias("source_id"), "ts")
    return scratch_layer(latest_outer_join(heads, pages, {"session_id": "session_id"}), "j2")


@query("stream_j2_order_sources", "orders")
def _(spark, sf):
    """The changelog folded: what the left join of the whole tables gives."""
    return folded(order_source_changes(spark, sf)).na.fill("-", ["source_id"])


@query("stream_k3_upsert_messages", "orders")
def _(spark, sf):
    """Messages per kind, how many have a value, and how many orders they leave in force."""
    changes = order_source_changes(spark, sf)
    messages = upsert_messages(changes, ["id"])
    kept = upserted(messages).agg(F.count("*").alias("order_count"))
    per = changes.select("kind", F.when(F.col("kind").startswith("+"), 1).alias("value")).groupBy("kind").agg(
        F.count("*").alias("message_count"), F.count("value").alias("value_count"))
    return per.unionByName(kept.select(F.lit("in force").alias("kind"), F.col("order_count").alias("message_count"), F.col("order_count").alias("value_count")))


def registered_changes(spark: SparkSession, sf: str) -> DataFrame:
    """New users at once, taken back and sent again as later log rows name another device; folded. Late."""
    events = m.event_rows(stream(spark, sf, "events", "event_id"), "event_type")
    new = events.filter(F.col("event_type") == "signup").select(F.col("mid").alias("user_id"), date_text("ts").alias("register_date"), "ts")
    columns = [F.col(c).alias(n) for n, c in DEVICE_FIELDS.items()]
    seen = event_stream(spark, sf, late=True).filter(F.col("uid").isNotNull()).select(*columns, "ts")
    return folded(scratch_layer(latest_outer_join(new, seen, {"user_id": "user_id"}), "j4"))


@query("stream_j4_registrations")
def _(spark, sf):
    """Late."""
    return registered_changes(spark, sf).na.fill("-")


@query("stream_t15_kept_days")
def _(spark, sf):
    """Late. Each buyer's last day, and whether the state still holds it when the stream has ended."""
    root = scratch_dir(spark, "t15")
    bought = event_stream(spark, sf, late=True).filter(F.col("page_id") == "order")
    first = to_layer(s.daily_first(bought, ["mid"], late=None).select("mid", "ts"), root + "/data", root + "/checkpoint")
    seen = first.groupBy("mid").agg(date_text(F.max("ts")).alias("last_day"))
    held = state_rows(spark, root + "/checkpoint", "last_day", ["mid"])
    return kept_and_dropped(seen, held.select("mid", F.date_from_unix_date(F.col("day").cast("int")).cast("string").alias("last_day")), ["mid", "last_day"])


def login_layer(spark: SparkSession, sf: str) -> DataFrame:
    """First logins, written by a query of their own, as the next query's stream."""
    root = scratch_dir(spark, "logins")
    first = to_layer(s.first_logins(event_stream(spark, sf)), root + "/data", root + "/checkpoint")
    return layer_stream(spark, root + "/data", first).select(F.col("uid").alias("user_id"), "ts")


@query("stream_t7_login_returns")
def _(spark, sf):
    return scratch_layer(s.login_days(login_layer(spark, sf)).drop("event_ts"), "t7")


@query("stream_t9_buyer_days")
def _(spark, sf):
    return scratch_layer(s.buyer_days(users_of(spark, sf, "purchase")).drop("event_ts"), "t9")


@query("stream_w5_keyed_tumbling_window")
def _(spark, sf):
    """Late: rows behind the watermark are lost to their window."""
    rows = s.with_event_time(event_stream(spark, sf, late=True).select("page_id", "during_time", "ts"))
    measures = [F.count(F.lit(1)).alias("views"), F.sum("during_time").alias("during_time")]
    return scratch_layer(s.tumbling(rows, ["page_id"], measures, "10 minutes"), "w5")


@query("stream_a0_play_sessions")
def _(spark, sf):
    events = stream(spark, sf, "events").filter(F.col("event_type") == "view")
    plays = events.select(
        F.col("user_id").cast("string").alias("sid"), F.floor("value").cast("int").alias("play_sec"),
        m.key_number().alias("position_sec"), m.key_number().cast("string").alias("video_id"), "ts")
    return scratch_layer(s.play_sessions(plays, m.PLAY_GAP_SECONDS), "a0")


def session_layer(spark: SparkSession, sf: str) -> DataFrame:
    """Closed play sessions, written by a query of their own, as the next query's stream."""
    root = scratch_dir(spark, "sessions")
    found = to_layer(s.play_sessions(m.plays(spark, sf, stream), m.PLAY_GAP_SECONDS), root + "/data", root + "/checkpoint")
    return layer_stream(spark, root + "/data", found)


# The order path: heads with their source (a changelog), details with their head (another), the versions of a detail
# compacted by event time, then the windows. Each arrow is a layer.
HOLD_DAYS, REGISTER_HOLD_DAYS = 30, 1
_layers: dict[tuple, str] = {}


def shared_layer(spark: SparkSession, sf: str, name: str, tables: list[str], build) -> tuple[str, DataFrame]:
    """A layer that several registered queries read, written once per session and state of the tables' files."""
    key = (spark.sparkContext.applicationId, sf, name, *[x for t in tables for x in files_of(m.table(spark, sf, t))])
    if key not in _layers:
        root = scratch_dir(spark, name)
        rows = build()
        if rows.isStreaming:
            to_layer(rows, root + "/data", root + "/checkpoint")
            drop_files(spark, root + "/checkpoint/state")
        else:
            rows.write.parquet(root + "/data")
        _layers[key] = root + "/data"
    return _layers[key], spark.read.parquet(_layers[key])


ORDER_TABLES = ["orders", "lineitem", "events", "customer"]


def streamed_facts(spark: SparkSession, sf: str) -> DataFrame:
    """All versions of the order details with their order and its source, as two streaming joins leave them."""
    def changes() -> DataFrame:
        path, heads = shared_layer(spark, sf, "heads", ORDER_TABLES, lambda: order_source_changes(spark, sf))
        sent = layer_stream(spark, path, heads).filter(F.col("kind").startswith("+")).select(
            F.col("id").alias("order_id"), F.col("session_id").alias("user_id"), "source_id", "ts",
            from_micros("seq").alias("turn"))
        lines = m.details(spark, sf, stream).select("id", "course_id", "order_id", "final_amount", "row_op_ts")
        return latest_outer_join(lines, sent, {"order_id": "order_id"}, "turn", salts=1)  # an order has few lines

    changelog = shared_layer(spark, sf, "changes", ORDER_TABLES, changes)[1]
    found = F.col("ts").isNotNull()
    if not takes_back(changelog):  # no second copy of the layer
        return changelog.drop("kind", "seq").filter(found)
    return shared_layer(spark, sf, "facts", ORDER_TABLES, lambda: folded(changelog).filter(found))[1]


def compacted(spark: SparkSession, sf: str, name: str, versions, key: str, version: str, late_id: Column, days: int) -> DataFrame:
    """The latest versions, a stored table, as the stream of a layer. The versions arrive in slices, some of them late."""
    def build() -> DataFrame:
        rows = versions().withColumn("log_id", late_id.cast("bigint"))
        path = in_files(rows, micros(version), "log_id")
        return s.latest_by_clock(file_stream(spark, path, rows).drop("log_id"), key, version, days * 86400)

    path, rows = shared_layer(spark, sf, name, ORDER_TABLES, build)
    return layer_stream(spark, path, rows)


def compacted_orders(spark: SparkSession, sf: str) -> DataFrame:
    return compacted(spark, sf, "orders", lambda: streamed_facts(spark, sf), "id", "row_op_ts", F.col("order_id"), HOLD_DAYS)


def compacted_payments(spark: SparkSession, sf: str) -> DataFrame:
    def paid() -> DataFrame:
        facts = streamed_facts(spark, sf)
        lines = file_stream(spark, in_files(facts, micros("ts")), facts)
        good = m.payments(spark, sf, stream).filter(F.col("payment_status") == PAID)
        found = s.paid_details(lines, good, salts=1)  # an order has few lines
        return scratch_layer(found.select("id", "course_id", "order_id", "final_amount", "row_op_ts", "user_id", "ts"), "paid")

    return compacted(spark, sf, "payments", paid, "id", "row_op_ts", F.col("order_id"), HOLD_DAYS)


def compacted_registrations(spark: SparkSession, sf: str) -> DataFrame:
    def registered_users() -> DataFrame:
        return stored(registered_changes(spark, sf).select("user_id", "ts", F.col("ts").alias("row_op_ts")), "registered")

    return compacted(spark, sf, "registrations", registered_users, "user_id", "row_op_ts", F.col("user_id"), REGISTER_HOLD_DAYS)


def _sums(name: str, build, table: str = "events") -> None:
    """Register the closed sums of a window table."""
    @query(name, table)
    def _(spark, sf):
        return scratch_layer(build(spark, sf), name)


def order_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a stream; the buyer's nation comes from a stream-static join."""
    who = m.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    joined = stream(spark, sf, "orders").join(who, F.col("o_custkey") == who["c_custkey"])
    return joined.select(F.col("c_nationkey").cast("string").alias("province_id"),
                         F.col("o_custkey").cast("string").alias("user_id"),
                         money("o_totalprice").alias("final_amount"), F.col("o_orderdate").alias("ts"))


_sums("stream_a5_user_register_window", lambda spark, sf: windows.user_registrations(compacted_registrations(spark, sf), m.HOUR))
_sums("stream_a8_order_buyer_window", lambda spark, sf: windows.order_buyers(compacted_orders(spark, sf)), "lineitem")
_sums("stream_a9_payer_window", lambda spark, sf: windows.payers(compacted_payments(spark, sf)), "lineitem")
_sums("stream_a11_source_order_window", lambda spark, sf: windows.source_orders(compacted_orders(spark, sf)), "lineitem")
_sums("stream_a12_course_order_window", lambda spark, sf: windows.course_orders(compacted_orders(spark, sf)), "lineitem")
_sums("stream_a2_keyword_window", lambda spark, sf: windows.keywords(m.search_log(spark, sf, stream), m.HOUR), "documents")
_sums("stream_a3_page_view_window", lambda spark, sf: windows.page_views(event_stream(spark, sf), m.HOUR))
_sums("stream_a4_user_login_window", lambda spark, sf: windows.user_logins(login_layer(spark, sf), m.HOUR))
_sums("stream_a6_video_play_window", lambda spark, sf: windows.chapter_plays(session_layer(spark, sf), m.HOUR))
_sums("stream_a7_cart_add_window", lambda spark, sf: windows.cart_adds(m.cart(spark, sf, stream), m.HOUR))
_sums("stream_a10_province_order_window", lambda spark, sf: windows.province_orders(order_stream(spark, sf)), "orders")
_sums("stream_a13_paper_exam_window", lambda spark, sf: windows.paper_exams(m.exams(spark, sf, stream)), "lineitem")
_sums("stream_a15_question_answer_window", lambda spark, sf: windows.question_answers(m.answers(spark, sf, stream), m.HOUR))


@query("stream_a14_paper_score_window", "lineitem")
def _(spark, sf):
    """The whole way to a stored, named window table, and back from it."""
    root = scratch_dir(spark, "a14")
    name = "dws_examination_paper_score_duration_exam_window"
    to_window_table(windows.paper_scores(m.exams(spark, sf, stream)), root, name,
                    lambda sums: w.score_names(sums, m.papers(spark, sf)))
    return read_window_table(spark, root, name).drop("ts", "month").na.fill("-")


@query("stream_a16_course_review_window", "lineitem")
def _(spark, sf):
    root = scratch_dir(spark, "a16")
    name = "dws_interaction_course_review_window"
    to_window_table(windows.course_reviews(m.reviews(spark, sf, stream)), root, name,
                    lambda sums: w.review_names(sums, m.courses(spark, sf)))
    return read_window_table(spark, root, name).drop("ts", "month").na.fill("-")


@query("stream_a1_traffic_window")
def _(spark, sf):
    """Four queries: the repaired page log, visitors and bounces become layers, then one query unites them."""
    path, log = page_log_files(spark, sf)
    root = scratch_dir(spark, "traffic")
    fixed = to_layer(s.repair_new_flag(file_stream(spark, path, log)), root + "/log", root + "/log-checkpoint")
    path = in_files(fixed, micros("ts"))
    uv = to_layer(windows.visitors(file_stream(spark, path, log)), root + "/uv", root + "/uv-checkpoint")
    jumps = to_layer(s.bounces(file_stream(spark, path, log), m.BOUNCE_SECONDS), root + "/jump", root + "/jump-checkpoint")
    sums = windows.traffic(layer_stream(spark, path, log), layer_stream(spark, root + "/uv", uv),
                           layer_stream(spark, root + "/jump", jumps), m.BOUNCE_SECONDS, m.HOUR)
    closed = to_layer(sums, root + "/window", root + "/window-checkpoint")
    return w.traffic_names(closed, m.sources(spark, sf), m.provinces(spark, sf))


@query("stream_j3_bounded_join")
def _(spark, sf):
    """Clicks joined to the same user's purchases at most two hours later."""
    events = stream(spark, sf, "events")
    clicks = events.filter(F.col("event_type") == "click").select("user_id", F.col("event_id").alias("click_id"), "ts")
    buys = stream(spark, sf, "events").filter(F.col("event_type") == "purchase").select(
        "user_id", F.col("event_id").alias("buy_id"), F.col("ts").alias("buy_ts"))
    left, right = s.with_event_time(clicks, "ts"), s.with_event_time(buys, "buy_ts")
    joined = s.bounded_join(left, right, ["user_id"], "2 hours", "0 seconds")
    return scratch_layer(joined.select("user_id", "click_id", "buy_id"), "j3")
