"""Named queries over the test tables; each takes (session, folder) and gives one DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, DoubleType, TimestampNTZType, TimestampType

from lectern.functions.measures import as_count, keyword_weight, score_band
from lectern.functions.segment import segmenter, word_costs
from lectern.functions.text import short_digest, words
from lectern.functions.timefn import (
    date_number, date_text, date_text_to_millis, datetime_text, from_millis, hour_label, is_newer_version,
    to_millis, whole_seconds,
)
from lectern.operators import joins, keyed, parse, routing, sessions, split
from lectern.operators.windows import summed, tumbling
from lectern.plans import model as m
from lectern.plans import reports as r
from lectern.plans import windows as w
from lectern.session import stored
from lectern.sources import messages, schemas
from lectern.sources.schemas import PAID

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf: present(fn(spark, sf))
        return fn
    return register


def present(df: DataFrame) -> DataFrame:
    """Plain output types: times as text, decimals as doubles, doubles to six places."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            c = datetime_text(c) if f.name in ("stt", "edt") else F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, DateType):
            c = date_text(c)
        elif isinstance(f.dataType, DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, DoubleType):
            c = F.round(c, 6)
        out.append(c.alias(f.name))
    return df.select(*out)


# --- messages, parsing, filters -----------------------------------------------------------------

PROPS = schemas.StructType([schemas.StructField("k", schemas.IntegerType())])


def _props_lines(spark, sf):
    cut = F.when(m.key_number() % 10 == 0, F.expr("substring(props, 2)")).otherwise(F.col("props"))
    return m.table(spark, sf, "events").select("event_id", cut.alias("value"))


@query("p1_good_records")
def _(spark, sf):
    good, _dirty = parse.parse_or_divert(_props_lines(spark, sf), PROPS)
    return good.groupBy("k").agg(F.count(F.lit(1)).alias("record_count"))


@query("p1_dirty_records")
def _(spark, sf):
    return parse.parse_or_divert(_props_lines(spark, sf), PROPS)[1]


@query("p2_parse_or_drop")
def _(spark, sf):
    return parse.parse_or_drop(_props_lines(spark, sf), PROPS)


def _log(spark, sf):
    return parse.parse_or_drop(m.raw_log_lines(spark, sf), schemas.TOPIC_LOG)


def _changes(spark, sf):
    return messages.change_rows(m.change_lines(spark, sf))


@query("s1_message_filter")
def _(spark, sf):
    lines = m.table(spark, sf, "events").select(
        F.when(m.key_number() % 10 == 0, "").when(m.key_number() % 10 == 1, None)
        .otherwise(F.col("props")).alias("value"))
    return parse.non_empty(lines).groupBy("value").agg(F.count(F.lit(1)).alias("message_count"))


@query("s2_json_view_sql")
def _(spark, sf):
    messages.json_view(m.raw_log_lines(spark, sf), schemas.TOPIC_LOG, "lectern_topic_log")
    return spark.sql(
        "select common.uid as user_id, page.page_id as page_id, count(*) as view_count, "
        "sum(page.during_time) as during_time from lectern_topic_log "
        "where page is not null and common.uid is not null group by 1, 2")


@query("s3_change_row_counts")
def _(spark, sf):
    return _changes(spark, sf).groupBy("database", "table", "type").agg(
        F.count(F.lit(1)).alias("row_count"), F.max(F.col("ts").cast("bigint")).alias("last_ts"))


@query("p3_dimension_changes")
def _(spark, sf):
    return parse.dimension_changes(_changes(spark, sf)).groupBy("table", "type").agg(
        F.count(F.lit(1)).alias("row_count"))


@query("p4_fact_changes")
def _(spark, sf):
    return parse.fact_changes(_changes(spark, sf)).groupBy("table", "type").agg(
        F.count(F.lit(1)).alias("row_count"))


@query("p5_tombstone_filter")
def _(spark, sf):
    rows = m.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("props")).alias("value"))
    return parse.non_empty(rows).select("event_id", "value")


@query("p6_required_ids")
def _(spark, sf):
    return parse.required(m.order_facts(spark, sf), "source_id", "order_id").select("id", "source_id", "order_id")


@query("p7_order_insert_rows")
def _(spark, sf):
    return parse.fields(parse.rows_of(_changes(spark, sf), "order_info", "insert"), "data",
                        {"id": "id", "buyer": "user_id", "trade_body": "trade_body"}, "ts")


@query("p8_payment_success")
def _(spark, sf):
    paid = parse.rows_of(_changes(spark, sf), "payment_info").filter(F.col("data")["payment_status"] == PAID)
    return parse.fields(paid, "data", {"id": "id", "order_id": "order_id"})


@query("p9_map_entry_projection")
def _(spark, sf):
    rows = parse.fields(parse.rows_of(_changes(spark, sf), "cart_info"), "data",
                        {"cart_id": "id", "buyer_id": "user_id", "missing": "no_such_key"}, "ts")
    return rows.withColumn("missing", F.coalesce("missing", F.lit("-")))


@query("p10_entry_pages")
def _(spark, sf):
    return split.entry_pages(m.raw_page_log(spark, sf)).select("log_id", "mid", "page_id")


@query("p11_logged_in_pages")
def _(spark, sf):
    return m.event_rows(m.table(spark, sf, "events")).filter(F.col("uid").isNotNull()).select("log_id", "uid")


@query("p12_view_pages")
def _(spark, sf):
    return split.view_pages(m.event_rows(m.table(spark, sf, "events"))).select("log_id", "page_id")


@query("p13_order_pages")
def _(spark, sf):
    return split.order_pages(m.event_rows(m.table(spark, sf, "events"))).select("log_id", "sid", "sc")


@query("p14_searches")
def _(spark, sf):
    return split.searches(m.search_log(spark, sf)).select(
        F.md5(F.col("full_word").cast("binary")).alias("text_md5"), "ts")


@query("p15_error_log")
def _(spark, sf):
    return split.split_log(_log(spark, sf))["error"].select(
        F.get_json_object("err", "$.error_code").cast("int").alias("error_code"))


@query("p15_start_log")
def _(spark, sf):
    rows = split.split_log(_log(spark, sf))["start"]
    return rows.select("common.mid", F.get_json_object("start", "$.entry").alias("entry"), "ts")


@query("p15_video_log")
def _(spark, sf):
    return split.split_log(_log(spark, sf))["video"].select("common.mid", "appVideo.*", "ts")


@query("p15_page_log")
def _(spark, sf):
    return split.flat_pages(split.split_log(_log(spark, sf))["page"]).select(
        "mid", "is_new", "page_id", "during_time", "ts")


def _exploded(spark, sf, kind):
    rows = split.split_log(_log(spark, sf))[kind]
    return rows.select(F.get_json_object(kind, "$.item").alias("item"),
                       F.get_json_object(kind, "$.pos_id").cast("int").alias("pos_id"),
                       F.col("common.mid").alias("mid"), F.col("page.page_id").alias("page_id"), "ts")


@query("p16_display_log")
def _(spark, sf):
    return _exploded(spark, sf, "display")


@query("p16_action_log")
def _(spark, sf):
    return _exploded(spark, sf, "action")


@query("p17_record_without_error")
def _(spark, sf):
    pages = split.split_log(_log(spark, sf))["page"]
    return pages.select(F.to_json(F.struct(F.col("page.page_id").alias("page_id"), "ts")).alias("value"))


@query("p18_flat_plays")
def _(spark, sf):
    return split.flat_plays(split.split_log(_log(spark, sf))["video"]).select(
        "sc", "ar", "uid", "os", "ch", "is_new", "md", "mid", "vc", "ba", "sid",
        "play_sec", "position_sec", "video_id", "ts")


@query("p19_login_facts")
def _(spark, sf):
    return split.login_facts(keyed.first_logins(m.event_rows(m.table(spark, sf, "events")), m.TIE))


@query("p20_column_pruning")
def _(spark, sf):
    routed = routing.route_dimensions(parse.dimension_changes(_changes(spark, sf)), _dim_config(spark))
    return routed.select("sink_table", F.array_join(F.array_sort(F.map_keys("data")), ",").alias("columns")) \
        .groupBy("sink_table", "columns").agg(F.count(F.lit(1)).alias("row_count"))


@query("p21_measure_rows")
def _(spark, sf):
    log = stored(m.raw_page_log(spark, sf), "raw_page_log")
    rows = w.traffic_rows(log, keyed.unique_visitors(log, m.TIE), keyed.bounces(log, m.TIE, m.BOUNCE_SECONDS))
    return rows.groupBy(F.to_date("ts").alias("day"), *w.TRAFFIC_KEYS).agg(*summed(*w.TRAFFIC_MEASURES))


@query("p22_score_bands")
def _(spark, sf):
    scores = m.exams(spark, sf).withColumn("score", F.col("score") + 2)
    return scores.groupBy("paper_id", score_band("score").alias("score_duration")).agg(
        F.count(F.lit(1)).alias("user_count"))


@query("p23_condition_counts")
def _(spark, sf):
    return m.raw_page_log(spark, sf).groupBy("sc").agg(
        F.sum(as_count(F.col("last_page_id").isNull())).alias("entries"),
        F.sum(as_count(F.col("last_page_id") == "home")).alias("from_home"))


# --- routing ------------------------------------------------------------------------------------

def _dim_config(spark):
    return routing.current_config(
        m.config_changes(spark, m.DIM_CONFIG_CHANGES, m.DIM_CONFIG_TYPE), ["source_table"])


def _fact_config(spark):
    return routing.current_config(
        m.config_changes(spark, m.FACT_CONFIG_CHANGES, m.FACT_CONFIG_TYPE), ["source_table", "source_type"])


@query("j5_dimension_routing")
def _(spark, sf):
    routed = routing.route_dimensions(parse.dimension_changes(_changes(spark, sf)), _dim_config(spark))
    return routed.select("sink_table", "sink_pk", "_op", F.col("data")["id"].alias("id"),
                         F.col("data")["name"].alias("name"), F.col("data")["course_name"].alias("course_name"),
                         F.col("data")["subject_id"].alias("subject_id"), "ts").na.fill("-")


@query("j5_fact_routing")
def _(spark, sf):
    routed = routing.route_facts(parse.fact_changes(_changes(spark, sf)), _fact_config(spark))
    return routed.select("sink_table", F.col("data")["id"].alias("id"), F.col("data")["user_id"].alias("user_id"),
                         "ts").na.fill("-")


def live_columns(routed):
    """Routed rows with the columns that the live routes may list."""
    return routed.select("sink_table", "_op", *[F.col("data")[c].alias(c) for c in ("id", "user_id", "number")], "ts").na.fill("-")


@query("j5_routing_by_time")
def _(spark, sf):
    """Each change row by the route that held at its time."""
    rows = m.live_changes(spark, sf)
    start = m.live_routes(spark)
    first = start.select(F.lit("r").alias("op"), F.struct(*start.columns).alias("after"), F.lit("0001-01-01").cast("timestamp_ntz").alias("ts"))
    config = rows.filter(F.col("op").isNotNull()).select("op", "before", "after", "ts").unionByName(first, allowMissingColumns=True)
    spans = routing.config_spans(config, list(m.LIVE_KEYS.values()))
    return live_columns(routing.route_by_time(rows.filter(F.col("table").isNotNull()), spans, m.LIVE_KEYS))


@query("s4_config_in_force")
def _(spark, sf):
    """Change rows per configured route, with the route's columns."""
    changes = parse.dimension_changes(_changes(spark, sf)).filter(F.col("type").isNotNull())
    config = _dim_config(spark)
    return changes.join(F.broadcast(config), changes["table"] == config["source_table"]).groupBy(
        "source_table", "sink_table", "sink_columns").agg(F.count(F.lit(1)).alias("row_count"))


# --- joins --------------------------------------------------------------------------------------

@query("j1_j2_order_details")
def _(spark, sf):
    return m.order_facts(spark, sf).drop("row_op_ts").na.fill("-", ["source_id"])


@query("j3_paid_details")
def _(spark, sf):
    return m.paid_facts(spark, sf).select(
        "id", "order_id", "user_id", "final_amount", "alipay_trade_no", "payment_type", "callback_time", "ts")


@query("j4_registrations")
def _(spark, sf):
    return m.registered(spark, sf).drop("row_op_ts", "register_time").na.fill("-")


@query("j6_source_and_province_names")
def _(spark, sf):
    per = m.event_rows(m.table(spark, sf, "events")).groupBy("sc", "ar").agg(F.count(F.lit(1)).alias("page_count"))
    named = joins.lookup(per, m.sources(spark, sf), {"sc": "id"}, {"source_name": "source_site"})
    return joins.lookup(named, m.provinces(spark, sf), {"ar": "id"}, {"province_name": "name"})


@query("j6_composite_key_lookup")
def _(spark, sf):
    who = m.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    found = joins.lookup(who, m.table(spark, sf, "supplier"),
                         {"c_custkey": "s_suppkey", "c_nationkey": "s_nationkey"}, {"found": "s_name"})
    return found.na.fill("-", ["found"])


@query("j7_course_subject_category")
def _(spark, sf):
    per = m.details(spark, sf).groupBy("course_id").agg(F.sum("final_amount").alias("amount"))
    named = joins.lookup(per, m.courses(spark, sf), {"course_id": "id"},
                         {"course_name": "course_name", "subject_id": "subject_id"})
    named = joins.lookup(named, m.subjects(spark, sf), {"subject_id": "id"},
                         {"subject_name": "subject_name", "category_id": "category_id"})
    return joins.lookup(named, m.categories(spark, sf), {"category_id": "id"}, {"category_name": "category_name"})


@query("j7b_paper_course_and_video_chapter")
def _(spark, sf):
    takers = m.exams(spark, sf).groupBy("paper_id").agg(F.count(F.lit(1)).alias("row_count"))
    named = joins.lookup(takers, m.papers(spark, sf), {"paper_id": "id"},
                         {"title": "paper_title", "parent_id": "course_id"})
    named = joins.lookup(named, m.courses(spark, sf), {"parent_id": "id"}, {"parent_name": "course_name"})
    views = m.plays(spark, sf).groupBy("video_id").agg(F.count(F.lit(1)).alias("row_count"))
    seen = joins.lookup(views, m.videos(spark, sf), {"video_id": "id"}, {"parent_id": "chapter_id"})
    seen = joins.lookup(seen, m.chapters(spark, sf), {"parent_id": "id"}, {"parent_name": "chapter_name"})
    both = named.select(F.lit("paper").alias("kind"), F.col("paper_id").alias("id"), "parent_id", "parent_name",
                        "row_count").unionByName(
        seen.select(F.lit("video").alias("kind"), F.col("video_id").alias("id"), "parent_id", "parent_name",
                    "row_count"))
    return both.na.fill("-")


def _dictionary(counts):
    """The words of two to four letters that occur often, as a dictionary; longer words are made of these."""
    costs, unknown = word_costs(counts)
    short = counts.filter(F.length("word").between(2, 4) & (F.col("n") >= 8)).select("word")
    return costs.join(short, "word", "left_semi"), unknown


@query("f1_segmented_keywords")
def _(spark, sf):
    """Words of the whole texts cut by a dictionary, counted; each distinct run is cut once."""
    runs = stored(w.keyword_rows(m.search_log(spark, sf)).groupBy(F.col("keyword").alias("word")).agg(F.count(F.lit(1)).alias("n")), "runs")
    cut = segmenter(*_dictionary(runs))
    return runs.select(F.explode(cut("word")).alias("keyword"), "n").groupBy("keyword").agg(F.sum("n").alias("keyword_count"))


@query("j8_f1_keyword_rows")
def _(spark, sf):
    """Words of the whole texts, counted per word."""
    return w.keyword_rows(m.search_log(spark, sf)).groupBy("keyword").agg(
        F.count(F.lit(1)).alias("hits"), F.min("ts").alias("first_ts"))


# --- stateful operators, batch form ---------------------------------------------------------------

@query("t1_new_visitor_repair")
def _(spark, sf):
    return keyed.repair_new_flag(m.event_rows(m.table(spark, sf, "events"))).select("log_id", "mid", "is_new")


@query("t2_daily_unique_visitor")
def _(spark, sf):
    return keyed.unique_visitors(m.raw_page_log(spark, sf), m.TIE).select("mid", "log_id", "page_id", "ts")


@query("t3_unique_visitor_per_page")
def _(spark, sf):
    views = split.view_pages(m.event_rows(m.table(spark, sf, "events")))
    return keyed.first_per_day(views, ["mid", "page_id"], "ts", m.TIE).select("mid", "page_id", "log_id")


@query("t4_bounces")
def _(spark, sf):
    return keyed.bounces(m.raw_page_log(spark, sf), m.TIE, m.BOUNCE_SECONDS).select("mid", "log_id", "page_id", "ts")


@query("t5_first_logins")
def _(spark, sf):
    return keyed.first_logins(m.event_rows(m.table(spark, sf, "events")), m.TIE).select("mid", "uid", "log_id", "ts")


@query("t6_latest_version")
def _(spark, sf):
    return keyed.latest_version(m.details(spark, sf), ["id"], "row_op_ts")


@query("t7_login_returns")
def _(spark, sf):
    return keyed.login_days(m.logins(spark, sf), "user_id")


@query("t8_cart_unique_users")
def _(spark, sf):
    return keyed.first_times(m.cart(spark, sf), ["user_id"], "ts")


@query("t9_order_buyers")
def _(spark, sf):
    return keyed.buyer_days(m.orders(spark, sf))


@query("t10_payers")
def _(spark, sf):
    paid = m.payments(spark, sf).filter(F.col("payment_status") == PAID)
    who = m.orders(spark, sf).select(F.col("id").alias("order_id"), "user_id")
    return keyed.buyer_days(paid.join(who, "order_id").select("user_id", "ts"))


@query("t11_province_buyer_flag")
def _(spark, sf):
    return keyed.flag_first(m.orders(spark, sf), ["province_id", "user_id"], "ts", ["id"], "order_uu_count").select(
        "id", "province_id", "user_id", "order_uu_count")


@query("t12_source_buyer_flag")
def _(spark, sf):
    pages = split.order_pages(m.event_rows(m.table(spark, sf, "events")))
    return keyed.flag_first(pages, ["mid", "sc"], "ts", m.TIE, "order_uu_count").select(
        "log_id", "mid", "sc", "order_uu_count")


@query("t13_order_counting")
def _(spark, sf):
    kept = keyed.latest_version(m.details(spark, sf), ["id"], "row_op_ts")
    flagged = keyed.flag_first(kept, ["order_id"], "row_op_ts", ["id"], "order_count", per_day=False)
    return flagged.select("id", "order_id", "order_count")


@query("t14_unique_viewer_flag")
def _(spark, sf):
    return keyed.flag_first(m.plays(spark, sf), ["uid"], "ts", m.TIE, "play_uu_count").select(
        "log_id", "uid", "play_uu_count")


@query("w5_keyed_tumbling_window")
def _(spark, sf):
    rows = m.event_rows(m.table(spark, sf, "events"))
    return tumbling(rows, ["page_id"], [F.count(F.lit(1)).alias("views"), F.sum("during_time").alias("during_time")],
                    width="10 minutes")


@query("w6_global_tumbling_window")
def _(spark, sf):
    rows = m.event_rows(m.table(spark, sf, "events"))
    return tumbling(rows, [], [F.count(F.lit(1)).alias("views")], width="10 seconds")


# --- window tables --------------------------------------------------------------------------------

def _traffic(spark, sf):
    return w.traffic(m.page_log(spark, sf), m.sources(spark, sf), m.provinces(spark, sf), m.TIE,
                     m.BOUNCE_SECONDS, m.HOUR)


def _keywords(spark, sf):
    return w.keywords(m.search_log(spark, sf), m.HOUR)


def _page_views(spark, sf):
    return w.page_views(m.event_rows(m.table(spark, sf, "events")), m.HOUR)


def _logins(spark, sf):
    return w.user_logins(m.logins(spark, sf), m.HOUR)


def _registrations(spark, sf):
    return w.user_registrations(m.registered(spark, sf), width=m.HOUR)


def _chapter_plays(spark, sf):
    return w.chapter_plays(m.sessions(spark, sf), m.videos(spark, sf), m.chapters(spark, sf), m.HOUR)


def _cart(spark, sf):
    return w.cart_adds(m.cart(spark, sf), m.HOUR)


def _order_buyers(spark, sf):
    return w.order_buyers(m.order_facts(spark, sf))


def _payers(spark, sf):
    return w.payers(m.paid_facts(spark, sf))


def _province_orders(spark, sf):
    return w.province_orders(m.orders(spark, sf), m.provinces(spark, sf))


def _source_orders(spark, sf):
    return w.source_orders(m.order_facts(spark, sf), m.sources(spark, sf))


def _course_orders(spark, sf):
    return w.course_orders(m.order_facts(spark, sf), m.courses(spark, sf), m.subjects(spark, sf),
                           m.categories(spark, sf))


def _paper_exams(spark, sf):
    return w.paper_exams(m.exams(spark, sf), m.papers(spark, sf), m.courses(spark, sf))


def _paper_scores(spark, sf):
    return w.paper_scores(m.exams(spark, sf), m.papers(spark, sf))


def _question_answers(spark, sf):
    return w.question_answers(m.answers(spark, sf), m.questions(spark, sf), m.HOUR)


def _course_reviews(spark, sf):
    return w.course_reviews(m.reviews(spark, sf), m.courses(spark, sf))


@query("a0_play_sessions")
def _(spark, sf):
    return sessions.play_sessions(m.plays(spark, sf), m.PLAY_GAP_SECONDS, tie=["log_id"]).select(
        "sid", "uid", "sc", "video_id", "play_sec", "position_sec", "ts")


WINDOW_QUERIES: dict[str, Query] = {
    "a1_traffic_window": _traffic,
    "a2_keyword_window": _keywords,
    "a3_page_view_window": _page_views,
    "a4_user_login_window": _logins,
    "a5_user_register_window": _registrations,
    "a6_chapter_play_window": _chapter_plays,
    "a7_cart_add_window": _cart,
    "a8_order_buyer_window": _order_buyers,
    "a9_payer_window": _payers,
    "a10_province_order_window": _province_orders,
    "a11_source_order_window": _source_orders,
    "a12_course_order_window": _course_orders,
    "a13_paper_exam_window": _paper_exams,
    "a14_paper_score_window": _paper_scores,
    "a15_question_answer_window": _question_answers,
    "a16_course_review_window": _course_reviews,
}
for _name, _fn in WINDOW_QUERIES.items():
    query(_name)(lambda spark, sf, _fn=_fn: _fn(spark, sf).na.fill("-"))


# --- reports --------------------------------------------------------------------------------------

def _report(name: str, fn, *tables: Query, date: str | None = None) -> None:
    query(name)(lambda spark, sf: fn(*[t(spark, sf) for t in tables], date=date).na.fill("-"))


# Dates inside the test tables, for the reports of one day.
EVENT_DATE, ORDER_DATE = "2024-01-15", "1998-03-02"

_report("r1_uv_by_source", r.uv_by_source, _traffic)
_report("r2_sessions_by_source", r.sessions_by_source, _traffic)
_report("r3_pages_per_session_by_source", r.pages_per_session, _traffic)
_report("r4_time_per_session_by_source", r.time_per_session, _traffic)
_report("r5_bounce_rate_by_source", r.bounce_rate, _traffic)
_report("r6_visitors_by_hour", r.visitors_by_hour, _traffic)
_report("r6_visitors_by_hour_of_day", r.visitors_by_hour, _traffic, date=EVENT_DATE)
_report("r7_visitors_by_type", r.visitors_by_type, _traffic)
_report("r8_keyword_scores", r.keyword_scores, _keywords)
_report("r9_user_changes", r.user_changes, _logins, _registrations)
_report("r9_user_changes_of_day", r.user_changes, _logins, _registrations, date=EVENT_DATE)

@query("r10_funnel")
def _(spark, sf):
    facts = stored(m.order_facts(spark, sf), "order_facts")
    return r.funnel(_page_views(spark, sf), _cart(spark, sf), w.order_buyers(facts),
                    w.payers(m.paid_facts(spark, sf, facts)))


@query("r11_new_buyers")
def _(spark, sf):
    facts = stored(m.order_facts(spark, sf), "order_facts")
    return r.new_buyers(w.order_buyers(facts), w.payers(m.paid_facts(spark, sf, facts)))


_report("r12_trade_by_source", r.trade_by_source, _source_orders)
_report("r13_amount_by_province", r.amount_by_province, _province_orders)
_report("r13_amount_by_province_of_day", r.amount_by_province, _province_orders, date=ORDER_DATE)
_report("r14_buyers_by_province", r.buyers_by_province, _province_orders)
_report("r15_orders_by_province", r.orders_by_province, _province_orders)
_report("r16_total_amount", r.total_amount, _province_orders)
_report("r17_total_orders", r.total_orders, _province_orders)
_report("r18_amount_by_course", r.amount_by_course, _course_orders)
_report("r19_amount_by_subject", r.amount_by_subject, _course_orders)
_report("r20_amount_by_category", r.amount_by_category, _course_orders)
_report("r21_reviews_by_course", r.reviews_by_course, _course_reviews)
_report("r22_exams_by_paper", r.exams_by_paper, _paper_exams)
_report("r23_exams_by_course", r.exams_by_course, _paper_exams)
_report("r24_score_distribution", r.score_distribution, _paper_scores)
_report("r25_questions_by_accuracy", r.questions_by_accuracy, _question_answers)
_report("r26_chapters", r.chapters, _chapter_plays)


# --- scalar functions -------------------------------------------------------------------------------

@query("f_time_functions")
def _(spark, sf):
    e = m.table(spark, sf, "events")
    millis = to_millis("ts")
    return e.select(
        "event_id", millis.alias("millis"), from_millis(millis, "Asia/Shanghai").alias("local_ts"),
        date_text("ts").alias("date_id"), date_number("ts").alias("date_number"),
        date_text_to_millis(date_text("ts"), "Asia/Shanghai").alias("day_start_millis"),
        F.date_format(whole_seconds("ts"), "yyyy-MM-dd HH:mm:ss").alias("row_time"),
        hour_label(F.hour("ts")).alias("hour_label"), F.substring(datetime_text("ts"), 1, 10).alias("date_part"))


@query("f_version_compare")
def _(spark, sf):
    text = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("Z"))
    e = m.table(spark, sf, "events").select(
        "event_id", text("ts").alias("left"),
        text(F.timestamp_add("SECOND", F.col("event_id") % 3 - 1, F.col("ts"))).alias("right"))
    return e.select("event_id", is_newer_version("left", "right").alias("is_newer"))


@query("f_text_functions")
def _(spark, sf):
    return m.table(spark, sf, "documents").select(
        "doc_id", short_digest("text").alias("digest"), F.size(words("text")).alias("word_count"))


@query("f_keyword_weights")
def _(spark, sf):
    source = F.upper("event_type")
    return m.table(spark, sf, "events").select(
        F.when(F.col("event_type") == "purchase", "ORDER").when(F.col("event_type") == "view", "SEARCH")
        .otherwise(source).alias("source")).groupBy("source").agg(F.sum(keyword_weight("source")).alias("weight"))


@query("f_json_encode")
def _(spark, sf):
    return m.plays(spark, sf).select("log_id", F.to_json(F.struct("uid", "video_id", "play_sec")).alias("value"))
