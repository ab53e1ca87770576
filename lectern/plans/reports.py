"""The twenty-six reports over the window tables.

Every report takes an optional ``date`` (``yyyy-MM-dd`` text or a date); without it the whole table
counts. Ratios are null where nothing can be divided. Orders end in a key, so equal measures do
not make a top ten random.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.measures import keyword_weight, ratio
from lectern.functions.text import short_digest
from lectern.functions.timefn import hour_label

TOP = 10  # fixed value: length of the top lists


def on_date(table: DataFrame, date: str | datetime.date | None) -> DataFrame:
    """Rows whose window starts on ``date``; a stored table also skips other months' folders."""
    if date is None:
        return table
    start = datetime.date.fromisoformat(str(date))
    if "month" in table.columns:
        table = table.filter(F.col("month") == start.year * 100 + start.month)
    end = start + datetime.timedelta(days=1)
    # A plain range on the stored column reaches the file scan.
    midnight = lambda d: F.lit(str(d)).cast("timestamp_ntz")
    return table.filter((F.col("stt") >= midnight(start)) & (F.col("stt") < midnight(end)))


def _by_source(traffic: DataFrame, date, measure, name: str) -> DataFrame:
    rows = on_date(traffic, date).groupBy("source_id", "source_name").agg(measure.alias(name))
    return rows.orderBy(F.desc(name), "source_id")


def uv_by_source(traffic: DataFrame, date=None) -> DataFrame:
    return _by_source(traffic, date, F.sum("uv_count"), "uv_count")


def sessions_by_source(traffic: DataFrame, date=None) -> DataFrame:
    return _by_source(traffic, date, F.sum("total_session_count"), "total_session_count")


def pages_per_session(traffic: DataFrame, date=None) -> DataFrame:
    value = ratio(F.sum("page_view_count"), F.sum("total_session_count"))
    return _by_source(traffic, date, value, "pv_per_session")


def time_per_session(traffic: DataFrame, date=None) -> DataFrame:
    value = ratio(F.sum("total_during_time"), F.sum("total_session_count"))
    return _by_source(traffic, date, value, "dur_per_session")


def bounce_rate(traffic: DataFrame, date=None) -> DataFrame:
    value = ratio(F.sum("jump_session_count"), F.sum("total_session_count"))
    return _by_source(traffic, date, value, "jump_rate")


def visitors_by_hour(traffic: DataFrame, date=None) -> DataFrame:
    """All 24 hours; hours without rows show 0."""
    new_uv = F.sum(F.when(F.col("is_new") == "1", F.col("uv_count")).otherwise(0))
    per_hour = on_date(traffic, date).groupBy(F.hour("stt").alias("hr")).agg(
        F.sum("uv_count").alias("uv_count"), F.sum("page_view_count").alias("page_view_count"),
        new_uv.alias("new_uv_count"),
    )
    hours = traffic.sparkSession.range(24).select(F.col("id").cast("int").alias("hr"))
    full = hours.join(per_hour, "hr", "left").select(
        "hr", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("uv_count", "page_view_count", "new_uv_count")]
    )
    return full.select(hour_label("hr").alias("hr"), "uv_count", "page_view_count", "new_uv_count").orderBy("hr")


def visitors_by_type(traffic: DataFrame, date=None) -> DataFrame:
    """Five indicators, each for new and for returning visitors; 0 for a type without sessions."""
    def total(measure: str, flag: str):
        return F.coalesce(F.sum(F.when(F.col("is_new") == flag, F.col(measure))), F.lit(0))

    sums = on_date(traffic, date).agg(*[
        total(m, flag).alias(f"{short}_{kind}")
        for kind, flag in (("new", "1"), ("old", "0"))
        for short, m in (("uv", "uv_count"), ("pv", "page_view_count"), ("se", "total_session_count"),
                         ("ju", "jump_session_count"), ("du", "total_during_time"))
    ])

    def per_session(part: str, kind: str, scale: int = 1):
        value = ratio(F.col(f"{part}_{kind}"), F.col(f"se_{kind}")) / scale
        return F.coalesce(value, F.lit(0.0))

    indicators = [
        ("uv_count", lambda k: F.col(f"uv_{k}").cast("double")),
        ("page_view_count", lambda k: F.col(f"pv_{k}").cast("double")),
        ("jump_rate", lambda k: per_session("ju", k)),
        ("avg_during_sec", lambda k: per_session("du", k, 1000)),
        ("avg_page_count", lambda k: per_session("pv", k)),
    ]
    cells = F.array(*[
        F.struct(F.lit(n).alias("indicator"), f("new").alias("new_visitor"), f("old").alias("old_visitor"))
        for n, f in indicators
    ])
    return sums.select(F.inline(cells))


def keyword_scores(keywords: DataFrame, date=None) -> DataFrame:
    score = F.sum(F.col("keyword_count") * keyword_weight("source")).alias("keyword_score")
    return on_date(keywords, date).groupBy("keyword").agg(score).orderBy(F.desc("keyword_score"), "keyword")


def _labelled(rows: list[tuple[str, DataFrame, str]], label: str, value: str, date) -> DataFrame:
    """One labelled total per (label, table, measure), united."""
    parts = [
        on_date(t, date).agg(F.coalesce(F.sum(m), F.lit(0)).cast("bigint").alias(value))
        .select(F.lit(name).alias(label), value)
        for name, t, m in rows
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def user_changes(logins: DataFrame, registrations: DataFrame, date=None) -> DataFrame:
    return _labelled([
        ("back_count", logins, "back_count"), ("activeUserCt", logins, "uv_count"),
        ("newUserCt", registrations, "register_count"),
    ], "type", "user_count", date)


def funnel(page_views: DataFrame, cart: DataFrame, orders: DataFrame, payments: DataFrame, date=None) -> DataFrame:
    return _labelled([
        ("home", page_views, "home_uv_count"), ("list_uv", page_views, "list_uv_count"),
        ("detail_uv", page_views, "detail_uv_count"), ("cart", cart, "cart_add_uv_count"),
        ("trade", orders, "order_uv_count"), ("payment", payments, "pay_suc_uv_count"),
    ], "page_id", "uv_count", date).orderBy(F.desc("uv_count"), "page_id")


def new_buyers(orders: DataFrame, payments: DataFrame, date=None) -> DataFrame:
    return _labelled([
        ("order", orders, "new_order_user_count"), ("payment", payments, "pay_suc_new_user_count"),
    ], "trade_type", "user_count", date)


def trade_by_source(source_orders: DataFrame, date=None) -> DataFrame:
    sums = [F.sum(m).alias(m) for m in ("order_total_amount", "order_uu_count", "order_count")]
    rows = on_date(source_orders, date).groupBy("source_id", "source_name").agg(*sums)
    return rows.orderBy(F.desc("order_total_amount"), "source_id").limit(TOP)


def _by_province(province_orders: DataFrame, date, measure: str) -> DataFrame:
    return on_date(province_orders, date).groupBy("province_id", "province_name").agg(F.sum(measure).alias(measure))


def amount_by_province(province_orders: DataFrame, date=None) -> DataFrame:
    return _by_province(province_orders, date, "order_total_amount")


def buyers_by_province(province_orders: DataFrame, date=None) -> DataFrame:
    return _by_province(province_orders, date, "order_uu_count")


def orders_by_province(province_orders: DataFrame, date=None) -> DataFrame:
    return _by_province(province_orders, date, "order_count")


def total_amount(province_orders: DataFrame, date=None) -> DataFrame:
    return on_date(province_orders, date).agg(F.sum("order_total_amount").alias("order_total_amount"))


def total_orders(province_orders: DataFrame, date=None) -> DataFrame:
    return on_date(province_orders, date).agg(F.sum("order_count").alias("order_count"))


def _amount(course_orders: DataFrame, date, key: str, name: str) -> DataFrame:
    rows = on_date(course_orders, date).groupBy(key, name).agg(F.sum("order_total_amount").alias("order_total_amount"))
    return rows.orderBy(F.desc("order_total_amount"), key)


def amount_by_course(course_orders: DataFrame, date=None) -> DataFrame:
    return _amount(course_orders, date, "course_id", "course_name").limit(TOP)


def amount_by_subject(course_orders: DataFrame, date=None) -> DataFrame:
    return _amount(course_orders, date, "subject_id", "subject_name")


def amount_by_category(course_orders: DataFrame, date=None) -> DataFrame:
    return _amount(course_orders, date, "category_id", "category_name")


def reviews_by_course(course_reviews: DataFrame, date=None) -> DataFrame:
    """Top ten by five-star reviews, with the total and the average of the stars."""
    sums = [F.sum(m).alias(m) for m in ("review_total_stars", "review_user_count", "good_review_user_count")]
    rows = on_date(course_reviews, date).groupBy("course_id", "course_name").agg(*sums)
    top = rows.orderBy(F.desc("good_review_user_count"), "course_id").limit(TOP)
    people = F.col("review_user_count")
    return top.withColumns({
        "avg_stars": ratio(F.col("review_total_stars"), people),
        "good_review_rate": ratio(F.col("good_review_user_count"), people),
    })


def _exams(paper_exams: DataFrame, date, key: str, name: str) -> DataFrame:
    sums = [F.sum(m).alias(m) for m in ("exam_taken_count", "exam_total_score", "exam_total_during_sec")]
    rows = on_date(paper_exams, date).groupBy(key, name).agg(*sums)
    top = rows.orderBy(F.desc("exam_taken_count"), key).limit(TOP)
    takers = F.col("exam_taken_count")
    return top.select(
        key, name, "exam_taken_count",
        ratio(F.col("exam_total_score"), takers).alias("exam_avg_score"),
        ratio(F.col("exam_total_during_sec"), takers).alias("exam_avg_sec"),
    )


def exams_by_paper(paper_exams: DataFrame, date=None) -> DataFrame:
    return _exams(paper_exams, date, "paper_id", "paper_title")


def exams_by_course(paper_exams: DataFrame, date=None) -> DataFrame:
    return _exams(paper_exams, date, "course_id", "course_name")


def score_distribution(paper_scores: DataFrame, date=None) -> DataFrame:
    rows = on_date(paper_scores, date).groupBy("score_duration").agg(F.sum("user_count").alias("exam_taken_count"))
    return rows.orderBy("score_duration")


def questions_by_accuracy(question_answers: DataFrame, date=None) -> DataFrame:
    """Top ten by share of correct answers; the text is shown by its short digest."""
    sums = [F.sum(m).alias(m) for m in ("correct_answer_count", "answer_count")]
    rows = on_date(question_answers, date).groupBy("question_id", "question_txt").agg(*sums)
    rate = ratio(F.col("correct_answer_count"), F.col("answer_count"))
    top = rows.withColumn("accuracy_rate", rate).orderBy(F.desc("accuracy_rate"), "question_id").limit(TOP)
    return top.withColumn("question_digest", short_digest("question_txt")).drop("question_txt")


def chapters(chapter_plays: DataFrame, date=None) -> DataFrame:
    rows = on_date(chapter_plays, date).groupBy("chapter_name").agg(
        F.sum("play_count").alias("play_count"), F.sum("play_total_sec").alias("play_total_sec"),
        F.sum("play_uu_count").alias("play_uu_count"),
    )
    top = rows.orderBy(F.desc("play_total_sec"), F.desc("play_count"), F.desc("play_uu_count"), "chapter_name").limit(TOP)
    return top.withColumn("sec_per_user", ratio(F.col("play_total_sec"), F.col("play_uu_count")))
