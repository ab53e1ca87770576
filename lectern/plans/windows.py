"""The sixteen window tables, each from its facts and dimensions.

Same shape everywhere: facts become rows of additive measures, the rows are summed per window and
key with partial sums before the shuffle, and names are looked up last, on the few summed rows.
Unique counts are measure rows too: one row per key and day at its first time. That keeps a hot
user, device or source out of any single task.

Window tables carry no ``ts`` of their own here; the sink stamps it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.measures import SEARCH_SOURCE, as_count, money, score_band
from lectern.functions.text import words
from lectern.functions.timefn import whole_seconds
from lectern.operators.joins import lookup
from lectern.operators.keyed import (
    bounces, buyer_days, first_per, first_per_day, first_times, latest_version, login_days,
    unique_visitors,
)
from lectern.operators.parse import required
from lectern.operators.skew import HOT_ROWS
from lectern.operators.split import searches, view_pages
from lectern.operators.windows import WINDOW, measure_rows, summed, tumbling


def _one():
    return F.lit(1).cast("bigint")


def united(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


TRAFFIC_KEYS = ["vc", "sc", "ar", "is_new"]
TRAFFIC_MEASURES = [
    "uv_count", "total_session_count", "page_view_count", "total_during_time", "jump_session_count",
]


def traffic_rows(page_log: DataFrame, visitors: DataFrame, jumps: DataFrame, ts: str = "ts") -> DataFrame:
    """Page views, unique visitors and bounces as one set of measure rows."""
    pages = measure_rows(
        page_log, ts, TRAFFIC_KEYS, TRAFFIC_MEASURES,
        total_session_count=as_count(F.col("last_page_id").isNull()),
        page_view_count=_one(), total_during_time=F.col("during_time"),
    )
    uv = measure_rows(visitors, ts, TRAFFIC_KEYS, TRAFFIC_MEASURES, uv_count=_one())
    jump = measure_rows(jumps, ts, TRAFFIC_KEYS, TRAFFIC_MEASURES, jump_session_count=_one())
    return united(pages, uv, jump)


def traffic_names(summed_rows: DataFrame, sources: DataFrame, provinces: DataFrame) -> DataFrame:
    named = lookup(summed_rows, sources, {"sc": "id"}, {"source_name": "source_site"})
    named = lookup(named, provinces, {"ar": "id"}, {"province_name": "name"})
    return named.select("stt", "edt", F.col("vc").alias("version_code"), F.col("sc").alias("source_id"),
                        "source_name", "ar", "province_name", "is_new", *TRAFFIC_MEASURES)


def traffic(
    page_log: DataFrame, sources: DataFrame, provinces: DataFrame, tie: list[str],
    bounce_seconds: int = 10, width: str = WINDOW, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    rows = traffic_rows(
        page_log, unique_visitors(page_log, tie),
        bounces(page_log, tie, bounce_seconds, hot_rows=hot_rows),
    )
    return traffic_names(tumbling(rows, TRAFFIC_KEYS, summed(*TRAFFIC_MEASURES), width=width), sources, provinces)


def keyword_rows(page_log: DataFrame, tokenize=words) -> DataFrame:
    """One row per word of each searched text; a text without words gives none."""
    return searches(page_log).select(F.explode(tokenize(F.col("full_word"))).alias("keyword"), "ts")


def keywords(page_log: DataFrame, width: str = WINDOW, tokenize=words) -> DataFrame:
    rows = keyword_rows(page_log, tokenize).withColumn("ts", whole_seconds("ts"))
    counted = tumbling(rows, ["keyword"], [F.count(F.lit(1)).alias("keyword_count")], width=width)
    return counted.select("stt", "edt", F.lit(SEARCH_SOURCE).alias("source"), "keyword", "keyword_count")


PAGE_VIEW_MEASURES = ["home_uv_count", "list_uv_count", "detail_uv_count"]


def page_view_rows(first_views: DataFrame, ts: str = "ts") -> DataFrame:
    page = F.col("page_id")
    return first_views.select(
        ts, as_count(page == "home").alias("home_uv_count"),
        as_count(page == "course_list").alias("list_uv_count"),
        as_count(page == "course_detail").alias("detail_uv_count"),
    )


def page_views(page_log: DataFrame, width: str = WINDOW) -> DataFrame:
    first = first_times(view_pages(page_log), ["mid", "page_id"], "ts")
    return tumbling(page_view_rows(first), [], summed(*PAGE_VIEW_MEASURES), width=width)


def user_logins(logins: DataFrame, width: str = WINDOW) -> DataFrame:
    return tumbling(login_days(logins, "user_id"), [], summed("back_count", "uv_count"), width=width)


def user_registrations(registered: DataFrame, version: str = "row_op_ts", width: str = WINDOW) -> DataFrame:
    kept = latest_version(registered.select("user_id", "ts", version), ["user_id"], version)
    return tumbling(kept, [], [F.count(F.lit(1)).alias("register_count")], width=width)


PLAY_MEASURES = ["play_count", "play_total_sec", "play_uu_count"]


def chapter_rows(plays: DataFrame, viewers: DataFrame, ts: str = "ts") -> DataFrame:
    """All plays, and ``viewers``: one row per user and day, for the video of the user's first play."""
    every = measure_rows(plays, ts, ["video_id"], PLAY_MEASURES, play_count=_one(),
                         play_total_sec=F.col("play_sec").cast("bigint"))
    return united(every, measure_rows(viewers, ts, ["video_id"], PLAY_MEASURES, play_uu_count=_one()))


def chapter_names(sums: DataFrame, videos: DataFrame, chapters: DataFrame) -> DataFrame:
    named = lookup(sums, videos, {"video_id": "id"}, {"chapter_id": "chapter_id"})
    named = lookup(named, chapters, {"chapter_id": "id"}, {"chapter_name": "chapter_name"})
    return named.select("stt", "edt", "chapter_id", "chapter_name", *PLAY_MEASURES)


def chapter_plays(plays: DataFrame, videos: DataFrame, chapters: DataFrame, width: str = WINDOW) -> DataFrame:
    """Plays per video and window, then the chapter. Viewers are unique per user and day."""
    viewers = first_per_day(plays.select("uid", "ts", "video_id"), ["uid"], "ts", ["video_id"])
    sums = tumbling(chapter_rows(plays, viewers), ["video_id"], summed(*PLAY_MEASURES), width=width)
    return chapter_names(sums, videos, chapters)


def cart_adds(cart: DataFrame, width: str = WINDOW) -> DataFrame:
    users = first_times(cart, ["user_id"], "ts").withColumn("cart_add_uv_count", _one())
    return tumbling(users, [], summed("cart_add_uv_count"), width=width)


def _buyers(facts: DataFrame, version: str, width: str, uv: str, new: str) -> DataFrame:
    kept = latest_version(facts.select("id", "user_id", "ts", version), ["id"], version)
    measures = [F.sum("uv_count").alias(uv), F.sum("new_count").alias(new)]
    return tumbling(buyer_days(kept), [], measures, width=width)


def order_buyers(details: DataFrame, version: str = "row_op_ts", width: str = WINDOW) -> DataFrame:
    return _buyers(details, version, width, "order_uv_count", "new_order_user_count")


def payers(paid: DataFrame, version: str = "row_op_ts", width: str = WINDOW) -> DataFrame:
    return _buyers(paid, version, width, "pay_suc_uv_count", "pay_suc_new_user_count")


TRADE_MEASURES = ["order_total_amount", "order_uu_count", "order_count"]


def _trade_rows(df: DataFrame, key: str, ts: str, **given) -> DataFrame:
    given["order_total_amount"] = money(given.get("order_total_amount", F.lit(0)))
    return measure_rows(df, ts, [key], TRADE_MEASURES, **given)


def province_rows(orders: DataFrame, buyers: DataFrame, ts: str = "ts") -> DataFrame:
    """All orders, and ``buyers``: one row per province, user and day."""
    every = _trade_rows(orders, "province_id", ts, order_total_amount=F.col("final_amount"), order_count=_one())
    return united(every, _trade_rows(buyers, "province_id", ts, order_uu_count=_one()))


def province_names(sums: DataFrame, provinces: DataFrame) -> DataFrame:
    named = lookup(sums, provinces, {"province_id": "id"}, {"province_name": "name"})
    return named.select("stt", "edt", "province_id", "province_name", *TRADE_MEASURES)


def province_orders(orders: DataFrame, provinces: DataFrame, width: str = WINDOW) -> DataFrame:
    """Amount, unique buyers and orders per province."""
    rows = province_rows(orders, first_times(orders, ["province_id", "user_id"], "ts"))
    return province_names(tumbling(rows, ["province_id"], summed(*TRADE_MEASURES), width=width), provinces)


def source_rows(details: DataFrame, buyers: DataFrame, orders: DataFrame, ts: str = "ts") -> DataFrame:
    """Details' amounts, ``buyers`` (one row per user, source and day) and ``orders`` (first details)."""
    amounts = _trade_rows(details, "source_id", ts, order_total_amount=F.col("final_amount"))
    unique = _trade_rows(buyers, "source_id", ts, order_uu_count=_one())
    return united(amounts, unique, _trade_rows(orders, "source_id", ts, order_count=_one()))


def source_names(sums: DataFrame, sources: DataFrame) -> DataFrame:
    named = lookup(sums, sources, {"source_id": "id"}, {"source_name": "source_site"})
    return named.select("stt", "edt", "source_id", "source_name", *TRADE_MEASURES)


def source_orders(details: DataFrame, sources: DataFrame, version: str = "row_op_ts", width: str = WINDOW) -> DataFrame:
    """Amount, unique buyers and orders per source, from order details.

    An order counts once, at its first detail.
    """
    needed = ["id", "order_id", "source_id", "user_id", "final_amount", "ts", version]
    whole = required(details, "source_id", "order_id").select(*needed)
    kept = latest_version(whole, ["id"], version)
    rows = source_rows(kept, first_times(kept, ["user_id", "source_id"], "ts"),
                       first_per(kept, ["order_id"], ["ts", "id"]))
    return source_names(tumbling(rows, ["source_id"], summed(*TRADE_MEASURES), width=width), sources)


def amounts() -> list:
    return [F.sum(money("final_amount")).alias("order_total_amount")]


def course_names(sums: DataFrame, courses: DataFrame, subjects: DataFrame, categories: DataFrame) -> DataFrame:
    """Course, subject and category, one, two and three lookups away."""
    named = lookup(sums, courses, {"course_id": "id"}, {"course_name": "course_name", "subject_id": "subject_id"})
    named = lookup(named, subjects, {"subject_id": "id"}, {"subject_name": "subject_name", "category_id": "category_id"})
    named = lookup(named, categories, {"category_id": "id"}, {"category_name": "category_name"})
    return named.select("stt", "edt", "course_id", "course_name", "subject_id", "subject_name",
                        "category_id", "category_name", "order_total_amount")


def course_orders(
    details: DataFrame, courses: DataFrame, subjects: DataFrame, categories: DataFrame,
    version: str = "row_op_ts", width: str = WINDOW,
) -> DataFrame:
    """Amount per course, with its subject and category."""
    kept = latest_version(details.select("id", "course_id", "final_amount", "ts", version), ["id"], version)
    return course_names(tumbling(kept, ["course_id"], amounts(), width=width), courses, subjects, categories)


def exam_measures() -> list:
    """Takers, total score (fraction cut off) and total time."""
    return [
        F.count(F.lit(1)).alias("exam_taken_count"),
        F.sum(F.col("score").cast("bigint")).alias("exam_total_score"),
        F.sum(F.col("duration_sec").cast("bigint")).alias("exam_total_during_sec"),
    ]


def exam_names(sums: DataFrame, papers: DataFrame, courses: DataFrame) -> DataFrame:
    named = lookup(sums, papers, {"paper_id": "id"}, {"paper_title": "paper_title", "course_id": "course_id"})
    named = lookup(named, courses, {"course_id": "id"}, {"course_name": "course_name"})
    return named.select("stt", "edt", "paper_id", "paper_title", "course_id", "course_name",
                        "exam_taken_count", "exam_total_score", "exam_total_during_sec")


def paper_exams(exams: DataFrame, papers: DataFrame, courses: DataFrame, width: str = WINDOW) -> DataFrame:
    return exam_names(tumbling(exams, ["paper_id"], exam_measures(), width=width), papers, courses)


def banded(exams: DataFrame) -> DataFrame:
    return exams.withColumn("score_duration", score_band("score"))


def score_measures() -> list:
    return [F.count(F.lit(1)).alias("user_count")]


def score_names(sums: DataFrame, papers: DataFrame) -> DataFrame:
    named = lookup(sums, papers, {"paper_id": "id"}, {"paper_title": "paper_title"})
    return named.select("stt", "edt", "paper_id", "paper_title", "score_duration", "user_count")


def paper_scores(exams: DataFrame, papers: DataFrame, width: str = WINDOW) -> DataFrame:
    sums = tumbling(banded(exams), ["paper_id", "score_duration"], score_measures(), width=width)
    return score_names(sums, papers)


def answer_measures() -> list:
    return [
        F.sum(as_count(F.col("is_correct") == "1")).alias("correct_answer_count"),
        F.count(F.lit(1)).alias("answer_count"),
    ]


def answer_names(sums: DataFrame, questions: DataFrame) -> DataFrame:
    named = lookup(sums, questions, {"question_id": "id"}, {"question_txt": "question_txt"})
    return named.select("stt", "edt", "question_id", "question_txt", "correct_answer_count", "answer_count")


def question_answers(answers: DataFrame, questions: DataFrame, width: str = WINDOW) -> DataFrame:
    return answer_names(tumbling(answers, ["question_id"], answer_measures(), width=width), questions)


def review_measures() -> list:
    stars = F.col("review_stars").cast("bigint")
    return [
        F.sum(stars).alias("review_total_stars"), F.count(F.lit(1)).alias("review_user_count"),
        F.sum(as_count(stars == 5)).alias("good_review_user_count"),
    ]


def review_names(sums: DataFrame, courses: DataFrame) -> DataFrame:
    named = lookup(sums, courses, {"course_id": "id"}, {"course_name": "course_name"})
    return named.select("stt", "edt", "course_id", "course_name", "review_total_stars",
                        "review_user_count", "good_review_user_count")


def course_reviews(reviews: DataFrame, courses: DataFrame, width: str = WINDOW) -> DataFrame:
    return review_names(tumbling(reviews, ["course_id"], review_measures(), width=width), courses)
