"""Streaming forms of the window tables: closed sums per window and key, before the names.

``to_window_table`` names and stores them. Inputs are layer streams. Facts that come as versions
must first go through ``operators.latest_version`` into a layer of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.measures import SEARCH_SOURCE, money
from lectern.functions.text import words
from lectern.functions.timefn import as_instant, whole_seconds
from lectern.operators.parse import required
from lectern.operators.split import entry_pages, searches, view_pages
from lectern.operators.windows import WINDOW, summed
from lectern.plans import windows as w
from lectern.streaming import operators as s

EVENT = "event_ts"


def _timed(df: DataFrame, late: str = s.LATE) -> DataFrame:
    return s.with_event_time(df, "ts", late)


def visitors(page_log: DataFrame) -> DataFrame:
    """Daily unique visitors; a layer of its own for ``traffic``, so no row is too late."""
    return s.daily_first(entry_pages(page_log), ["mid"], late=None).select(*page_log.columns)


def traffic(page_log: DataFrame, visitor_layer: DataFrame, bounce_layer: DataFrame, bounce_seconds: int = 10,
            width: str = WINDOW) -> DataFrame:
    """A window waits until its bounces are known: the bounce bound and five seconds more."""
    rows = w.traffic_rows(page_log, visitor_layer, bounce_layer)
    return s.tumbling(_timed(rows, f"{bounce_seconds + 5} seconds"), w.TRAFFIC_KEYS, summed(*w.TRAFFIC_MEASURES), width)


def keywords(page_log: DataFrame, width: str = WINDOW, tokenize=words) -> DataFrame:
    # times are worked out per text, not per word
    texts = searches(page_log).select(tokenize(F.col("full_word")).alias("words"), as_instant(whole_seconds("ts")).alias(EVENT))
    rows = texts.select(F.explode("words").alias("keyword"), EVENT)
    counted = s.tumbling_sums(rows, ["keyword"], {"keyword_count": F.lit(1).cast("bigint")}, s.LATE_KEYWORDS, width)
    return counted.select("stt", "edt", F.lit(SEARCH_SOURCE).alias("source"), "keyword", "keyword_count")


def page_views(page_log: DataFrame, width: str = WINDOW) -> DataFrame:
    first = s.daily_first(view_pages(page_log), ["mid", "page_id"])
    return s.tumbling(w.page_view_rows(first, EVENT), [], summed(*w.PAGE_VIEW_MEASURES), width)


def user_logins(logins: DataFrame, width: str = WINDOW) -> DataFrame:
    return s.tumbling(s.login_days(logins), [], summed("back_count", "uv_count"), width)


def user_registrations(compacted: DataFrame, width: str = WINDOW) -> DataFrame:
    return s.tumbling(_timed(compacted), [], [F.count(F.lit(1)).alias("register_count")], width)


def chapter_plays(plays: DataFrame, width: str = WINDOW) -> DataFrame:
    timed = _timed(plays)
    viewers = s.daily_first(plays.select("uid", "video_id", "ts"), ["uid"])
    return s.tumbling(w.chapter_rows(timed, viewers, EVENT), ["video_id"], summed(*w.PLAY_MEASURES), width)


def cart_adds(cart: DataFrame, width: str = WINDOW) -> DataFrame:
    users = s.daily_first(cart.select("user_id", "ts"), ["user_id"])
    return s.tumbling(users, [], [F.count(F.lit(1)).alias("cart_add_uv_count")], width)


def _buyers(compacted: DataFrame, uv: str, new: str, width: str) -> DataFrame:
    measures = [F.sum("uv_count").alias(uv), F.sum("new_count").alias(new)]
    return s.tumbling(s.buyer_days(compacted), [], measures, width)


def order_buyers(compacted: DataFrame, width: str = WINDOW) -> DataFrame:
    return _buyers(compacted, "order_uv_count", "new_order_user_count", width)


def payers(compacted: DataFrame, width: str = WINDOW) -> DataFrame:
    return _buyers(compacted, "pay_suc_uv_count", "pay_suc_new_user_count", width)


def province_orders(orders: DataFrame, width: str = WINDOW) -> DataFrame:
    buyers = s.daily_first(orders.select("province_id", "user_id", "ts"), ["province_id", "user_id"])
    rows = w.province_rows(_timed(orders), buyers, EVENT)
    return s.tumbling(rows, ["province_id"], summed(*w.TRADE_MEASURES), width)


def source_orders(compacted: DataFrame, width: str = WINDOW) -> DataFrame:
    whole = required(compacted, "source_id", "order_id")
    buyers = s.daily_first(whole.select("user_id", "source_id", "ts"), ["user_id", "source_id"])
    # An order counts at its first detail only, also when a later detail falls on another day.
    firsts = s.daily_first(whole.select("order_id", "source_id", "ts"), ["order_id"], forget=False)
    rows = w.source_rows(_timed(whole), buyers, firsts.filter(F.col("last_day").isNull()), EVENT)
    return s.tumbling(rows, ["source_id"], summed(*w.TRADE_MEASURES), width)


def course_orders(compacted: DataFrame, width: str = WINDOW) -> DataFrame:
    rows = compacted.withColumn(EVENT, as_instant("ts"))
    return s.tumbling_sums(rows, ["course_id"], {"order_total_amount": money("final_amount")}, s.LATE, width)


def paper_exams(exams: DataFrame, width: str = WINDOW) -> DataFrame:
    return s.tumbling(_timed(exams), ["paper_id"], w.exam_measures(), width)


def paper_scores(exams: DataFrame, width: str = WINDOW) -> DataFrame:
    return s.tumbling(_timed(w.banded(exams)), ["paper_id", "score_duration"], w.score_measures(), width)


def question_answers(answers: DataFrame, width: str = WINDOW) -> DataFrame:
    return s.tumbling(_timed(answers), ["question_id"], w.answer_measures(), width)


def course_reviews(reviews: DataFrame, width: str = WINDOW) -> DataFrame:
    return s.tumbling(_timed(reviews), ["course_id"], w.review_measures(), width)
