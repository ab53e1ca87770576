"""Splitting the behaviour log and flattening its records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.timefn import date_text, datetime_text, from_millis

RECORD = ["common", "page", "start", "appVideo", "displays", "actions", "ts"]


def split_log(log: DataFrame) -> dict[str, DataFrame]:
    """Parsed log -> ``error, start, video, page, display, action``.

    A record's error part goes to ``error`` and the record goes on without it. A record with
    ``start`` is a start, else one with ``appVideo`` a play, else a page; only pages give displays
    and actions, one row each.
    """
    is_start = F.col("start").isNotNull()
    is_video = ~is_start & F.col("appVideo").isNotNull()
    pages = log.filter(~is_start & ~is_video)
    return {
        "error": log.filter(F.col("err").isNotNull()).select("err"),
        "start": log.filter(is_start).select(*RECORD),
        "video": log.filter(is_video).select(*RECORD),
        "page": pages.select("common", "page", "ts"),
        "display": pages.select(F.explode("displays").alias("display"), "common", "page", "ts"),
        "action": pages.select(F.explode("actions").alias("action"), "common", "page", "ts"),
    }


def flat_pages(pages: DataFrame, tz: str = "UTC") -> DataFrame:
    """Page records as one flat row: ``common.*, page.*, ts`` with ``ts`` a wall-clock time."""
    return pages.select("common.*", "page.*", from_millis("ts", tz).alias("ts"))


def flat_plays(plays: DataFrame, tz: str = "UTC") -> DataFrame:
    """Play records as one flat row of device, video and time columns."""
    return plays.filter(F.col("common").isNotNull() & F.col("appVideo").isNotNull()).select(
        "common.*", "appVideo.*", from_millis("ts", tz).alias("ts")
    )


# Columns of the login facts and the log columns they come from.
LOGIN_FIELDS = {
    "channel": "ch", "province_id": "ar", "version_code": "vc", "mid_id": "mid", "brand": "ba",
    "model": "md", "source_id": "sc", "operating_system": "os",
}


def login_facts(first_rows: DataFrame) -> DataFrame:
    """First logged-in rows -> login facts."""
    return first_rows.select(
        F.col("uid").alias("user_id"), date_text("ts").alias("date_id"),
        datetime_text("ts").alias("login_time"),
        *[F.col(c).alias(n) for n, c in LOGIN_FIELDS.items()], "ts",
    )


# Page ids the traffic and order jobs look for.
VIEW_PAGES = ["home", "course_list", "course_detail"]
ORDER_PAGE = "order"
KEYWORD_ITEM = "keyword"


def entry_pages(pages: DataFrame) -> DataFrame:
    """The pages that start a visit."""
    return pages.filter(F.col("last_page_id").isNull())


def view_pages(pages: DataFrame) -> DataFrame:
    """The home, list and detail pages."""
    return pages.filter(F.col("page_id").isin(*VIEW_PAGES))


def order_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("page_id") == ORDER_PAGE)


def searches(pages: DataFrame) -> DataFrame:
    """Pages on which a keyword was searched, as ``full_word, ts``."""
    hit = F.col("item").isNotNull() & (F.col("item_type") == KEYWORD_ITEM)
    return pages.filter(hit).select(F.col("item").alias("full_word"), "ts")
