"""Fact joins and dimension lookups.

No join here forces a broadcast. Dimension tables are small in most installations and Spark
broadcasts them by their measured size; where one grows past the limit the same plan shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.timefn import date_text, micros
from lectern.operators.skew import SALTS, join_unique
from lectern.operators.split import order_pages
from lectern.sources.schemas import DEVICE_FIELDS


def session_sources(page_log: DataFrame) -> DataFrame:
    """One source per session, from its last order page; one row per session however many pages."""
    pages = order_pages(page_log).filter(F.col("sid").isNotNull())
    last = F.max(F.struct("ts", F.col("sc").alias("source_id"))).alias("_last")
    return pages.groupBy(F.col("sid").alias("session_id")).agg(last).select(
        "session_id", F.col("_last.source_id").alias("source_id")
    )


def order_details(
    details: DataFrame,
    orders: DataFrame,
    page_log: DataFrame,
    hot_rows: int | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Order details with their order (inner) and the session's source (left).

    The source is joined to the orders, which are fewer than the details. With ``hot_rows`` hot keys are salted.
    Buyer and time come from the order where the details lack them.
    """
    sourced = join_unique(orders, session_sources(page_log), ["session_id"], ["id"], "left",
                          hot_rows=hot_rows, salts=salts)
    head = sourced.select(
        F.col("id").alias("order_id"), "out_trade_no", "trade_body", "session_id", "province_id", "source_id",
        *[c for c in ("user_id", "ts") if c in orders.columns and c not in details.columns],
    )
    return join_unique(details, head, ["order_id"], ["id"], "inner", hot_rows=hot_rows, salts=salts)


def paid_details(
    details: DataFrame,
    payments: DataFrame,
    within_seconds: int = 905,
    detail_ts: str = "ts",
    pay_ts: str = "ts",
    hot_rows: int | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Order details joined to their successful payments no later than ``within_seconds``."""
    paid = payments.select(
        "order_id", "alipay_trade_no", "payment_type", "payment_status", "callback_content",
        "callback_time", F.col(pay_ts).alias("_pay_ts"),
    )
    joined = join_unique(details, paid, ["order_id"], ["id"], "inner", hot_rows=hot_rows, salts=salts)
    lag = micros("_pay_ts") - micros(detail_ts)
    timely = joined.filter(lag.between(0, within_seconds * 1_000_000))
    return timely.withColumn("ts", F.col("_pay_ts")).drop("_pay_ts")


def devices(log: DataFrame) -> DataFrame:
    """One row per logged-in user: the device columns of the user's last log row."""
    columns = [F.col(c).alias(n) for n, c in DEVICE_FIELDS.items() if n != "user_id"]
    last = F.max(F.struct("ts", *columns)).alias("_last")
    return log.filter(F.col("uid").isNotNull()).groupBy(F.col("uid").alias("user_id")).agg(last).select(
        "user_id", *[F.col("_last")[n].alias(n) for n in DEVICE_FIELDS if n != "user_id"]
    )


def registrations(users: DataFrame, log: DataFrame, hot_rows: int | None = None, salts: int = SALTS) -> DataFrame:
    """New users with the device they were seen on (left)."""
    known = users.select(
        F.col("id").alias("user_id"), F.col("create_time").alias("register_time"),
        date_text("create_time").alias("register_date"), "ts",
    )
    joined = join_unique(known, devices(log), ["user_id"], ["ts"], "left", hot_rows=hot_rows, salts=salts)
    return joined.select("user_id", "register_time", "register_date",
                         *[n for n in DEVICE_FIELDS if n != "user_id"], "ts")


def lookup(facts: DataFrame, dim: DataFrame, on: dict[str, str], take: dict[str, str]) -> DataFrame:
    """Left join to a dimension: rows without a match keep nulls.

    ``on`` maps fact columns to dimension columns (several for a composite key); ``take`` maps new
    columns to dimension columns. Call it after aggregating, when there are fewest rows.
    """
    keys = [F.col(d).alias(f"_k{i}") for i, d in enumerate(on.values())]
    right = dim.select(*keys, *[F.col(d).alias(n) for n, d in take.items()])
    condition = None
    for i, f in enumerate(on):
        same = facts[f] == right[f"_k{i}"]
        condition = same if condition is None else condition & same
    return facts.join(right, condition, "left").drop(*[f"_k{i}" for i in range(len(on))])
