"""Golden rows for each branch, and the same answers when every key counts as hot."""

import datetime as dt
import random

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.operators import joins, keyed, neighbours, sessions, skew
from lectern.operators.windows import summed, tumbling

DAY0 = dt.datetime(2024, 1, 1)
HOT = [10**6, 2, 1]  # rows that make a key hot: none, some, every key


def at(seconds=0.0, days=0):
    return DAY0 + dt.timedelta(days=days, seconds=seconds)


@pytest.mark.parametrize("hot", HOT)
def test_bounces_golden(spark, hot):
    log = spark.createDataFrame([
        ("101", "home", None, at(10)), ("102", "home", None, at(12)), ("102", "good_list", None, at(15)),
        ("102", "good_list", "detail", at(30)),
        ("a", "home", None, at(0)), ("a", "list", "home", at(9.999)),           # went on: no bounce
        ("b", "home", None, at(0)), ("b", "list", "home", at(10)),              # exactly the bound: bounce
        ("c", "home", None, at(0)), ("c", "home", None, at(5)), ("c", "x", "home", at(6)),
    ], "mid string, page_id string, last_page_id string, ts timestamp_ntz")
    got = rows(keyed.bounces(log, ["page_id"], hot_rows=hot, slice_seconds=4), "mid", "ts")
    assert got == sorted([("101", at(10)), ("102", at(12)), ("102", at(15)), ("b", at(0)), ("c", at(0))])


@pytest.mark.parametrize("hot", HOT)
def test_flag_repair_golden(spark, hot):
    log = spark.createDataFrame([
        ("a", "1", at(1)), ("a", "1", at(2)), ("a", "1", at(0, 1)),              # next day: repaired
        ("b", "0", at(1)), ("b", "1", at(2)),                                    # known before: repaired
        ("c", "0", at(1)), ("c", "0", at(2)),
    ], "mid string, is_new string, ts timestamp_ntz")
    got = rows(keyed.repair_new_flag(log, hot_rows=hot, salts=3), "mid", "ts", "is_new")
    assert got == [("a", at(1), "1"), ("a", at(2), "1"), ("a", at(0, 1), "0"), ("b", at(1), "0"), ("b", at(2), "0"),
                   ("c", at(1), "0"), ("c", at(2), "0")]


def test_daily_unique_visitor(spark):
    log = spark.createDataFrame([
        ("a", None, at(5)), ("a", None, at(3)), ("a", "home", at(1)), ("a", None, at(1, 1)),
    ], "mid string, last_page_id string, ts timestamp_ntz")
    assert rows(keyed.unique_visitors(log, []), "ts") == [(at(3),), (at(1, 1),)]


def test_latest_version(spark):
    df = spark.createDataFrame([
        ("1", 5, "x"), ("1", 7, "y"), ("2", 1, "a"), ("2", 1, "b"), (None, 9, "t"),
    ], "id string, v int, body string")
    once = keyed.latest_version(df, ["id"], "v")
    assert rows(once) == [("1", 7, "y"), ("2", 1, "b")]
    assert rows(keyed.latest_version(once, ["id"], "v")) == rows(once)


def test_login_returns(spark):
    df = spark.createDataFrame([
        ("a", at(3600)), ("a", at(7200)), ("a", at(10, 1)),
        ("b", at(3600)), ("b", at(0, 7)),                      # seven days to the midnight: not returning
        ("c", at(3600)), ("c", at(0.001, 7)),                  # a millisecond more: returning
    ], "user_id string, ts timestamp_ntz")
    got = rows(keyed.login_days(df, "user_id"), "user_id", "ts", "back_count")
    assert got == [("a", at(3600), 0), ("a", at(10, 1), 0), ("b", at(3600), 0), ("b", at(0, 7), 0),
                   ("c", at(3600), 0), ("c", at(0.001, 7), 1)]


def test_new_buyers(spark):
    df = spark.createDataFrame([("u", at(5)), ("u", at(9)), ("u", at(1, 1))], "user_id string, ts timestamp_ntz")
    assert rows(keyed.buyer_days(df)) == [("u", at(5), 1, 1), ("u", at(1, 1), 1, 0)]


def test_first_flag(spark):
    df = spark.createDataFrame([
        ("o", 3, at(50)), ("o", 1, at(7)), ("o", 2, at(7)), ("o", 4, at(1, 1)), ("p", 1, at(0)),
    ], "k string, id int, ts timestamp_ntz")
    daily = keyed.flag_first(df, ["k"], "ts", ["id"], "f")
    assert rows(daily.filter("f = 1"), "k", "id") == [("o", 1), ("o", 4), ("p", 1)] and daily.count() == 5
    ever = keyed.flag_first(df, ["k"], "ts", ["id"], "f", per_day=False)
    assert rows(ever.filter("f = 1"), "k", "id") == [("o", 1), ("p", 1)] and ever.count() == 5


@pytest.mark.parametrize("hot", HOT)
def test_play_sessions(spark, hot):
    df = spark.createDataFrame([
        ("s", "v1", 1, 10, at(0)), ("s", "v2", 2, 20, at(2)), ("s", "v3", 4, 30, at(5)),   # gaps 2 s and 3 s: one session
        ("s", "v4", 8, 40, at(9)),                                                         # 4 s: a new one
        ("t", "v5", 1, 7, at(1)),
    ], "sid string, video_id string, play_sec int, position_sec int, ts timestamp_ntz")
    got = rows(sessions.play_sessions(df, hot_rows=hot, slice_seconds=3), "sid", "video_id", "play_sec", "position_sec", "ts")
    assert got == [("s", "v1", 7, 30, at(0)), ("s", "v4", 8, 40, at(9)), ("t", "v5", 1, 7, at(1))]


@pytest.mark.parametrize("hot", HOT)
def test_neighbours_match_plain_window(spark, hot):
    rng = random.Random(3)
    data = [(rng.choice("aaaaab"), i, at(rng.randrange(500))) for i in range(300)] + [(None, 900 + i, at(i)) for i in range(5)]
    df = spark.createDataFrame(data, "k string, id int, ts timestamp_ntz")
    got = rows(neighbours.with_neighbours(df, ["k"], "ts", ["id"], {"p": "id"}, {"n": "id"}, hot, 20), "k", "id", "p", "n")
    want = []
    for key in {d[0] for d in data}:
        ids = [d[1] for d in sorted((d for d in data if d[0] == key), key=lambda d: (d[2], d[1]))]
        want += [(key, i, p, n) for p, i, n in zip([None, *ids], ids, [*ids[1:], None])]
    assert got == sorted(want, key=lambda t: tuple((v is None, str(v)) for v in t))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_plain_join(spark, how):
    facts = spark.createDataFrame([("hot" if i % 3 else None if i % 2 else str(i), i) for i in range(200)], "k string, id int")
    dims = spark.createDataFrame([("hot", "H"), ("0", "Z"), ("4", "Y")], "k string, name string")
    got = skew.join_unique(facts, dims, ["k"], ["id"], how, hot_rows=10, salts=7)
    assert rows(got, "k", "id", "name") == rows(facts.join(dims, "k", how), "k", "id", "name")


def test_order_facts(spark):
    details = spark.createDataFrame([("d1", "o1", at(0)), ("d2", "o1", at(1)), ("d3", "none", at(0))], "id string, order_id string, ts timestamp_ntz")
    orders = spark.createDataFrame([("o1", "s1", "7")], "id string, session_id string, province_id string") \
        .withColumns({"out_trade_no": F.lit("n"), "trade_body": F.lit("b")})
    log = spark.createDataFrame([("s1", "order", "3", at(1)), ("s1", "order", "4", at(2)), ("s1", "home", "5", at(3))],
                                "sid string, page_id string, sc string, ts timestamp_ntz")
    facts = joins.order_details(details, orders, log)
    assert rows(facts, "id", "province_id", "source_id") == [("d1", "7", "4"), ("d2", "7", "4")]
    pay = spark.createDataFrame([("o1", at(905))], "order_id string, ts timestamp_ntz").withColumns(
        {c: F.lit(c) for c in ("alipay_trade_no", "payment_type", "payment_status", "callback_content", "callback_time")})
    assert rows(joins.paid_details(facts, pay), "id", "ts") == [("d1", at(905)), ("d2", at(905))]
    assert rows(joins.paid_details(facts, pay, within_seconds=904), "id") == [("d2",)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 300_000)), min_size=1, max_size=30))
def test_unique_counts_and_window_totals(spark, data):
    df = spark.createDataFrame([(k, at(s)) for k, s in data], "mid string, ts timestamp_ntz")
    days = {(k, at(s).date()) for k, s in data}
    assert keyed.first_times(df, ["mid"], "ts").count() == len(days)
    total = tumbling(df.withColumn("n", F.lit(1)), [], summed("n")).agg(F.sum("n")).first()[0]
    assert total == len(data)
