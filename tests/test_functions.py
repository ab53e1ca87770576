import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from lectern.functions import measures, text, timefn


def test_score_bands_at_their_bounds(spark):
    df = spark.createDataFrame([(s,) for s in (-1.0, 0.0, 59.9, 60.0, 70.0, 80.0, 90.0, 100.0, 100.5)], "s double")
    got = [r[0] for r in df.orderBy("s").select(measures.score_band("s")).collect()]
    assert got == ["[0,60)"] * 3 + ["[60,70)", "[70,80)", "[80,90)", "[90,100]", "[90,100]", ""]


def test_keyword_weights(spark):
    df = spark.createDataFrame([("SEARCH",), ("ORDER",), ("CART",), ("CLICK",), ("other",), (None,)], "s string")
    assert [r[0] for r in df.select(measures.keyword_weight("s")).collect()] == [10, 5, 2, 1, 0, 0]


def test_epoch_numbers_and_zones(spark):
    df = spark.createDataFrame([(1_700_000_000_123,)], "ms long")
    got = df.select(
        timefn.from_millis("ms").alias("utc"), timefn.from_millis("ms", "Asia/Shanghai").alias("local"),
        timefn.to_millis(timefn.from_millis("ms", "Asia/Shanghai"), "Asia/Shanghai").alias("back"),
        timefn.date_text_to_millis(F.lit("2023-11-15"), "Asia/Shanghai").alias("midnight"),
    ).first()
    assert got.utc == dt.datetime(2023, 11, 14, 22, 13, 20, 123000)
    assert got.local == dt.datetime(2023, 11, 15, 6, 13, 20, 123000)
    assert got.back == 1_700_000_000_123
    assert got.midnight == 1_699_977_600_000


def test_times_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([(1_700_000_000_123,)], "ms long")
    expr = timefn.from_micros(F.unix_micros(timefn.as_instant(timefn.from_millis("ms"))))
    here = df.select(expr).first()[0]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert df.select(expr).first()[0] == here == dt.datetime(2023, 11, 14, 22, 13, 20, 123000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_version_text_compares_by_time(spark):
    df = spark.createDataFrame([("2022-04-01 11:10:55.04Z", "2022-04-01 11:10:55.039Z")], "a string, b string")
    assert df.select(timefn.is_newer_version("a", "b"), timefn.is_newer_version("b", "a")).first()[:] == (True, False)


def test_words_of_mixed_text(spark):
    df = spark.createDataFrame([("Spark 3.5, 数据 Spark!",), ("...",)], "t string")
    got = [r[0] for r in df.select(text.words("t")).collect()]
    assert got == [["spark", "3", "5", "数据", "spark"], []]


def test_digest_has_ten_digits(spark):
    df = spark.createDataFrame([("abc",)], "t string")
    assert rows(df.select(text.short_digest("t"))) == [("900150983c",)]
    assert rows(df.select(timefn.hour_label(F.lit(7)))) == [("07",)]
