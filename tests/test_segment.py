"""Segmentation by a dictionary against all paths through the lattice."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions.segment import Lattice, segmenter, word_costs
from lectern.plans import windows as w


def every_path(run, costs, unknown):
    """The best of all ways to set bars into a run."""
    best = None
    for cuts in itertools.product([False, True], repeat=max(0, len(run) - 1)):
        ends = [i + 1 for i, cut in enumerate(cuts) if cut] + [len(run)]
        parts = [run[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        options = [[p for p in ((costs[x], f"|{x}|") if x in costs else None, (unknown, x) if len(x) == 1 else None) if p] for x in parts]
        for chosen in itertools.product(*options):
            found = (sum(c for c, _ in chosen), "".join(t for _, t in chosen))
            best = found if best is None or found < best else best
    return [x for x in best[1].split("|") if x]


def test_best_path_is_the_best_of_all():
    draw = random.Random(4)
    for _ in range(1500):
        costs = {"".join(draw.choice("ab") for _ in range(draw.randint(1, 4))): draw.randint(1, 6) for _ in range(draw.randint(0, 7))}
        run = "".join(draw.choice("abc") for _ in range(draw.randint(1, 9)))
        unknown = draw.randint(3, 8)
        assert Lattice(costs, unknown).best(run) == every_path(run, costs, unknown), (run, costs, unknown)


def test_a_very_long_run_is_cut_whole():
    lattice = Lattice({"ab": 1, "abc": 2}, 5)
    assert lattice.best("ab" * 20_000) == ["ab"] * 20_000
    assert lattice.best("x" * 20_000) == ["x" * 20_000]


def dictionary(spark, rows):
    return spark.createDataFrame(rows, "word string, cost int")


def test_text_without_spaces(spark):
    words = dictionary(spark, [("数据", 3), ("数据库", 4), ("学习", 3), ("在线", 3), ("在", 2), ("", 1), (None, 1), ("在线", 9), ("线", None)])
    cut = segmenter(words, 10)
    rows = [(1, "在线学习数据库 Spark4数据"), (2, None), (3, ""), (4, "?! "), (5, "未知词")]
    got = {r.id: r.w for r in spark.createDataFrame(rows, "id int, text string").select("id", cut("text").alias("w")).collect()}
    assert got == {1: ["在线", "学习", "数据库", "spark4", "数据"], 2: None, 3: [], 4: [], 5: ["未知词"]}


def test_the_keyword_job_takes_a_segmenter(spark):
    log = spark.createDataFrame([("机器学习入门",), ("学习机器",), (None,)], "item string").select(
        "item", F.lit("keyword").alias("item_type"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"))
    cut = segmenter(dictionary(spark, [("机器", 2), ("学习", 2), ("机器学习", 5)]), 9)
    counts = {r.keyword: r["count"] for r in w.keyword_rows(log, cut).groupBy("keyword").count().collect()}
    assert counts == {"机器": 2, "学习": 2, "入门": 1}


def test_rarer_words_cost_more_and_unknown_characters_most(spark):
    costs, unknown = word_costs(spark.createDataFrame([("often", 900), ("seldom", 1)], "word string, n bigint"))
    found = {r.word: r.cost for r in costs.collect()}
    assert 0 < found["often"] < found["seldom"] < unknown


def test_a_dictionary_beyond_its_bound_is_refused(spark):
    with pytest.raises(ValueError):
        segmenter(dictionary(spark, [("a", 1), ("b", 1), ("c", 1)]), 5, most_words=2)
    empty = segmenter(dictionary(spark, []), 5)
    assert spark.range(1).select(empty(F.lit("a b")).alias("w")).head().w == ["a", "b"]
