"""Language and toxicity models: held-out accuracy, calibration, odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import language, toxicity
from tests.llm.odd import LONG, documents, none

FOLDER = "/root/testdata/sf0.01"
STEMS = {"aa": ["lorun", "vesti", "mokan", "teril"], "bb": ["zhuk", "przed", "szcze", "wkrot"], "cc": ["aloha", "kanaka", "mele", "wahine"]}


def prose(draw, name, n):
    return " ".join("".join(draw.sample(STEMS[name], 2)) + draw.choice([",", ".", ""]) for _ in range(n))


def test_held_out_languages_of_the_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = language.op9(spark, FOLDER).join(docs, "doc_id").toPandas()
    assert len(found) == docs.count()
    held = found[found.held_out]
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() > 0.98
    assert found.score.between(0, 1).all()


def test_the_held_out_rows_lang_and_source_play_no_part(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = language.held_out(F.col("doc_id"))
    docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    docs.withColumn("lang", F.when(~out, F.col("lang")).otherwise("xx")).withColumn("source", F.lit("z")).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    first, second = (sorted(map(tuple, language.op9(spark, str(tmp_path / n)).collect())) for n in "ab")
    assert first == second


def test_languages_of_odd_rows(spark):
    draw = random.Random(1)
    rows = [(100 + i, prose(draw, name, draw.randrange(3, 40)), name, "s", 0) for i, name in enumerate(list(STEMS) * 40)]
    model = language.train(documents(spark, rows))
    odd = [(1, None), (2, ""), (3, " \n"), (4, "12 34 !?"), (5, prose(draw, "bb", 50)), (6, LONG), (7, prose(draw, "cc", 50).upper()), (7, prose(draw, "cc", 50).upper()), (None, "\U0001f600")]
    found = language.identify(documents(spark, [(i, t, "cc", "s", 0) for i, t in odd]), model)
    got = sorted((str(r.doc_id), r.lang_pred) for r in found.select("row.doc_id", "lang_pred").collect())
    assert got == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "und"), ("5", "bb"), ("6", got[5][1]), ("7", "cc"), ("7", "cc"), ("None", "und")]
    assert got[5][1] in STEMS
    assert {r.score for r in found.where("lang_pred = 'und'").collect()} == {0.0}
    assert (model.weights == 0).mean() > 0.5  # the elastic net leaves most weights at zero


def test_temperature_makes_scores_honest():
    draw = np.random.default_rng(0)
    at = np.arange(3)
    model = language.LanguageModel(["a", "b"], np.ones(3), np.array([[9.0, -9], [0, 0], [0, 0]]), np.zeros(2))
    wanted = (draw.random(4000) < 0.3).astype(int)  # a model that is too sure: its first answer is right 7 times of 10
    rows = [(at, np.array([1.0, 0, 0]))] * 4000
    model.temperature = language.calibrate(model, rows, wanted)
    assert abs(language.softmax(model.scores(*rows[0]) / model.temperature)[0] - 0.7) < 0.03


@pytest.mark.parametrize("rows", [[], [(1, "only this", "en", "s", 0)]])
def test_one_language_and_none(spark, rows):
    model = language.train(documents(spark, rows) if rows else none(spark))
    found = language.identify(documents(spark, [(1, "some text", None, None, None)]), model).collect()
    assert (found[0].lang_pred, found[0].score) == (("en", 1.0) if rows else ("und", 0.0))
    assert language.identify(none(spark), model).count() == 0


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError):
        language.train(documents(spark, [(1, "a", "x", "", 0), (2, "b", "y", "", 0)]))


def insulting(n, seed):
    draw, rows = random.Random(seed), []
    for i in range(n):
        words = [draw.choice(["calm", "river", "stone", "light", "walk", "table", "quiet"]) for _ in range(draw.randrange(10, 60))]
        grade = draw.choice([0, 0, 0, 1, 2])
        for _ in range({0: 0, 1: 1, 2: 6}[grade]):
            words[draw.randrange(len(words))] = draw.choice(["badword", "badwords", "vileness", "vilest"])
        rows.append((i, " ".join(words), grade))
    return rows


def test_held_out_toxicity(spark):
    rows = [(i, t, min(g, 1)) for i, t, g in insulting(900, 1)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id bigint, text string, grade int"))
    assert (np.diff(model.cuts) > 0).all() and len(model.cuts) == toxicity.TOXIC_GRADES
    fresh = insulting(400, 2)
    found = toxicity.grade_texts(spark.createDataFrame([(i, t, "clash") for i, t, _ in fresh], "doc_id bigint, text string, severity string"), model)
    got = {r.doc_id: r for r in found.select("row.doc_id", F.col("severity").alias("s"), "p_toxic", "grade").collect()}
    right = [(got[i].grade > 0) == ("badword" in t or "vile" in t) for i, t, _ in fresh]
    assert np.mean(right) > 0.99
    mild, severe = ([got[i].s for i, t, g in fresh if g == k] for k in (1, 2))
    assert np.mean(severe) > np.mean(mild) + 0.5  # expected severity follows the order


def test_graded_labels(spark):
    rows = insulting(900, 3)
    model = toxicity.train(spark.createDataFrame(rows, "doc_id bigint, text string, grade int"))
    assert len(model.cuts) == 2
    found = toxicity.grade_texts(spark.createDataFrame([(i, t) for i, t, _ in insulting(300, 4)], "doc_id bigint, text string"), model)
    got = {r.doc_id: r.grade for r in found.select("row.doc_id", "grade").collect()}
    assert np.mean([got[i] == g for i, _, g in insulting(300, 4)]) > 0.9


def test_gradient_of_the_cumulative_link(monkeypatch):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(2000, 2))
    latent = x @ [2.0, -1.0] + draw.logistic(size=2000)
    grades = np.digitize(latent, [-1.0, 1.0, 2.0])
    monkeypatch.setattr(toxicity, "STEPS", 2000)
    rows, at = np.repeat(np.arange(2000), 2), np.tile([0, 1], 2000)
    weights, cuts = toxicity.fit_cumulative(rows, at, x.ravel(), grades, 2, 4)
    assert np.allclose(weights, [2, -1], atol=0.2) and np.allclose(cuts, [-1, 1, 2], atol=0.25)


def test_toxicity_of_odd_rows(spark):
    rows = [(i, t, min(g, 1)) for i, t, g in insulting(300, 5)] + [(900, None, 1), (901, "x", None)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id bigint, text string, grade int"))
    odd = [(1, None), (2, ""), (3, "123 !!"), (4, LONG + " badword"), (5, "VILEST"), (5, "VILEST"), (None, "calm")]
    found = toxicity.grade_texts(documents(spark, [(i, t, "", "", 0) for i, t in odd]), model)
    got = sorted((str(r.doc_id), r.grade > 0) for r in found.select("row.doc_id", "grade").collect())
    assert got == [("1", False), ("2", False), ("3", False), ("4", True), ("5", True), ("5", True), ("None", False)]
    assert toxicity.grade_texts(none(spark), model).count() == 0


@pytest.mark.parametrize("rows", [[], [(1, "all fine", 0)], [(1, "all bad", 1)], [(1, "same", 0), (2, "same", 1)]])
def test_nothing_to_learn(spark, rows):
    model = toxicity.train(spark.createDataFrame(rows, "doc_id bigint, text string, grade int"))
    assert model is None
    found = toxicity.grade_texts(documents(spark, [(1, "text", "", "", 0)]), model).collect()
    assert (found[0].severity, found[0].p_toxic, found[0].grade) == (0.0, 0.0, 0)


def test_gravest_label_counts(spark):
    docs = documents(spark, [(1, "t", "", "", 0), (2, "u", "", "", 0), (3, "v", "", "", 0)])
    labels = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 1, None), (3, 1, 0), (9, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert sorted(map(tuple, toxicity.labelled_documents(docs, labels).collect())) == [(1, "t", 1), (3, "v", 0)]
