"""Toxicity grades by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import hashed_share, query, stored, table

#: Labelled texts that the model is fitted on, and features that it may use.
SAMPLE_ROWS, FEATURES = 10_000, 4096
#: A word's features: itself and its first letters, which words of one stem share.
PREFIXES = (4, 5, 6)
#: Likelihood ratio (in nats) that a feature must reach, so that few of 100,000 candidates are chosen by chance.
LEAST_RATIO = 6.0
#: Texts that a feature must be in; grades of toxic texts, by how much of what marks toxic texts they hold.
LEAST_TEXTS, TOXIC_GRADES = 3, 3
#: Ridge penalty per text, steps of the fit.
RIDGE, STEPS, RATE = 1e-5, 400, 0.05
#: Words that a task remembers the features of.
WORDS = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def text_features(text: str | None, known: dict[str, int], remembered: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of the known features in the whole text, in lower case."""
    found: Counter[int] = Counter()
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        places = remembered.get(word)
        if places is None:
            if len(remembered) >= WORDS:
                remembered.clear()
            places = remembered[word] = [known[f] for f in word_features(word) if f in known]
        for p in places:
            found[p] += n
    at = np.fromiter(found.keys(), np.int64, len(found))
    return at, np.fromiter(found.values(), np.float64, len(found))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class SeverityModel:
    """P(grade > k) = sigmoid(features · weights - cuts[k]): one set of weights for all ascending cuts."""

    known: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return sigmoid(np.log1p(n) @ self.weights[at] - self.cuts)


def fit_cumulative(rows: np.ndarray, at: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts of the proportional-odds model, by Adam on all rows; (rows, at, values) are the sparse features."""
    n = len(grades)
    weights, cuts, gaps = np.zeros(n_features), 0.0, np.zeros(n_grades - 2)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (weights, np.zeros(1), gaps)]
    levels = np.arange(n_grades)
    for step in range(1, STEPS + 1):
        bounds = cuts + np.r_[0.0, np.cumsum(np.exp(gaps))]
        score = np.bincount(rows, values * weights[at], minlength=n)
        # P(grade = k) is the difference of two sigmoids; beyond the ends they are 1 and 0
        upper = np.c_[np.ones(n), sigmoid(score[:, None] - bounds), np.zeros(n)]
        p = np.maximum(upper[np.arange(n), grades] - upper[np.arange(n), grades + 1], 1e-12)
        slope = upper * (1 - upper)
        d_score = -(slope[np.arange(n), grades] - slope[np.arange(n), grades + 1]) / p / n
        d_bounds = np.array([((grades == k + 1) * slope[:, k + 1] / p - (grades == k) * slope[:, k + 1] / p).sum() / n for k in levels[:-1]])
        gradient = (
            np.bincount(at, values * d_score[rows], minlength=n_features) + RIDGE * weights,
            np.array([d_bounds.sum()]),
            np.array([d_bounds[k + 1 :].sum() for k in range(n_grades - 2)]) * np.exp(gaps),
        )
        moved = []
        for (m, v), g in zip(state, gradient, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            moved.append(RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
        weights, cuts, gaps = weights - moved[0], cuts - float(moved[1][0]), gaps - moved[2]
    return weights, cuts + np.r_[0.0, np.cumsum(np.exp(gaps))]


def train(labelled: DataFrame, text: str = "text", grade: str = "grade", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> SeverityModel | None:
    """A model of integer grades from 0 (harmless) up; None if not both harmless and other rows are there, or nothing tells them apart.

    ``labelled`` has a row for each labelled text. Grades may be 0 and 1 only: the texts of grade 1 are then dealt to
    ``TOXIC_GRADES`` equal parts by how often they hold features that mark them out, so that there is an order to learn.
    Features are counted in tasks over a sample of about ``sample_rows`` rows, chosen by the hash of the key; the
    ``FEATURES`` that tell grades 0 and above apart best (likelihood ratio) are fitted on the driver. Rows whose text or
    grade is null are not learned from.
    """
    rows = labelled.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{grade}`").cast("int").alias("grade")).where(
        "text IS NOT NULL AND grade IS NOT NULL"
    )
    rows = stored(rows, "labelled")
    total = rows.count()
    if not total:
        return None
    rows = rows.where(hashed_share(F.col("key"), min(1.0, sample_rows / total)))

    def seen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        for frame in frames:
            for words, toxic in zip(frame["text"], frame["grade"] > 0, strict=True):
                counts[bool(toxic)].update({f for w in set(_WORD.findall(words.lower())) for f in word_features(w)})
        names = sorted(counts[0].keys() | counts[1].keys())
        for low in range(0, len(names), 10_000):
            some = names[low : low + 10_000]
            yield pd.DataFrame({"feature": pd.Series(some, dtype=object), "clean": [counts[0][f] for f in some], "toxic": [counts[1][f] for f in some]})

    both = rows.agg(F.sum((F.col("grade") == 0).cast("long")).alias("clean"), F.sum((F.col("grade") > 0).cast("long")).alias("toxic")).first()
    if not both["clean"] or not both["toxic"]:
        return None
    c, t = F.col("clean").cast("double"), F.col("toxic").cast("double")
    share = (c + t) / float(both["clean"] + both["toxic"])
    term = lambda n, whole: F.when(n > 0, n * F.log(n / (whole * share))).otherwise(0.0) + F.when(n < whole, (whole - n) * F.log((whole - n) / (whole * (1 - share)))).otherwise(0.0)
    counted = (
        rows.mapInPandas(seen, "feature string, clean bigint, toxic bigint")
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where((c + t >= LEAST_TEXTS) & (share < 1))
        .withColumn("ratio", term(c, F.lit(float(both["clean"]))) + term(t, F.lit(float(both["toxic"]))))
        .where(F.col("ratio") >= LEAST_RATIO)
        .orderBy(F.desc("ratio"), "feature")
        .limit(FEATURES)
        .toPandas()
    )
    known = {f: i for i, f in enumerate(counted["feature"])}

    def sparse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        remembered: dict[str, list[int]] = {}
        for frame in frames:
            found = [text_features(x, known, remembered) for x in frame["text"]]
            yield pd.DataFrame({"key": frame["key"], "grade": frame["grade"], "at": [a.astype("<i4").tobytes() for a, _ in found], "n": [n.astype("<i4").tobytes() for _, n in found]})

    sample = rows.mapInPandas(sparse, "key string, grade int, at binary, n binary").toPandas().sort_values(["key", "at"], na_position="first").reset_index(drop=True)
    at = [np.frombuffer(x, "<i4") for x in sample["at"]]
    n = [np.frombuffer(x, "<i4") for x in sample["n"]]
    grades = sample["grade"].to_numpy().clip(0)
    if grades.max() == 1:
        marks = ((counted["toxic"] / both["toxic"]) > 4 * (counted["clean"] + 0.5) / both["clean"]).to_numpy()
        held = np.array([float(v[marks[a]].sum()) for a, v in zip(at, n, strict=True)])
        toxic = grades > 0
        steps = np.quantile(held[toxic], np.arange(1, TOXIC_GRADES) / TOXIC_GRADES)
        grades = np.where(toxic, 1 + (held[:, None] > steps).sum(axis=1), 0)
    grades = np.unique(grades, return_inverse=True)[1]
    owner = np.repeat(np.arange(len(at)), [len(a) for a in at])
    flat_at, flat_n = np.concatenate(at), np.concatenate(n)
    if not known:
        return None
    weights, cuts = fit_cumulative(owner, flat_at, np.log1p(flat_n), grades, len(known), int(grades.max()) + 1)
    return SeverityModel(known, weights, cuts)


def grade_texts(docs: DataFrame, model: SeverityModel | None, text: str = "text") -> DataFrame:
    """Columns ``row`` (the input row), severity (the expected grade), p_toxic (the chance of a grade above 0) and grade
    (the number of cuts that are likelier passed than not) of every whole text.

    A null text is as an empty one: it has no features, and its severity is what the cuts alone give. Without a model all
    three are 0. Repeated rows have a row each; an empty table gives an empty table; extra columns, of any name, come
    back inside ``row``.
    """
    packed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    judge = F.pandas_udf(_judge(model), "severity double, p_toxic double, grade int")
    return packed.select("row", judge("text").alias("found")).select("row", "found.*")


def _judge(model: SeverityModel | None):
    def judged(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        remembered: dict[str, list[int]] = {}
        for texts in series:
            above = [model.above(*text_features(t, model.known, remembered)) if model else np.zeros(1) for t in texts.fillna("")]
            yield pd.DataFrame({"severity": [float(a.sum()) for a in above], "p_toxic": [float(a[0]) for a in above], "grade": np.array([(a >= 0.5).sum() for a in above], np.int32)})

    judged.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return judged


def labelled_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, grade) of about ``sample_rows`` labelled documents, chosen by the hash of their id; of several labels
    of a document the gravest counts. The chosen labels are that many rows of two numbers, so they may be broadcast."""
    grades = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("grade"))
    total = max(1, labels.select("doc_id").distinct().count())
    chosen = grades.where(hashed_share(F.col("doc_id").cast("string"), min(1.0, sample_rows / total)))
    return docs.select("doc_id", "text").join(F.broadcast(stored(chosen, "grades")), "doc_id")


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Expected severity, chance of toxicity, grade and verdict of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train(labelled_documents(docs, table(spark, folder, "labels")))
    return grade_texts(docs, model).select("row.doc_id", "severity", "p_toxic", "grade", (F.col("grade") > 0).alias("toxic"))
