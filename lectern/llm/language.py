"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import hashed_share, query, table
from lectern.llm.tokens import text_blocks

#: Hash buckets of n-grams, and the longest n-gram.
BUCKETS, LONGEST = 1 << 15, 3
#: Texts that the weights are fitted on, dealt evenly to the languages; of these, the share kept for the temperature.
SAMPLE_ROWS, CALIBRATION = 4096, 0.2
#: Most languages that a table may name.
MOST_LANGUAGES = 1024
#: Follow-the-regularised-leader: step, smoothing, elastic net; texts in a step, passes.
ALPHA, BETA, L1, L2, BATCH, PASSES = 0.5, 1.0, 1e-4, 1e-4, 64, 6
UNKNOWN = "und"


def gram_buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, bool]]:
    """Of each whole text the buckets of its n-grams, repeats included, and whether it has a letter.

    Letters count in lower case; everything between two runs of letters is one space.
    """
    for low, high in text_blocks(texts):
        some = [f" {t.lower()} " for t in texts[low:high]]
        codes = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = np.flatnonzero(np.bincount(codes))
        letter = np.zeros(int(codes.max()) + 1, bool)
        letter[seen] = [chr(c).isalpha() for c in seen.tolist()]
        codes = np.where(letter[codes], codes, 0).astype(np.uint64)
        ends = np.cumsum([len(t) for t in some])
        for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
            c = codes[a:b]
            c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]
            gram, out = c, [c[c != 0]]
            for n in range(2, LONGEST + 1):
                gram = gram[:-1] * np.uint64(0x110000) + c[n - 1 :]
                out.append(gram + np.uint64(n << 62 & (1 << 64) - 1))
            grams = np.concatenate(out) * np.uint64(0x9E3779B97F4A7C15)
            yield (grams >> np.uint64(64 - 15)).astype(np.int64) % BUCKETS, bool((c != 0).any())


def _features(buckets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text's TF-IDF vector of length one: places and values."""
    counts = np.bincount(buckets, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    return at, x / (np.linalg.norm(x) or 1.0)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def scores(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray, languages: list[str], idf: np.ndarray) -> LanguageModel:
    """Weights by follow-the-regularised-leader with an elastic net, a step for each ``BATCH`` of rows; the bias is free of it."""
    k = len(languages)
    z, n, w = (np.zeros((BUCKETS + 1, k)) for _ in range(3))
    order = np.random.default_rng(42)
    for _ in range(PASSES):
        for batch in np.array_split(order.permutation(len(rows)), max(1, len(rows) // BATCH)):
            gradient = np.zeros_like(w)
            for i in batch:
                at, x = rows[i]
                error = softmax(x @ w[at] + w[-1])
                error[wanted[i]] -= 1
                gradient[at] += x[:, None] * error
                gradient[-1] += error
            sigma = (np.sqrt(n + gradient**2) - np.sqrt(n)) / ALPHA
            z += gradient - sigma * w
            n += gradient**2
            size = np.r_[np.full(BUCKETS, L1 * len(batch)), 0.0][:, None]
            w = np.where(np.abs(z) <= size, 0.0, -(z - np.sign(z) * size) / ((BETA + np.sqrt(n)) / ALPHA + L2 * len(batch)))
    return LanguageModel(languages, idf, w[:-1], w[-1])


def calibrate(model: LanguageModel, rows: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray) -> float:
    """The temperature under which held-back rows are likeliest, by golden section over its logarithm."""
    if not rows:
        return 1.0
    scores = np.array([model.scores(*r) for r in rows])
    loss = lambda t: -np.log(np.maximum(softmax(scores / np.exp(t))[np.arange(len(rows)), wanted], 1e-12)).mean()
    low, high, gold = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - gold * (high - low), low + gold * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(texts: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """A model of the languages of the rows whose text and language are not null; None if there are no such rows.

    Document frequencies are counted over all rows, in the tasks that read them. Weights and temperature are fitted on
    the driver to at most about ``sample_rows`` rows, chosen by the hash of the key and dealt evenly to the languages.
    """
    rows = texts.where(F.col(f"`{text}`").isNotNull() & F.col(f"`{language}`").isNotNull()).select(
        F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{language}`").alias("lang")
    )
    by_language = rows.groupBy("lang").count()
    sizes = by_language.orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if not sizes:
        return None
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")

    def frequencies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for frame in frames:
            for buckets, _ in gram_buckets(frame["text"].tolist()):
                here = np.zeros(BUCKETS, bool)
                here[buckets] = True
                total += here
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    counted = rows.select("text").mapInPandas(frequencies, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(BUCKETS)
    frequency[counted["bucket"]] = counted["n"]
    idf = np.log((1 + sum(r["count"] for r in sizes)) / (1 + frequency)) + 1

    def counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [np.unique(b, return_counts=True) for b, _ in gram_buckets(frame["text"].tolist())]
            yield pd.DataFrame({"key": frame["key"], "lang": frame["lang"], "at": [a.astype("<i4").tobytes() for a, _ in found], "n": [n.astype("<i4").tobytes() for _, n in found]})

    each = sample_rows / len(sizes)
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, each / r["count"]))) for r in sizes])
    sample = rows.where(hashed_share(F.col("key"), share)).mapInPandas(counts, "key string, lang string, at binary, n binary").toPandas()
    sample = sample.sort_values(["key", "lang", "at", "n"], na_position="first").reset_index(drop=True)
    languages = [r["lang"] for r in sizes]
    wanted = sample["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy()
    vectors = []
    for at, n in zip(sample["at"], sample["n"], strict=True):
        at = np.frombuffer(at, "<i4")
        x = np.log1p(np.frombuffer(n, "<i4")) * idf[at]
        vectors.append((at, (x / (np.linalg.norm(x) or 1.0)).astype(np.float32)))
    held = np.random.default_rng(7).random(len(vectors)) < CALIBRATION
    fitted = [v for v, h in zip(vectors, held, strict=True) if not h]
    model = fit_ftrl(fitted, wanted[~held], languages, idf)
    model.temperature = calibrate(model, [v for v, h in zip(vectors, held, strict=True) if h], wanted[held])
    return model


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """Columns ``row`` (the input row), lang_pred and score (the calibrated probability of lang_pred) of every whole text.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if there is no model. Nothing but
    the text plays a part. Repeated rows have a row each; an empty table gives an empty table; extra columns, of any
    name, come back inside ``row``.
    """
    packed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    guess = F.pandas_udf(_guesser(model), "lang_pred string, score double")
    return packed.select("row", guess("text").alias("guess")).select("row", "guess.*")


def _guesser(model: LanguageModel | None):
    def guesses(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            names, scores = [], []
            for buckets, letters in gram_buckets(texts.fillna("").tolist()):
                if not letters or model is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                likely = softmax(model.scores(*_features(buckets, model.idf)) / model.temperature)
                best = int(likely.argmax())
                names.append(model.languages[best])
                scores.append(min(1.0, float(likely[best])))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    guesses.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return guesses


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


@query("op9_language_id")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
