"""From raw documents to packed training sequences, in stages that are written and read again.

A stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of documents. Every stage
works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import language, lines, packing, simhash, toxicity
from lectern.llm.common import stored, table
from lectern.llm.tokens import public

#: A language that is less likely than this is no answer.
LEAST_SCORE = 0.5
#: Near copies: a Jaccard similarity of 0.8 or more of the shingles of five words, checked exactly. Pairs of just that
#: similarity must meet with this probability; their SimHash differs in 19 of 128 bits, with a deviation of 4.
WORDS, SIMILARITY, WIDTH, RADIUS, RECALL = 5, 0.8, 128, 28, 0.99


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (null and empty ones too) and texts of no clear language.

    The model learns from the documents' own lang. If no document has one, none is rejected.
    """
    model = language.train(docs)
    if model is None:
        return docs
    found = language.identify(docs, model)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose grade is above 0. The model learns from labels; without any, none is rejected."""
    model = toxicity.train(toxicity.labelled_documents(docs, table(spark, sf_dir, "labels")))
    return toxicity.grade_texts(docs, model).where("grade = 0").select("row.*")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that recur over a source's documents; n_chars follows. Documents stay, if only as empty texts.

    Copies of a text count once, since copies are the next stage's matter and one of them has to stay whole.
    """
    found = lines.drop_site_lines(docs, copies_once=True)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("row.n_chars").isNotNull(), F.char_length("text").cast("long"))}
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document with the smallest id, once if its row is repeated."""
    groups = simhash.near_copy_groups(docs, SIMILARITY, words=WORDS, width=WIDTH, radius=RADIUS, recall=RECALL)
    kept = stored(groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct(), "kept")
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").dropDuplicates()


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document's tokens and their places in sequences of at most 1024."""
    pieces = packing.token_pieces(docs, public("byte_bpe_50k.json"))
    return packing.best_fit(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("language_id", identify_language),
    ("toxicity", reject_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_near_copies),
    ("best_fit_packing", pack),
]

#: SQL can express neither the models nor the packing; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
