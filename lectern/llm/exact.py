"""Exact dedup by sorting contents, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import query, stored, table, tasks

#: Splitters are made of so many characters from the beginning of sampled texts, which the driver receives.
SPLITTER_CHARS = 64


def exact_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] = lambda t: t
) -> DataFrame:
    """One row per document: ``key``, keep_id, group_size (long), kept, text_sha256 of the normalised text.

    Texts are range-partitioned by their first bytes at splitters that Spark samples, sorted whole, on disk if need be,
    and compared in full with their neighbours (a sorted aggregate). A range is over (beginning, salt), so a text or a
    beginning that a third of all rows share is cut into as many ranges as its weight asks for; each text gives one
    row for each. These rows are few bytes long and are summed by the text's SHA-256, under which every document then
    finds its group.

    keep: "smallest" or "largest" id of equal texts stays. A null text counts as empty. Null ids are counted in
    their group and stay only if all ids of the group are null. Rows that share id and text share their result, and
    each counts. An empty table gives an empty table. Extra columns play no part.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep: smallest or largest")
    content = normalise(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    rows = docs.select(F.col(f"`{key}`").alias("id"), content.alias("content"))
    # an id that is null orders last, whichever end is kept; a struct as the aggregate makes Spark sort, not hash
    best = (lambda c: F.min(F.struct(c.isNull(), c.alias("id")))) if keep == "smallest" else (lambda c: F.max(F.struct(c.isNotNull(), c.alias("id"))))
    runs = (
        rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(tasks(docs.sparkSession))))
        .withColumn("lead", F.substring("content", 1, SPLITTER_CHARS))
        .repartitionByRange("lead", "salt")
        .groupBy("lead", "salt", "content")
        .agg(best(F.col("id")).alias("best"), F.count("*").alias("n"))
        .select(F.sha2("content", 256).alias("sha"), F.col("best.id").alias("id"), "n")
    )
    groups = stored(runs.groupBy("sha").agg(best(F.col("id")).alias("best"), F.sum("n").alias("n")).select("sha", F.col("best.id").alias("keep_id"), "n"), "exact")
    return (
        rows.select("id", F.sha2("content", 256).alias("sha"))
        .join(groups, "sha")
        .select(
            F.col("id").alias(key),
            "keep_id",
            F.col("n").alias("group_size"),
            F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query("op6_exact_dedup", SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the document of its text that stays: the one of the largest id."""
    return exact_groups(table(spark, folder, "documents"), keep="largest")
