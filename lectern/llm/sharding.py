"""Sharding by extendible hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import query, stored, table

#: Bytes of text that a shard may hold.
SHARD_BYTES = 16 << 20
#: Bits of the hash, and how many of them one round looks at.
BITS, STEP = 60, 10


def _prefix(value: Column, depth: Column | int) -> Column:
    """The first ``depth`` of the hash's bits."""
    by = F.lit(BITS) - depth
    return F.expr("0") if isinstance(depth, int) and depth == 0 else F.call_function("shiftright", value, by.cast("int"))


def extendible_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: ``key``, n_bytes, shard (the bits that lead to it; "" is the only shard), depth, shard_bytes.

    The hash is the first 60 bits of the key's MD5. A round sums bytes under the next ten bits of all buckets that are
    still too large (at most 1,024 cells for each), adds the cells up to every depth between, and ends each cell at the
    first depth that fits. Only documents of cells that fit at no depth go on to the next ten bits. Sizes are read from
    the texts once; sums are partial before the shuffle, so a hot key costs one row per task.

    A document larger than the limit ends alone in its shard. Documents that agree in all 60 bits (repeated keys) can't
    be told apart by the hash: they are dealt out by input task and then in blocks that fit, and the shard's name gets
    these two numbers. A null text has 0 bytes; null keys hash as the empty text. An empty table gives an empty table.
    Extra columns play no part.
    """
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    rows = stored(
        docs.select(
            F.col(f"`{key}`").alias("key"),
            F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long").alias("h"),
            F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("n_bytes"),
            F.spark_partition_id().alias("task"),
        ),
        "sizes",
    )
    active, done = rows, []
    for below in range(0, BITS, STEP):
        deep = below + STEP
        cells = active.groupBy(_prefix(F.col("h"), F.lit(deep)).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
        depths = F.explode(F.sequence(F.lit(below + (below > 0)), F.lit(deep)))
        sums = (
            cells.select("cell", "bytes", "n", depths.alias("depth"))
            .withColumn("bucket", F.call_function("shiftright", F.col("cell"), (F.lit(deep) - F.col("depth")).cast("int")))
            .groupBy("depth", "bucket")
            .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
            .where((F.col("bytes") <= shard_bytes) | (F.col("n") == 1))
        )
        ends = (
            cells.select("cell", depths.alias("depth"))
            .withColumn("bucket", F.call_function("shiftright", F.col("cell"), (F.lit(deep) - F.col("depth")).cast("int")))
            .join(sums, ["depth", "bucket"], "left")
            .groupBy("cell")
            .agg(F.min(F.when(F.col("bytes").isNotNull(), F.struct("depth", "bucket", "bytes"))).alias("end"))
        )
        dealt = stored(active.withColumn("cell", _prefix(F.col("h"), F.lit(deep))).join(ends, "cell").drop("cell"), "dealt")
        done.append(
            dealt.where("end IS NOT NULL").select(
                "key",
                "n_bytes",
                F.lpad(F.bin("end.bucket"), F.col("end.depth"), F.lit("0")).alias("shard"),
                F.col("end.depth").alias("depth"),
                F.col("end.bytes").alias("shard_bytes"),
            )
        )
        active = dealt.where("end IS NULL").drop("end")
        if active.isEmpty():
            break
    else:
        alike = Window.partitionBy("h", "task")
        block = F.col("n") / F.greatest(F.lit(1), F.floor(F.lit(shard_bytes) / F.greatest(F.lit(1), F.col("largest"))))
        rest = (
            active.withColumn("n", F.row_number().over(alike.orderBy("n_bytes")) - 1)
            .withColumn("largest", F.max("n_bytes").over(alike))
            .withColumn("block", F.floor(block))
        )
        done.append(
            rest.select(
                "key",
                "n_bytes",
                F.concat_ws("-", F.lpad(F.bin("h"), F.lit(BITS), F.lit("0")), "task", "block").alias("shard"),
                F.lit(BITS).alias("depth"),
                F.sum("n_bytes").over(Window.partitionBy("h", "task", "block")).alias("shard_bytes"),
            )
        )
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("key", key)


SQL = """
WITH d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h,
             coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents),
s AS (SELECT depth, h >> (60 - depth)::INT AS bucket, sum(n_bytes)::BIGINT AS bytes, count(*) AS n
      FROM d, (SELECT unnest(generate_series(0, 60)) AS depth) GROUP BY ALL HAVING sum(n_bytes) <= {limit} OR count(*) = 1),
e AS (SELECT d.doc_id, d.n_bytes, d.h, s.depth, s.bucket, s.bytes,
        row_number() OVER (PARTITION BY d.doc_id, d.h ORDER BY s.depth) AS r
      FROM d JOIN s ON s.bucket = d.h >> (60 - s.depth)::INT)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(bucket), depth::INT, '0') END AS shard, depth::INT AS depth, bytes AS shard_bytes
FROM e WHERE r = 1
"""


@query("op7_extendible_shards", SQL.format(limit=SHARD_BYTES))
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """The shard of every document, in shards of at most 16 MiB of text."""
    return extendible_shards(table(spark, folder, "documents"))
