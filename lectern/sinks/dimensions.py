"""Dimension tables as versions of rows.

A batch of changes is appended as a folder of versions; readers see the latest version per key over
the last snapshot and all later batches. ``compact`` writes a new snapshot. Nothing is rewritten in
place, so readers and retries are safe without a transactional table format.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.keyed import latest_version
from lectern.operators.routing import sink_rows, sink_schema


ARRIVAL = "_arrival"


def append_versions(routed: DataFrame, config_row, path: str, number: int) -> None:
    """Write one sink table's rows of a batch as versions.

    ``config_row`` has ``sink_table, sink_columns, sink_pk``; it is one small configuration row. Of equal
    versions (they are whole seconds) the row with the greatest ``ARRIVAL`` stays, if the rows have it.
    """
    columns = sink_schema(config_row["sink_columns"])
    key = config_row["sink_pk"] or "id"
    arrival = [ARRIVAL] if ARRIVAL in routed.columns else []
    rows = sink_rows(routed, config_row["sink_table"], config_row["sink_columns"], "ts", "_op", *arrival)
    versions = rows.withColumns({"_version": F.col("ts").cast("bigint"), "_batch": F.lit(number).cast("bigint")}).drop("ts")
    best = latest_version(versions, [key], "_version", *arrival).select(*columns, "_op", "_version", "_batch")
    best.write.mode("overwrite").parquet(f"{path}/{config_row['sink_table']}/batch_id={number}")


def upsert_batch(spark: SparkSession, routed: DataFrame, config: DataFrame, path: str, number: int) -> None:
    """Write a batch of routed rows to every configured dimension table.

    Only configuration rows, a handful, come to the driver.
    """
    for row in config.select("sink_table", "sink_columns", "sink_pk").collect():
        append_versions(routed, row, path, number)


def read_dimension(spark: SparkSession, path: str, sink_table: str, key: str = "id", drop_deleted: bool = False) -> DataFrame:
    """The dimension as of now; deletes keep the last row unless ``drop_deleted``."""
    versions = spark.read.option("basePath", f"{path}/{sink_table}").option("mergeSchema", "true").parquet(
        f"{path}/{sink_table}/batch_id=*").drop("batch_id")
    order = versions.withColumn("_v", F.struct("_version", "_batch"))
    kept = latest_version(order, [key], "_v")
    if drop_deleted:
        kept = kept.filter(F.col("_op") != "delete")
    return kept.drop("_v", "_op", "_version", "_batch")


def compact(spark: SparkSession, path: str, target: str, sink_table: str, key: str = "id") -> None:
    """Write the current rows as the first batch of a new location; readers then move there."""
    versions = spark.read.option("basePath", f"{path}/{sink_table}").option("mergeSchema", "true").parquet(
        f"{path}/{sink_table}/batch_id=*").drop("batch_id")
    kept = latest_version(versions.withColumn("_v", F.struct("_version", "_batch")), [key], "_v").drop("_v")
    kept.write.mode("overwrite").parquet(f"{target}/{sink_table}/batch_id=-1")
