"""Layer tables, dimension tables and configuration tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One stored table of a folder of parquet tables (a file or a directory each)."""
    path = f"{folder.rstrip('/')}/{name}"
    return spark.read.parquet(path if name.endswith(".parquet") else path + ".parquet")


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              bounds: tuple[int, int] | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """A table behind JDBC; give a numeric column and its bounds to read it in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0],
                                upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    """A bounded source of literal rows, for tests and configuration."""
    return spark.createDataFrame(data, schema)
