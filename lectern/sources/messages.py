"""Message sources: one text value per message, from Kafka or from files of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.operators.parse import non_empty, parse_or_drop
from lectern.sources.schemas import TOPIC_DB


def kafka_messages(spark: SparkSession, servers: str, topic: str, stream: bool = True, **options: str) -> DataFrame:
    """Values of a Kafka topic from the earliest offset; the checkpoint keeps the position.

    Give ``maxOffsetsPerTrigger`` to bound a micro-batch.
    """
    reader = (spark.readStream if stream else spark.read).format("kafka")
    reader = reader.options(**{"kafka.bootstrap.servers": servers, "subscribe": topic,
                               "startingOffsets": "earliest", **options})
    return non_empty(reader.load().select(F.col("value").cast("string").alias("value")))


def line_messages(spark: SparkSession, path: str, stream: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """Values from text files, one message per line."""
    if not stream:
        return non_empty(spark.read.text(path))
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return non_empty(reader.load(path))


def table_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """A growing folder of parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def json_view(messages: DataFrame, schema: StructType, name: str) -> DataFrame:
    """Parsed messages, also as a temporary view for SQL."""
    parsed = parse_or_drop(messages, schema)
    parsed.createOrReplaceTempView(name)
    return parsed


def change_rows(messages: DataFrame) -> DataFrame:
    """Messages of the change topic as ``database, table, type, data, ts``."""
    return parse_or_drop(messages, TOPIC_DB)
