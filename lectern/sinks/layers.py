"""Sinks: layers of files, window tables, message values, dead letters.

A micro-batch is written to a folder named by its number. Writing it again after a failure replaces
that folder, so each batch counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.functions.timefn import JSON_TIMES
from lectern.operators.windows import stamped
from lectern.sources.schemas import WINDOW_TABLES


def append_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer into ``path/batch_id=N``."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")
    return write


def read_layer(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All batches of a layer as one table, without the batch number."""
    return spark.read.schema(schema).parquet(f"{path}/batch_id=*").select(*schema.names)


def message_values(df: DataFrame, topic: str | None = None) -> DataFrame:
    """Rows as JSON text ``value``, and a ``topic`` column if the rows themselves name it.

    The topic column does not go into the payload. Feed this to a Kafka writer, or ``value`` to files.
    """
    payload = [c for c in df.columns if c != topic]
    value = F.to_json(F.struct(*payload), JSON_TIMES).alias("value")
    return df.select(value) if topic is None else df.select(F.col(topic).alias("topic"), value)


def upsert_values(df: DataFrame, key: str) -> DataFrame:
    """Rows as JSON ``key`` and ``value``; readers keep the latest version per key."""
    return df.select(F.to_json(F.struct(key), JSON_TIMES).alias("key"),
                     F.to_json(F.struct(*df.columns), JSON_TIMES).alias("value"))


def write_kafka(values: DataFrame, servers: str, topic: str | None = None) -> None:
    """Batch write of message values; with a ``topic`` column each row goes to its own topic."""
    writer = values.write.format("kafka").option("kafka.bootstrap.servers", servers)
    (writer.option("topic", topic) if topic else writer).save()


def write_by_topic(routed: DataFrame, path: str, topic: str = "sink_table", number: int = 0) -> None:
    """The file form of the dynamic-topic sink: in batch ``number``, one folder per topic."""
    message_values(routed, topic).write.mode("overwrite").partitionBy("topic").text(f"{path}/batch_id={number}")


def write_dead_letters(dirty: DataFrame, path: str, number: int = 0) -> None:
    """Unparseable lines of batch ``number``, verbatim."""
    dirty.select("value").write.mode("overwrite").text(f"{path}/batch_id={number}")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all batches, with their topic if they have one."""
    return spark.read.text(path).drop("batch_id")


def window_rows(df: DataFrame, name: str) -> DataFrame:
    """A window table's columns by name and in order: bounds, columns, write time.

    Helper columns that the table does not list fall away here.
    """
    return stamped(df.select("stt", "edt", *WINDOW_TABLES[name]))


MONTH = "month"


def write_window_table(df: DataFrame, path: str, name: str, number: int = 0) -> None:
    """Write closed windows as batch ``number``, in folders by month and sorted by time.

    A report of one day reads one month's folder and, by the time ranges the files note, only the
    row groups of that day. Folders by day would make years of backfill a heap of tiny files. The
    rebalance hint lets Spark split a heavy month over several files and join light ones.
    """
    month = F.date_format("stt", "yyyyMM").cast("int")
    rows = window_rows(df, name).withColumn(MONTH, month).hint("rebalance", MONTH)
    target = f"{path}/{name}/batch_id={number}"
    rows.sortWithinPartitions(MONTH, "stt").write.mode("overwrite").partitionBy(MONTH).parquet(target)


def read_window_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """All batches of a window table, with the ``month`` folder column that reports prune by."""
    return spark.read.parquet(f"{path}/{name}").drop("batch_id")


def show(df: DataFrame, rows: int = 20) -> None:
    """Print the first rows of a batch."""
    df.show(rows, truncate=False)
