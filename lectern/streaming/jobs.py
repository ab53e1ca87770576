"""Ingest jobs: raw log to fact layers, change rows to dimension and fact tables.

Each job works through what its source holds and stops, or runs on when given ``every``. A job has
several targets, so it writes each batch itself, to folders named by the batch's number, and replaces
them when a batch comes again. Read these layers as tables, or as streams behind finished batches only:
a stream that already took the first attempt's files would see the second's as new.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.timefn import from_millis
from lectern.operators import parse, routing, split
from lectern.sinks.dimensions import ARRIVAL, upsert_batch
from lectern.sources import messages
from lectern.sources.schemas import TOPIC_LOG
from lectern.streaming import operators as s
from lectern.streaming.run import start

# The layers of the split log.
LOG_LAYERS = {
    "page": "dwd_traffic_page_log", "start": "dwd_traffic_start_log", "display": "dwd_traffic_display_log",
    "action": "dwd_traffic_action_log", "error": "dwd_traffic_error_log", "video": "play_pre_process",
}
DIRTY_LAYER = "dirty_data"


def _write(df: DataFrame, path: str, number: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={number}")


def run_log_split(lines: DataFrame, path: str, every: str | None = None) -> list:
    """Raw log lines -> dirty lines, and six fact layers with the new-visitor flag repaired.

    The text of a record, not its parsed form, goes through the keyed state; the parser runs again
    behind it. That keeps what Python sees to a few plain columns.
    """
    read = parse.parsed(lines, TOPIC_LOG)
    dirty = read.filter(~F.coalesce(parse.is_good(), F.lit(False))).select("value")
    good = read.filter(parse.is_good()).select(
        "value", F.col("record.common.mid").alias("mid"), F.col("record.common.is_new").alias("is_new"),
        from_millis("record.ts").alias("ts"))
    fixed = s.repair_new_flag(good).select("value", "is_new")

    def write_dirty(batch: DataFrame, number: int) -> None:
        _write(batch, f"{path}/{DIRTY_LAYER}", number)

    def write_parts(batch: DataFrame, number: int) -> None:
        log = parse.parsed(batch, TOPIC_LOG).select("record.*", "is_new").withColumn(
            "common", F.col("common").withField("is_new", F.col("is_new")))
        log.persist()
        try:
            for kind, rows in split.split_log(log).items():
                _write(rows, f"{path}/{LOG_LAYERS[kind]}", number)
        finally:
            log.unpersist()

    queries = [start(dirty, write_dirty, f"{path}/_checkpoint_dirty", every),
               start(fixed, write_parts, f"{path}/_checkpoint_parts", every)]
    if every is None:
        for q in queries:
            q.awaitTermination()
    return queries


def run_dimensions(lines: DataFrame, config: Callable[[], DataFrame], path: str, every: str | None = None):
    """Change rows -> dimension tables. ``config`` is asked again in each batch, so changes apply live."""
    changes = parse.dimension_changes(messages.change_rows(lines))

    def write(batch: DataFrame, number: int) -> None:
        current = config()
        # numbered as read, before any shuffle: a source keeps the changes of a key in order
        numbered = batch.withColumn(ARRIVAL, F.monotonically_increasing_id())
        routed = routing.route_dimensions(numbered, current, ARRIVAL).persist()
        try:
            upsert_batch(batch.sparkSession, routed, current, path + "/dim", number)
        finally:
            routed.unpersist()

    query = start(changes, write, f"{path}/_checkpoint_dim", every)
    if every is None:
        query.awaitTermination()
    return query


def run_facts(lines: DataFrame, config: Callable[[], DataFrame], path: str, every: str | None = None):
    """Change rows -> fact layers, one folder per target table."""
    changes = parse.fact_changes(messages.change_rows(lines))

    def write(batch: DataFrame, number: int) -> None:
        routed = routing.route_facts(batch, config())
        routed.write.mode("overwrite").partitionBy("sink_table").parquet(f"{path}/dwd/batch_id={number}")

    query = start(changes, write, f"{path}/_checkpoint_dwd", every)
    if every is None:
        query.awaitTermination()
    return query
