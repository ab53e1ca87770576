"""Running streaming queries into layers of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from lectern.session import drop_files, scratch_dir
from lectern.sinks.layers import write_window_table
from lectern.streaming.operators import ROCKS_DB, STATE_BUCKETS, STATE_STORE

LOCAL_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
COUNT_STATE = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
PARTITIONS = "spark.sql.shuffle.partitions"
#: The most parts of the state that a core works through in a micro-batch.
PARTS_PER_CORE = 3
#: Buckets that a part of the state has at least where the session names their number.
BUCKETS_PER_PART = 8
BatchWriter = Callable[[DataFrame, int], None]


def _begin(df: DataFrame, writer: DataStreamWriter, checkpoint: str, every: str | None) -> StreamingQuery:
    spark = df.sparkSession
    # Timers and map state need the RocksDB store.
    spark.conf.set(STATE_STORE, ROCKS_DB)
    # Sessions of one key meet within each task before the shuffle.
    spark.conf.set(LOCAL_SESSIONS, "true")
    # Counting the rows of the state costs a read for each that is written; nothing here asks for their number.
    spark.conf.set(COUNT_STATE, "false")
    writer = writer.outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    before = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, state_partitions(spark))
    try:
        return writer.start()
    finally:
        spark.conf.set(PARTITIONS, before)


def start(df: DataFrame, write: BatchWriter, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start a query that hands each micro-batch to ``write``.

    Without ``every`` it works through what is there and stops; with it (``'10 seconds'``) it runs on.
    The checkpoint keeps positions and state, and ``write`` may be called again with the same batch
    number after a failure, so it must be repeatable.
    """
    return _begin(df, df.writeStream.foreachBatch(write), checkpoint, every)


def state_partitions(spark: SparkSession) -> str:
    """State is split once, at a query's first start: by the session's own number if it names one, up to
    ``PARTS_PER_CORE`` parts per core of the cluster, else one part per core. A part costs its task about half a second
    in every micro-batch, however few its rows, so where the session names few buckets there are no more parts than they fill."""
    number = spark.conf.get(PARTITIONS)
    named = number != "200" or spark.sparkContext.getConf().contains(PARTITIONS)
    cores = spark.sparkContext.defaultParallelism
    if not named:
        return str(cores)
    buckets = spark.conf.get(STATE_BUCKETS, None)
    filled = PARTS_PER_CORE * cores if buckets is None else max(cores, int(buckets) // BUCKETS_PER_PART)
    return str(min(int(number), filled, PARTS_PER_CORE * cores))


def to_layer(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a query to the end of its input, then read its layer as a table.

    The file sink notes which files belong to finished batches, and the readers of a layer, streams
    and tables alike, go by those notes: each row counts once also after a failure.
    """
    _begin(df, df.writeStream.format("parquet").option("path", path), checkpoint, None).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def to_window_table(sums: DataFrame, path: str, name: str, naming: Callable[[DataFrame], DataFrame] = lambda df: df,
                    every: str | None = None) -> StreamingQuery:
    """Closed window sums -> named rows of a window table.

    ``naming`` looks up names in the dimensions. It is called for each batch, on few rows, and should
    read the dimensions anew, so that their changes apply.
    """
    def write(batch: DataFrame, number: int) -> None:
        write_window_table(naming(batch), path, name, number)

    query = start(sums, write, f"{path}/_checkpoint_{name}", every)
    if every is None:
        query.awaitTermination()
    return query


def scratch_layer(df: DataFrame, name: str) -> DataFrame:
    """``to_layer`` in a new folder of the shared scratch space. The query has ended and nothing can begin it again, so its
    state goes away."""
    root = scratch_dir(df.sparkSession, name)
    layer = to_layer(df, f"{root}/data", f"{root}/checkpoint")
    drop_files(df.sparkSession, f"{root}/checkpoint/state")
    return layer


def layer_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The next query's view of a layer: its files as a stream."""
    return spark.readStream.schema(like.schema).parquet(path)
