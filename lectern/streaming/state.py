"""What a streaming query remembers: its state, read back as a table.

A query's checkpoint holds the state of every finished micro-batch. Reading it shows which keys a time to live or a
timer has dropped, and how long the others stay; tests and audits go by it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The column that says until when a value with a time to live is kept.
EXPIRES = "expires"
_TTL_VALUE, _TTL_UNTIL = "value", "ttlExpirationMs"


def _value_columns(value: StructType, of: str) -> list[Column]:
    """The fields of a state value; one with a time to live is wrapped together with its end."""
    if value.fieldNames() != [_TTL_VALUE, _TTL_UNTIL]:
        return [F.col(of)[f].alias(f) for f in value.fieldNames()]
    inner = value[_TTL_VALUE].dataType.fieldNames()
    return [*[F.col(of)[_TTL_VALUE][f].alias(f) for f in inner], F.timestamp_millis(F.col(of)[_TTL_UNTIL]).alias(EXPIRES)]


def state_rows(
    spark: SparkSession, checkpoint: str, variable: str, keys: list[str], batch: int | None = None, operator: int = 0
) -> DataFrame:
    """One row per key that the variable of a keyed processor has a value for: ``keys``, then the value's fields.

    checkpoint: the stopped query's checkpoint folder. keys: names for the grouping columns, in their order. batch: after
    which micro-batch, the last one if left out. operator: which stateful operator of the query. A value with a time to
    live has a last column ``expires``. Map state has a row per entry, with the entry's own key fields after ``keys``.
    The state of a ``Bucketed`` processor is shown by its keys, too. A variable that has no value has no row. Each task reads one part of the state.
    """
    reader = spark.read.format("statestore").option("path", checkpoint).option("operatorId", operator).option("stateVarName", variable)
    rows = (reader if batch is None else reader.option("batchId", batch)).load()
    key = rows.schema["key"].dataType.fieldNames()
    if key == ["bucket"]:
        return _bucket_rows(rows, keys)
    if len(key) != len(keys):
        raise ValueError(f"the state is kept by {len(key)} columns, not by {keys}")
    named = [F.col("key")[k].alias(n) for k, n in zip(key, keys, strict=True)]
    if "user_map_key" in rows.columns:
        named += [F.col("user_map_key")[f].alias(f) for f in rows.schema["user_map_key"].dataType.fieldNames()]
        return rows.select(*named, *_value_columns(rows.schema["user_map_value"].dataType, "user_map_value"))
    return rows.select(*named, *_value_columns(rows.schema["value"].dataType, "value"))


def _bucket_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    fields = rows.schema["value"].dataType["columns"].dataType.fields
    others = [f for f in fields if not re.fullmatch(r"k\d+", f.name)]
    if len(fields) - len(others) != len(keys):
        raise ValueError(f"the state is kept by {len(fields) - len(others)} columns, not by {keys}")

    def entries(batches):
        import pyarrow as pa

        for batch in batches:
            for value in batch.column(0).drop_null():
                yield from pa.ipc.open_stream(value.as_py()).read_all().to_batches()

    found = rows.select(F.col("value.entries").alias("entries")).mapInArrow(entries, StructType(fields))
    return found.toDF(*keys, *[f.name for f in others])


def kept_and_dropped(seen: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of ``seen`` with ``kept``: whether the state still has its keys. Null keys meet null keys."""
    marks = held.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)]).distinct().withColumn("_held", F.lit(True))
    same = [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(keys)]
    return seen.join(marks, same, "left").select(*seen.columns, F.coalesce("_held", F.lit(False)).alias("kept"))
