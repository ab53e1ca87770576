"""Configuration-driven routing of change rows to dimension and fact tables.

Routes are a handful of rows and few tables name most changes, so the routes go to every task: dealt out by table, all
changes of one table would meet in one task. Spark can't tell their size before it has run, hence the hints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def route_stage() -> Column:
    """Of changes of one instant an update follows a creation and a delete follows both."""
    return F.when(F.col("op") == "d", 2).when(F.col("op") == "u", 1).otherwise(0)


def current_config(changes: DataFrame, keys: list[str], seq: str = "ts_ms") -> DataFrame:
    """Fold change rows ``op, before, after`` to the rows that hold now.

    The last change of a key wins; a key whose last change is a delete has no row. Of changes of one
    instant an update follows a creation and a delete follows both; ``seq`` may be any column that
    orders the changes better, such as the offset of the message.
    """
    row = F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after"))
    rows = changes.select("op", seq, row.alias("_row")).select("op", seq, "_row.*")
    last = Window.partitionBy(*keys).orderBy(F.col(seq).desc(), route_stage().desc())
    kept = rows.withColumn("_rn", F.row_number().over(last)).filter((F.col("_rn") == 1) & (F.col("op") != "d"))
    return kept.drop("op", seq, "_rn")


def config_spans(changes: DataFrame, keys: list[str], at: str = "ts") -> DataFrame:
    """Change rows ``op, before, after`` as routes with the time they held: their columns, ``_from`` and ``_to`` (null: still).

    The batch form of live routing: a fact takes the route of the span that its time lies in.
    """
    row = F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after"))
    rows = changes.select("op", F.col(at).alias("_from"), route_stage().alias("_stage"), row.alias("_row")).select("op", "_from", "_stage", "_row.*")
    later = Window.partitionBy(*keys).orderBy("_from", "_stage")
    spans = rows.withColumn("_to", F.lead("_from").over(later))
    return spans.filter((F.col("op") != "d") & (F.col("_to").isNull() | (F.col("_to") > F.col("_from")))).drop("op", "_stage")


def route_by_time(changes: DataFrame, spans: DataFrame, keys: dict[str, str], ts: str = "ts") -> DataFrame:
    """Change rows with the route that held at their time -> ``sink_table, sink_pk, _op, data, ts``."""
    on = (changes[ts] >= spans["_from"]) & (spans["_to"].isNull() | (changes[ts] < spans["_to"]))
    for fact, route in keys.items():
        on = on & (changes[fact] == spans[route])
    pk = F.col("sink_pk") if "sink_pk" in spans.columns else F.lit(None).cast("string")
    return changes.join(F.broadcast(spans), on, "inner").select(
        "sink_table", F.coalesce(pk, F.lit("id")).alias("sink_pk"), F.col("type").alias("_op"),
        listed_columns("data", "sink_columns").alias("data"), changes[ts])


def listed_columns(data: str, columns: str) -> Column:
    """Only those entries of the map whose key the comma-separated list names."""
    names = F.split(F.col(columns), ",")
    return F.map_filter(F.col(data), lambda k, v: F.array_contains(names, k))


def route_dimensions(changes: DataFrame, config: DataFrame, *others: str) -> DataFrame:
    """Change rows of configured tables -> ``sink_table, sink_pk, _op, data, ts`` and ``others``, such as a number of arrival.

    The change type has a column of its own, so a dimension may have a column named ``type``.
    """
    typed = changes.filter(F.col("type").isNotNull())
    return typed.join(F.broadcast(config), typed["table"] == config["source_table"], "inner").select(
        "sink_table", F.coalesce("sink_pk", F.lit("id")).alias("sink_pk"), F.col("type").alias("_op"),
        listed_columns("data", "sink_columns").alias("data"), "ts", *others,
    )


def route_facts(changes: DataFrame, config: DataFrame) -> DataFrame:
    """Change rows of configured tables and types -> ``sink_table, data, ts``."""
    on = (changes["table"] == config["source_table"]) & (changes["type"] == config["source_type"])
    return changes.join(F.broadcast(config), on, "inner").select(
        "sink_table", listed_columns("data", "sink_columns").alias("data"), changes["ts"]
    )


def sink_schema(sink_columns: str) -> list[str]:
    """Columns of a dimension table: those listed, all strings."""
    return [c.strip() for c in sink_columns.split(",")]


def sink_rows(routed: DataFrame, sink_table: str, sink_columns: str, *others: str) -> DataFrame:
    """Rows of one sink table with the listed columns."""
    return routed.filter(F.col("sink_table") == sink_table).select(
        *[F.col("data")[c].alias(c) for c in sink_schema(sink_columns)], *others
    )
