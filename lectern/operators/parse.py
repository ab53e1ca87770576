"""From message text to typed rows, and the filters on change rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt_record"

# Change types that carry no row, and those that repeat old rows.
BOOTSTRAP_MARKERS = ["bootstrap-start", "bootstrap-complete"]
BOOTSTRAP_ROWS = ["bootstrap-insert"]


def non_empty(messages: DataFrame, value: str = "value") -> DataFrame:
    """Null messages (tombstones) and empty ones carry nothing."""
    return messages.filter(F.col(value).isNotNull() & (F.col(value) != ""))


def parsed(messages: DataFrame, schema: StructType, value: str = "value") -> DataFrame:
    """Add ``record``; its ``_corrupt_record`` field is set where the text is no JSON object.

    Exploding a one-element array makes each text be parsed once: filters on the record stay above
    it, where they would otherwise be pushed below and parse the text again.
    """
    with_corrupt = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    read = F.from_json(F.col(value), with_corrupt, options)
    return messages.select("*", F.explode(F.array(read)).alias("record"))


def is_good(record: str = "record") -> Column:
    return F.col(record).isNotNull() & F.col(f"{record}.{CORRUPT}").isNull()


def parse_or_divert(messages: DataFrame, schema: StructType, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good rows as columns of ``schema``, dirty lines verbatim)."""
    read = parsed(messages, schema, value)
    good = read.filter(is_good()).select(*[F.col("record")[f.name].alias(f.name) for f in schema.fields])
    dirty = read.filter(~F.coalesce(is_good(), F.lit(False))).select(value)
    return good, dirty


def parse_or_drop(messages: DataFrame, schema: StructType, value: str = "value") -> DataFrame:
    return parse_or_divert(messages, schema, value)[0]


def dimension_changes(topic_db: DataFrame) -> DataFrame:
    """Changes that may fill dimension tables; rows of the first full copy count."""
    return topic_db.filter(F.col("type").isNull() | ~F.col("type").isin(*BOOTSTRAP_MARKERS))


def fact_changes(topic_db: DataFrame) -> DataFrame:
    """Changes that may be facts; rows of the first full copy do not count."""
    return topic_db.filter(F.col("type").isNull() | ~F.col("type").isin(*BOOTSTRAP_MARKERS, *BOOTSTRAP_ROWS))


def rows_of(topic_db: DataFrame, table: str, change: str | None = None) -> DataFrame:
    """Change rows of one table, of one type if given."""
    picked = topic_db.filter(F.col("table") == table)
    return picked if change is None else picked.filter(F.col("type") == change)


def fields(df: DataFrame, map_column: str, names: dict[str, str], *others: str) -> DataFrame:
    """Map entries as columns: ``names`` maps new names to keys."""
    return df.select(*[F.col(map_column)[k].alias(n) for n, k in names.items()], *others)


def required(df: DataFrame, *names: str) -> DataFrame:
    """Rows where all these ids are there."""
    return df.dropna(subset=list(names))
