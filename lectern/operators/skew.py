"""Splitting hot keys.

A key is *hot* when it has at least ``hot_rows`` rows. A table of N rows has at most
``N / hot_rows`` hot keys, so the list of hot keys is small by construction and may be broadcast.
Cold keys are never split: their group fits one task. Nothing is dropped; every operator that
splits a hot key puts its parts together again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.timefn import micros

HOT_ROWS = 1_000_000
SALTS = 64


def _same(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> Column:
    return reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(right[prefix + k]) for k in keys]
    )


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with at least ``hot_rows`` rows; counted with a map-side partial count."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counted.filter(F.col("_n") >= hot_rows).select(*[F.col(k).alias("_hot_" + k) for k in keys])


def mark_hot(df: DataFrame, keys: list[str], hot: DataFrame, flag: str = "_hot") -> DataFrame:
    """Add a boolean: does the row belong to a hot key. ``hot`` comes from ``hot_keys``.

    There are at most N / ``hot_rows`` hot keys. Spark broadcasts their list if it finds it small enough.
    """
    listed = hot.withColumn(flag, F.lit(True))
    joined = df.join(listed, _same(df, listed, keys, "_hot_"), "left")
    return joined.drop(*["_hot_" + k for k in keys]).withColumn(
        flag, F.coalesce(F.col(flag), F.lit(False))
    )


def slice_hot(
    df: DataFrame,
    keys: list[str],
    ts: str,
    slice_seconds: int,
    hot_rows: int = HOT_ROWS,
    name: str = "_slice",
) -> DataFrame:
    """Add a time-slice number to rows of hot keys, null for cold keys.

    Grouping by ``keys`` plus the slice spreads one hot key over as many tasks as there are
    slices; cold keys stay whole.
    """
    marked = mark_hot(df, keys, hot_keys(df, keys, hot_rows))
    number = F.floor(micros(ts) / F.lit(slice_seconds * 1_000_000)).cast("bigint")
    return marked.withColumn(name, F.when(F.col("_hot"), number)).drop("_hot")


def join_unique(
    facts: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    spread: list[str],
    how: str = "left",
    hot: DataFrame | None = None,
    hot_rows: int | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Join facts, whose keys may be hot, to a table with one row per key.

    This is a plain join: Spark broadcasts a side it finds small enough, and splits a hot key's part by
    the size it measures at run time. Where that can't be (a grouping by the same key right behind the
    join, or adaptive execution off), name the hot keys (``hot``) or have them counted (``hot_rows``):
    their rows get one of ``salts`` numbers from the ``spread`` columns, and only their rows of
    ``per_key`` are repeated once per number.
    """
    if hot is None and hot_rows is None:
        return facts.join(per_key, keys, how)
    hot = hot_keys(facts, keys, hot_rows) if hot is None else hot
    number = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    left = mark_hot(facts, keys, hot).withColumn("_salt", F.when(F.col("_hot"), number).otherwise(F.lit(0)))
    numbers = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = mark_hot(per_key, keys, hot).withColumn("_salt", F.explode(numbers)).drop("_hot")
    return left.drop("_hot").join(right, [*keys, "_salt"], how).drop("_salt")
