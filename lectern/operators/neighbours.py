"""Look at the row before and the row after within a key, also when one key is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.skew import HOT_ROWS, slice_hot


def with_neighbours(
    df: DataFrame,
    keys: list[str],
    ts: str,
    tie: list[str],
    before: dict[str, str] | None = None,
    after: dict[str, str] | None = None,
    hot_rows: int = HOT_ROWS,
    slice_seconds: int = 600,
) -> DataFrame:
    """Add columns of the previous (``before``) and next (``after``) row of the same key.

    ``before`` and ``after`` map new names to columns; order is ``ts`` then ``tie``, which must
    make it unique. A hot key is cut into time slices; only the first and last row of each slice
    go through a second window that reaches over the slice bounds, at most two rows per slice.
    """
    before, after = before or {}, after or {}
    order = [ts, *tie]
    sliced = slice_hot(df, keys, ts, slice_seconds, hot_rows)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(*order)
    columns = {n: F.lag(c).over(inside) for n, c in before.items()}
    columns |= {n: F.lead(c).over(inside) for n, c in after.items()}
    columns["_first"] = F.lag(F.lit(1)).over(inside).isNull()
    columns["_last"] = F.lead(F.lit(1)).over(inside).isNull()
    near = sliced.withColumns(columns)
    on_edge = F.col("_slice").isNotNull() & (F.col("_first") | F.col("_last"))

    edges = near.filter(on_edge)
    reached = {n: F.when(F.col("_first"), F.lag(c).over(across)).otherwise(F.col(n)) for n, c in before.items()}
    reached |= {n: F.when(F.col("_last"), F.lead(c).over(across)).otherwise(F.col(n)) for n, c in after.items()}
    both = near.filter(~on_edge).unionByName(edges.withColumns(reached))
    return both.drop("_slice", "_first", "_last")
