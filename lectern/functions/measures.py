"""Row-level measures: score bands, keyword weights, conditions as counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.timefn import col

# A score belongs to the first band whose upper bound it stays under; the top band
# also holds its bound itself.
SCORE_BANDS = [
    (60, "[0,60)"),
    (70, "[60,70)"),
    (80, "[70,80)"),
    (90, "[80,90)"),
    (100, "[90,100]"),
]

# Weight of one keyword hit by where it came from; any other source weighs 0.
KEYWORD_WEIGHTS = {"SEARCH": 10, "ORDER": 5, "CART": 2, "CLICK": 1}
SEARCH_SOURCE = "SEARCH"

MONEY = "decimal(16,2)"


def score_band(score: Column | str) -> Column:
    """Band label of a score; '' above the top band."""
    s = col(score)
    band = F
    for high, label in SCORE_BANDS:
        band = band.when(s <= high if label.endswith("]") else s < high, F.lit(label))
    return band.otherwise(F.lit(""))


def keyword_weight(source: Column | str) -> Column:
    s = col(source)
    weight = F
    for name, value in KEYWORD_WEIGHTS.items():
        weight = weight.when(s == name, F.lit(value))
    return weight.otherwise(F.lit(0))


def as_count(condition: Column) -> Column:
    """True -> 1, false or null -> 0."""
    return F.when(condition, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def money(amount: Column | str) -> Column:
    """Amounts become decimals before they are summed, so sums do not depend on row order."""
    return col(amount).cast(MONEY)


def ratio(part: Column, whole: Column) -> Column:
    """Null instead of an error when the denominator is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))
