"""Text functions of the keyword job and the question report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.timefn import col

# Fixed value: a word is an unbroken run of letters and digits.
WORD_PATTERN = r"[\p{L}\p{N}]+"


def words(text: Column | str) -> Column:
    """All words of the whole text, lower-cased, repeats kept."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(WORD_PATTERN), F.lit(0))


def short_digest(text: Column | str) -> Column:
    """First ten hex digits of the md5 of a text; stands in for long question texts."""
    return F.substring(F.md5(col(text).cast("binary")), 1, 10)
