"""Rows that every operator must take: nulls, empty and long texts, repeated rows, names that clash."""

from __future__ import annotations

LONG = "lorem ipsum dolor sit amet consectetur " * 4000
ROWS = [
    (1, "alpha beta gamma delta", "en", "a.example", 22),
    (2, None, "en", "a.example", None),
    (3, "", None, "a.example", 0),
    (4, LONG, "en", None, len(LONG)),
    (5, "alpha beta gamma delta", None, "b.example", 22),
    (5, "alpha beta gamma delta", None, "b.example", 22),
    (None, "une phrase en français", "fr", "b.example", 22),
    (7, "   \n\t ", "fr", "b.example", 6),
    (8, "12345 !!! ???", "fr", "b.example", 13),
    (9, "ÅNGSTRÖM naïve 日本語 \U0001f600", "fr", None, 20),
]
#: Columns that operators use inside or return; here they hold something else.
CLASHING = ["row", "id", "host", "lines", "kept", "keep_id", "component_id", "fingerprint", "h", "node", "sequence_id", "offset", "length", "lang_pred", "score", "severity", "shard", "count", "ids", "decoded"]


def documents(spark, rows=None):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING)
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(*r, *["clash"] * len(CLASHING)) for r in rows], schema)


def none(spark):
    return documents(spark).where("false")
