"""Line dedup by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import packed, query, table

#: A line goes if it is on more than this share of its host's pages, and on at least so many pages.
RATIO = 0.1
LEAST_PAGES = 3
#: White space that is cut from a line's ends before lines are compared.
BLANK = " \t\r\f\x0b"


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(F.btrim(line, F.lit(BLANK))))


def site_lines(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES, copies_once: bool = False) -> DataFrame:
    """Boilerplate of each host: (host, lines: array of 16-byte digests).

    A page counts a line once. Lines reach the shuffle as digests, summed before it. Of a host's lines at most
    (mean distinct lines per page) / ratio can exceed the ratio, so the array is bounded whatever the host's size.
    With ``copies_once`` pages of a host that consist of the same lines are one page.
    """
    digests = F.array_distinct(F.transform(F.split(F.col(f"`{text}`"), "\n"), _digest))
    pages = docs.select(F.col(f"`{host}`").alias("host"), digests.alias("digests"))
    if copies_once:
        pages = pages.select("host", F.sort_array("digests").alias("digests")).distinct()
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    seen = (
        pages.select("host", F.explode("digests").alias("line"))
        .where(F.col("line") != F.unhex(F.md5(F.lit(""))))
        .groupBy("host", "line")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= least_pages)
    )
    return (
        seen.alias("s")
        .join(totals.alias("t"), F.col("s.host").eqNullSafe(F.col("t.host")))
        .where(F.col("n") > F.lit(float(ratio)) * F.col("pages"))
        .groupBy(F.col("s.host").alias("host"))
        .agg(F.collect_list("line").alias("lines"))
    )


def drop_site_lines(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES, copies_once: bool = False) -> DataFrame:
    """Each page without its host's boilerplate: columns ``row`` (the input row, unchanged), ``text`` (the lines that
    stay, joined by line feeds), ``n_lines`` and ``n_dropped`` (long).

    Lines are compared without white space at their ends; blank lines always stay. Pages with a null host are one
    host. A null text stays null, has no lines and still counts as a page; an empty text has one (blank) line. Repeated
    rows count as often as they occur. Hosts with fewer than ``least_pages`` pages lose nothing. An empty table gives
    an empty table. Extra columns, of any name, come back inside ``row``.

    With ``copies_once`` rows of a host with the same lines count as one page, so that a text does not become
    boilerplate by being copied.
    """
    marked = packed(docs, text=F.col(f"`{text}`"), host=F.col(f"`{host}`"))
    found = site_lines(docs, text, host, ratio, least_pages, copies_once)
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda line: ~F.array_contains("lines", _digest(line)))
    # one pass over the lines where the host has boilerplate, none elsewhere
    after = (
        marked.alias("d")
        .join(found.alias("f"), F.col("d.host").eqNullSafe(F.col("f.host")), "left")
        .select("row", "text", F.when(F.col("lines").isNotNull(), kept).alias("kept"))
    )
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    return after.select(
        "row",
        F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"),
        n_lines.alias("n_lines"),
        F.when(F.col("kept").isNull(), 0).otherwise(F.size(lines) - F.size("kept")).cast("long").alias("n_dropped"),
    )


SQL = r"""
WITH l AS (SELECT rowid_, source, pos, line, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS k
  FROM (SELECT *, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents))),
t AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
b AS (SELECT l.source, k FROM l WHERE k <> '' GROUP BY l.source, k
      HAVING count(DISTINCT rowid_) >= {least} AND count(DISTINCT rowid_) > {ratio} * (SELECT pages FROM t WHERE t.source IS NOT DISTINCT FROM l.source)),
m AS (SELECT l.*, EXISTS (SELECT 1 FROM b WHERE b.source IS NOT DISTINCT FROM l.source AND b.k = l.k) AS gone FROM l),
g AS (SELECT rowid_, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
        coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM m GROUP BY rowid_)
SELECT d.doc_id, d.source, g.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM (SELECT doc_id, source, row_number() OVER () AS rowid_ FROM documents) d LEFT JOIN g USING (rowid_)
"""


@query("op5_line_dedup", SQL.format(ratio=RATIO, least=LEAST_PAGES))
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: its id and host, the text without its host's boilerplate, lines and dropped lines."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return drop_site_lines(docs).select("row.doc_id", "row.source", "text", "n_lines", "n_dropped")
