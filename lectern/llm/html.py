"""Main text of web pages: boilerplate by a host's suffix array, then by the elements that hold it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import query, stored, table

#: Tokens in a row that must recur on another page of the host; pages of a host whose streams one suffix array holds.
RUN, SHARD_PAGES = 8, 512
#: Places of the bitmap of the runs that can decide a block; a run that shares a place with one is sent for nothing.
PLACES = 1 << 20

# Element names of HTML, and words that name parts of pages in class, id and role.
RAW = {"script", "style", "textarea", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q",
    "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br",
}
CHROME_TAGS = {"head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "noscript", "template", "svg", "object", "audio", "video", "canvas"}
CHROME_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "alert", "aside", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary",
    "consent", "contentinfo", "cookie", "cookies", "dialog", "disqus", "footer", "form", "gdpr", "login", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "related", "replies", "respond", "search", "share", "sharing", "sidebar",
    "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Of an article or main element, only these words count: others name the page's layout.
CHROME_ARTICLES = {"ad", "ads", "advert", "advertisement", "comment", "comments", "promo", "related", "replies", "sponsored"}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    """A run of text between the edges of blocks; ``place``: in the article, in a part that is no main text, or open."""

    text: str
    place: str


def _words_of(rest: str) -> set[str]:
    if "=" not in rest:
        return set()
    return {w.lower() for found in _NAMES.findall(rest) for w in _WORDS.findall(" ".join(found))}


def page_blocks(html: str | None) -> list[Block]:
    """The page's text in blocks, in page order: references decoded, white space turned into single spaces, trimmed."""
    html, out, held, at = html or "", [], [], 0
    stack: list[tuple[str, str]] = [("", "open")]

    def close() -> None:
        text = " ".join(unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(Block(text, stack[-1][1]))

    while m := _MARKUP.search(html, at):
        held.append(html[at : m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name == "br":
            held.append(" ")
            continue
        if m["end"]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if name not in INLINE:
                close()
            elif depth and any(s not in INLINE for s, _ in stack[depth + 1 :]):
                continue  # an inline end tag does not end the blocks inside
            if depth:
                if stack[depth][1] != stack[-1][1] or stack[depth - 1][1] != stack[-1][1]:
                    close()
                del stack[depth:]
            continue
        if name not in INLINE and name not in ("script", "style"):
            close()
            if name not in VOID:  # a block ends the open paragraph
                inner = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] not in INLINE), 0)
                if stack[inner][0] == "p":
                    del stack[inner:]
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in VOID or m["rest"].endswith("/"):
            continue
        place = stack[-1][1]
        words = _words_of(m["rest"])
        if place != "chrome":
            if name in ("article", "main"):
                place = "chrome" if words & CHROME_ARTICLES else "article"
            elif name in CHROME_TAGS or (name not in ("html", "body") and words & CHROME_WORDS):
                place = "chrome"
            elif place == "open" and (name == "header" or ("header" in words and name not in ("html", "body"))):
                place = "chrome"
        if place != stack[-1][1]:
            close()
        stack.append((name, place))
    held.append(html[at:])
    close()
    return out


def repeated(streams: list[np.ndarray], run: int = RUN) -> list[np.ndarray]:
    """For each page's tokens, which of them lie in ``run`` or more in a row that another of the pages has too.

    The streams are concatenated, each with an end of its own that matches nothing. Suffixes are sorted by their first
    token, then by twice as many tokens as before until all ``run`` decide; suffixes that share them are then neighbours,
    and a group of neighbours from two pages covers its tokens.
    """
    page = np.concatenate([np.full(len(s) + 1, i) for i, s in enumerate(streams)])
    tokens = np.concatenate([np.append(s, 0) for s in streams])
    ends = np.cumsum([len(s) + 1 for s in streams]) - 1
    rank = np.unique(tokens, return_inverse=True)[1]
    rank[ends] = rank.max() + 1 + np.arange(len(ends))
    width = 1
    while width < run:
        step = min(width, run - width)
        after = np.append(rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64))
        rank = np.unique(rank * (int(after.max()) + 1) + after, return_inverse=True)[1]
        width += step
    order = np.argsort(rank, kind="stable")
    first = np.flatnonzero(np.r_[True, rank[order][1:] != rank[order][:-1]])
    low, high = np.minimum.reduceat(page[order], first), np.maximum.reduceat(page[order], first)
    shared = np.zeros(len(rank), bool)
    shared[order] = np.repeat(low != high, np.diff(np.r_[first, len(order)]))
    starts = np.flatnonzero(shared)
    edges = np.zeros(len(rank) + run + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + run, -1)
    covered = np.cumsum(edges)[: len(rank)] > 0
    return np.split(np.delete(covered, ends), np.cumsum([len(s) for s in streams])[:-1])


def _streams(pages: list[str | None]) -> tuple[list[list[Block]], list[list[list[str]]], list[np.ndarray], np.ndarray]:
    """Each page's blocks, their tokens and the tokens' numbers, and the hash of each number's token."""
    numbers: dict[str, int] = {}
    blocks = [page_blocks(p) for p in pages]
    words = [[b.text.split(" ") for b in page] for page in blocks]
    streams = [np.array([numbers.setdefault(w, len(numbers)) for block in page for w in block], np.int64) for page in words]
    return blocks, words, streams, np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in numbers], np.uint64)


def run_hashes(tokens: np.ndarray, run: int) -> np.ndarray:
    """A hash of every ``run`` tokens in a row, from the tokens' hashes."""
    out = np.zeros(max(0, len(tokens) - run + 1), np.uint64)
    for i in range(run):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + tokens[i : i + len(out)]
    return out.view(np.int64)


def group_runs(pages: list[str | None], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pages' distinct runs, and which of them touch a block that repetition decides."""
    runs, touches = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    blocks, words, streams, hashes = _streams(pages)
    for page, split, stream in zip(blocks, words, streams, strict=True):
        found = run_hashes(hashes[stream], run)
        is_open = np.repeat([b.place == "open" for b in page], [len(w) for w in split]) if page else np.zeros(0, bool)
        before = np.r_[0, np.cumsum(is_open)]
        runs.append(found)
        touches.append(before[run : run + len(found)] > before[: len(found)])
    distinct, at = np.unique(np.concatenate(runs), return_inverse=True)
    touching = np.zeros(len(distinct), bool)
    np.logical_or.at(touching, at, np.concatenate(touches))
    return distinct, touching


def open_places(pages: list[str | None], run: int = RUN) -> np.ndarray:
    """Places in a bitmap of ``PLACES`` of the hashes of all runs that touch a block which repetition decides."""
    some = [p for p in pages if any(b.place == "open" for b in page_blocks(p))]
    found, touching = group_runs(some, run)
    return np.unique(found[touching] % PLACES)


def main_texts(pages: list[str | None], run: int = RUN, shared: np.ndarray | None = None) -> list[str]:
    """Main texts of pages of one host; ``shared``: hashes of runs that further pages of the host have too.

    Blocks of an article stay as they are: what articles share is quoted or copied, not boilerplate. Outside it, blocks
    that the suffix array covers go, and so do runs of ``run`` or more covered tokens in the others; unique runs stay,
    except in elements that by name hold no main text.
    """
    blocks, words, streams, hashes = _streams(pages)
    out = []
    for page, split, stream, covered in zip(blocks, words, streams, repeated(streams, run), strict=True):
        if shared is not None and len(shared):
            starts = np.flatnonzero(np.isin(run_hashes(hashes[stream], run), shared))
            for i in range(run):
                covered[starts + i] = True
        at, texts = 0, []
        for block, tokens in zip(page, split, strict=True):
            gone = covered[at : at + len(tokens)]
            at += len(tokens)
            if block.place == "article":
                texts.append(block.text)
            elif block.place == "open" and not gone.all():
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                for low, high in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    if high - low < run:  # the end of a run from the block before, or the beginning of one
                        gone[low:high] = False
                texts.append(" ".join(t for t, g in zip(tokens, gone, strict=True) if not g))
        out.append("\n".join(texts))
    return out


def extract_main(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", run: int = RUN, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """Page by page: ``key``, ``url``, text (empty if none), n_chars (its code points).

    Pages are grouped by the host in their URL. A host of more than ``shard_pages`` pages is dealt by hash into groups of
    about as many, each with a suffix array of its own, so no task holds a host whole. Runs that touch a block which
    repetition decides are then looked for in the host's other groups: a bitmap of these runs' hashes, of fixed size, goes
    to every group, which gives the hashes of its runs that it may hold. Those that several groups of a host have are
    sent back to the groups in which they can decide a block, so the result is that of one suffix array per host; where
    no block is open nothing is sent. A null html is empty. Pages without a host in their URL,
    and null URLs, are one host. Rows that share an id are pages each. An empty table gives an empty table. Extra columns
    play no part.
    """
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    rows = rows.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)))
    large = stored(
        rows.groupBy("host").count().where(F.col("count") > shard_pages).select("host", F.ceil(F.col("count") / shard_pages).alias("shards")), "hosts"
    )
    kind = rows.schema["key"].dataType.simpleString()
    told = f"key {kind}, url string, text string, n_chars bigint"

    def html_of(group: pd.DataFrame) -> list[str | None]:
        return [None if pd.isna(h) else h for h in group["html"]]

    def texts(group: pd.DataFrame, shared: np.ndarray | None = None) -> pd.DataFrame:
        found = main_texts(html_of(group), run, shared)
        return pd.DataFrame({"key": group["key"], "url": group["url"], "text": pd.Series(found, index=group.index, dtype=object), "n_chars": pd.Series([len(t) for t in found], index=group.index, dtype="int64")})

    def runs(group: pd.DataFrame) -> pd.DataFrame:
        found, touching = group_runs(html_of(group), run)
        maybe = touching | bitmap[found % PLACES]
        found, touching = found[maybe], touching[maybe]
        return pd.DataFrame({"host": group["host"].iloc[0], "shard": group["shard"].iloc[0], "run": found, "touching": touching})

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"place": open_places(html_of(frame), run)})

    if large.isEmpty():
        out = rows.groupBy("host").applyInPandas(lambda group: texts(group), told)
    else:
        parts = rows.join(large, "host").withColumn("shard", F.pmod(F.xxhash64("key", "url"), F.col("shards"))).drop("shards")
        held = rows.join(large, "host", "left_semi").select("html").mapInPandas(places, "place bigint").distinct().collect()  # PLACES at most
        bitmap = np.zeros(PLACES, bool)
        bitmap[[r["place"] for r in held]] = True
        whole = rows.join(large, "host", "left_anti").groupBy("host").applyInPandas(lambda group: texts(group), told)
        if not held:
            alone = parts.groupBy("host", "shard").applyInPandas(lambda group: texts(group), told)
            return whole.unionByName(alone).withColumnRenamed("key", key).withColumnRenamed("url", url)
        shared = (
            parts.groupBy("host", "shard").applyInPandas(runs, "host string, shard bigint, run bigint, touching boolean")
            .groupBy("host", "run")
            .agg(F.min("shard").alias("low"), F.max("shard").alias("high"), F.collect_set(F.when(F.col("touching"), F.col("shard"))).alias("shards"))
            .where("low <> high")
            .select("host", F.explode("shards").alias("shard"), "run")
        )
        dealt = parts.groupBy("host", "shard").cogroup(shared.groupBy("host", "shard"))
        out = whole.unionByName(dealt.applyInPandas(lambda group, found: texts(group, found["run"].to_numpy(np.int64)), told))
    return out.withColumnRenamed("key", key).withColumnRenamed("url", url)


@query("op4_html_main_text")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page and its length."""
    return extract_main(table(spark, folder, "pages"))
