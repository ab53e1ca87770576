"""Periodic runs of words: stretches that repeat a few words over and over, found and cut down to one period."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import query, table
from lectern.llm.tokens import BLOCK_CHARS

#: Words of the shortest run, and periods that it must hold.
LEAST_WORDS, LEAST_PERIODS = 24, 3
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
SPACE = r"[\x20\x09-\x0D]+"


def lyndon_lengths(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that begins at each place, by the grouping phase of Baier's suffix sorter.

    Suffixes begin in groups by first symbol, and groups are taken from the highest down. Each suffix of a group points
    at the nearest place before it that is in a lower group. Places with pointers go up, next to their old group, those
    with more of them higher, and their group's word grows by as many copies of the taken group's word. When a group is
    taken its word is the longest Lyndon word at its places. No suffix array is made; time and memory are linear.
    """
    order = np.argsort(symbols, kind="stable")
    bounds = np.flatnonzero(np.diff(symbols[order])) + 1
    members = [part.tolist() for part in np.split(order, bounds)] if len(order) else []
    group = np.empty(len(symbols), np.int64)
    group[order] = np.repeat(np.arange(len(members)), [len(m) for m in members])
    group = group.tolist()
    word = [1] * len(members)
    lower, higher = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    pointer, taken, lengths = [-1] * len(group), bytearray(len(group)), [0] * len(group)
    now = len(members) - 1
    while now >= 0:
        size, to, counts = word[now], [], []
        for i in members[now]:
            if group[i] != now:
                continue
            lengths[i], taken[i] = size, 1
            j = i - 1
            while j >= 0 and taken[j]:
                j = pointer[j]
            pointer[i] = j
            if j >= 0:  # pointers never go down within a group, so equal ones are neighbours
                if to and to[-1] == j:
                    counts[-1] += 1
                else:
                    to.append(j)
                    counts.append(1)
        moved: dict[tuple[int, int], list[int]] = {}
        for j, count in zip(to, counts, strict=True):
            moved.setdefault((count, group[j]), []).append(j)
        for count, old in sorted(moved, reverse=True):
            new, places = len(members), moved[count, old]
            members.append(places)
            word.append(word[old] + count * size)
            lower.append(old)
            higher.append(higher[old])
            lower[higher[old]], higher[old] = new, new
            for j in places:
                group[j] = new
        members[now] = []
        now = lower[now]
    return np.array(lengths, np.int64)


class Extensions:
    """Longest common extensions of pairs of places, by sums of powers modulo 2^64 and halving steps, in whole arrays."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        mixed = (symbols.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        powers = np.full(self.n + 1, 0xD6E8FEB86659FD93, np.uint64)
        powers[0] = 1
        self.powers = np.cumprod(powers, dtype=np.uint64)
        self.sums = np.r_[np.uint64(0), np.cumsum((mixed ^ (mixed >> np.uint64(32))) * self.powers[:-1], dtype=np.uint64)]

    def grams(self, k: int) -> np.ndarray:
        """A hash of the k symbols from each place on."""
        return (self.sums[k:] - self.sums[:-k]) * self.powers[self.n - k :: -1][: self.n - k + 1]

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n symbols from a and from b on (a < b) have one hash."""
        return (self.sums[a + n] - self.sums[a]) * self.powers[b - a] == self.sums[b + n] - self.sums[b]

    def reach(self, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
        """How many symbols from a and b on, or before them, are equal."""
        most = a if back else self.n - b
        n = np.zeros(len(a), np.int64)
        for bit in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
            more = n + (1 << bit)
            fits = np.flatnonzero(more <= most)
            shift = more[fits] if back else 0
            same = self.equal(a[fits] - shift, b[fits] - shift, more[fits])
            n[fits[same]] = more[fits[same]]
        return n


def _exact(symbols: np.ndarray, start: int, end: int, period: int, inside: int) -> tuple[int, int]:
    """The run around symbols[inside:inside + 2 * period], should two hashes have been equal by chance."""
    n = len(symbols)
    whole = np.array_equal(symbols[start : end - period], symbols[start + period : end])
    if whole and (start == 0 or symbols[start - 1] != symbols[start - 1 + period]) and (end == n or symbols[end] != symbols[end - period]):
        return start, end
    breaks = np.flatnonzero(symbols[: n - period] != symbols[period:])
    k = int(np.searchsorted(breaks, inside))
    return (int(breaks[k - 1]) + 1 if k else 0), (int(breaks[k]) if k < len(breaks) else n - period) + period


def _runs(symbols: np.ndarray, least: int, periods: int) -> set[tuple[int, int, int]]:
    """Runs (start, length, period) of one stretch.

    The longest Lyndon word at a place, under one order of the symbols or its reverse, is the root of a run that begins
    less than a period before, for every run. So the roots are the candidates, and extending them both ways gives the runs.
    """
    n, extensions, found = len(symbols), Extensions(symbols), set()
    for order in (symbols, symbols.max() - symbols):
        root = lyndon_lengths(order)
        place = np.arange(n)
        place = place[place + (periods - 1) * root <= n]
        place = place[extensions.equal(place, place + root[place], (periods - 2) * root[place])]
        # the root one period before, if there, leads to the same run
        own = np.zeros(n, np.int64)
        own[place] = root[place]
        place = place[(place < own[place]) | (own[place - own[place]] != own[place])]
        period = root[place]
        start = place - extensions.reach(place, place + period, True)
        end = place + period + extensions.reach(place, place + period, False)
        long = end - start >= np.maximum(least, periods * period)
        for a, b, q, i in zip(*(x[long].tolist() for x in (start, end, period, place)), strict=True):
            a, b = _exact(symbols, a, b, q, i)
            if b - a >= max(least, periods * q):
                found.add((a, b - a, q))
    return found


def find_runs(symbols: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of at least ``least`` symbols and ``periods`` (3 or more) periods, by start.

    In such a run every window of some two thirds of the shortest run occurs twice, one period apart, so a run lies
    within a stretch that repeated windows cover: only such stretches are sorted, each apart. Nothing else can hold one.
    """
    if periods < 3:
        raise ValueError("a run must hold three periods or more")
    window = least - least // periods
    if len(symbols) < max(least, 3):
        return []
    grams = Extensions(symbols).grams(window)
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    at = np.flatnonzero(np.isin(grams, twice))
    edges = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    covered = np.r_[False, np.cumsum(edges[:-1]) > 0, False]
    ends = np.flatnonzero(covered[1:] != covered[:-1]).reshape(-1, 2)
    return sorted((low + start, n, q) for low, high in ends.tolist() for start, n, q in _runs(symbols[low:high], least, periods))


def numbered(words: list[bytes]) -> np.ndarray:
    """Words by the order of their first use."""
    known = dict.fromkeys(words)
    known = dict(zip(known, range(len(known)), strict=True))
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def word_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, periods: int = LEAST_PERIODS, collapsed: str = "collapsed") -> DataFrame:
    """``key``, ``n_words`` (long), ``runs`` (array of start, length, period, by start and period) and ``collapsed``.

    Words are what white space (ASCII) sets apart, compared byte by byte. A run is a stretch of words with the period,
    as long as it can be and no shorter than ``least`` words and ``periods`` periods. ``collapsed`` has the words, with
    one space between them, that are in no run or in the first period of every run they are in.

    Rows are handled where they are read; a task holds the words of one text. A null text and one without words have no
    runs and collapse to the empty text. Rows that share an id have a row each. An empty table gives an empty table.
    Extra columns play no part.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    run = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def one(body: bytes | None) -> tuple[int, list[dict], bytes]:
        words = (body or b"").split()
        found = find_runs(numbered(words), least, periods) if len(words) >= least else []
        if found:
            edges = np.zeros(len(words) + 1, np.int64)
            for start, n, q in found:
                edges[start + q] += 1
                edges[start + n] -= 1
            kept = b" ".join(w for w, in_run in zip(words, np.cumsum(edges[:-1]).tolist(), strict=True) if not in_run)
        else:
            kept = b" ".join(words)
        return len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in found], kept

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            keys, texts = frame.column("key"), frame.column("text").to_pylist()
            low = size = 0
            for high, body in enumerate(texts, 1):
                size += len(body or b"")
                if size >= BLOCK_CHARS or high == len(texts):
                    n, runs, kept = zip(*map(one, texts[low:high]), strict=True)
                    columns = [keys.slice(low, high - low), pa.array(n, pa.int64()), pa.array(runs, run), pa.array(kept, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "n_words", "runs", "collapsed"])
                    low, size = high, 0

    out = rows.mapInArrow(batches, f"key {kind}, n_words bigint, runs {RUNS}, collapsed string")
    return out.withColumnsRenamed({"key": key, "collapsed": collapsed})


def strongest(runs: Column) -> Column:
    """The run with the most periods; of equal ones the first. Null if there is none."""
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast(RUNS[6:-1])
    return F.aggregate(runs, none, lambda best, r: F.when(more(best, r), r).otherwise(best))


def looped(text: Column, seed: Column) -> Column:
    """The text of which a stretch to the end repeats its first words, where ten divides the seed; else the text itself."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, g = F.size(words).cast("long"), F.floor(seed / 10)
    first = F.when(n > 0, g % n)
    rest = n - first
    period = 1 + F.floor(rest / (3 + g % 8))
    part = F.slice(words, (first + 1).cast("int"), period.cast("int"))
    loop = F.slice(F.flatten(F.array_repeat(part, F.ceil(rest / period).cast("int"))), F.lit(1), rest.cast("int"))
    made = F.array_join(F.concat(F.slice(words, F.lit(1), first.cast("int")), loop), " ")
    return F.when((seed % 10 == 0) & (n > 0), made).otherwise(text)


@query("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of every document's words, a tenth of the documents looped by their id's checksum: the strongest run, digests
    of all runs and of the text without what repeats."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = word_runs(docs.withColumn("text", looped(F.col("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")))))
    top = found.withColumn("top", strongest(F.col("runs")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
