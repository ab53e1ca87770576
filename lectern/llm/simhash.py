"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints of all texts are cut down to distinct ones, dealt out to buckets, and linked inside each bucket by the index;
every bucket gives a spanning forest of its links, never all pairs, and the forests' union is reduced to components by
joins. No step holds more than two bucket pieces of fingerprints in one task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import Forest, components, query, spanning, stored, table

#: XXH64's seed; word i of a wide fingerprint takes SEED + i.
SEED = 42
#: Distinct fingerprints of a bucket that one task indexes; larger buckets are cut into pieces, and every two pieces meet in a task.
BUCKET_ROWS = 1 << 20
#: Fingerprints under a leaf of the index, and nodes under a node.
FAN = 16
#: Text that is split into words at a time, and pairs of nodes that are compared at a time.
BLOCK_BYTES, BLOCK_PAIRS = 1 << 20, 1 << 9
#: Rows of whole buckets that are indexed together.
BLOCK_ROWS = 1 << 17
#: Least hashes in a band, spanning forests of candidates that leave a bucket, and candidates that a task holds.
BAND, FORESTS, COMPARED = 4, 3, 1 << 17
#: Shingle hashes of a bucket that one task holds to check its pairs; larger buckets are cut into parts that meet two by two.
CHECKED = 1 << 21

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_blocks(text: str, words: int) -> Iterator[list[bytes]]:
    """Word shingles of the whole text, block by block: A-Z in lower case, words between ASCII white space."""
    data, at, tail, shared = text.encode("utf-8", "surrogatepass").lower(), 0, [], False
    while at < len(data):
        cut = _SPACE.search(data, min(len(data), at + BLOCK_BYTES))
        end = cut.start() if cut else len(data)
        tail += data[at:end].split()
        at = end
        if len(tail) >= words:
            shared = True
            yield [b" ".join(s) for s in zip(*(tail[i:] for i in range(words)), strict=False)]
            tail = tail[len(tail) - words + 1 :]
    if tail and not shared:
        yield [b" ".join(tail)]


def fingerprint(text: str | None, words: int, width: int) -> np.ndarray:
    """The SimHash of a text as width / 64 words; a bit is 1 if it is 1 in over half the shingles' hashes."""
    seeds = range(SEED, SEED + width // 64)
    ones, n = np.zeros(width, np.int64), 0
    for block in shingle_blocks(text or "", words):
        n += len(block)
        for i, seed in enumerate(seeds):
            hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in block), np.uint64, len(block))
            ones[64 * i : 64 * i + 64] += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8").astype(np.uint64)


def fingerprints(docs: DataFrame, key: str, text: str, words: int, width: int) -> DataFrame:
    """(id, f: array of long) for every row; null and wordless texts have fingerprint zero."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "f": [fingerprint(t, words, width).view(np.int64) for t in frame["text"]]})

    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(batches, f"id {kind}, f array<bigint>")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each value in the Gray-code order, in which neighbours differ in one bit."""
    for by in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(by))
    return x


def _differ(a: np.ndarray, b: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
    x = a ^ b
    return np.bitwise_count(x if among is None else x & among).sum(axis=1, dtype=np.int16)


class GrayIndex:
    """Fingerprints in Gray order under nodes that hold the bits all their members share (mask) and those bits' values."""

    def __init__(self, f: np.ndarray):
        self.size = len(f)
        every = np.full_like(f, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.levels = [(f, every)]
        low = high = f
        while len(low) > FAN:
            starts = np.arange(0, len(low), FAN)
            low, high = np.bitwise_and.reduceat(low, starts, axis=0), np.bitwise_or.reduceat(high, starts, axis=0)
            self.levels.append((low, ~(low ^ high)))

    def link(self, forest: Forest, at: int, radius: int, found=None) -> None:
        """Unite all pairs within the radius; the fingerprints stand at ``at`` and after in the forest.

        With ``found``, the forest stays as it is, and found(i, j, differing bits) gets the pairs of different trees.
        """
        for i, j, differ in self.pairs(forest, at, radius):
            if found:
                found(i, j, differ)
            else:
                forest.unite(i, j)

    def pairs(self, forest: Forest, at: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The pairs within the radius and their differing bits, part by part; the forest may grow in between.

        Two nodes are followed down while their shared bits differ in no more than the radius. A step adds only the
        differences on bits that came to be shared since the step above. Nodes whose members are one tree already are
        left out together, so dense groups cost little more than their size.
        """
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        i, j = np.triu_indices(n)
        todo = [(top, i, j, np.zeros_like(self.levels[top][0], shape=(len(i), self.levels[top][0].shape[1])), np.zeros(len(i), np.int16))]
        while todo:
            level, i, j, known, differ = todo.pop()
            if len(i) > BLOCK_PAIRS:
                todo.append((level, i[BLOCK_PAIRS:], j[BLOCK_PAIRS:], known[BLOCK_PAIRS:], differ[BLOCK_PAIRS:]))
                i, j, known, differ = i[:BLOCK_PAIRS], j[:BLOCK_PAIRS], known[:BLOCK_PAIRS], differ[:BLOCK_PAIRS]
            bits, mask = self.levels[level]
            shared = mask[i] & mask[j]
            differ = differ + _differ(bits[i], bits[j], shared & ~known)
            near = differ <= radius
            i, j, shared, differ = i[near], j[near], shared[near], differ[near]
            if level == 0:
                apart = i < j
                yield at + i[apart], at + j[apart], differ[apart]
                continue
            one, tree = self._trees(forest, at, level)
            alike = one[i] & one[j] & (tree[i] == tree[j])
            i, j, shared, differ = i[~alike], j[~alike], shared[~alike], differ[~alike]
            below = len(self.levels[level - 1][0])
            step = np.arange(FAN)
            ci = np.repeat(i[:, None] * FAN + step, FAN, axis=1).ravel()
            cj = np.tile(j[:, None] * FAN + step, (1, FAN)).ravel()
            from_pair = np.repeat(np.arange(len(i)), FAN * FAN)
            real = (ci < below) & (cj < below) & (ci <= cj)
            if len(ci):
                todo.append((level - 1, ci[real], cj[real], shared[from_pair[real]], differ[from_pair[real]]))

    def _trees(self, forest: Forest, at: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        roots = forest.up[at : at + self.size]
        starts = np.arange(0, self.size, FAN**level)
        least, most = np.minimum.reduceat(roots, starts), np.maximum.reduceat(roots, starts)
        return least == most, least


def linked(bucket: np.ndarray, f: np.ndarray, lead: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each bucket, as positions (root, member).

    bucket: a run number per row, ascending; lead: the value whose Gray rank orders the rows of a bucket.
    """
    order = np.lexsort((*(f[:, i] for i in range(f.shape[1])), gray_rank(lead), bucket))
    bucket, f = bucket[order], f[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, len(bucket)])
    ends = np.repeat(starts + sizes, sizes)
    forest = Forest(len(bucket))
    rows = np.arange(len(bucket))
    for by in range(1, 2 * FAN):  # neighbours in Gray order; small buckets are done after this
        rows = rows[rows + by < ends[rows]]
        if not len(rows):
            break
        for cut in range(0, len(rows), 1 << 18):
            r = rows[cut : cut + (1 << 18)]
            near = _differ(f[r], f[r + by]) <= radius
            forest.unite(r[near], r[near] + by)
    for start, size in zip(starts, sizes, strict=True):
        if size > 2 * FAN:
            GrayIndex(f[start : start + size]).link(forest, int(start), radius)
    member = np.flatnonzero(forest.up != np.arange(len(bucket)))
    return order[forest.up[member]], order[member]


def turned(f: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The word of each fingerprint that holds bit ``last``, turned so that this bit leads: a block that ends there comes first."""
    word, by = np.take_along_axis(f, last[:, None] // 64, axis=1)[:, 0], np.uint64(63) - (last % 64).astype(np.uint64)
    return (word << by) | (word >> ((np.uint64(64) - by) % np.uint64(64)))


def _linker(radius: int, words: int, bits: int, last: list[int]):
    names, last_of = [f"f{i}" for i in range(words)], np.array(last)

    def edges(block: pd.DataFrame) -> Iterator[pd.DataFrame]:
        run = block.groupby(["bucket", "lo", "hi"], sort=True).ngroup().to_numpy()
        f = block[names].to_numpy(np.int64).view(np.uint64)
        a, b = linked(run, f, turned(f, last_of[block["bucket"].to_numpy() >> bits]), radius)
        yield pd.DataFrame({f"{end}{i}": f[rows, i].view(np.int64) for end, rows in (("a", a), ("b", b)) for i in range(words)})

    return _by_buckets(edges)


def _by_buckets(links):
    """Feeds rows that are sorted by bucket to a function, many whole buckets at a time."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in frames:
            held.append(frame)
            n += len(frame)
            if n >= BLOCK_ROWS:
                block = pd.concat(held, ignore_index=True)
                last = block.iloc[-1]
                going_on = ((block["bucket"] == last["bucket"]) & (block["lo"] == last["lo"]) & (block["hi"] == last["hi"])).to_numpy()
                if not going_on.all():
                    yield from links(block[~going_on])
                held, n = [block[going_on]], int(going_on.sum())
        if n:
            yield from links(pd.concat(held, ignore_index=True))

    return batches


def _bits(f: list[Column], positions: list[int]) -> Column:
    out = F.lit(0).cast("long")
    for p in positions:
        bit = F.shiftrightunsigned(f[p // 64], p % 64).bitwiseAND(F.lit(1).cast("long"))
        out = F.shiftleft(out, 1).bitwiseOR(bit)
    return out


def sampled_tables(total: int, width: int, radius: int, recall: float) -> list[list[int]]:
    """Samples of bits, as long as the logarithm of the count of fingerprints asks for, and as many as it takes for two
    fingerprints at the very edge of the radius to agree on one of them with probability ``recall``: a sample holds a bit
    once, so each further bit must miss as many differing ones among fewer."""
    bits = min(width, max(8, math.ceil(math.log2(max(2, total))) - 4))
    alike = math.prod(max(0, width - radius - i) / (width - i) for i in range(bits))
    if not alike:
        raise ValueError(f"no sample of {bits} bits misses {radius} of {width}")
    tables = 1 if alike >= recall else math.ceil(math.log(1 - recall) / math.log(1 - alike))
    draw = np.random.default_rng(SEED)
    return [sorted(int(x) for x in draw.choice(width, bits, replace=False)) for _ in range(tables)]


def simhash_groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = 3,
    width: int = 64,
    radius: int = 3,
    recall: float | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per document: ``key``, fingerprint (hexadecimal), component_id (smallest id reachable by links, itself included).

    Fingerprints of ``width`` bits over shingles of ``words`` words link if they differ in at most ``radius`` bits.
    Without ``recall`` every link is found: the fingerprint is cut into radius + 1 blocks, one of which any two linked
    fingerprints share; a bucket is a block and its value, and Gray order starts with that block. For a radius too wide
    for that, ``recall`` names the share of pairs at the edge of the radius that must meet in a bucket: buckets are then
    samples of bits (``sampled_tables``), and nearer pairs meet more often. Links are checked in full in both cases.

    Null and wordless texts have fingerprint zero, which links like any other. Texts of equal fingerprints are linked;
    only distinct fingerprints are compared. Null ids never become a component_id, unless all of a component are null.
    Rows that share an id share their result. An empty table gives an empty table. Extra columns play no part.
    """
    spark = docs.sparkSession
    n_words = width // 64
    ids = stored(fingerprints(docs, key, text, words, width), "fingerprints")
    f = [F.col(f"f{i}") for i in range(n_words)]
    wide = ids.select("id", *[F.col("f")[i].alias(f"f{i}") for i in range(n_words)])
    node = f[0] if n_words == 1 else F.xxhash64(*f)
    distinct = stored(wide.groupBy(*f).agg(F.min("id").alias("first")).withColumn("node", node), "distinct")
    total = distinct.count()
    if recall is None:
        size = width // (radius + 1)
        blocks = [list(range(size * b, size * (b + 1) if b < radius else width)) for b in range(radius + 1)]
    else:
        blocks = sampled_tables(total, width, radius, recall)
    blocks = [b[-48:] for b in blocks]  # a bucket is one number; what shares a block shares its end
    bits = max(map(len, blocks))
    buckets = F.array(*[F.lit(t << bits).cast("long").bitwiseOR(_bits(f, b)) for t, b in enumerate(blocks)])
    dealt = distinct.select(*f, F.explode(buckets).alias("bucket"))
    hot = None
    if total > bucket_rows:  # else no bucket can have as many
        hot = stored(dealt.groupBy("bucket").count().where(F.col("count") > bucket_rows).select("bucket", F.ceil(F.col("count") / bucket_rows).alias("pieces")), "hot")
    if hot is None or hot.isEmpty():
        dealt = dealt.withColumns({"lo": F.lit(0), "hi": F.lit(0)})
    else:
        pieces = F.coalesce(F.col("pieces"), F.lit(1))
        dealt = (
            dealt.join(hot, "bucket", "left")
            .withColumn("piece", F.pmod(F.xxhash64(*f), pieces))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
            .withColumns({"lo": F.least("piece", "other").cast("int"), "hi": F.greatest("piece", "other").cast("int")})
            .drop("pieces", "piece", "other")
        )
    linker = _linker(radius, n_words, bits, [b[-1] for b in blocks])
    ends = [f"{end}{i}" for end in "ab" for i in range(n_words)]
    pairs = dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInPandas(linker, ", ".join(f"{e} bigint" for e in ends))
    named_by = lambda end: F.col(f"{end}0") if n_words == 1 else F.xxhash64(*[f"{end}{i}" for i in range(n_words)])
    labels = components(pairs.select(named_by("a").alias("a"), named_by("b").alias("b")))
    named = stored(
        distinct.join(labels, "node", "left").select(*f, "first", F.coalesce("component", "node").alias("component")),
        "named",
    )
    first = stored(named.groupBy("component").agg(F.min("first").alias("component_id")), "first")
    final = stored(named.join(first, "component").select(*f, "component_id"), "final")
    hexed = F.concat(*[F.lower(F.lpad(F.hex(x), 16, "0")) for x in reversed(f)])
    return wide.join(final, [f"f{i}" for i in range(n_words)]).select(F.col("id").alias(key), hexed.alias("fingerprint"), "component_id")


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, in order."""
    parts = [np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in block), np.uint64, len(block))) for block in shingle_blocks(text or "", words)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def set_fingerprint(hashes: np.ndarray, width: int) -> np.ndarray:
    """The SimHash of distinct shingles; words after the first take bits of the hashes mixed once more (SplitMix64)."""
    out = []
    for _ in range(width // 64):
        ones = np.zeros(64, np.int64)
        for low in range(0, len(hashes), BLOCK_ROWS):
            ones += np.unpackbits(hashes[low : low + BLOCK_ROWS].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])
        hashes = hashes + np.uint64(0x9E3779B97F4A7C15)
        hashes = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = (hashes ^ (hashes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        hashes = hashes ^ (hashes >> np.uint64(31))
    return np.array(out, np.uint64)


def band_keys(hashes: np.ndarray, bands: int) -> list[int]:
    """A key for each band: what the least values of a set of hashes are under ``BAND`` random orders."""
    draw = np.random.default_rng(SEED)
    factors, shifts = (draw.integers(0, 1 << 64, bands * BAND, np.uint64) for _ in range(2))
    least = np.full(bands * BAND, np.uint64(0xFFFFFFFFFFFFFFFF))
    for low in range(0, len(hashes), 1 << 12):
        mixed = hashes[low : low + (1 << 12), None] * (factors | np.uint64(1)) + shifts
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    return [int(np.uint64(xxhash.xxh3_64_intdigest(least[BAND * b : BAND * b + BAND].tobytes(), b)).view(np.int64)) for b in range(bands)]


def strongest_forest(forest: Forest, i: np.ndarray, j: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Which of the links make a spanning forest over the trees that are there, those of fewest differing bits first."""
    trees, kept = Forest(0), []
    trees.up = forest.up.copy()
    for level in np.unique(differ):
        edges = np.flatnonzero(differ == level)
        while len(edges):
            a, b = trees.find(i[edges]), trees.find(j[edges])
            apart = a != b
            edges, low, high = edges[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            _, first = np.unique(high, return_index=True)  # each root hooks once, to a lower one: no rings
            trees.up[high[first]] = low[first]
            kept.append(edges[first])
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


class Candidates:
    """Links between rows, cut down again and again to ``forests`` spanning forests that share no link."""

    def __init__(self, forest: Forest, allowed, forests: int = FORESTS):
        self.forest, self.allowed, self.forests, self.n = forest, allowed, forests, 0
        self.keys, self.differ = [np.zeros(0, np.int64)], [np.zeros(0, np.int16)]

    def add(self, i: np.ndarray, j: np.ndarray, differ: np.ndarray) -> None:
        apart = self.forest.up[i] != self.forest.up[j]
        i, j, differ = i[apart], j[apart], differ[apart]
        good = self.allowed(i, j)
        i, j = i[good], j[good]
        self.keys.append(np.minimum(i, j) * len(self.forest.up) + np.maximum(i, j))
        self.differ.append(differ[good])
        self.n += len(i)
        if self.n > max(COMPARED, 2 * self.forests * len(self.forest.up)):
            self.cut_down()

    def cut_down(self) -> tuple[np.ndarray, np.ndarray]:
        """The links that are left, as positions."""
        keys, first = np.unique(np.concatenate(self.keys), return_index=True)
        differ = np.concatenate(self.differ)[first]
        ends, rest, kept = np.divmod(keys, max(1, len(self.forest.up))), np.arange(len(keys)), []
        for _ in range(self.forests):
            some = strongest_forest(self.forest, ends[0][rest], ends[1][rest], differ[rest])
            kept.append(rest[some])
            rest = np.delete(rest, some)
        kept = np.concatenate(kept)
        self.keys, self.differ, self.n = [keys[kept]], [differ[kept]], len(kept)
        return ends[0][kept], ends[1][kept]


class Arranged:
    """The rows of whole buckets by bucket and Gray order, each group of a bucket one tree."""

    def __init__(self, block: pd.DataFrame, names: list[str], similarity: float, keys: tuple[str, ...] = ("bucket", "lo", "hi")):
        run = block.groupby(list(keys), sort=False).ngroup().to_numpy()
        f = np.ascontiguousarray(block[names].to_numpy(np.int64)).view(np.uint64)
        order = np.lexsort((*(f[:, w] for w in range(f.shape[1])), gray_rank(f[:, 0]), run))
        self.block, self.f, run = block.iloc[order], f[order], run[order]
        self.node, self.n, group, self.piece = (self.block[c].to_numpy(np.int64) for c in ("node", "n", "group", "piece"))
        self.across = (self.block["lo"] != self.block["hi"]).to_numpy()
        self.similarity, self.forest = similarity, Forest(len(block))
        _, first, inverse = np.unique(np.stack([run, group]), axis=1, return_index=True, return_inverse=True)
        self.forest.up = first[inverse.ravel()]
        self.starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        self.sizes = np.diff(np.r_[self.starts, len(run)])

    def allowed(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n, piece = self.n, self.piece
        return (np.minimum(n[i], n[j]) >= self.similarity * np.maximum(n[i], n[j])) & (~self.across[i] | (piece[i] != piece[j]))

    def neighbours(self) -> Iterator[tuple[int, np.ndarray]]:
        """How far apart in Gray order, and the rows that have a row there."""
        ends, rows = np.repeat(self.starts + self.sizes, self.sizes), np.arange(len(self.node))
        for by in range(1, 2 * FAN):
            rows = rows[rows + by < ends[rows]]
            yield by, rows

    def large(self) -> Iterator[tuple[int, int]]:
        """Buckets some of whose pairs are no neighbours."""
        return ((start, size) for start, size in zip(self.starts.tolist(), self.sizes.tolist(), strict=True) if size >= 2 * FAN)

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All allowed pairs of different groups within the radius, each once, part by part."""
        f, forest, wide = self.f, self.forest, np.repeat(self.sizes >= 2 * FAN, self.sizes)
        for by, rows in self.neighbours():
            r = rows[~wide[rows]]
            r = r[(forest.up[r] != forest.up[r + by]) & (_differ(f[r], f[r + by]) <= radius)]
            r = r[self.allowed(r, r + by)]
            yield r, r + by
        for start, size in self.large():
            for i, j, _ in GrayIndex(f[start : start + size]).pairs(forest, start, radius):
                fits = self.allowed(i, j) & (forest.up[i] != forest.up[j])
                if fits.any():
                    yield i[fits], j[fits]


def _not_alone(block: pd.DataFrame) -> pd.DataFrame:
    run = block.groupby(["bucket", "lo", "hi"], sort=False).ngroup().to_numpy()
    return block[np.bincount(run)[run] > 1]


def _candidates(width: int, radius: int, similarity: float, every: bool, cut: bool = True):
    """Links to be checked inside each bucket: pairs of nodes of different groups whose fingerprints are within the radius
    and whose counts of shingles allow the similarity, as few as connect the same trees three times over.

    Neighbours in Gray order are looked at, once over, and with ``every`` all pairs, by the index. What its pairs connect is
    one tree for the rest of the search, so that a dense group costs little more than its size.

    Without ``cut`` nothing is left out: all such pairs of different groups come out, part by part as they are found.
    """
    names = [f"f{i}" for i in range(width // 64)]

    def pairs(block: pd.DataFrame) -> Iterator[pd.DataFrame]:
        block = _not_alone(block)
        if block.empty:
            return
        a = Arranged(block, names, similarity)

        def named(i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
            one, other = a.node[i], a.node[j]
            return pd.DataFrame({"a": np.minimum(one, other), "b": np.maximum(one, other)})

        if not cut:
            for i, j in a.pairs(radius):
                yield named(i, j)
            return
        found = Candidates(a.forest, a.allowed, FORESTS if every else 1)
        for by, rows in a.neighbours():
            differ = _differ(a.f[rows], a.f[rows + by])
            near = differ <= radius
            found.add(rows[near], rows[near] + by, differ[near])
        if every:
            trial = Forest(0)
            trial.up = a.forest.up.copy()

            def nearer(i: np.ndarray, j: np.ndarray, differ: np.ndarray) -> None:
                fits = a.allowed(i, j)
                i, j, differ = i[fits], j[fits], differ[fits]
                some = strongest_forest(trial, i, j, differ)
                found.add(i[some], j[some], differ[some])
                trial.unite(i[some], j[some])

            for start, size in a.large():
                GrayIndex(a.f[start : start + size]).link(trial, start, radius, nearer)
        yield named(*found.cut_down())

    return _by_buckets(pairs)


def _first_met(a: Arranged, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the bucket is the first of those that the rows of a pair share."""
    bands, bucket = np.stack(a.block["bands"].to_numpy()), a.block["bucket"].to_numpy()
    alike = bands[i] == bands[j]
    return bands[i, alike.argmax(axis=1)] == bucket[i]


def _open(width: int, radius: int, similarity: float):
    """The rows of each bucket that have a pair of different groups, by ``_candidates``, which no bucket before has."""
    names = [f"f{i}" for i in range(width // 64)]

    def rows(block: pd.DataFrame) -> Iterator[pd.DataFrame]:
        block = _not_alone(block)
        if block.empty:
            return
        a = Arranged(block, names, similarity)
        is_open = np.zeros(len(block), bool)
        for i, j in a.pairs(radius):
            for low in range(0, len(i), BLOCK_ROWS):
                some, other = i[low : low + BLOCK_ROWS], j[low : low + BLOCK_ROWS]
                new = ~(is_open[some] & is_open[other])
                some, other = some[new], other[new]
                first = _first_met(a, some, other)
                is_open[some[first]] = is_open[other[first]] = True
        if is_open.any():
            yield a.block[is_open]

    return _by_buckets(rows)


def _checked(width: int, radius: int, similarity: float):
    """A spanning forest of the links among a bucket's open rows: their pairs, checked on the sets of hashes."""
    names = [f"f{i}" for i in range(width // 64)]

    def links(block: pd.DataFrame) -> pd.DataFrame:
        a = Arranged(block, names, similarity, ("bucket", "lo", "hi", "low", "high"))
        part, two = a.block["part"].to_numpy(), block["low"].iloc[0] != block["high"].iloc[0]
        hashes = a.block["hashes"].to_numpy()
        n = np.array([len(h) for h in hashes])
        ids = np.unique(np.concatenate(hashes), return_inverse=True)[1]
        at = np.cumsum(n) - n
        here, forest = np.zeros(ids.max() + 1, bool), a.forest
        kept: list[tuple[int, int]] = []
        for i, j in a.pairs(radius):
            if two:
                apart = part[i] != part[j]
                i, j = i[apart], j[apart]
            first = _first_met(a, i, j)
            i, j = i[first], j[first]
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            turns = np.flatnonzero(np.diff(i, prepend=-1)).tolist()
            for low, high in zip(turns, [*turns[1:], len(i)], strict=False):
                one, others = int(i[low]), j[low:high]
                others = others[forest.up[others] != forest.up[one]]
                if not len(others):
                    continue
                here[ids[at[one] : at[one] + n[one]]] = True
                ends = np.cumsum(n[others])
                held = here[ids[np.arange(ends[-1]) + np.repeat(at[others] - (ends - n[others]), n[others])]]
                here[ids[at[one] : at[one] + n[one]]] = False
                both = np.add.reduceat(held, ends - n[others], dtype=np.int64)
                like = others[both / (n[one] + n[others] - both) >= similarity]
                for other in like.tolist():
                    if forest.up[other] != forest.up[one]:
                        kept.append((one, other))
                        forest.unite(np.array([one]), np.array([other]))
        ends = a.node[np.array(kept, np.int64).reshape(-1, 2)]
        return pd.DataFrame({"a": ends.min(axis=1), "b": ends.max(axis=1)})

    return links


def near_copy_groups(
    docs: DataFrame,
    similarity: float,
    key: str = "doc_id",
    text: str = "text",
    words: int = 5,
    width: int = 128,
    radius: int = 28,
    recall: float = 0.99,
    piece_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per document: ``key``, component_id (smallest id reachable by links, itself included).

    Documents link if the Jaccard similarity of their distinct shingles of ``words`` words is ``similarity`` or more.
    Texts of equal sets of shingles are one node. Nodes meet in buckets: bands of ``BAND`` least hashes, as many bands as
    two sets of just that similarity need to share one with probability ``recall``, whatever the corpus's size. In a
    bucket the Gray-order index finds the pairs whose SimHash differs in at most ``radius`` bits (sets of similarity 0.8
    differ in 19 of 128 on average, with a deviation of 4). They only are candidates: each is checked on the sets.

    A bucket gives no list of its pairs. Neighbours in Gray order are checked and united first. Then all pairs of
    different groups are looked at inside the task; what leaves it are three spanning forests that share no pair, made of
    a forest of all pairs and of the neighbours, nearest first. What passes the check is united, which leaves few pairs of
    different groups where copies are many. Of these only the rows leave a bucket, once each, and meet again with their sets: a
    task checks all pairs of a bucket's rows, each in the first bucket that both are in, and gives a spanning forest of the
    links. So no candidate goes unchecked, and none leaves a task as a pair. A bucket over ``piece_rows`` is cut into pieces that meet two by two. Wordless and null texts link with each other only. Null ids
    never become a component_id, unless all of a component are null. Rows that share an id share their result. An empty
    table gives an empty table; extra columns play no part.
    """
    n_words, bands = width // 64, max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**BAND)))
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    f = [f"f{i}" for i in range(n_words)]

    def node_of(hashes: np.ndarray) -> int:
        return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))

    def signatures(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for t in frame["text"]:
                hashes = shingle_set(t, words)
                found.append((node_of(hashes), len(hashes), *set_fingerprint(hashes, width).view(np.int64).tolist(), band_keys(hashes, bands)))
            yield pd.concat([frame[["id"]].reset_index(drop=True), pd.DataFrame(found, columns=["node", "n", *f, "bands"])], axis=1)

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low in range(0, len(frame), 128):
                found = [shingle_set(t, words) for t in frame["text"].iloc[low : low + 128]]
                yield pd.DataFrame({"node": [node_of(h) for h in found], "hashes": [h.view(np.int64) for h in found]})

    ids = stored(rows.mapInPandas(signatures, f"id {kind}, node bigint, n bigint, " + ", ".join(f"{c} bigint" for c in f) + ", bands array<bigint>"), "signatures")
    distinct = stored(ids.groupBy("node").agg(F.min("id").alias("first"), *[F.min(c).alias(c) for c in ("n", *f)], F.min("bands").alias("bands")), "distinct")
    worded = distinct.where("n > 0").drop("first")
    buckets = worded.select("node", F.explode("bands").alias("bucket"))
    counts = buckets.groupBy("bucket").count().where(F.col("count") > piece_rows) if worded.count() > piece_rows else None
    hot = counts and stored(counts.select("bucket", F.ceil(F.col("count") / piece_rows).alias("pieces")), "hot")

    def in_buckets(nodes: DataFrame) -> DataFrame:
        dealt = nodes.withColumn("bucket", F.explode("bands"))
        if hot is None or hot.isEmpty():
            dealt = dealt.withColumns({"piece": F.lit(0).cast("long"), "lo": F.lit(0), "hi": F.lit(0)})
        else:
            pieces = F.coalesce(F.col("pieces"), F.lit(1))
            dealt = (
                dealt.join(hot, "bucket", "left")
                .withColumn("piece", F.pmod(F.xxhash64("node"), pieces))
                .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
                .withColumns({"lo": F.least("piece", "other").cast("int"), "hi": F.greatest("piece", "other").cast("int")})
                .drop("pieces", "other")
            )
        return dealt

    def by_bucket(dealt: DataFrame) -> DataFrame:
        return dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

    def candidates(nodes: DataFrame, every: bool) -> DataFrame:
        return by_bucket(in_buckets(nodes).drop("bands")).mapInPandas(_candidates(width, radius, similarity, every), "a bigint, b bigint")

    def sets_of(nodes: DataFrame) -> DataFrame:
        needed = stored(distinct.join(nodes, "node", "left_semi").select(F.col("first").alias("needed_id")).distinct(), "needed")
        texts = rows.join(needed, F.col("id").eqNullSafe(F.col("needed_id")), "left_semi").select("text")
        return stored(texts.mapInPandas(sets, "node bigint, hashes array<bigint>").join(nodes, "node", "left_semi").dropDuplicates(["node"]), "sets")

    def similar(pairs: DataFrame, name: str) -> DataFrame:
        held = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        met = pairs.join(held.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a").join(held.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
        both = F.size(F.array_intersect("ha", "hb"))
        return stored(met.where(both / (F.size("ha") + F.size("hb") - both) >= F.lit(float(similarity))).select("a", "b"), name)

    def rest(nodes: DataFrame) -> DataFrame:
        dealt = in_buckets(nodes)
        met = stored(by_bucket(dealt).mapInPandas(_open(width, radius, similarity), dealt.schema), "open")
        parts = F.ceil(F.sum("n") / CHECKED)
        large = stored(met.groupBy("bucket", "lo", "hi").agg(parts.alias("parts")).where("parts > 1"), "large")
        parts = F.coalesce(F.col("parts"), F.lit(1))
        cut = (
            met.join(large, ["bucket", "lo", "hi"], "left")
            .withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), parts))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
            .withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
            .drop("parts", "other")
        )
        whole = cut.join(sets_of(met.select("node").distinct()), "node")
        return stored(whole.groupBy("bucket", "lo", "hi", "low", "high").applyInPandas(_checked(width, radius, similarity), "a bigint, b bigint"), "rest")

    def grouped(links: DataFrame) -> DataFrame:
        united = components(links).withColumnRenamed("component", "group")
        return stored(worded.join(united, "node", "left").withColumn("group", F.coalesce("group", "node")), "grouped")

    near = stored(candidates(worded.withColumn("group", F.col("node")), False).distinct(), "candidates")
    links = similar(near, "sure")
    wide = stored(candidates(grouped(links), True).distinct(), "candidates")
    links = links.unionByName(similar(wide, "links"))
    labels = components(links.unionByName(rest(grouped(links))))
    named = stored(distinct.join(labels, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component")), "named")
    first = stored(named.groupBy("component").agg(F.min("first").alias("component_id")), "first")
    final = named.join(first, "component").select("node", "component_id")
    return ids.select("id", "node").join(final, "node").select(F.col("id").alias(key), "component_id")


@query("op10_simhash_near_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document: three-word shingles, links at three or fewer bits."""
    return simhash_groups(table(spark, folder, "documents"))
