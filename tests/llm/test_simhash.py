"""Fingerprints, the Gray-order index and the groups, against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import simhash
from tests.llm.odd import LONG, ROWS, documents, none


def plain_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet="aAbZ É\t\n\x0b\xa0ß日 ", max_size=60), st.integers(1, 5))
def test_fingerprint(text, words):
    assert int(simhash.fingerprint(text, words, 64)[0]) == plain_fingerprint(text, words)


def test_long_texts_are_read_in_blocks_without_a_seam(monkeypatch):
    text = " ".join(random.Random(1).choice(["a", "bb", "ccc"]) for _ in range(3000))
    whole = simhash.fingerprint(text, 3, 128)
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 7)
    assert (simhash.fingerprint(text, 3, 128) == whole).all()
    assert int(whole[0]) == plain_fingerprint(text, 3)


def brute_components(prints, radius):
    forest = list(range(len(prints)))

    def root(i):
        while forest[i] != i:
            i = forest[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if sum(bin(int(a) ^ int(b)).count("1") for a, b in zip(prints[i], prints[j], strict=True)) <= radius:
                a, b = root(i), root(j)
                forest[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def clustered(draw, n, words, flips):
    """Fingerprints around few centres, so that links, chains and whole groups of one component are there."""
    centres = [[draw.getrandbits(64) for _ in range(words)] for _ in range(4)]
    out = []
    for _ in range(n):
        f = list(draw.choice(centres))
        for _ in range(draw.randrange(flips)):
            f[draw.randrange(words)] ^= 1 << draw.randrange(64)
        out.append(f)
    return np.unique(np.array(out, np.uint64), axis=0)


@pytest.mark.parametrize(("words", "flips", "radius"), [(1, 12, 3), (1, 4, 3), (1, 30, 3), (2, 40, 26), (1, 8, 0)])
def test_index_finds_every_link(words, flips, radius):
    f = clustered(random.Random(flips + radius), 500, words, flips)
    a, b = simhash.linked(np.zeros(len(f), int), f, f[:, 0], radius)
    forest = simhash.Forest(len(f))
    forest.unite(a, b)
    want = brute_components(f, radius)
    assert forest.up.tolist() == want
    assert len(a) == len(f) - len(set(want))  # a forest, not all pairs


def test_buckets_are_apart():
    f = np.array([[1], [1], [1]], np.uint64)
    a, b = simhash.linked(np.array([0, 1, 1]), f, f[:, 0], 3)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(1, 2)]


def texts(n):
    draw = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    bases = [[draw.choice(words) for _ in range(120)] for _ in range(6)]
    out = []
    for i in range(n):
        t = list(bases[i % 6]) if i % 4 else [draw.choice(words) for _ in range(draw.randrange(1, 90))]
        for _ in range(i % 3):
            t[draw.randrange(len(t))] = draw.choice(words)
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize(("bucket_rows", "radius"), [(1 << 17, 3), (8, 3), (1 << 17, 0), (1 << 17, 1)])
def test_groups_against_brute_force(spark, bucket_rows, radius):
    rows = ROWS + [(50 + i, t, "en", "s", 0) for i, t in enumerate(texts(240))]
    found = simhash.simhash_groups(documents(spark, rows), radius=radius, bucket_rows=bucket_rows).collect()
    prints = [plain_fingerprint(r[1], 3) for r in rows]
    groups = brute_components([[p] for p in prints], radius)
    smallest = {}
    for r, g in zip(rows, groups, strict=True):
        if r[0] is not None:
            smallest[g] = min(smallest.get(g, r[0]), r[0])
    want = sorted((str(r[0]), format(p, "016x"), smallest.get(g)) for r, p, g in zip(rows, prints, groups, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in found) == want


def test_wide_fingerprints_meet_in_sampled_buckets(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts(240))]
    found = {r.doc_id: r.component_id for r in simhash.simhash_groups(documents(spark, rows), words=5, width=128, radius=26, recall=0.99).collect()}
    f = np.array([simhash.fingerprint(r[1], 5, 128) for r in rows])
    want = brute_components(f, 26)
    assert all(found[i] >= want[i] for i in range(len(rows)))  # no link that is none
    assert np.mean([found[i] == want[i] for i in range(len(rows))]) >= 0.98


def test_nothing_and_empty_texts(spark):
    assert simhash.simhash_groups(none(spark)).count() == 0
    found = simhash.simhash_groups(documents(spark, [(4, None, "", "", 0), (3, " ", "", "", 0), (9, LONG, "", "", 0)])).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(4, 3), (3, 3), (9, 9)}
    assert {r.fingerprint for r in found if r.doc_id < 9} == {"0" * 16}


@pytest.mark.parametrize("total", [10_000, 200_000, 10_000_000])
def test_recall_over_the_whole_radius_at_the_size_of_the_corpus(total):
    draw, width, radius = np.random.default_rng(3), 128, 26
    tables = simhash.sampled_tables(total, width, radius, 0.95)
    assert len(tables[0]) == max(8, int(np.ceil(np.log2(total))) - 4)
    apart = np.argsort(draw.random((1000, width)), axis=1)[:, :radius]  # the bits in which a pair at the edge differs
    differs = np.zeros((1000, width), bool)
    np.put_along_axis(differs, apart, True, axis=1)
    assert np.mean([any(not d[t].any() for t in tables) for d in differs]) > 0.93
