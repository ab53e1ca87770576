"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import runs
from tests.llm.odd import ROWS, documents, none


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(w, least=24, periods=3):
    out = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least, periods * q) and not any(w[i : i + n - d] == w[i + d : i + n] for d in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out)


def collapse(words, found):
    gone = {i for start, n, q in found for i in range(start + q, start + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_lyndon_lengths_reach_to_the_next_smaller_suffix(s):
    want = [next((j - i for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s) - i) for i in range(len(s))]
    assert runs.lyndon_lengths(np.array(s, np.int64)).tolist() == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 6)), max_size=8), st.sampled_from([1, 3, 4, 9, 24]), st.sampled_from([3, 4]))
def test_runs_of_random_loops(parts, least, periods):
    s = [x for part, n in parts for x in part * n]
    assert runs.find_runs(np.array(s, np.int64), least, periods) == brute(s, least, periods)


def test_longer_random_loops():
    draw = random.Random(5)
    for _ in range(150):
        s = []
        while len(s) < 400:
            s += [draw.randrange(4) for _ in range(draw.randint(1, 40))] * draw.choice([1, 1, 2, 3, 5])
        assert runs.find_runs(np.array(s)) == brute(s)


def test_words_with_equal_hashes_by_design():
    """Sums of powers modulo 2^64 can't tell these two apart; runs are then found by comparing."""
    a = [0]
    while len(a) < 2048:
        a += [1 - x for x in a]
    b = [1 - x for x in a]
    assert runs.find_runs(np.array(a + b + a + b + a)) == []  # two and a half periods
    assert (0, 3 * len(a + b), len(a + b)) in runs.find_runs(np.array((a + b) * 3))


def test_few_periods_are_refused():
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(9, np.int64), periods=2)


def loop(words, h):
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query(spark, tmp_path):
    draw = random.Random(2)
    rows = list(ROWS)
    for i in range(300):
        words = [draw.choice(["a", "b", "ça", "x y", "C"]) for _ in range(draw.choice([0, 1, 5, 30, 90, 200]))]
        text = draw.choice([" ", "\n", "\t\x0b", " \r\n"]).join(words * draw.choice([1, 1, 3, 4])) + draw.choice(["", " "])
        rows.append((1000 + i, text, "en", "s", len(text)))
    rows.append((5000, "copy " * 5000, "en", "s", 0))
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    want, looped, strong = [], 0, 0
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for doc, text, *_ in rows:
        words = words_of(text)
        if doc is not None:
            after = loop(words, zlib.crc32(str(doc).encode()))
            looped += after != words
            words = after
        found = brute(words) if words[:1] != ["copy"] else [(0, 5000, 1)]
        if text and text.startswith("lorem ipsum"):
            found = runs.find_runs(runs.numbered([w.encode() for w in words]))
            assert (0, 4000 * 6, 6) in found or len(found) == 1
        top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        strong += len(found) > 1
        want.append((doc, len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(collapse(words, found))))
    got = runs.op12(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert looped > 10 and strong > 0


def test_operator_keeps_texts_and_nothing_of_nothing(spark):
    got = {r.doc_id: r for r in runs.word_runs(documents(spark, [(1, "go on " * 12 + "end", "en", "s", 0), (2, None, None, None, None)])).collect()}
    assert got[1].collapsed == "go on end" and got[1].n_words == 25 and [tuple(r) for r in got[1].runs] == [(0, 24, 2)]
    assert got[2].collapsed == "" and got[2].runs == [] and got[2].n_words == 0
    assert runs.word_runs(none(spark)).count() == 0
