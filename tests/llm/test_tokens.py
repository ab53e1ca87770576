"""Encoders, tree concatenation and packing against the tokenizers library."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import bpe, packing, tokens
from tests.llm.odd import LONG, ROWS, documents, none

WORD, BYTE = tokens.public("word_bpe_49k.json"), tokens.public("byte_bpe_50k.json")
LIBRARY = {p: tokens.tokenizer(p) for p in (WORD, BYTE)}
PARTS = ["a", "ab", " a", "'", "'s", "'ll", "!!", "é", "́", "1234", "aaaaaaaaaaa", "thetheth", " the", "\n", "<|endoftext|>", "日本", "ü", "!!!", "hello", "é", "Σ", "가",
         "  ", "foo,", "foo.", "9.", "ü,", "!.", "\t", "\xa0", " ", "\U0001f600", "x" * 300, " " * 300]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=40).map("".join)


def library(path, text):
    return LIBRARY[path].encode(text, add_special_tokens=False).ids


ENCODERS = [(WORD, tokens.WordEncoder(WORD)), (BYTE, tokens.ByteEncoder(BYTE))]


@settings(deadline=None, max_examples=200)
@given(st.lists(TEXTS, max_size=5))
def test_encoders_give_the_librarys_ids(texts):
    for path, encoder in ENCODERS:
        for _ in range(2):  # the second time from what it remembers
            assert [x.tolist() for x in encoder.encode(texts)] == [library(path, t) for t in texts]


def test_a_full_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "WORDS", 3)
    texts = ["one two three four five", "six seven, eight. one two"] * 3
    encoder = tokens.WordEncoder(WORD)
    assert [x.tolist() for t in texts for x in encoder.encode([t])] == [library(WORD, t) for t in texts]


def by_tree(text, leaf):
    encoder, cuts = LIBRARY[WORD], bpe.leaf_cuts(len(text), leaf)
    spans = [bpe.encode_span(encoder, text[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) <= leaf
    return bpe.concatenate(encoder, text, spans, cuts).ids.tolist()


@settings(deadline=None, max_examples=150)
@given(TEXTS, st.sampled_from([1, 3, 17, 64]), st.sampled_from([1, 2, 16]))
def test_tree_of_any_text(text, leaf, window):
    before, bpe.WINDOW = bpe.WINDOW, window
    try:
        assert by_tree(text, leaf) == library(WORD, text)
    finally:
        bpe.WINDOW = before


@settings(deadline=None, max_examples=80)
@given(st.text(alphabet="thingeratos", max_size=400), st.integers(1, 90))
def test_tree_of_text_without_any_cut(text, leaf):
    assert by_tree(text, leaf) == library(WORD, text)


def test_round_trip_of_all_rows(spark):
    draw = random.Random(2)
    rows = ROWS + [(100 + i, "".join(draw.choice(PARTS) for _ in range(draw.randrange(200))), "en", "s", 0) for i in range(60)]
    rows.append((999, "antidisestablishment" * 3000, "en", "s", 0))
    coded = bpe.bpe_encode(documents(spark, rows), WORD, leaf_chars=50, decoded="decoded").cache()
    got = sorted((str(r.doc_id), list(r.ids), r.decoded) for r in coded.collect())
    want = [(str(r[0]), library(WORD, r[1] or "")) for r in rows]
    assert got == sorted((i, x, LIBRARY[WORD].decode(x, skip_special_tokens=False)) for i, x in want)
    again = bpe.bpe_decode(coded.drop("decoded"), WORD)
    assert sorted((str(r.doc_id), r.decoded) for r in again.collect()) == sorted((i, d) for i, _, d in got)


def test_round_trip_of_nothing(spark):
    assert bpe.bpe_encode(none(spark), WORD).count() == 0
    empty = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert sorted(map(tuple, bpe.bpe_decode(empty, WORD).collect())) == [(1, None), (2, "")]


def check_places(placed, capacity):
    sequences = defaultdict(list)
    for r in placed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [8, 1024])
def test_pieces_hold_the_librarys_ids_and_places_have_no_gap(spark, capacity):
    draw = random.Random(4)
    rows = [r for i, r in enumerate(ROWS) if i != 5] + [(100 + i, " ".join(["word"] * draw.randrange(300)) + draw.choice(PARTS), "en", "s", 0) for i in range(200)]
    placed = packing.pack_documents(documents(spark, rows), BYTE, capacity=capacity).collect()
    pieces = defaultdict(list)
    for r in placed:
        assert r.length == len(r.ids) // 4 <= capacity and (r.length == capacity or r.piece == 0)
        pieces[r.doc_id].append((r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for doc, text, *_ in rows:
        ids = library(BYTE, text or "") + [packing.END]
        found = sorted(pieces[doc])
        assert [p for p, _, _ in found] == list(range(len(found)))
        assert sum((x for _, _, x in found), []) == ids
        assert [s for _, s, _ in found] == np.cumsum([0, *(len(x) for _, _, x in found)])[:-1].tolist()
    total = sum(r.length for r in placed)
    assert check_places(placed, capacity) <= 1.1 * -(-total // capacity) + 4


def test_repeated_rows_and_replaced_columns(spark):
    rows = [(1, "one two", "en", "s", 0)] * 5
    placed = packing.pack_documents(documents(spark, rows), BYTE).collect()
    assert len(placed) == 5 and check_places(placed, 1024) == 1
    table = spark.createDataFrame([(1, 3, "x"), (2, None, "x"), (3, 0, "x")], "a int, length int, sequence_id string")
    got = {r.a: (r.sequence_id, r.offset) for r in packing.best_fit(table, capacity=4).collect()}
    assert got[1][1] == 0 and got[2] == got[3] == (None, None)
    assert packing.pack_documents(none(spark), BYTE).count() == 0
    with pytest.raises(Exception, match="longer than"):
        packing.best_fit(spark.createDataFrame([(9,)], "length int"), capacity=4).collect()


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(1, 20), max_size=200), st.integers(1, 5))
def test_bins_are_best_fit_and_bounded(lengths, most):
    bins, free, open_ = packing.Bins(20, most), {}, set()
    for n in lengths:
        fits = [free[b] for b in open_ if free[b] >= n]
        new = not fits
        if new and len(open_) == most:
            least = min(free[b] for b in open_)
        b, at = bins.put(n)
        if new:
            assert b not in free and at == 0
            if len(open_) == most:  # the fullest has been closed; the packer knows which of equals
                shut = next(x for x in open_ if free[x] == least and x not in {y for s in bins.by_space for y in s})
                open_.discard(shut)
            free[b] = 20
        else:
            assert free[b] == min(fits) and at == 20 - free[b]
        free[b] -= n
        open_.add(b)
        if not free[b]:
            open_.discard(b)
        assert len(open_) == bins.open <= most




def test_long_text_in_one_piece_of_input():
    assert by_tree(LONG, 1 << 12) == library(WORD, LONG)


def test_every_character_before_a_stop(monkeypatch):
    """Some letters end in a mark once they are normalised, and a mark stays with the stop that follows."""
    path = tokens.public("word_bpe_49k.json")
    encoder, library = tokens.WordEncoder(path), tokens.tokenizer(path)
    chars = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c <= 0xDFFF]
    for low in range(0, len(chars), 4096):
        texts = [f"a{c}. {c}, a{c} {c}b{c}" for c in chars[low : low + 4096]]
        want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        assert [x.tolist() for x in encoder.encode(texts)] == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_decoding_is_the_librarys(name):
    library = tokens.tokenizer(tokens.public(name))
    decode, draw = bpe.decoding(library), np.random.default_rng(1)
    for _ in range(300):
        ids = draw.integers(0, 51_000, draw.integers(0, 20)).tolist()
        assert decode(ids) == library.decode(ids, skip_special_tokens=False)
