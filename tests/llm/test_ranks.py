"""BPE by ranks against the library on whole texts."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import regex

from lectern.llm import ranks
from lectern.llm.tokens import public
from tests.llm.odd import ROWS, documents, none

PATH = public("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def whole():
    return ranks.RankTokenizer(PATH)


@pytest.fixture(scope="module")
def small():
    return ranks.RankTokenizer(PATH, window=1)


def library(tokenizer, text):
    return tokenizer.by_match.encode_ordinary(text)


def test_every_character_at_which_a_text_may_be_cut(whole, small):
    settled = regex.compile(ranks.SETTLED)
    chars = [chr(c) for c in range(0xD800) if settled.match(chr(c))]
    assert len(chars) > 30_000
    for low in range(0, len(chars), 32):
        text = "".join(f"a{c}a1{c}1!{c}! {c} '{c}s{c}{c}'s  {c}  {c}1" for c in chars[low : low + 32])
        assert small.encode(text).tolist() == library(whole, text)


def test_random_texts(whole, small):
    draw = random.Random(1)
    for _ in range(20_000):
        text = "".join(draw.choice("ab'sStrelvmd1 2\n\t .,! 　é日٣²\U0001f600ՙ") for _ in range(draw.randint(0, 30)))
        assert small.encode(text).tolist() == library(whole, text)
        assert small.decode(small.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 300_000, "\n " * 30_000 + "b", "word " * 40_000, "!" * 200_000, "é" * 100_000, "x  " * 50_000])
def test_long_texts(whole, text):
    assert whole.encode(text).tolist() == library(whole, text)


@pytest.mark.parametrize("after", ["", "x", "'s"])
def test_white_space_on_which_the_library_gives_up(whole, after):
    """Of a run before a word all but the last character are one match; the library can't say so itself."""
    text = "a" + " " * 2_000_000 + after
    with pytest.raises(ValueError):
        whole.by_match.encode_to_numpy("a" + " " * 2_000_000 + "x", disallowed_special=())
    n = 2_000_000 - bool(after)
    one = whole.as_one.encode_ordinary(" " * n)
    assert whole.encode(text).tolist() == library(whole, "a") + one + (library(whole, " " + after) if after else [])


def test_windows_are_small(whole):
    text = "some words, and more 123 " * 20_000
    cuts = list(whole.cuts(text))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False))
    assert max(b - a for a, b in cuts) < ranks.WINDOW_CHARS + 32


def test_tables(spark, whole):
    coded = ranks.rank_encode(documents(spark), PATH, decoded="bytes")
    got = sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.bytes)) for r in coded.collect()), key=str)
    assert got == sorted(((r[0], library(whole, r[1] or ""), (r[1] or "").encode()) for r in ROWS), key=str)
    again = ranks.rank_decode(coded.withColumnRenamed("bytes", "row"), PATH)
    assert again.columns == ["doc_id", "row", "decoded"]
    assert all(r.row == r.decoded for r in again.collect())
    assert ranks.rank_encode(none(spark), PATH).count() == 0


def test_bytes_that_are_no_text(spark):
    half = next(i for i, token in ranks.RankTokenizer(PATH).bytes.items() if token == "é".encode()[:1])
    table = spark.createDataFrame([(1, np.array([half], "<u4").tobytes()), (2, None), (3, b"")], "k int, ids binary")
    got = {r.k: r.decoded for r in ranks.rank_decode(table, PATH).collect()}
    assert got[2] is None and bytes(got[3]) == b"" and bytes(got[1]) == b"\xc3"


def test_query(spark, tmp_path, whole):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, ranks.op11(spark, str(tmp_path)).collect()), key=str)
    want = []
    for doc, text, *_ in ROWS:
        ids = library(whole, text or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((doc, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
