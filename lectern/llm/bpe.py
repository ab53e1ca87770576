"""BPE encoding by tree concatenation, and decoding."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import query, table
from lectern.llm.tokens import WordEncoder, public, tokenizer

#: Texts of more characters are encoded in halves of halves, none longer than this, in different tasks.
LEAF_CHARS = 1 << 15
#: Tokens on each side of a join that are encoded anew at first; doubled until both sides agree.
WINDOW = 16


@dataclass
class Span:
    """Ids of a stretch of text, and where in the text each begins and ends."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def cut(self, low: int, high: int) -> Span:
        return Span(self.ids[low:high], self.starts[low:high], self.ends[low:high])


def encode_span(encoder, text: str, at: int = 0) -> Span:
    code = encoder.encode(text, add_special_tokens=False)
    places = np.array(code.offsets, np.int64).reshape(-1, 2) + at
    return Span(np.array(code.ids, np.int32), places[:, 0], places[:, 1])


def _agreeing(window: Span, side: Span) -> np.ndarray:
    """Numbers of the window's tokens that the side has too, at the same place, and whose place no other token shares."""

    def alone(s: Span) -> np.ndarray:
        after = np.r_[s.starts[1:] >= s.ends[:-1], True]
        before = np.r_[True, s.ends[:-1] <= s.starts[1:]]
        return after & before & (s.ends > s.starts)

    ours, theirs = alone(window), alone(side)
    there = {(a, b, i) for a, b, i in zip(side.starts[theirs].tolist(), side.ends[theirs].tolist(), side.ids[theirs].tolist(), strict=True)}
    return np.array([k for k in np.flatnonzero(ours).tolist() if (int(window.starts[k]), int(window.ends[k]), int(window.ids[k])) in there], np.int64)


def join(encoder, text: str, left: Span, right: Span, low: int, middle: int, high: int, reach: int) -> Span:
    """The ids of text[low:high] from those of its parts before and after ``middle``.

    The text around the join is encoded anew, from a token that the left part has to one that the right part has, until
    the new ids share a token with each part. Any two neighbours of the result are then neighbours in one encoding, and
    a row of tokens whose neighbours all are so is the encoding itself. A window that holds a whole part agrees with it.
    It goes at least ``reach`` characters to both sides, so that a special token across the join lies in it.
    """
    k = WINDOW
    while True:
        whole_left, whole_right = k >= len(left.ids), k >= len(right.ids)
        a = low if whole_left else int(left.starts[-k])
        b = high if whole_right else int(right.ends[k - 1])
        if (a > middle - reach and not whole_left) or (b < middle + reach and not whole_right):
            k *= 2
            continue
        window = encode_span(encoder, text[a:b], a)
        tail = left.cut(max(0, len(left.ids) - k), len(left.ids))
        head = right.cut(0, k)
        first = 0 if whole_left else next(iter(_agreeing(window, tail).tolist()), None)
        last = len(window.ids) - 1 if whole_right else next(iter(_agreeing(window, head).tolist()[::-1]), None)
        if first is not None and last is not None and (first < last or (whole_left and whole_right)):
            before = left.cut(0, 0) if whole_left else left.cut(0, int(np.flatnonzero(left.starts == window.starts[first])[0]))
            after = right.cut(0, 0) if whole_right else right.cut(int(np.flatnonzero(right.ends == window.ends[last])[-1]) + 1, len(right.ids))
            parts = (before, window.cut(first, last + 1), after)
            return Span(*(np.concatenate([getattr(p, n) for p in parts]) for n in ("ids", "starts", "ends")))
        k *= 2


def concatenate(encoder, text: str, spans: list[Span], cuts: list[int]) -> Span:
    """The tree's upper part: neighbours are joined two by two until one is left. cuts: where spans begin, and the end."""
    reach = max((len(t.content) for t in encoder.get_added_tokens_decoder().values()), default=0)
    while len(spans) > 1:
        joined = [join(encoder, text, spans[i], spans[i + 1], *cuts[i : i + 3], reach) for i in range(0, len(spans) - 1, 2)]
        spans = joined + spans[2 * len(joined) :]
        cuts = cuts[::2] if cuts[::2][-1] == cuts[-1] else [*cuts[::2], cuts[-1]]
    return spans[0]


def leaf_cuts(n: int, leaf: int) -> list[int]:
    """Where halves of halves of a text begin, and its end; no part is longer than a leaf."""
    parts = 1
    while -(-n // parts) > leaf:
        parts *= 2
    return [n * i // parts for i in range(parts + 1)]


def decoding(decoder):
    """A function from ids to text, as the library decodes them. Without a decoder of its own, a tokenizer's text is the
    tokens it knows with a space between them."""
    if decoder.decoder is not None:
        return lambda ids: decoder.decode(ids, skip_special_tokens=False)
    names = {i: token for token, i in decoder.get_vocab().items()}
    return lambda ids: " ".join(filter(None, map(names.get, ids)))


def decode_all(decode, ids) -> pd.Series:
    return pd.Series([None if x is None else decode(np.asarray(x).tolist()) for x in ids], dtype=object)


def bpe_encode(docs: DataFrame, tokens: str, key: str = "doc_id", text: str = "text", leaf_chars: int = LEAF_CHARS, decoded: str | None = None) -> DataFrame:
    """``key`` and ids (array of int) of every text, as the library encodes the whole text without special tokens.

    With ``decoded``, a column of that name has the text that the ids decode to, as ``bpe_decode`` would add it, made by
    the same tasks.

    tokens: path on every executor of the file of a tokenizer that drops white space and marks the ends of words.
    Short texts are encoded where they are read. A text of more than ``leaf_chars`` characters is cut into halves of
    halves, which other tasks encode, each in one piece, and one task joins: it holds one text and its ids. Joins need
    no white space or other fixed place to cut.

    A null text is empty and has no ids. Rows that share an id have a row each. An empty table gives an empty table.
    Extra columns play no part.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def answer(decode, keys, ids: list[np.ndarray]) -> pd.DataFrame:
        out = pd.DataFrame({"key": keys, "ids": ids})
        return out.assign(**{decoded: decode_all(decode, ids)}) if decoded else out

    def short(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = WordEncoder(tokens)
        decode = decoding(encoder.tokenizer)
        for frame in frames:
            for low in range(0, len(frame), 512):
                some = frame.iloc[low : low + 512]
                yield answer(decode, some["key"].array, list(encoder.encode(some["text"].tolist())))

    def cut_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row, owner, whole in zip(frame["row"], frame["key"], frame["text"], strict=True):
                cuts = leaf_cuts(len(whole), leaf_chars)
                yield pd.DataFrame({"row": row, "key": pd.Series([owner] * (len(cuts) - 1), dtype=frame["key"].dtype), "low": cuts[:-1], "text": [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]})

    def leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokenizer(tokens)
        for frame in frames:
            for low in range(0, len(frame), 64):
                some = frame.iloc[low : low + 64]
                spans = [encode_span(encoder, t, a) for t, a in zip(some["text"], some["low"], strict=True)]
                yield some.assign(ids=[s.ids for s in spans], starts=[s.starts.astype(np.int32) for s in spans], ends=[s.ends.astype(np.int32) for s in spans])

    loaded: dict = {}

    def joined(parts: pd.DataFrame) -> pd.DataFrame:
        if tokens not in loaded:
            loaded[tokens] = tokenizer(tokens)
            loaded["decode"] = decoding(loaded[tokens])
        parts = parts.sort_values("low")
        whole = "".join(parts["text"])
        spans = [Span(*(np.asarray(x, np.int64) for x in row)) for row in zip(parts["ids"], parts["starts"], parts["ends"], strict=True)]
        ids = concatenate(loaded[tokens], whole, spans, [*parts["low"], len(whole)]).ids
        return answer(loaded["decode"], parts["key"].iloc[:1].array, [ids])

    n = F.char_length("text")
    long = rows.where(n > leaf_chars).select(F.monotonically_increasing_id().alias("row"), "key", "text")
    pieces = long.mapInPandas(cut_up, f"row bigint, key {kind}, low bigint, text string")
    encoded = pieces.repartition("row", "low").mapInPandas(leaves, f"row bigint, key {kind}, low bigint, text string, ids array<int>, starts array<int>, ends array<int>")
    out = f"key {kind}, ids array<int>" + (f", `{decoded}` string" if decoded else "")
    long = encoded.groupBy("row").applyInPandas(joined, out)
    return rows.where(n <= leaf_chars).mapInPandas(short, out).unionByName(long).withColumnRenamed("key", key)


def bpe_decode(coded: DataFrame, tokens: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns but ``ids``, and the text that the library decodes from the ids, special tokens included.

    Null ids decode to null, no ids to the empty text.
    """
    rest = [c for c in coded.columns if c != ids]
    schema = coded.select(*[f"`{c}`" for c in rest]).schema.add(decoded, "string")

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = decoding(tokenizer(tokens))
        for frame in frames:
            for low in range(0, len(frame), 256):
                some = frame.iloc[low : low + 256]
                yield some[rest].assign(**{decoded: decode_all(decode, some[ids]).array})

    return coded.mapInPandas(batches, schema)


@query("op8_bpe_round_trip")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Count and digest of every document's ids, and the digest of the text they decode to."""
    tokens = public("word_bpe_49k.json")
    coded = bpe_encode(table(spark, folder, "documents"), tokens, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
