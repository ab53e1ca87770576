"""BPE by a local file of ranks: encoding with long texts cut where a match ends anyway, decoding to raw bytes."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import query, table
from lectern.llm.tokens import public, text_blocks

#: Texts of more characters are encoded in windows of about that many.
WINDOW_CHARS = 1 << 16
#: White space characters in a row from which on they are taken out of the text: the pattern's search for the last
#: one before a word keeps a stack as deep as the run.
LONG_SPACE = 1 << 10
#: Where every match of the public pattern ends, whatever stands farther away: before white space that follows
#: something else, before the last of several white space characters, and wherever letters, digits and other signs
#: meet, but for an apostrophe before a letter, which may begin a match of its own. Both characters must be of ranges
#: that have long been settled, since libraries differ in how new their table of characters is.
SETTLED = r"[\x00-\u024F\u0410-\u044F\u3001-\u303D\u3041-\u3094\u30A1-\u30FE\u4E00-\u9FA5\uAC00-\uD7A3]"
SAFE = (
    rf"(?<={SETTLED})(?={SETTLED})(?:"
    r"(?<=\S)(?=\s)|(?<=\s)(?=\s\S)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])"
    r"|(?<=[^\s\p{L}\p{N}])(?=\p{N})|(?<=[^\s\p{L}\p{N}'])(?=\p{L}))"
)


class RankTokenizer:
    """Ids of texts and bytes of ids by a file of ranks (base64 of a token's bytes, its id) and a pattern.

    ``safe`` matches places in a text at which every match of ``pattern`` ends, and all that it leaves between white
    space runs' first and last character; the default is right for the public pattern only.
    """

    def __init__(self, path: str, pattern: str | None = None, safe: str = SAFE, window: int = WINDOW_CHARS):
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.by_match = tiktoken.Encoding("by match", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.as_one = tiktoken.Encoding("as one", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.safe, self.spaces, self.window = regex.compile(safe), regex.compile(rf"\s{{{LONG_SPACE},}}"), window

    def cuts(self, text: str) -> Iterator[tuple[int, int]]:
        """Windows of a text, in order: each ends at the first safe place after its full size, the last at the end."""
        low = 0
        while low < len(text):
            found = self.safe.search(text, low + self.window)
            high = found.start() if found else len(text)
            yield low, high
            low = high

    def _parts(self, text: str) -> Iterator[np.ndarray]:
        """Ids of one window. Of a long run of white space all but the last character before a word are one match."""
        low = 0
        for run in self.spaces.finditer(text):
            end = run.end() - (run.end() < len(text))
            if low < run.start():
                yield self.by_match.encode_to_numpy(text[low : run.start()], disallowed_special=())
            yield self.as_one.encode_to_numpy(text[run.start() : end], disallowed_special=())
            low = end
        if low < len(text):
            yield self.by_match.encode_to_numpy(text[low:] if low else text, disallowed_special=())

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self.window:
            found = list(self._parts(text))
        else:
            found = [ids for low, high in self.cuts(text) for ids in self._parts(text[low:high])]
        return (np.concatenate(found) if found else np.zeros(0)).astype("<u4", copy=False)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def rank_encode(
    docs: DataFrame,
    ranks: str,
    key: str = "doc_id",
    text: str = "text",
    pattern: str | None = None,
    safe: str = SAFE,
    window: int = WINDOW_CHARS,
    decoded: str | None = None,
) -> DataFrame:
    """``key`` and ids (binary: unsigned little-endian 32-bit numbers) of every text, each match of the pattern apart.

    ranks: path on every executor of a file of ranks. No special tokens: their strings are ordinary text. Rows are
    encoded where they are read. A text of more than ``window`` characters is encoded in windows that end at places
    where a match of the pattern ends whatever comes before or after (``safe``), so its ids are those of the whole; a
    stretch without such a place, one word for instance, stays in one window. With ``decoded``, a column of that name
    (binary) has the bytes that the ids decode to, as ``rank_decode`` would add it, made by the same tasks.

    A null text is empty and has no ids. Rows that share an id have a row each, null ids too. An empty table gives an
    empty table. Extra columns play no part.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = RankTokenizer(ranks, pattern, safe, window)
        for frame in frames:
            keys, texts = frame.column("key"), frame.column("text").to_pylist()
            for low, high in text_blocks(texts):
                ids = [tokenizer.encode(t) for t in texts[low:high]]
                columns = {"key": keys.slice(low, high - low), "ids": pa.array([i.tobytes() for i in ids], pa.binary())}
                if decoded:
                    columns["decoded"] = pa.array([tokenizer.decode(i) for i in ids], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    out = rows.mapInArrow(batches, f"key {kind}, ids binary" + (", decoded binary" if decoded else ""))
    return out.withColumnsRenamed({"key": key, **({"decoded": decoded} if decoded else {})})


def rank_decode(coded: DataFrame, ranks: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns but ``ids`` (see ``rank_encode``) and the bytes that the ids decode to, whether text or not.

    Null ids decode to null, no ids to no bytes; an id that the file lacks raises. A column called ``decoded`` before
    is replaced. Repeated rows decode each; an empty table gives an empty table.
    """
    rest = [c for c in coded.columns if c not in (ids, decoded)]
    rows = coded.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(f"`{ids}`").alias("ids"))

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = RankTokenizer(ranks)
        for frame in frames:
            found = [None if x is None else tokenizer.decode(np.frombuffer(x, "<u4")) for x in frame.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([frame.column("row"), pa.array(found, pa.binary())], ["row", "decoded"])

    out = rows.select("row").schema.add("decoded", "binary")
    made = rows.mapInArrow(batches, out)
    return made.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], F.col("decoded").alias(decoded))


@query("op11_rank_bpe_round_trip")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Count and digest of every document's ids, and the digest of the bytes they decode to."""
    coded = rank_encode(table(spark, folder, "documents"), public("byte_bpe_50k.tiktoken"), decoded="decoded")
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
