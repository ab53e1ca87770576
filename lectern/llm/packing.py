"""Best-fit packing of token sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import query, table
from lectern.llm.tokens import ByteEncoder, public, text_blocks

CAPACITY = 1024
#: Bins that one task keeps open.
OPEN_BINS = 1 << 14
#: Id after each document.
END = 2


def token_pieces(docs: DataFrame, tokens: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of each document's ids and the end id: ``key``, piece (int), start, length (long), ids (binary).

    ids are unsigned little-endian 32-bit numbers. tokens: path of a byte-level tokenizer's file on every executor.
    Documents of more than ``capacity`` ids are cut so that all pieces but the first are full. A null text is empty: one
    piece with the end id. Rows that share an id give the same pieces each. An empty table gives an empty table. Extra
    columns play no part.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = ByteEncoder(tokens)
        for frame in frames:
            keys, texts = frame["key"], frame["text"].fillna("").tolist()
            for low, high in text_blocks(texts):
                out = ([], [], [], [], [])
                for at, ids in zip(range(low, high), encoder.encode(texts[low:high]), strict=True):
                    ids = np.append(ids, end).astype("<u4")
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for column, value in zip(out, (at, piece, a, b - a, ids[a:b].tobytes()), strict=True):
                            column.append(value)
                yield pd.DataFrame({"key": keys.iloc[out[0]].array, "piece": out[1], "start": out[2], "length": out[3], "ids": out[4]})

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(batches, f"key {kind}, piece int, start bigint, length bigint, ids binary").withColumnRenamed("key", key)


class Bins:
    """A bounded number of open bins, by their free space, under a bitset of the spaces that some bin has."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.open, self.bits = capacity, most, 0, 0
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.started = 0

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the place in it of a piece: the open bin it fills best, or a new one."""
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.open == self.most:  # the fullest closes first
                self._take((self.bits & -self.bits).bit_length() - 1)
            space, bin_ = self.capacity, self.started
            self.started += 1
        if left := space - length:
            self.by_space[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.capacity - space

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        out = bins.pop()
        if not bins:
            self.bits &= ~(1 << space)
        self.open -= 1
        return out


def best_fit(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """All columns of the pieces, sequence_id and offset (long): the sequence of each piece and its place there.

    Columns of the pieces that have these two names are replaced.

    Pieces are dealt out to tasks by a hash of their row and packed online in the hash's order, which mixes lengths; a
    task holds ``open_bins`` bins and closes the fullest when it needs another. Each task leaves a few bins half full,
    so tasks should have many more pieces than there are lengths: the number of tasks is left to adaptive execution.
    Sequences have no gaps; numbers are unique, in no order. Pieces of no or null length take no room: their sequence
    and offset are null. A piece longer than the capacity raises. Rows that repeat are pieces each.
    """
    pieces = pieces.select(*[f"`{c}`" for c in pieces.columns if c.lower() not in ("sequence_id", "offset")])
    names = [f"`{c}`" for c in pieces.columns]
    hashed = [n for n, f in zip(names, pieces.schema, strict=True) if f.dataType.typeName() not in ("map", "variant")]
    n = F.coalesce(F.col(f"`{length}`").cast("long"), F.lit(0).cast("long"))
    checked = F.when(n > capacity, F.raise_error(F.lit(f"a piece is longer than {capacity}")).cast("long")).otherwise(n)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, bins = TaskContext.get().partitionId() << 40, Bins(capacity, open_bins)
        for frame in frames:
            places = [bins.put(n) if n > 0 else (None, None) for n in frame.column("length").to_pylist()]
            numbers = pa.array([None if b is None else first + b for b, _ in places], pa.int64())
            yield pa.RecordBatch.from_arrays([frame.column("piece"), numbers, pa.array([o for _, o in places], pa.int64())], ["piece", "sequence_id", "offset"])

    rows = pieces.select(F.struct(*names).alias("piece"), checked.alias("length"), F.xxhash64(*hashed).alias("mixed"))
    out = rows.select("piece").schema.add("sequence_id", "long").add("offset", "long")
    placed = rows.repartition("mixed").sortWithinPartitions("mixed").select("piece", "length").mapInArrow(batches, out)
    return placed.select("piece.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokens: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of all documents (see ``token_pieces``), ids included, with their places (see ``best_fit``)."""
    return best_fit(token_pieces(docs, tokens, key, text, capacity, end), capacity=capacity)


@query("op3_best_fit_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every document and their places; the ids go no further than their checksum."""
    pieces = token_pieces(table(spark, folder, "documents"), public("byte_bpe_50k.json"))
    return best_fit(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
