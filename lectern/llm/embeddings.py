"""Near-dedup of embeddings: navigable small-world graphs per shard, queried by all vectors of a label."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import Forest, components, query, stored, table
from lectern.llm.hnsw import Graph

COSINE = 0.93
#: Vectors in a graph; a label has as many graphs as it needs.
SHARD_ROWS = 8192
#: Width of the first beam; queries against which a beam is audited; the share of their links that it must find.
BEAM, AUDITED, RECALL = 64, 1024, 0.99
#: Single precision may be so far off; hits are verified in double precision.
SLACK = 1e-3


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one in double precision; scaled first, so that no square leaves the range of numbers."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


class Shard:
    """The graph of one shard's vectors and how wide its beams must be."""

    def __init__(self, vectors: np.ndarray, cosine: float, beam: int = BEAM, audited: int = AUDITED, recall: float = RECALL):
        self.vectors, self.cosine = vectors, cosine
        self.graph = Graph(vectors)
        self.beam = min(beam, len(vectors))
        self.recall = self._audit(audited, recall)

    def _audit(self, audited: int, recall: float) -> float:
        """Double the beam until it finds the asked share of a vector's links, on average over those of a sample that have
        any, counted by brute force: each vector counts alike, so a dense group doesn't decide for the others."""
        sample = np.random.default_rng(len(self.vectors)).permutation(len(self.vectors))[:audited]
        true = np.array([np.count_nonzero(self.vectors @ self.vectors[i] >= self.cosine) for i in sample]) - 1
        linked = true > 0
        while True:
            q, _ = self.hits(self.vectors[sample])
            found = np.bincount(q, minlength=len(sample)) - 1
            reached = float(np.mean(found[linked] / true[linked])) if linked.any() else 1.0
            if reached >= recall or self.beam >= len(self.vectors):
                return reached
            self.beam = min(2 * self.beam, len(self.vectors))

    def hits(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, vector) whose cosine reaches the limit.

        A query whose beam holds nothing but hits gets a beam four times as wide. A beam of a quarter of the shard costs
        more than reading the shard, which then takes its place: it is the beam that holds all.
        """
        found_q, found_v, todo, beam = [], [], np.arange(len(queries)), self.beam
        while len(todo):
            if 4 * beam >= len(self.vectors):
                for low in range(0, len(todo), 512):
                    q, v = np.nonzero(queries[todo[low : low + 512]] @ self.vectors.T >= self.cosine)
                    found_q.append(todo[low + q])
                    found_v.append(v)
                break
            ids, sims = self.graph.search(queries[todo], beam)
            full = (sims[:, -1] >= self.cosine - SLACK) & (ids[:, -1] >= 0)
            q, slot = np.nonzero((sims >= self.cosine - SLACK) & (ids >= 0) & ~full[:, None])
            v, q = ids[q, slot], todo[q]
            exact = np.einsum("ij,ij->i", queries[q], self.vectors[v]) >= self.cosine
            found_q.append(q[exact])
            found_v.append(v[exact])
            todo, beam = todo[full], 4 * beam
        return (np.concatenate(found_q), np.concatenate(found_v)) if found_q else (np.zeros(0, int), np.zeros(0, int))


def _searches(cosine: float):
    """Reads the rows of a partition by shard, the shard's own vectors first; gives links by node and a forest of them."""

    def told(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])

    class Reader:
        def __init__(self):
            self.key, self.held, self.shard = None, [], None

        def start(self):
            if self.shard is None and self.held:
                self.nodes, self.weights = (np.concatenate(x) for x in list(zip(*self.held, strict=True))[:2])
                vectors = np.concatenate([h[2] for h in self.held])
                self.held, self.forest = [], Forest(len(vectors))
                self.shard = Shard(vectors, cosine)
                yield from self.ask(self.nodes, vectors, own=True)

        def ask(self, nodes, vectors, own=False):
            for low in range(0, len(nodes), 1024):
                some = nodes[low : low + 1024]
                q, v = self.shard.hits(vectors[low : low + 1024])
                if own:
                    q, v = q[v != low + q], v[v != low + q]
                    self.forest.unite(low + q, v)
                else:
                    order = np.argsort(q, kind="stable")
                    q, v = q[order], v[order]
                    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
                    self.forest.unite(np.repeat(v[first], np.diff(np.r_[first, len(q)])), v)
                    yield told(1, some[q[first]], self.nodes[v[first]])
                links = np.bincount(q, self.weights[v], minlength=len(some)).astype(np.int64)
                yield told(0, some, links)

        def end(self):
            yield from self.start()
            if self.shard is not None:
                member = np.flatnonzero(self.forest.up != np.arange(len(self.nodes)))
                yield told(1, self.nodes[self.forest.up[member]], self.nodes[member])
            self.shard = None

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for frame in frames:
            keys, own = frame.column("shard_key").to_numpy(), frame.column("own").to_numpy(zero_copy_only=False)
            nodes, weights = frame.column("node").to_numpy(), frame.column("n").to_numpy()
            lists = frame.column("vector")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (own[1:] != own[:-1]), True])
            for low, high in zip(edges, edges[1:], strict=False):
                if keys[low] != reader.key:
                    yield from reader.end()
                    reader.key = keys[low]
                vectors = unit(values[offsets[low] : offsets[high]].reshape(high - low, -1))
                if own[low]:
                    reader.held.append((nodes[low:high], weights[low:high], vectors))
                else:
                    yield from reader.start()
                    yield from reader.ask(nodes[low:high], vectors)
        yield from reader.end()

    return batches


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per vector: ``key``, n_links (long), component_id (smallest id reachable by links, itself included), kept.

    Vectors of one label (and one length) are compared. Equal vectors become one with a weight. A label's vectors are
    dealt by hash into shards of about ``shard_rows``, each one graph in one task; all vectors of the label are asked
    of every shard, in blocks, so a label with a third of all rows is as many tasks as it has shards. A beam is
    doubled until it finds ``RECALL`` of the links of ``AUDITED`` of the shard's vectors, and widened for queries that
    it holds too little for. Cosines are verified in double precision. A shard gives link counts and a forest of its
    links, never the pairs.

    Null, empty and zero vectors, vectors with null or non-finite elements, and vectors without a label have no links
    and are components of their own. Null ids never become a component_id unless all of the component are null. Rows
    that share an id are vectors each, with links and components of their own. Ids may be of any type that has an order. An empty table gives an
    empty table. Extra columns play no part.
    """
    given = rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), F.col(f"`{label}`").alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 1.7976931348623157e308))
    fit = F.coalesce(F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    given = given.withColumn("vector", F.when(fit, F.col("vector")))
    distinct = stored(
        given.where("vector IS NOT NULL")
        .groupBy("label", "vector")
        .agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .withColumn("node", F.monotonically_increasing_id()),  # a number of its own, whatever the ids are; fixed once written
        "vectors",
    )
    shards = distinct.groupBy("label", F.size("vector").alias("size")).agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    dealt = (
        distinct.withColumn("size", F.size("vector"))
        .join(shards, ["label", "size"])
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("shards")) == F.col("shard"))
        .select(F.xxhash64("label", "size", "shard").alias("shard_key"), "own", "node", "n", "vector")
    )
    found = stored(
        dealt.repartition("shard_key").sortWithinPartitions("shard_key", F.desc("own"), "node").mapInArrow(_searches(cosine), "kind int, a bigint, b bigint"),
        "links",
    )
    links = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    labels = components(found.where("kind = 1"))
    named = stored(
        distinct.join(links, "node", "left").join(labels, "node", "left").select(
            "label", "vector", "first", (F.coalesce("links", F.lit(0).cast("long")) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")
        ),
        "named",
    )
    smallest = stored(named.groupBy("component").agg(F.min("first").alias("component_id")), "smallest")
    final = stored(named.join(smallest, "component").select("label", "vector", "n_links", "component_id"), "final")
    return given.join(final, ["label", "vector"], "left").select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("id").eqNullSafe(F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))).alias("kept"),
    )


@query("op2_embedding_near_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Links, component and fate of every vector: same label, cosine of 0.93 or more."""
    return near_vectors(table(spark, folder, "embeddings"))
