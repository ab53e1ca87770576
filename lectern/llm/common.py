"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import lectern.llm
import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import stored

# functions of this package travel to the executors with their code, which therefore need no copy of it
cloudpickle.register_pickle_by_value(lectern.llm)

#: Edges that one task cuts down to a forest.
TASK_EDGES = 1 << 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its DuckDB twin."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as one struct, ``row``, beside new columns, so that no name can clash with a new one."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Forest:
    """Union-find over positions, in whole arrays; every root is the least position of its tree."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        x = self.up[x]
        while (y := self.up[x]).tobytes() != x.tobytes():
            x = y
        return x

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
        self.up = self.find(np.arange(len(self.up)))


def spanning(edges: DataFrame) -> DataFrame:
    """As few of the edges (a, b) as connect the same nodes, task by task; a task takes some ``TASK_EDGES`` of them."""

    def forests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f[["a", "b"]].to_numpy(np.int64) for f in frames]
        if held:
            nodes, ends = np.unique(np.concatenate(held), return_inverse=True)
            ends = ends.reshape(-1, 2)
            forest = Forest(len(nodes))
            forest.unite(ends[:, 0], ends[:, 1])
            member = np.flatnonzero(forest.up != np.arange(len(nodes)))
            yield pd.DataFrame({"a": nodes[forest.up[member]], "b": nodes[member]})

    found = stored(edges.select("a", "b").where("a <> b"), "edges")
    return found.coalesce(max(1, -(-found.count() // TASK_EDGES))).mapInPandas(forests, "a bigint, b bigint")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Smallest node that each node reaches over undirected edges (a, b): returns (node, component).

    First every task cuts its share of the edges down to a spanning forest. Then each round gives every node the least label among its neighbours and itself, then follows labels
    once (the label's own label), so that long chains halve. Every round is a join and a grouping with
    partial sums, written to the shared folder; a star with a third of all nodes is a skewed join, which
    Spark splits. Nodes without edges have no row; so have null nodes. It ends when no label changes and
    raises after ``rounds`` rounds, which 2^rounds nodes in one chain would need.
    """
    edges = stored(spanning(edges), "forest")
    both = stored(
        edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    for _ in range(rounds):
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label")
        # the root that a node points at hears of the node's neighbours as well, so whole trees hook at once
        told = (
            both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b")
            .join(labels.select(F.col("node").alias("a"), F.col("label").alias("own")), "a")
            .where("other < own")
            .select(F.col("own").alias("node"), F.col("other").alias("label"))
        )
        hooked = stored(heard.unionByName(told).unionByName(labels).groupBy("node").agg(F.min("label").alias("label")), "hooked")
        after = stored(
            hooked.alias("x").join(hooked.alias("y"), F.col("x.label") == F.col("y.node")).select(F.col("x.node").alias("node"), F.col("y.label").alias("label")),
            "labels",
        )
        same = after.join(labels.withColumnRenamed("label", "before"), "node").where("label <> before").isEmpty()
        labels = after
        if same:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def hashed_share(key: Column, share: float | Column) -> Column:
    """True for about that share of the keys, the same ones on every run."""
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < share * F.lit(float(1 << 30))
