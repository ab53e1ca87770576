"""Graphs and links against brute force in double precision."""

from __future__ import annotations

import numpy as np
import pytest

from lectern.llm import embeddings
from lectern.llm.common import Forest
from lectern.llm.hnsw import Graph


def planted(n, seed, dims=16):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(n // 8, dims))
    near = centres[draw.integers(0, len(centres), n)] + draw.normal(size=(n, dims)) * draw.choice([0.05, 0.2, 0.4, 2.0], size=(n, 1))
    return near


def brute(vectors, labels, cosine):
    unit = embeddings.unit(vectors)
    link = (unit @ unit.T >= cosine) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(link, False)
    forest = Forest(len(vectors))
    forest.unite(*np.nonzero(link))
    return link.sum(axis=1), forest.up


def test_beam_search_finds_neighbours():
    vectors = embeddings.unit(planted(3000, 1, 32))
    graph = Graph(vectors)
    ids, sims = graph.search(vectors[:200], 64)
    true = np.argsort(-(vectors[:200] @ vectors.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, true, strict=True)]) > 0.9
    assert (np.diff(sims, axis=1) <= 0).all()


def test_audit_widens_beams_until_links_are_found(monkeypatch):
    vectors = embeddings.unit(planted(2000, 2))
    search = Graph.search

    def poor(self, queries, beam):
        ids, sims = search(self, queries, beam)
        if beam < 16:  # a beam that ends at the first node
            ids[:, 1:], sims[:, 1:] = -1, -np.inf
        return ids, sims

    monkeypatch.setattr(Graph, "search", poor)
    shard = embeddings.Shard(vectors, 0.93, beam=2, audited=500)
    q, v = shard.hits(vectors)
    assert shard.beam == 16 and shard.recall >= embeddings.RECALL
    assert len(q) >= 0.98 * (vectors @ vectors.T >= 0.93).sum()


def test_a_dense_group_is_found_whole():
    draw = np.random.default_rng(0)
    dense = draw.normal(size=8) + draw.normal(size=(700, 8)) * 0.01
    vectors = embeddings.unit(np.concatenate([dense, draw.normal(size=(1500, 8))]))
    q, v = embeddings.Shard(vectors, 0.93).hits(vectors[:50])
    assert np.bincount(q, minlength=50).min() >= 700


@pytest.mark.parametrize("shard_rows", [10_000, 150])
def test_links_and_components_against_brute_force(spark, shard_rows):
    n = 900
    vectors = planted(n, 4)
    vectors[10:40] = vectors[5]  # equal vectors
    labels = np.where(np.arange(n) < 500, 0, np.arange(n) % 3)  # one label has over half of all rows
    rows = [(int(i), vectors[i].tolist(), int(labels[i]), "clash") for i in range(n)]
    odd = [(2000, None, 0, ""), (2001, [], 0, ""), (2002, [0.0] * 16, 0, ""), (2003, [float("nan")] + [1.0] * 15, 0, ""), (2004, [None] + [1.0] * 15, 0, ""),
           (2005, [float("inf")] * 16, 0, ""), (2006, vectors[5].tolist(), None, ""), (2007, [1.0, 2.0], 0, ""), (2008, (vectors[5] * 1e300).tolist(), 9, ""), (2009, (vectors[5] * 1e-300).tolist(), 9, "")]
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, label int, node string")
    found = {r.vec_id: r for r in embeddings.near_vectors(table, shard_rows=shard_rows).collect()}
    links, component = brute(vectors, labels, 0.93)
    got = np.array([found[i].n_links for i in range(n)])
    assert got.sum() >= 0.98 * links.sum() and (got <= links).all()
    assert [found[i].component_id for i in range(n)] == component.tolist()
    assert all(found[i].kept == (found[i].component_id == i) for i in found)
    for i in range(2000, 2008):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert (found[2009].n_links, found[2009].component_id) == (1, 2008)


def test_null_and_repeated_ids_and_nothing(spark):
    kind = "vec_id bigint, embedding array<float>, label int"
    rows = [(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, [0.0, 1.0], 1), (3, [0.0, 1.0], 1), (3, [0.0, 1.0], 1)]
    found = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embeddings.near_vectors(spark.createDataFrame(rows, kind)).collect())
    assert found == [("3", 2, "3", True), ("3", 2, "3", True), ("None", 1, "None", True), ("None", 1, "None", True), ("None", 2, "3", False)]
    assert embeddings.near_vectors(spark.createDataFrame([], kind)).count() == 0


def test_one_id_with_different_vectors_and_ids_of_text(spark):
    rows = [("a", [1.0, 0.0, 0.0], 1), ("a", [0.0, 1.0, 0.0], 1), ("b", [1.0, 0.01, 0.0], 1), ("c", [0.0, 0.0, 1.0], 1)]
    found = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id string, embedding array<float>, label int"))
    assert sorted(map(tuple, found.collect())) == [("a", 0, "a", True), ("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True)]


def test_a_dense_group_does_not_hide_what_others_miss(monkeypatch):
    """Of 2,000 vectors 500 are one group; the others are pairs, which a beam that stops at the first node never finds."""
    draw = np.random.default_rng(7)
    pairs = np.repeat(draw.normal(size=(750, 16)), 2, axis=0) + draw.normal(size=(1500, 16)) * 0.01
    vectors = embeddings.unit(np.concatenate([draw.normal(size=16) + draw.normal(size=(500, 16)) * 0.01, pairs]))
    search = Graph.search

    def poor(self, queries, beam):
        ids, sims = search(self, queries, beam)
        if beam < 32:
            lone = sims[:, -1] < 0.9
            ids[lone, 1:], sims[lone, 1:] = -1, -np.inf
        return ids, sims

    monkeypatch.setattr(Graph, "search", poor)
    shard = embeddings.Shard(vectors, 0.93, beam=8, audited=500)
    assert shard.beam >= 32 and shard.recall >= embeddings.RECALL
