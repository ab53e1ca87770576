"""Merkle manifests against plain Python and SQL."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from lectern.llm import merkle
from tests.llm.odd import ROWS, documents, none


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def value(x) -> str:
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The last node, and for each first node its siblings level by level."""
    at, proofs = [[i] for i in range(len(nodes))], [[] for _ in nodes]
    while len(nodes) > 1:
        after, held = [], []
        for low in range(0, len(nodes), 16):
            run = nodes[low : low + 16]
            for k, under in enumerate(at[low : low + 16]):
                for leaf in under:
                    proofs[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            after.append(sha("".join(run)))
            held.append([leaf for under in at[low : low + 16] for leaf in under])
        nodes, at = after, held
    return nodes[0], proofs


def brute(rows):
    """(id, leaf, subroot, root, proof) of rows (id, group, leaf)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[g] = tree([r[2] for r in groups[g]])
    root, tops = tree([trees[g][0] for g in order])
    return [(r[0], r[2], trees[g][0], root, proof + tops[i]) for i, g in enumerate(order) for r, proof in zip(groups[g], trees[g][1], strict=True)]


def collected(df):
    return [(r.id, r.leaf, r.subroot, r.root, [tuple(x) for x in r.proof]) for r in df.select("row.id", "row.leaf", "subroot", "root", "proof").collect()]


def key(r):
    return tuple(map(str, r))


def test_groups_of_all_sizes(spark):
    sizes = {None: 3, "": 1, "a": 16, "b": 17, "é": 256, "z": 257, "hot": 4200, "Z": 2}
    rows = [(i * 7919 % 10_007, g, sha(f"{g}{i}")) for g, n in sizes.items() for i in range(n)]
    rows += [(5, "ties", sha(str(i % 3))) for i in range(40)] + [(None, "ties", sha("none"))] * 2
    leaves = spark.createDataFrame(rows, "id long, source string, leaf string").repartition(5)
    found = merkle.merkle_proofs(leaves, "source", ["id"], "leaf")
    got = collected(found)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert found.select(merkle.folded(F.col("row.leaf"), F.col("proof")).alias("r")).distinct().collect() == [(got[0][3],)]


def test_more_groups_than_a_block(spark):
    rows = [(i, f"s{i % 700}", sha(str(i))) for i in range(1500)]
    found = merkle.merkle_proofs(spark.createDataFrame(rows, "id long, source string, leaf string"), "source", ["id"], "leaf")
    assert sorted(collected(found), key=key) == sorted(brute(rows), key=key)


def test_one_leaf_is_its_own_root(spark):
    found = merkle.merkle_proofs(spark.createDataFrame([(1, None, "x" * 64)], "id long, source string, leaf string"), "source", ["id"], "leaf")
    assert collected(found) == [(1, "x" * 64, "x" * 64, "x" * 64, [])]


def test_nothing_and_clashing_names(spark):
    leaf = F.sha2(F.coalesce("text", F.lit("")), 256)
    assert merkle.merkle_proofs(none(spark).withColumn("leaf", leaf), "source", ["doc_id"], "leaf").count() == 0
    odd = documents(spark).withColumn("leaf", leaf).withColumn("root", F.lit("clash")).withColumn("a map", F.create_map(F.lit("a"), F.lit(1)))
    found = merkle.merkle_proofs(odd, "source", ["doc_id"], "leaf")
    assert found.columns == ["row", "proof", "subroot", "root"] and found.select("row.*").columns == odd.columns
    assert found.where("row.root = 'clash'").count() == len(ROWS)


def test_query(spark, tmp_path):
    docs = documents(spark)
    for more in (100, 200, 400):
        docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + more).withColumn("text", F.concat(F.lit("Ä BIG "), F.coalesce("text", F.lit("x")))))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    leaves, shown = [], defaultdict(set)
    for r in docs.collect():
        front = "".join(map(value, (r.doc_id, r.source, r.lang, r.n_chars)))
        leaves.append((r.doc_id, r.source, sha(front + value(r.text))))
        text = r.text
        if text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        shown[leaves[-1][2]].add(sha(front + value(text)))
    want = []
    for doc, leaf, subroot, root, proof in brute(leaves):
        (h,) = shown[leaf]
        for before, after in proof:
            h = sha(before + h + after)
        want.append((doc, leaf, subroot, root, sha("".join(b + a for b, a in proof)), h, h == root))
    got = merkle.op13(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert {r[-1] for r in want} == {True, False}
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(sql.execute(merkle.ORACLE).fetchall(), key=key) == sorted(want, key=key)


def test_a_hot_group_meets_in_no_task(spark):
    nodes = spark.range(3000).select(F.lit("=hot").alias("group"), F.struct("id").alias("keys"), F.sha2(F.col("id").cast("string"), 256).alias("h"), F.lit(0).alias("tie"), F.struct("id").alias("row"))
    ranked = merkle._ranked(nodes, "ranked")
    assert [tuple(r) for r in ranked.orderBy("rank").select("rank", "total", "row.id").collect()] == [(i, 3000, i) for i in range(3000)]
    blocks = merkle._blocks(ranked, "blocks")
    assert blocks.count() == 12 and blocks.selectExpr("max(aggregate(runs, 0, (n, x) -> n + size(x.kids)))").head()[0] == merkle.BLOCK
