"""Merkle manifest of a table: a root per group, a root of these, and a proof for every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import query, stored, table

#: Nodes under one node, leaves in one block (two levels of nodes), and characters of a digest.
FANOUT, BLOCK, HEX = 16, 256, 64
LEVEL = "struct<before:string,after:string>"


def digest(*columns: Column) -> Column:
    """SHA-256 (lowercase hex) of values: ``-`` for a null, else the UTF-8 byte count, ``:`` and the value as text."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _ranked(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes (group, keys, h, tie, row) with ``rank`` in their group, from 0, and the group's ``total``.

    Rows are sorted over range partitions, so no task takes a whole group. Only the groups' counts per partition meet by
    group: at most one for each partition.
    """
    order = ["group", "keys", "h", "tie"]
    sort = nodes.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(sort.select("group", "h", "row", F.monotonically_increasing_id().alias("place")), name)
    placed = placed.withColumn("part", F.shiftright("place", 33))
    parts = stored(placed.groupBy("group", "part").agg(F.min("place").alias("first"), F.count("*").alias("n")), f"{name}-parts")
    all_of = Window.partitionBy("group")
    before = F.sum("n").over(all_of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("group", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(all_of).alias("total"))
    return placed.join(starts, ["group", "part"]).select("group", (F.col("place") + F.col("shift")).alias("rank"), "total", "h", "row")


def _texts(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda x: x["h"]), "")


def _blocks(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes (group, rank, total, h, row) rolled up by their rank's digits: the last is grouped away into runs of sixteen
    under their digest, the one before into blocks of sixteen runs: (group, block, total, h, runs).

    A level exists where more than one node is left. One shuffle serves both groupings; a block is all that a task must
    hold of a group.
    """
    rank, total = F.col("rank"), F.col("total")
    digits = nodes.select("group", F.floor(rank / BLOCK).alias("block"), (F.floor(rank / FANOUT) % FANOUT).alias("d1"), (rank % FANOUT).alias("d0"), "total", "h", "row")
    by_digit = lambda name: lambda a, b: (a[name] - b[name]).cast("int")
    runs = (
        digits.repartition("group", "block")
        .groupBy("group", "block", "d1")
        .agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("d0", "h", "row")), by_digit("d0")).alias("kids"))
        .withColumn("h", F.when(total > 1, F.sha2(_texts(F.col("kids")), 256)).otherwise(F.col("kids")[0]["h"]))
    )
    blocks = (
        runs.groupBy("group", "block")
        .agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("d1", "h", "kids")), by_digit("d1")).alias("runs"))
        .withColumn("h", F.when(total > FANOUT, F.sha2(_texts(F.col("runs")), 256)).otherwise(F.col("runs")[0]["h"]))
    )
    return stored(blocks.select("group", "block", "total", "h", "runs"), name)


def _rolled(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Tables of blocks, each over the blocks of the one before, until every group has one block.

    As many rounds as 256 to that power reach the largest group's size.
    """
    rounds = [_blocks(nodes, name)]
    while (rounds[-1].agg(F.max("total")).head()[0] or 0) > BLOCK:
        last, kind = rounds[-1], rounds[0].schema["runs"].dataType.elementType["kids"].dataType.elementType["row"].dataType
        above = last.select("group", F.col("block").alias("rank"), F.ceil(F.col("total") / BLOCK).alias("total"), "h", F.lit(None).cast(kind).alias("row"))
        rounds.append(_blocks(above, name))
    return rounds


def _around(run: Column, place: Column) -> Column:
    """The digests of a run on both sides of one of its nodes."""
    return F.struct(F.substring(run, F.lit(1), place * HEX).alias("before"), F.substring(run, place * HEX + HEX + 1, F.lit(FANOUT * HEX)).alias("after"))


def _unrolled(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Nodes of blocks with what a fold of their digest meets up to the root: (group, rank, h, row, path, subroot, root).

    above: (group, block, path, subroot, root), what follows each block. It is laid beside its block by grouping; from
    there on a node's proof comes out of the nested runs, by transform and explode alone.
    """
    kinds = {f.name: f.dataType for f in [*blocks.schema, *above.schema]}
    wide = lambda df: df.select("group", "block", *[(F.col(c) if c in df.columns else F.lit(None).cast(kinds[c])).alias(c) for c in ("total", "runs", "path", "subroot", "root")])
    met = wide(blocks).unionByName(wide(above)).groupBy("group", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("total", "runs", "path", "subroot", "root")])
    rest = ["group", "total", "subroot", "root"]
    runs = met.withColumn("top", _texts(F.col("runs"))).select(*rest, "block", "path", "top", F.posexplode("runs").alias("i", "run"))
    level = lambda run, place, least: F.when(F.col("total") > least, F.concat(F.array(_around(F.col(run), F.col(place))), "path")).otherwise(F.col("path"))
    kids = (
        runs.select(*rest, (F.col("block") * FANOUT + F.col("i")).alias("number"), level("top", "i", FANOUT).alias("path"), "run")
        .withColumn("own", _texts(F.col("run.kids")))
        .select(*rest, "number", "path", "own", F.posexplode("run.kids").alias("j", "kid"))
    )
    return kids.select("group", (F.col("number") * FANOUT + F.col("j")).alias("rank"), "kid.h", "kid.row", level("own", "j", 1).alias("path"), "subroot", "root")


def _proofs(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first round's nodes; above: (group, path, subroot, root), what follows each group's last node."""
    found = above.withColumn("rank", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        found = _unrolled(blocks, found.select("group", F.col("rank").alias("block"), "path", "subroot", "root"))
    return found


def merkle_proofs(leaves: DataFrame, group: str, order: list[str], leaf: str) -> DataFrame:
    """All columns of the leaves as ``row``, and per leaf ``proof``, ``subroot`` of its group and ``root`` of all.

    leaf: a digest as 64 characters of hex. In a group, leaves ascend by ``order`` (nulls first), ties by their digest.
    Sixteen neighbours become the SHA-256 of their digests in a row (the last run has fewer, if only one), again and
    again until one node is left, the subroot; a lone leaf is one itself. Subroots, ordered by their group's text (null
    first, then bytewise), become the root in the same way. ``proof`` has for each level, from the leaf upwards, the
    digests ``before`` and ``after`` the leaf's own node in its run; ``folded`` leads from a leaf to the root by it.

    Ranks come from sorted range partitions; blocks of 256 leaves are nested structs of runs, and their digests, a
    256th of the rows, go through the same steps again. Null groups are one group. Rows that repeat are leaves each. An
    empty table has no rows. A leaf that is null counts as empty text. Extra columns, of any name and type, come back in
    ``row``.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    nodes = leaves.select(
        key.alias("group"),
        F.struct(*[F.col(f"`{c}`") for c in order]).alias("keys"),
        F.coalesce(F.col(f"`{leaf}`"), F.lit("")).alias("h"),
        F.monotonically_increasing_id().alias("tie"),
        F.struct(*[F.col(f"`{c}`") for c in leaves.columns]).alias("row"),
    )
    groups = _rolled(_ranked(stored(nodes, "leaves"), "ranked"), "blocks")
    tops = groups[-1].select(F.lit("").alias("group"), F.col("group").alias("keys"), "h", F.lit(0).alias("tie"), F.struct("group").alias("row"))
    roots = _rolled(_ranked(tops, "subroots"), "tops")
    start = roots[-1].select("group", F.lit(None).cast("string").alias("subroot"), F.col("h").alias("root"), F.array().cast(f"array<{LEVEL}>").alias("path"))
    subroots = _proofs(roots, start).select("row.group", "path", F.col("h").alias("subroot"), "root")
    found = _proofs(groups, stored(subroots, "proofs"))
    return found.select("row", F.col("path").alias("proof"), "subroot", "root")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest leads to by a proof."""
    return F.aggregate(proof, leaf, lambda h, level: F.sha2(F.concat(level["before"], h, level["after"]), 256))


def _sql(levels: int = 6) -> str:
    """Trees of up to 16^levels leaves a source and as many sources."""
    byte = "list_reduce([xor(a, ascii(c)::UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x // 2, 3988292384 * (x % 2)))"
    crc = f"xor(4294967295, list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::UBIGINT)), lambda a, b: {byte.replace('ascii(c)::UBIGINT', 'b')}))"
    h = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [
        f"""WITH d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS at_, count(*) OVER (PARTITION BY source) AS n_
  FROM (SELECT doc_id, source, {h('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {h(lower)} ELSE {h('text')} END AS shown FROM documents))""",
        "a0 AS MATERIALIZED (SELECT source AS g, at_ AS i, n_ AS n, leaf AS h FROM d)",
    ]
    up = lambda t: [
        q
        for k in range(levels)
        for q in (
            f"{t}r{k} AS MATERIALIZED (SELECT g, i // 16 AS j, n, string_agg(h, '' ORDER BY i) AS run FROM {t}{k} GROUP BY g, i // 16, n)",
            f"{t}{k + 1} AS MATERIALIZED (SELECT g, j AS i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(run) ELSE run END AS h FROM {t}r{k})",
        )
    ]
    out += up("a")
    out.append(f"s AS MATERIALIZED (SELECT g AS source, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS at_, count(*) OVER () AS n_ FROM a{levels})")
    out.append("b0 AS MATERIALIZED (SELECT 0 AS g, at_ AS i, n_ AS n, subroot AS h FROM s)")
    out += up("b")
    out.append(f"f0 AS (SELECT d.*, s.subroot, s.at_ AS at2, b.h AS root, '' AS proof, shown AS fold FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source, b{levels} b)")
    steps = [("a", k, "at_", "r.g IS NOT DISTINCT FROM f.source") for k in range(levels)] + [("b", k, "at2", "r.g = 0") for k in range(levels)]
    for m, (t, k, at, on) in enumerate(steps):
        place = f"({at} // {16**k}) % 16 * 64"
        out.append(
            f"""f{m + 1} AS MATERIALIZED (SELECT f.* REPLACE (
  CASE WHEN r.n > 1 THEN proof || substr(run, 1, {place}) || substr(run, {place} + 65) ELSE proof END AS proof,
  CASE WHEN r.n > 1 THEN sha256(substr(run, 1, {place}) || fold || substr(run, {place} + 65)) ELSE fold END AS fold)
  FROM f{m} f JOIN {t}r{k} r ON {on} AND r.j = {at} // {16 ** (k + 1)})"""
        )
    return ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM f{len(steps)}"


ORACLE = _sql()


@query("op13_merkle_manifest", ORACLE)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's leaf, the roots above it, its proof's digest, and whether it holds for what the document shows
    now: where 5 divides the id's checksum, somebody has lower-cased its text."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    whole = [F.col(c) for c in docs.columns]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0) & (lower != F.col("text"))
    leaves = docs.select("doc_id", "source", digest(*whole).alias("leaf"), F.when(tampered, digest(*whole[:-1], lower)).alias("shown"))
    found = merkle_proofs(leaves, "source", ["doc_id"], "leaf")
    siblings = F.array_join(F.transform("proof", lambda x: F.concat(x["before"], x["after"])), "")
    out = found.select("row.doc_id", "row.leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("row.shown", "row.leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
