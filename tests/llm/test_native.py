"""Line dedup, exact dedup and sharding: DataFrame functions against SQL and plain Python."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import duckdb
import pytest

from lectern.llm import exact, lines, sharding
from tests.llm.odd import LONG, ROWS, documents, none


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def brute_lines(rows, ratio, least):
    pages, seen = Counter(), Counter()
    for _, text, _, host, _ in rows:
        pages[host] += 1
        for line in {t.strip(" \t\r\f\x0b") for t in (text.split("\n") if text is not None else [])}:
            seen[host, line] += 1
    out = []
    for doc, text, _, host, _ in rows:
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        bad = lambda t: t and seen[host, t] >= least and seen[host, t] > ratio * pages[host]  # noqa: B023, E731
        split = text.split("\n")
        kept = [t for t in split if not bad(t.strip(" \t\r\f\x0b"))]
        out.append((doc, "\n".join(kept), len(split), len(split) - len(kept)))
    return out


def test_lines_against_brute_force(spark):
    rows = list(ROWS)
    for i in range(40):
        host = [None, "x.example", "y.example"][i % 3]
        rows.append((100 + i, f"menu \n\nown line {i}\n{'footer' if i % 2 else ' rare'}\nmenu", "en", host, 0))
    rows.append((200, "all gone", "en", "z.example", 0))
    rows += [(201 + i, "all gone\r", "en", "z.example", 0) for i in range(2)]
    found = lines.drop_site_lines(documents(spark, rows), ratio=0.4)
    got = [tuple(r) for r in found.select("row.doc_id", "text", "n_lines", "n_dropped").collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(brute_lines(rows, 0.4, 3), key=key)
    assert (200, "", 1, 1) in got
    assert "row" in found.select("row.*").columns  # the clashing names come back
    assert "Python" not in plan(found) and "Pandas" not in plan(found)


def test_lines_of_nothing(spark):
    assert lines.drop_site_lines(none(spark)).count() == 0


def test_a_host_with_a_third_of_all_pages_and_one_line_each(spark):
    rows = [(i, "hot line\nline " + str(i), "en", "hot.example" if i % 3 == 0 else f"h{i % 50}.example", 0) for i in range(600)]
    got = {r.doc_id: r.n_dropped for r in lines.drop_site_lines(documents(spark, rows)).select("row.doc_id", "n_dropped").collect()}
    assert set(got.values()) == {1}


def brute_exact(rows, largest):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for r in rows:
        ids = [i for i in groups[r[1] or ""] if i is not None]
        keep = (max if largest else min)(ids) if ids else None
        out.append((r[0], keep, len(groups[r[1] or ""]), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    return out


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_against_brute_force(spark, keep):
    head = "x" * 100  # longer than a splitter
    rows = ROWS + [(1000 + i, "hot", "en", "s", 3) for i in range(300)] + [(2000 + i, head + str(i % 90), "en", "s", 3) for i in range(300)] + [(None, "lone", None, None, None)]
    found = exact.exact_groups(documents(spark, rows), keep=keep)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute_exact(rows, keep == "largest"), key=key)
    assert "Python" not in plan(found)


def test_exact_of_nothing_and_normalised(spark):
    from pyspark.sql import functions as F

    assert exact.exact_groups(none(spark)).count() == 0
    found = exact.exact_groups(documents(spark, [(1, "A", "", "", 1), (2, "a", "", "", 1)]), normalise=F.lower)
    assert {r.keep_id for r in found.collect()} == {1}
    with pytest.raises(ValueError):
        exact.exact_groups(none(spark), keep="first")


def brute_shards(rows, limit):
    docs = [(r[0], len((r[1] or "").encode()), int(hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], 16)) for r in rows]
    out = []

    def split(some, depth, prefix):
        if sum(d[1] for d in some) <= limit or len(some) == 1:
            out.extend((d[0], d[1], prefix, depth, sum(x[1] for x in some)) for d in some)
        else:
            for bit in "01":
                part = [d for d in some if format(d[2], "060b")[depth] == bit]
                if part:
                    split(part, depth + 1, prefix + bit)

    split(docs, 0, "")
    return out


@pytest.mark.parametrize("limit", [50, 700, 20_000, 10**9])
def test_shards_against_brute_force(spark, limit):
    rows = [r for i, r in enumerate(ROWS) if i != 5] + [(100 + i, "y" * (i % 37), "en", "s", 0) for i in range(500)]
    found = sharding.extendible_shards(documents(spark, rows), shard_bytes=limit)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.select("doc_id", "n_bytes", "shard", "depth", "shard_bytes").collect()), key=key) == sorted(brute_shards(rows, limit), key=key)


def test_shards_of_repeated_keys_fit_too(spark):
    rows = [(1, "z" * 10, "en", "s", 0)] * 50 + [(2, LONG, "en", "s", 0)]
    found = sharding.extendible_shards(documents(spark, rows), shard_bytes=35).collect()
    size = defaultdict(int)
    for r in found:
        size[r.shard] += r.n_bytes
        assert r.doc_id == 2 or r.shard_bytes <= 35
    assert len(found) == 51 and all(r.shard_bytes == size[r.shard] for r in found)
    assert sharding.extendible_shards(none(spark)).count() == 0


def test_shards_against_sql_with_a_small_limit(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    want = sorted(map(tuple, con.execute("select doc_id, n_bytes, shard, depth, shard_bytes from (" + sharding.SQL.format(limit=40_000) + ")").fetchall()))
    found = sharding.extendible_shards(spark.read.parquet(f"{folder}/documents.parquet"), shard_bytes=40_000)
    assert sorted(map(tuple, found.select("doc_id", "n_bytes", "shard", "depth", "shard_bytes").collect())) == want
    assert len({w[2] for w in want}) > 5
