from __future__ import annotations

import random

from lectern.llm.common import components, hashed_share


def brute(edges):
    label = {}
    for a, b in edges:
        label.setdefault(a, a)
        label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components_of_chains_stars_and_random_graphs(spark):
    draw = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 700)]
    loose = [(draw.randrange(1000, 1200), draw.randrange(1000, 1200)) for _ in range(120)]
    edges = [e for e in chain + star + loose if e[0] != e[1]]
    draw.shuffle(edges)
    found = dict(map(tuple, components(spark.createDataFrame(edges + edges[:5] + [(7, 7)], "a bigint, b bigint")).collect()))
    assert found == brute(edges)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_sample_is_a_fixed_share(spark):
    from pyspark.sql import functions as F

    ids = spark.range(20_000)
    first = {r.id for r in ids.where(hashed_share(F.col("id"), 0.25)).collect()}
    assert first == {r.id for r in ids.repartition(7).where(hashed_share(F.col("id"), 0.25)).collect()}
    assert 4500 < len(first) < 5500
