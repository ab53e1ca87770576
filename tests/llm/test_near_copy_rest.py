"""Pairs that the forests leave out are checked inside the tasks; only rows and links leave them."""

import numpy as np
import pandas as pd
import pytest
from lectern.llm import simhash
from lectern.llm.simhash import _checked, _open, near_copy_groups, shingle_set

WORDS = [f"w{i}" for i in range(4000)]


def family(rows, changed, seed=3):
    """Texts of 60 words that each differ from one text in some words of their own."""
    draw = np.random.default_rng(seed)
    base, out = [WORDS[i] for i in draw.integers(0, 4000, 60)], []
    for i in range(rows):
        text = list(base)
        for at in draw.choice(60, changed[i % len(changed)], replace=False):
            text[at] = f"x{i}y{at}"
        out.append(" ".join(text))
    return out


def brute(texts, similarity=0.8):
    sets, up = [set(shingle_set(t, 5).tolist()) for t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(texts))]


def block(texts, group=None):
    sets = [shingle_set(t, 5) for t in texts]
    f = np.stack([simhash.set_fingerprint(h, 128) for h in sets]).view(np.int64)
    rows = pd.DataFrame({"node": np.arange(len(texts)) * 3, "n": [len(h) for h in sets], "f0": f[:, 0], "f1": f[:, 1], "bucket": 9, "piece": 0, "lo": 0, "hi": 0})
    rows["group"] = rows["node"] if group is None else group
    rows["bands"], rows["hashes"] = [np.array([9, 8])] * len(rows), [h.view(np.int64) for h in sets]
    return rows.assign(part=0, low=0, high=0)


@pytest.mark.parametrize("rows", [2, 20, 70])
def test_a_bucket_gives_a_forest_of_its_links(rows):
    texts = family(rows, [0, 2, 5])
    found = _checked(128, 28, 0.8)(block(texts))
    want = brute(texts)
    assert len(found) == rows - len(set(want))
    up = list(range(rows))
    for a, b in found.itertuples(index=False):
        a, b = sorted((up[a // 3], up[b // 3]))
        up = [a if x == b else x for x in up]
    assert up == want


def test_open_rows_leave_a_bucket_once_and_only_the_first_they_share():
    rows = block(family(60, [6]))
    found = pd.concat(list(_open(128, 60, 0.5)(iter([rows]))))
    assert sorted(found["node"]) == sorted(rows["node"])
    assert not list(_open(128, 60, 0.5)(iter([rows.assign(bucket=8)])))
    assert not list(_open(128, 60, 0.5)(iter([rows.assign(group=0)])))


@pytest.mark.parametrize("checked", [1 << 21, 300])
def test_a_group_that_mostly_fails_the_check(spark, monkeypatch, checked):
    monkeypatch.setattr(simhash, "CHECKED", checked)
    texts = family(90, [1, 2, 3, 5, 7])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in near_copy_groups(docs, 0.8, recall=0.999999, radius=60).collect()}
    assert [found[i] for i in range(90)] == brute(texts)
