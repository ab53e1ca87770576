"""Candidates of a bucket that the spanning forests leave out are checked, too."""

import numpy as np
import pandas as pd
import pytest
from lectern.llm.simhash import FORESTS, _candidates


def bucket(rows, seed=1):
    """Fingerprints within twelve bits of each other, each a group of its own."""
    draw = np.random.default_rng(seed)
    f = np.repeat(draw.integers(0, 1 << 62, (1, 2), np.int64), rows, axis=0)
    for row in f:
        for bit in draw.choice(60, 6, replace=False):
            row[bit % 2] ^= np.int64(1) << np.int64(bit)
    return pd.DataFrame({"node": np.arange(rows) * 7, "n": 100, "f0": f[:, 0], "f1": f[:, 1], "group": np.arange(rows) * 7,
                         "bucket": 5, "piece": 0, "lo": 0, "hi": 0})


def found(block, cut):
    parts = list(_candidates(128, 28, 0.8, True, cut)(iter([block])))
    return [] if not parts else list(pd.concat(parts)[["a", "b"]].itertuples(index=False, name=None))


@pytest.mark.parametrize("rows", [2, 12, 31, 32, 90])
def test_all_pairs_of_a_bucket_come_out_once(rows):
    block = bucket(rows)
    want = {(7 * i, 7 * j) for i in range(rows) for j in range(i + 1, rows)}
    every = found(block, cut=False)
    assert set(every) == want and len(every) == len(want)
    assert len(found(block, cut=True)) <= FORESTS * (rows - 1)


def test_pairs_of_one_group_or_of_unlike_sizes_do_not():
    block = bucket(40)
    block["group"] = np.where(block["node"] < 140, 0, block["node"])
    block.loc[39, "n"] = 50
    every = found(block, cut=False)
    assert len(every) == 39 * 38 // 2 - 20 * 19 // 2 and not any(7 * 39 in pair for pair in every)
