"""The cost of keyed state goes by the rows: few buckets for few rows, and texts compared only where times tie."""

import numpy as np
import pandas as pd
import pytest

from lectern.plans import stream_registry as registry
from lectern.streaming import operators as s
from lectern.streaming import processors as p
from lectern.streaming.run import state_partitions


class Text(str):
    """A text that counts how often its order is asked for."""

    asked = 0

    def __lt__(self, other):
        Text.asked += 1
        return str.__lt__(self, other)

    __hash__ = str.__hash__


def random_rows(seed, text=str):
    r = np.random.default_rng(seed)
    n = int(r.integers(0, 60))
    at = r.integers(0, 4 if seed % 2 else 10**9, n)
    frame = pd.DataFrame({"k0": pd.Series(r.choice(["a", "b", None], n), dtype=object), "at": at,
                          "row": pd.Series([text(f"t{i}") for i in r.integers(0, 30, n)], dtype=object)})
    return frame.assign(at=frame["at"].astype(float).where(r.random(n) < 0.9)) if seed % 3 == 0 else frame


@pytest.mark.parametrize("seed", range(40))
def test_rows_come_in_the_order_of_key_time_and_text(seed):
    frame = random_rows(seed)
    n = p.numbered(frame, ["k0"])
    want = frame.assign(n=n).sort_values(["n", "at", "row"], kind="stable")
    pd.testing.assert_frame_equal(frame.assign(n=n).iloc[p.in_order(frame, n)].reset_index(drop=True), want.reset_index(drop=True))
    last = want.drop_duplicates("n", keep="last").drop(columns="n")
    pd.testing.assert_frame_equal(p.greatest(frame, n).reset_index(drop=True), last.reset_index(drop=True))
    days = frame.assign(day=frame["at"] // p.DAY).sort_values(["at", "row"]).drop_duplicates(["k0", "day"])[["k0", "at", "row"]]
    order = ["k0", "at", "row"]
    pd.testing.assert_frame_equal(p.earliest_per_day(frame, ["k0"]).sort_values(order, ignore_index=True), days.sort_values(order, ignore_index=True))


def test_texts_of_different_times_are_not_compared():
    frame = pd.DataFrame({"k0": ["a"] * 500, "at": np.arange(500)[::-1], "row": pd.Series([Text(f"t{i}") for i in range(500)], dtype=object)})
    Text.asked = 0
    assert p.earliest_per_day(frame, ["k0"])["row"].tolist() == ["t499"]
    assert p.greatest_and_first(frame, ["k0"])["row"].tolist() == ["t0"]
    assert Text.asked == 0


def test_buckets_and_parts_go_by_the_rows(spark):
    cores, before = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    least = registry.BUCKETS_PER_CORE * cores
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "10000")
        for rows, buckets, parts in ((0, least, cores), (1000 * registry.ROWS_PER_BUCKET * cores, 1000 * cores, 3 * cores)):
            with registry.buckets_for(spark, rows):
                assert spark.conf.get(s.STATE_BUCKETS) == str(buckets)
                assert state_partitions(spark) == str(parts)
        assert spark.conf.get(s.STATE_BUCKETS, None) is None and state_partitions(spark) == str(3 * cores)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_chunk_sends_one_cell_per_bucket():
    frame = pd.DataFrame({"k0": ["a", None, "c", "a"], "at": [3, 1, None, 2], "row": ["x", "", "y", "z"], "bucket": [2, 0, 2, 2]})
    kinds = {"k0": "string", "at": "bigint", "row": "string"}
    cells = p.dealt(frame, kinds)
    assert cells["bucket"].tolist() == [0, 2]
    back = p.whole(iter([cells[cells["bucket"] == 2], cells[cells["bucket"] == 0]]))
    assert back["k0"].tolist() == ["a", "c", "a", None] and back["row"].tolist() == ["x", "y", "z", ""]
    assert [None if x != x else x for x in back["at"]] == [3, None, 2, 1]
    sent = p.marked_cells(cells, frame["at"], kinds)
    assert sent["event_ts"].isna().tolist() == [True, True, False] and sent["event_ts"].iloc[2] == pd.Timestamp(3, unit="us", tz="UTC")
    assert p.whole(iter([sent.iloc[[2]]])).empty and p.marked_cells(p.dealt(frame[:0], kinds), frame["at"][:0], kinds).empty
