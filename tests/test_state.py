"""What keyed state keeps and drops, read back from the checkpoints of stopped queries."""

import datetime as dt
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lectern.session import scratch_dir
from lectern.sources.messages import table_stream
from lectern.streaming import operators as s
from lectern.streaming.run import start, to_layer
from lectern.streaming.state import EXPIRES, kept_and_dropped, state_rows

DAY0 = dt.datetime(2024, 1, 1)
FIRST_DAY = 19723  # days from 1970 to DAY0
SCHEMA = "mid string, uid string, ts timestamp_ntz"


def at(seconds=0, days=0):
    return DAY0 + dt.timedelta(days=days, seconds=seconds)


def add_file(spark, path, *data, schema=SCHEMA):
    """One more file, which is a micro-batch."""
    spark.createDataFrame(list(data), schema).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.05)  # file order is by modification time


def read_files(spark, path, schema=SCHEMA):
    return table_stream(spark, path, spark.createDataFrame([], schema).schema, files_per_batch=1)


def test_a_key_is_dropped_a_full_day_after_its_last(spark):
    path, root = scratch_dir(spark, "files"), scratch_dir(spark, "run")
    add_file(spark, path, ("a", None, at(10)), ("b", None, at(20)), ("'; x", None, at(30)))
    add_file(spark, path, ("b", None, at(4, 9)), ("c", None, at(7, 7)), ("d", None, at(0, 8)))

    def run():
        first = s.daily_first(read_files(spark, path), ["mid"], late=None).select("mid", "ts")
        return to_layer(first, f"{root}/data", f"{root}/checkpoint")

    def held(batch=None):
        return state_rows(spark, f"{root}/checkpoint", "last_day", ["mid"], batch)

    seen = run()
    assert rows(held(0)) == [("'; x", FIRST_DAY), ("a", FIRST_DAY), ("b", FIRST_DAY)]
    # the clock stands five seconds before the latest row, a second short of day 9, and day 7 goes at its beginning
    assert rows(held()) == [("b", FIRST_DAY + 9), ("c", FIRST_DAY + 7), ("d", FIRST_DAY + 8)]
    marked = kept_and_dropped(seen.select("mid").distinct(), held(), ["mid"])
    assert rows(marked) == [("'; x", False), ("a", False), ("b", True), ("c", True), ("d", True)]

    # after a restart from the checkpoint: c's day is left behind; a late row of a dropped key counts again and goes again
    add_file(spark, path, ("b", None, at(6, 9)), ("a", None, at(11)))
    seen = run()
    assert rows(held(), "mid") == [("b",), ("d",)]
    assert rows(seen.filter("mid = 'a'"), "ts") == sorted([(at(10),), (at(11),)], key=str)


def versions_until_read(spark, path, root, schema, keep_ms, new_rows):
    """The state of a query on the wall clock, which is never done: stopped when so many rows are read."""
    found = s.latest_version(read_files(spark, path, schema), "id", "ts", hold_ms=3_600_000, keep_ms=keep_ms)
    query = start(found, lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/data/{number}"), f"{root}/checkpoint", "1 second")
    try:
        for _ in range(120):
            if sum(p.numInputRows for p in query.recentProgress) >= new_rows:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    return state_rows(spark, f"{root}/checkpoint", "best", ["id"])


def test_a_time_to_live_is_set_on_create_and_on_write(spark):
    schema, keep = "id string, v string, ts timestamp_ntz", 600_000
    path, root = scratch_dir(spark, "files"), scratch_dir(spark, "run")

    def ends(new_rows):
        return {r["id"]: r["until"] for r in versions_until_read(spark, path, root, schema, keep, new_rows).select("id", F.unix_millis(EXPIRES).alias("until")).collect()}

    before = time.time() * 1000
    add_file(spark, path, ("a", "1", at(1)), ("b", "1", at(1)), schema=schema)
    created = ends(2)
    assert set(created) == {"a", "b"} and all(before + keep <= e <= time.time() * 1000 + keep for e in created.values())
    add_file(spark, path, ("a", "2", at(2)), schema=schema)
    written = ends(1)
    assert written["a"] > created["a"] and written["b"] == created["b"]


def test_what_has_outlived_its_time_is_dropped(spark):
    schema = "id string, v string, ts timestamp_ntz"
    path, root = scratch_dir(spark, "files"), scratch_dir(spark, "run")
    add_file(spark, path, ("a", "1", at(1)), schema=schema)
    versions_until_read(spark, path, root, schema, 1, 1)
    add_file(spark, path, ("b", "1", at(1)), schema=schema)
    held = versions_until_read(spark, path, root, schema, 1, 1)
    assert "a" not in [r["id"] for r in held.collect()]


def test_map_state_has_a_row_per_entry(spark):
    path, root = scratch_dir(spark, "files"), scratch_dir(spark, "run")
    add_file(spark, path, ("a", "u", at(10)), ("a", "u", at(40, 1)), ("b", "u", at(50, 1)))
    to_layer(s.first_logins(read_files(spark, path)), f"{root}/data", f"{root}/checkpoint")
    held = state_rows(spark, f"{root}/checkpoint", "days", ["mid"])
    assert rows(held, "mid", "day", "sent") == sorted([("a", FIRST_DAY, True), ("a", FIRST_DAY + 1, False), ("b", FIRST_DAY + 1, False)], key=str)
    with pytest.raises(ValueError, match="kept by 1 columns"):
        state_rows(spark, f"{root}/checkpoint", "days", ["mid", "day"])


def test_null_keys_and_empty_state(spark):
    seen = spark.createDataFrame([(None, 1), ("a", 2)], "mid string, n int")
    held = spark.createDataFrame([(None,), (None,)], "mid string")
    assert rows(kept_and_dropped(seen, held, ["mid"])) == sorted([(None, 1, True), ("a", 2, False)], key=str)
    assert rows(kept_and_dropped(seen.limit(0), held, ["mid"])) == []
