"""State by key: over several runs, with late rows, ties and keys that fall silent."""

from __future__ import annotations

from lotmark.streaming import jobs, keyed
from pyspark.sql import functions as F

SCHEMA = "k long, n long, v string, s long"


def put(spark, folder, rows):
    frame = spark.createDataFrame(rows, SCHEMA).select("k", "n", "v", F.timestamp_seconds("s").alias("ts"))
    frame.coalesce(1).write.mode("append").parquet(folder)


def held(spark, source, state, silent=100_000):
    keyed.advance(jobs.stream(spark, source), state, ["k"], ["n"], "ts", silent_ms=silent)
    return {(r.k, r.n, r.v, r._at) for r in keyed.current(spark, state).collect()}


def test_state_goes_on_and_silent_keys_leave(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    put(spark, source, [(1, 1, "a", 1000), (1, 3, "c", 1001), (1, 2, "b", 1002), (2, 5, "x", 1000), (None, 1, "null", 1002)])
    first = held(spark, source, state)
    assert first == {(1, 3, "c", 1002_000), (2, 5, "x", 1000_000), (None, 1, "null", 1002_000)}
    assert held(spark, source, state) == first  # nothing new
    put(spark, source, [(1, 3, "z", 1050), (3, None, "none", 1060), (3, 1, "one", 1059), (1, 9, "late", 900)])
    assert held(spark, source, state) == {(1, 3, "z", 1050_000), (2, 5, "x", 1000_000), (3, 1, "one", 1060_000), (None, 1, "null", 1002_000)}
    put(spark, source, [(4, 1, "new", 1130)])
    # 2 and null were silent for a hundred seconds, 1 and 3 weren't
    assert held(spark, source, state) == {(1, 3, "z", 1050_000), (3, 1, "one", 1060_000), (4, 1, "new", 1130_000)}
    put(spark, source, [(2, 1, "again", 1131)])
    assert (2, 1, "again", 1131_000) in held(spark, source, state)
    whole = str(tmp_path / "whole")
    assert held(spark, source, whole, silent=10**9) == {(1, 9, "late", 1050_000), (2, 5, "x", 1131_000), (3, 1, "one", 1060_000), (4, 1, "new", 1130_000), (None, 1, "null", 1002_000)}
