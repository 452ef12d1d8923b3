"""Lines are dealt to tasks by the size of their files."""

from __future__ import annotations

import math
from pathlib import Path

from lotmark.sources import tables


def test_tasks_grow_with_the_lines(spark, small, monkeypatch):
    monkeypatch.setattr(tables, "PIECE", 1000)
    m = tables.Model(spark, small)
    n = math.ceil(Path(f"{small}/lineitem.parquet").stat().st_size / 1000)
    assert m.pieces == n > spark.sparkContext.defaultParallelism
    for df in (m.bids, m.items, m.packages):
        assert df.rdd.getNumPartitions() == n


def test_as_many_tasks_as_cores_at_least(spark, small):
    assert tables.Model(spark, small).pieces == spark.sparkContext.defaultParallelism
