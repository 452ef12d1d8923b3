"""Exact top-k against scores of all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from lotmark.llm import queries, topk

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, block string, score string"


def brute(rows: list[tuple], k: int, every: int) -> set[tuple]:
    """rows: (vec_id, embedding), each id once."""
    ok = {i: [math.floor(1024 * float(np.float32(c))) for c in e] for i, e in rows if e and all(c is not None and math.isfinite(c) for c in e)}
    out = set()
    for q, x in ok.items():
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in ok.items() if i != q and len(y) == len(x))
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, "r", "b", "s") for i, e in rows], SCHEMA)


def test_random_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(500)]
    rows += [(i, rows[i % 7][1]) for i in range(500, 600)]  # many copies: ties
    rows += [(600, None), (601, []), (602, [None] * 8), (603, [math.nan] * 8), (604, [math.inf] + [0.0] * 7), (700, [0.0] * 8), (800, [1.0, 2.0])]
    out = {tuple(r) for r in topk.search(frame(spark, rows), k=10, every=50).collect()}
    assert out == brute(rows, 10, 50)


@pytest.mark.parametrize("rows", [[], [(100, [1.0])], [(100, [1.0]), (200, [0.5]), (1, [-3.0])], [(0, [0.0, 0.0]), (1, [0.0, 0.0])]])
def test_few_rows(spark, rows):
    out = {tuple(r) for r in topk.search(frame(spark, rows)).collect()}
    assert out == brute(rows, 10, 100)


def test_repeated_rows(spark):
    rows = [(100, [1.0, 0.0])] * 2 + [(1, [1.0, 1.0])] * 2 + [(None, [9.0, 9.0])]
    out = sorted(tuple(r) for r in topk.search(frame(spark, rows)).collect())
    one = 1024 * 1024  # each row of id 100 is a query, and the other one's candidate
    assert out == sorted([(100, 1, 1, one), (100, 2, 1, one), (100, 3, 100, one)] * 2)


def test_rows_that_share_an_id_but_not_the_vector(spark):
    rows = [(100, [1.0, 0.0]), (100, [3.0, 0.0]), (1, [2.0, 0.0])]
    out = sorted(tuple(r) for r in topk.search(frame(spark, rows)).collect())
    one = 1024 * 1024
    assert out == sorted([(100, 1, 100, 3 * one), (100, 2, 1, 2 * one), (100, 1, 1, 6 * one), (100, 2, 100, 3 * one)])


def test_index_is_exact_for_any_data():
    rng = np.random.default_rng(5)
    for n, d, spread in ((1, 1, 3), (40, 3, 2), (700, 16, 1000), (3000, 4, 50)):
        x = rng.integers(-spread, spread + 1, size=(n, d))
        index = topk.ImpactIndex(np.arange(n), x)
        for q in rng.integers(-spread, spread + 1, size=(8, d)):
            at, scores = index.best(q.astype(float), 10, 3)
            ids = index.ids[at]
            want = sorted((-int(x[i] @ q), i) for i in range(n) if i != 3)[:10]
            assert [(-int(s), int(i)) for i, s in zip(ids, scores, strict=True)] == want


def test_whole_table(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert {tuple(r) for r in queries.op3_topk(spark, small).collect()} == brute(rows, 10, 100)
