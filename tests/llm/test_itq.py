"""Near duplicates of embeddings against cosines of all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from lotmark.llm import common, itq, queries

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, bucket string, keys string"


def brute(rows: list[tuple], cosine: float = 0.98) -> tuple[dict, dict]:
    """(links, component) by row number; rows: (vec_id, embedding, label)."""
    ok = [i for i, (v, e, lab) in enumerate(rows) if v is not None and lab is not None and e and all(c is not None and math.isfinite(c) for c in e) and any(e)]
    links = {i: set() for i in range(len(rows))}
    unit = {i: (x := np.array(rows[i][1], dtype=np.float32).astype(float)) / np.linalg.norm(x) for i in ok}
    for n, i in enumerate(ok):
        for j in ok[n + 1 :]:
            if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i].add(j)
                links[j].add(i)
    component: dict[int, int | None] = {}
    for i in range(len(rows)):
        if i in component:
            continue
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component |= {j: min(ids, default=None) for j in seen}
    return links, component


def frame(spark, rows):
    return spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)


def test_groups_copies_and_bad_rows(spark):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for label in range(3):
        for _ in range(40):
            base = rng.normal(size=32)
            for _ in range(int(rng.integers(1, 6))):
                rows.append((n, (base + rng.normal(size=32) * 0.02).astype("float32").tolist(), label))
                n += 1
    rows += [(n + i, rows[i][1], rows[i][2]) for i in range(30)] + [(n + 100, rows[0][1], 1), (n + 101, rows[0][1], None)]
    rows += [(n + 200 + i, e, 0) for i, e in enumerate([None, [], [None] * 32, [math.nan] * 32, [math.inf] + [0.0] * 31, [0.0] * 32, [1.0, 0.0], [1.0, 0.0]])]
    links, component = brute(rows)
    out = {r.vec_id: r for r in itq.near_duplicates(frame(spark, rows)).collect()}
    assert len(out) == len(rows)
    for i, (v, _, _) in enumerate(rows):
        assert (out[v].n_links, out[v].component_id, out[v].kept) == (len(links[i]), component[i], component[i] == v)


def test_large_group_spans_blocks(spark, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.01).astype("float32").tolist(), 7) for i in range(150)]
    links, _ = brute(rows)
    out = {r.vec_id: r for r in itq.near_duplicates(frame(spark, rows)).collect()}
    assert all(out[i].n_links == len(links[i]) and out[i].component_id == 0 for i in range(150))


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 0.0], 0)], [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], None)], [(None, [1.0], 1), (4, [1.0], 1)], [(1, None, 1)]])
def test_few_rows(spark, rows):
    links, component = brute(rows)
    out = sorted(((r.vec_id, r.n_links, r.component_id) for r in itq.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert out == sorted(((v, len(links[i]), component[i]) for i, (v, _, _) in enumerate(rows)), key=str)


def test_repeated_rows_link(spark):
    rows = [(1, [1.0, 2.0], 0)] * 3 + [(2, [1.0, 2.0], 0)]
    assert {(r.vec_id, r.n_links, r.component_id) for r in itq.near_duplicates(frame(spark, rows)).collect()} == {(1, 3, 1), (2, 3, 1)}


def test_rotation_is_orthogonal_and_balanced():
    x = np.random.default_rng(0).normal(size=(4000, 16)) * np.linspace(1, 3, 16)
    mean, p = itq.rotations(x, 32)
    assert np.allclose(p[:, :16].T @ p[:, :16], np.eye(16), atol=1e-8)
    share = ((x - mean) @ p > 0).mean(axis=0)
    assert (abs(share - 0.5) < 0.05).all()


def test_whole_table_recall(spark, small):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    links, component = brute(rows)
    out = {r.vec_id: r for r in queries.op6_itq(spark, small).collect()}
    assert len(out) == len(rows)
    want, got = sum(map(len, links.values())), sum(r.n_links for r in out.values())
    assert got <= want and got >= 0.98 * want
    assert all(out[v].n_links <= len(links[i]) for i, (v, _, _) in enumerate(rows))


def planted(seed: int, dims: int = 64) -> list[tuple]:
    """Rows at cosines of 0.98 to 0.99 with others: pairs in five labels, and groups of up to 40 around a centre in label 0,
    which holds a third of the rows. The other rows are strangers."""
    rng = np.random.default_rng(seed)

    def turned(x, cosine):
        y = rng.normal(size=dims)
        y -= (y @ x) * x
        return cosine * x + math.sqrt(1 - cosine**2) * y / np.linalg.norm(y)

    def direction():
        x = rng.normal(size=dims)
        return x / np.linalg.norm(x)

    found = []
    for label in range(1, 6):
        for _ in range(150):
            x = direction()
            found += [(x, label), (turned(x, rng.uniform(0.98, 0.99)), label)]
        found += [(direction(), label) for _ in range(100)]
    for size in (2, 5, 12, 40) * 8:
        x = direction()  # two members at cosine a with the centre are at about a * a with each other
        found += [(turned(x, math.sqrt(rng.uniform(0.98, 0.99))), 0) for _ in range(size)]
    found += [(direction(), 0) for _ in range(1000 - 8 * 59)]
    return [(i, x.astype("float32").tolist(), label) for i, (x, label) in enumerate(found)]


def test_recall_at_the_limit(spark):
    rows = planted(11)
    labels = [r[2] for r in rows]
    assert labels.count(0) * 3 >= len(rows)
    links, _ = brute(rows)
    out = {r.vec_id: r.n_links for r in itq.near_duplicates(frame(spark, rows)).collect()}
    for kind in (lambda label: label == 0, lambda label: label > 0):
        want = sum(len(links[i]) for i, label in enumerate(labels) if kind(label))
        got = sum(out[i] for i, label in enumerate(labels) if kind(label))
        assert want >= 1000 and 0.9 * want <= got <= want
    assert all(out[i] <= len(links[i]) for i in out)


def test_samples_are_the_smallest_hashes(spark):
    df = spark.range(5000).withColumnRenamed("id", "vec_id")
    want = [r.vec_id for r in df.orderBy(F.xxhash64("vec_id")).limit(100).collect()]
    assert [r.vec_id for r in common.sampled(df, 100, "vec_id").collect()] == want
    assert common.sampled(df, 4000, "vec_id").count() == 4000 and common.sampled(df.limit(0), 5, "vec_id").count() == 0


def test_ids_that_repeat_with_another_label_or_vector(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 5), (2, [1.0, 0.01], 0), (1, [0.0, 1.0], 0), (3, [0.01, 1.0], 0)]
    out = sorted((r.vec_id, r.n_links, r.component_id) for r in itq.near_duplicates(frame(spark, rows)).collect())
    assert out == [(1, 0, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_keys_follow_the_number_of_vectors():
    assert itq.keys(100, 0.98) == itq.keys(60_000, 0.98) == (8, 16)
    tables, bits = itq.keys(10**9, 0.98)
    same = (1 - math.acos(0.98) / math.pi) ** bits
    assert bits == 30 and 1 - (1 - same) ** tables >= 0.96
