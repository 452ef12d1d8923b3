"""Rendezvous sharding: its law, its slots, and how few records move."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

from lotmark.llm import queries, sharding

SCHEMA = "doc_id long, text string, shard string, slot string, size string, rank string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "", "", "", "") for i, t in rows], SCHEMA)


def test_columns_slots_and_edges(spark):
    rows = [(i, f"text {i}") for i in range(300)] + [(None, "no key"), (None, None), (5, "text 5"), (6, "other"), (7, None), (8, ""), (9, "é" * 10_000)]
    out = sharding.assign(docs(spark, rows), [1.0] * 4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in out:
        assert r.law == "key" and 0 <= r.shard < 4 and r.grown_shard in (r.shard, 4)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    per_key = defaultdict(set)
    for r in out:
        per_key[r.doc_id].add((r.shard, r.grown_shard))
    assert all(len(v) == 1 for v in per_key.values())


def test_growth_equals_a_fresh_assignment(spark):
    rows = docs(spark, [(i, "x") for i in range(2000)])
    grown = {r.doc_id: r.grown_shard for r in sharding.assign(rows, [1.0] * 5).collect()}
    fresh = {r.doc_id: r.shard for r in sharding.assign(rows, [1.0] * 6).collect()}
    assert grown == fresh
    moved = sum(s == 5 for s in fresh.values())
    assert 0.12 < moved / 2000 < 0.21


def test_weights(spark):
    rows = docs(spark, [(i, "x") for i in range(6000)])
    n = Counter(r.shard for r in sharding.assign(rows, [1.0, 2.0, 0.0, 3.0]).collect())
    assert n[2] == 0 and abs(n[1] / n[0] - 2) < 0.35 and abs(n[3] / n[0] - 3) < 0.5


def test_order_does_not_matter_and_empty(spark):
    rows = docs(spark, [(i % 50, f"t{i % 60}") for i in range(200)])
    a, b = (sorted(map(tuple, sharding.assign(x, [1.0] * 16).collect()), key=str) for x in (rows, rows.repartition(9)))
    assert a == b
    assert sharding.assign(docs(spark, []), [1.0] * 16).collect() == []


def test_whole_table(spark, small):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = queries.op5_sharding(spark, small).collect()
    assert {(r.doc_id, r["size"], r.text_crc32) for r in out} == {(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    assert all(r.shard < 16 and r.grown_shard in (r.shard, 16) for r in out)


def test_assignment_and_slots_against_plain_python(spark):
    weights = [1.0, 2.0, 0.0, 0.5, 1.0]
    rows = [(i, f"text {i % 7}" * (i % 5)) for i in range(400)] + [(7, "again"), (7, "again"), (None, None), (None, "x")]

    def draw(key, shard):
        text = "null" if key is None else str(key)
        return (int(hashlib.md5(f"{text}:{shard}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52

    def best(key, w):
        return min((-math.log(draw(key, s)) / x, s) for s, x in enumerate(w) if x > 0)[1]

    placed = {}
    for key, text in rows:
        body = (text or "").encode()
        placed.setdefault(best(key, weights), []).append((key is not None, key or 0, zlib.crc32(body), len(body) + 1))
    want = []
    for shard, members in placed.items():
        for slot, (there, key, crc, size) in enumerate(sorted(members)):
            key = key if there else None
            want.append((key, size, crc, "key", shard, slot, best(key, [*weights, 1.0])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in sharding.assign(docs, weights).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
