"""Mixing against targets filled by hand, and the laws of a mix."""

from __future__ import annotations

import math
import re
import struct
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from lotmark.llm import mixing, queries

SCHEMA = "doc_id long, text string, source string, n_chars long, size string, uses int, hash string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes: dict, weights=(5.0, 2.0, 1.0), most=3) -> dict:
    """Targets by filling: give every source its share, fix those above their cap, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in fixed]
        left, weight = total - sum(fixed.values()), sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / weight > most * sizes[s]]
        if not over:
            return fixed | {s: left * w[s] / weight for s in free}
        fixed |= {s: float(most * sizes[s]) for s in over}


def rows(spread: dict) -> list[tuple]:
    out, n = [], 0
    for source, sizes in spread.items():
        for size in sizes:
            out.append((n, " ".join(f"w{n}x{i}" for i in range(size)), source, 0, "clash", 1, "clash"))
            n += 1
    return out


CASES = {
    "plain": {"a": [5, 9, 30], "b": [7] * 20, "c": [50]},
    "capped": {"a": [1], "b": [100, 300], "c": [2, 3], "d": [1] * 10, None: [40]},
    "one": {"a": [3, 4]},
    "no words": {"a": [0, 0], "b": [10]},
    "null only": {None: [4, 4, 0]},
}


@pytest.mark.parametrize("case", CASES)
def test_targets_and_taken(spark, case):
    data = rows(CASES[case])
    out = mixing.plan(spark.createDataFrame(data, SCHEMA)).collect()
    sizes = {s: sum(v) for s, v in CASES[case].items()}
    want, taken = shares(sizes), defaultdict(int)
    assert len(out) == len(data)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        whole = r.target // r.source_size if r.source_size else 0
        assert r.taken >= whole * r.size
        taken[r.source] += r.taken
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 0.5 + 1e-6


@pytest.mark.parametrize("case", CASES)
def test_mix_holds_the_taken_words(spark, case):
    docs = spark.createDataFrame(rows(CASES[case]), SCHEMA)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got, plan = defaultdict(int), defaultdict(int)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in mixed.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert texts[r.doc_id].startswith(r.text)
    for r in mixing.plan(docs).collect():
        plan[r.doc_id] += r.taken
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in plan.items() if v}


def test_repeated_rows_nulls_and_order(spark):
    data = [(1, "a b c", "s", 5, "", 1, ""), (1, "a b c", "s", 5, "", 1, ""), (None, "d e", "s", 3, "", 1, ""), (2, None, "s", 0, "", 1, ""), (3, "x " * 500, "t", 0, "", 1, "")]
    docs = spark.createDataFrame(data, SCHEMA)
    a = sorted(map(tuple, mixing.plan(docs).collect()), key=str)
    b = sorted(map(tuple, mixing.plan(docs.repartition(7)).collect()), key=str)
    assert a == b and len(a) == len(data)
    words = sum(len(WORD.findall(r.text or "")) for r in mixing.mix(docs).collect())
    assert words == sum(r[-1] for r in a)


def test_better_documents_come_first(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a", 0, "", 1, "") for i in range(400)] + [(1000, "w " * 6000, "b", 0, "", 1, "")], SCHEMA)
    score = F.when(F.col("doc_id") % 2 == 0, 20.0).otherwise(1.0)
    out = [r for r in mixing.plan(docs, weights=(1.0, 4.0), score=score).collect() if r.doc_id < 1000]
    even, odd = (sum(r.taken for r in out if r.doc_id % 2 == k) for k in (0, 1))
    assert even > 3 * odd > 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.plan(docs).collect() == [] and mixing.mix(docs).collect() == []


def test_first_words(spark):
    one = spark.createDataFrame([("  a b\tc \n", n) for n in range(1, 5)], "text string, n int")
    assert [r[0] for r in one.select(mixing.first_words(F.col("text"), F.col("n"))).collect()][:2] == ["  a", "  a b"]


def test_whole_table(spark, small):
    texts = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    sizes = defaultdict(int)
    for r in texts.values():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want, taken = shares(sizes), defaultdict(int)
    out = queries.op2_mixing(spark, small).collect()
    assert len(out) == len(texts)
    for r in out:
        doc = texts[r.doc_id]
        assert r["size"] == len(WORD.findall(doc.text or "")) and r.target == pytest.approx(want[doc.source])
        taken[doc.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.51 for s in sizes)


def test_documents_are_taken_in_order_of_their_keys(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)), f"s{i % 3}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")

    def key(i):  # the hash of the id, then of the seed, as Spark chains them
        first = xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest()
        last = xxhash.xxh64(struct.pack("<i", 17), seed=first).intdigest()
        return -math.log(((last & ((1 << 52) - 1)) + 0.5) / (1 << 52))

    for whole in (False, True):
        got = {r.doc_id: r for r in mixing.plan(docs, whole=whole).collect()}
        for source in ("s0", "s1", "s2"):
            ids = sorted((i for i, _, s in rows if s == source), key=key)
            target, total = got[ids[0]].target, got[ids[0]].source_size
            epochs = int(target // total)
            left = round(target) - epochs * total
            for i in ids:
                size = got[i].size
                part = (size if 2 * left >= size else 0) if whole else min(size, max(left, 0))
                assert got[i].taken == epochs * size + part
                left -= size


def test_whole_documents_alone(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    mixed = mixing.mix(docs, whole=True).collect()
    assert all(r.text == texts[r.doc_id] for r in mixed)
    planned = mixing.plan(docs, whole=True).collect()
    largest = {}
    for r in planned:
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    taken = {s: sum(r.taken for r in planned if r.source == s) for s in largest}
    target = {r.source: r.target for r in planned}
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in taken)
    assert sum(taken.values()) == sum(len((r.text or "").split()) for r in mixed)


def test_quality_on_documents_that_the_fit_has_not_seen(spark, small):
    big = small.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    score = mixing.fitted_quality(docs, labels.where(half))
    rows = docs.withColumn("s", score).join(labels.where(~half), "doc_id").select("quality", "s").collect()
    good, bad = [r.s for r in rows if r.quality], [r.s for r in rows if not r.quality]
    right = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert right >= 0.75 and all(mixing.LEAST_QUALITY <= r.s <= 1 for r in rows)
    assert mixing.fitted_quality(docs.limit(0), labels)._jc.toString() == mixing.quality(F.col("text"))._jc.toString()
