"""Toxicity: accuracy on documents that the fit hasn't seen, and edge tables."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotmark.llm import toxicity

SCHEMA = "doc_id long, text string, severity string, rejected string, toxic string"
LABELS = "doc_id long, quality int, toxic int"
BAD = "vileword nastyword foulword cruelword hatedword".split()


def made(n: int, seed: int) -> tuple[list, list]:
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"word{k}" for k in rng.integers(0, 400, size=60)]
        toxic = int(i % 10 == 0)
        if toxic:
            for _ in range(int(rng.integers(1, 8))):
                words[int(rng.integers(60))] = str(rng.choice(BAD))
        docs.append((seed * 10_000 + i, " ".join(words), "s", "r", "t"))
        labels.append((seed * 10_000 + i, 1, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = made(1500, 1)
    return toxicity.fit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS))


def test_held_out(spark, model):
    docs, labels = made(800, 2)
    severity = {r.doc_id: r.severity for r in toxicity.score(spark.createDataFrame(docs, SCHEMA), model).collect()}
    got = [(severity[i] >= toxicity.REJECT, t) for i, _, t in labels]
    assert sum(g for g, t in got if t) >= 0.97 * sum(t for _, t in got)
    assert sum(g for g, t in got if not t) <= 2


def test_severity_is_ordered(spark, model):
    texts = [("a", "word1 word2"), ("b", "word1 " + BAD[0]), ("c", "word1 " + " ".join(BAD)), ("d", " ".join(BAD * 20)), ("e", None), ("f", ""), ("g", BAD[0].upper() + "!")]
    rows = [(ord(k), t, "", "", "") for k, t in texts]
    s = {chr(r.doc_id): r.severity for r in toxicity.score(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert s["a"] == s["e"] == s["f"] < s["b"] == s["g"] < s["c"] < s["d"] <= 3
    assert list(model.thresholds) == sorted(model.thresholds)


def test_columns_and_rows_stay(spark):
    docs, labels = made(300, 3)
    docs = docs + docs[:5] + [(None, "x", "", "", ""), (None, None, "", "", "")]
    labels = labels + labels[:9] + [(None, 1, 1), (5, None, None), (10**9, 0, 1)]
    out = toxicity.grade(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS))
    assert out.columns == ["doc_id", "text", "toxic", "severity", "rejected"] and out.count() == len(docs)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 1)], [(1, None, None)], [(99, 1, 1), (98, 1, 0)]])
def test_no_use_from_labels(spark, labels):
    docs = spark.createDataFrame([(1, "some text", "", "", ""), (2, None, "", "", "")], SCHEMA)
    out = toxicity.grade(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == 2 and not any(r.rejected for r in out)


def test_empty_documents(spark):
    assert toxicity.grade(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, 1, 1)], LABELS)).collect() == []


def test_thresholds_share_weights():
    rng = np.random.default_rng(0)
    strength = rng.integers(0, 4, size=400)
    rows, cols = np.arange(400), np.zeros(400, dtype=int)
    w, t = toxicity.fit_grades(rows, cols, strength.astype(float), strength, 1)
    expected = (1 / (1 + np.exp(-(np.outer(strength, w[:1]) - t)))).sum(axis=1)
    assert w[0] > 0 and np.corrcoef(expected, strength)[0, 1] > 0.95


def test_held_out_on_tables(spark, small):
    big = small.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = toxicity.fit(docs, labels.where(half))
    out = toxicity.score(docs, model).join(labels.where(~half), "doc_id").select("toxic", (F.col("severity") >= toxicity.REJECT).alias("r")).collect()
    toxic = [x.r for x in out if x.toxic]
    clean = [x.r for x in out if not x.toxic]
    assert sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.04 * len(clean)


def test_scores_are_those_of_the_weights(spark):
    model = toxicity.Model({"bad": 1.5, "badl~": 0.5, "worse": 2.25, "ärger": 1.0}, (2.0, 3.0, 4.5))
    texts = [None, "", "bad", "Bad bad, badly! badly_bad worse2worse", "ärger ÄRGER", "nothing here", "worse " * 200_000]

    def severity(text):
        found = {}
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            for f in toxicity.features(word):
                found[f] = found.get(f, 0) + 1
        z = sum(model.weights[f] * (1 + math.log(n)) for f, n in found.items() if f in model.weights)
        return sum(1 / (1 + math.exp(t - z)) for t in model.thresholds)

    rows = [(i, t, "", "", "") for i, t in enumerate(texts)]
    got = {r.doc_id: r.severity for r in toxicity.score(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert all(abs(got[i] - severity(t)) < 1e-9 for i, t in enumerate(texts))


def test_ids_of_another_type(spark):
    docs = spark.createDataFrame([(str(i), f"vile word{i}" if i % 4 == 0 else f"fine word{i}") for i in range(80)], "doc_id string, text string")
    labels = spark.createDataFrame([(str(i), 1, int(i % 4 == 0)) for i in range(80)], "doc_id string, quality int, toxic int")
    out = toxicity.grade(docs, labels).collect()
    assert all(r.rejected == (int(r.doc_id) % 4 == 0) for r in out)
