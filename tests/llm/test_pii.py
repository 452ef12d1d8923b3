"""Personal data: patterns against plain searches, proposals, the boosted trees and what they add."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lotmark.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plainly(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark)


PIECES = st.sampled_from(["4111 1111 1111 1111", "4111111111111111", "+1 (555) 555-1234", "1.2.3.4", "300.1.1.1", "001.02.3.255", "a@b.c", "@", ".", "-", " ", "+", "x", "9", "12", "@d.e", "_", "\n", "é", "5500-0000-0000-0004", "(", ")", "+49", "00", "1234567"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=14))
def test_base_is_what_plain_searches_find(pieces):
    text = "".join(pieces)
    assert pii.base(text) == plainly(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1.@+- (x5", max_size=40))
def test_base_on_any_text(text):
    assert pii.base(text) == plainly(text)


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, "a." * 200_000, "1." * 200_000, "@a.b " * 80_000, "+1 " * 130_000, "1 2-" * 100_000, "a@" * 200_000, "at (at) " * 50_000, "1:2:" * 100_000, "+" + " " * 300_000, "1234567 " * 50_000])
def test_long_texts_take_no_square_time(model, text):
    found = pii.spans(text, model)
    assert all(0 <= a < b <= len(text) for _, a, b, _, _ in found)


def test_trees_score_as_spark_does(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(1)
    rows = rng.normal(size=(300, 4))
    frame = spark.createDataFrame([(float(x[0] * x[1] > 0), x.tolist()) for x in rows], "label double, xs array<double>").select("label", "xs", array_to_vector("xs").alias("features"))
    fitted = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(frame)
    ours = pii.flattened([t.toDebugString for t in fitted.trees], fitted.treeWeights)
    theirs = [r.p for r in fitted.transform(frame).select(vector_to_array("probability")[1].alias("p")).collect()]
    assert np.allclose(ours.scores(rows), theirs)


def test_calibration():
    scores, labels = np.linspace(0, 1, 200), np.array([0] * 100 + [1, 0] * 20 + [1] * 60)
    bound = pii.calibrated(scores, labels, 0.9)
    assert labels[scores >= bound].mean() >= 0.9 and labels[scores >= bound].sum() >= 60
    assert pii.calibrated(scores, np.zeros(200), 0.9) == 1.0


def test_what_the_trees_add(model):
    hit = wrong = miss = 0
    for text, right in pii.labelled_texts(2000, seed=77):
        found = pii.spans(text, model)
        assert [s[:3] for s in found if s[3]] == [(pii.KINDS[k], a, b) for a, k, b in pii.base(text)]
        more = {s[:3] for s in found if not s[3]}
        want = {(pii.KINDS[k], a, b) for a, k, b in right}
        hit += len(more & want)
        wrong += len(more - want)
        miss += sum(not any(s[3] and s[1] < b and a < s[2] for s in found) for _, a, b in want - more)
    assert wrong <= 0.02 * hit and hit >= 0.85 * (hit + miss)
    joined = "see 4465758382889437 4465758382889437 there"
    assert pii.base(joined) == [] and [s[:3] for s in pii.spans(joined, model)] == [("card", 4, 20), ("card", 21, 37)]


def test_edges(spark, model):
    rows = [(1, None, "p"), (2, "", "q"), (3, "mail a@b.co now", "r"), (3, "mail a@b.co now", "r"), (None, "é +1 (555) 555-1234", "s"), (4, "x" * 200_000 + " a@b.co", "t")]
    out = pii.find(spark.createDataFrame(rows, "doc_id long, text string, spans string"), model, redacted="clean").collect()
    got = sorted(((r.doc_id, [(s.kind, s.start, s.end, s.base) for s in r.spans], r.clean) for r in out), key=str)
    want = [(1, [], None), (2, [], ""), *[(3, [("email", 5, 11, True)], "mail [email] now")] * 2, (None, [("phone", 2, 19, True)], "é [phone]"), (4, [("email", 200_001, 200_007, True)], "x" * 200_000 + " [email]")]
    assert got == sorted(want, key=str)
    assert pii.find(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []


def test_masks_cover_overlaps():
    assert pii.masked("ab cdef g", [("phone", 0, 2, True, 1.0), ("card", 3, 6, True, 1.0), ("ip", 4, 7, True, 1.0)]) == "[phone] [card] g"


def test_whole_table(spark, small):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = queries.op12_pii(spark, small).collect()
    assert len(out) == len(texts)
    for r in out:
        known = plainly(texts[r.doc_id])
        listed = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in known]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in known) for i in range(4)]
        spans = r.spans.split(",") if r.spans else []
        assert set(listed) <= set(spans)
        keys = [(int(a), pii.KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in spans)]
        assert keys == sorted(keys)
