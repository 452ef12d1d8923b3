"""Fill-in-middle: lists of boundaries, the index of distinct texts, and cuts against plain Python."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lotmark.llm import fim, queries
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, n string, form string, output string, member string, body string, hash string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e", "f") for i, t in rows], SCHEMA)


def plainly(doc_id, text, seed=1):
    t = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return ("plain", None, None, t)
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if h4 % 100 < 20:
        return ("spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}")
    return ("psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=300), st.integers(0, 12))
def test_packed_lists_give_every_value(steps, shift):
    values = np.cumsum(np.array(steps, dtype=np.int64) << shift)
    form = fim.packed(values)
    assert fim.selected(form, list(range(len(values)))) == values.tolist()


def test_long_lists_and_their_size():
    dense, sparse = np.arange(300_001), np.arange(0, 10**9, 5003)
    for values in (dense, sparse):
        places = [0, 1, 4095, 4096, len(values) // 2, len(values) - 2, len(values) - 1]
        assert fim.selected(fim.packed(values), places) == values[places].tolist()
    assert len(fim.packed(dense)) < 0.3 * len(dense) and len(fim.packed(sparse)) < 2.1 * len(sparse)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_units(text):
    body = text.encode("utf-8", "replace")
    text = body.decode()
    cut = lambda v: [body[a:b] for a, b in zip(v, v[1:], strict=False)]
    assert cut(fim.boundaries(body)) == [c.encode() for c in text]
    lines = cut(fim.boundaries(body, "line"))
    assert b"".join(lines) == body and all(x.endswith(b"\n") and x.count(b"\n") == 1 for x in lines[:-1]) and (not lines or lines[-1][:-1].count(b"\n") == 0)
    words = cut(fim.boundaries(body, "word"))
    assert b"".join(words) == body and [w for x in words for w in x.split()] == body.split()
    assert all(len(x.split()) == 1 for x in words[1:])
    with pytest.raises(ValueError):
        fim.boundaries(body, "page")


def test_edges_against_plain_python(spark):
    rows = [(i, f"t{i} é😀漢 word\nline " * (i % 6)) for i in range(150)]
    rows += [(None, "no key"), (None, None), (5, None), (6, ""), (7, "x"), (7, "x"), (7, "y"), (8, "a<P>b"), (9, "<M>"), (10, "<<S"), (11, "P><S" * 3), (12, "é" * 70_000), (13, "a\x00b"), *((1000 + i, "the same text") for i in range(700))]
    out = fim.transform(docs(spark, rows), keep=["doc_id", "n", "form", "output"]).collect()
    got = Counter((r.doc_id, r.n, r.form, r.output, r._n, r._form, r.prefix_units, r.middle_units, r._output) for r in out)
    want = Counter((i, "a", "b", "c", len(t or ""), *plainly(i, t)) for i, t in rows)
    assert got == want
    assert {r._form for r in out} == {"plain", "psm", "spm"}
    assert fim.transform(docs(spark, [])).collect() == []


def test_copies_share_rows_of_the_index_up_to_a_bound(spark):
    rows = [(i, "hot") for i in range(1000)] + [(i, f"text {i % 40}") for i in range(120)]
    found = fim.index(docs(spark, rows), keep=["doc_id"], members=100).collect()
    sizes = [len(r.members) for r in found if r.body == "hot"]
    assert sum(sizes) == 1000 and len(sizes) > 5 and max(sizes) < 200
    assert Counter(r.body for r in found if r.body != "hot") == Counter({f"text {i}": 1 for i in range(40)})


def test_restoring_seeds_and_words(spark):
    rows = [(i, f"one two {i}  three\nfour " * (1 + i % 4) + "<") for i in range(80)]
    indexed = fim.index(docs(spark, rows), keep=["doc_id"], unit="word")
    seen = {}
    for seed in (1, 2):
        out = fim.cut(indexed, seed=seed).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
        assert {(r.doc_id, r.back) for r in out} == set(rows)
        for r in out:
            if r.form == "psm" and 0 < r.prefix_units:
                prefix = r.output[3 : r.output.index("<S>")]
                assert len(prefix.split()) == r.prefix_units
        seen[seed] = {(r.doc_id, r.output) for r in out}
    assert seen[1] != seen[2]


def test_whole_table(spark, small, same_as_sql):
    assert same_as_sql(queries.op11_fim, queries.ORACLE["op11_fim"]) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert all(r.restored_sha256 and r.output_sha256 for r in queries.op11_fim(spark, small).collect())
