"""Fixity audits: damage is located, and only damage."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from lotmark.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, file string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", "f", "r") for r in rows], SCHEMA)


PAGES = [(i, f"http://h/{i}", f"<p>{'x' * (i % 50)}</p>") for i in range(2500)]


@pytest.fixture(scope="module")
def ours(spark):
    return warc.layout(frame(spark, PAGES))


def test_layout(ours):
    rows = sorted(ours.collect(), key=lambda r: (r.file, r.record))
    assert [r.page_id for r in rows] == list(range(2500))
    end = 0
    for r in rows:
        end = 0 if r.record == 0 else end
        assert r.offset == end
        end += r.length
    page = PAGES[7]
    made = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:7>\r\nWARC-Target-URI: {page[1]}\r\nContent-Type: text/html\r\nContent-Length: {len(page[2])}\r\n\r\n{page[2]}\r\n\r\n".encode()
    assert (rows[7].digest, rows[7].length) == (hashlib.sha256(made).hexdigest(), len(made))


def test_equal_replicas_differ_nowhere(ours):
    assert warc.audit(ours, ours).collect() == []


def test_damage_is_located(spark, ours):
    wrong = {3, 1023, 1024, 2047, 2499}
    theirs = warc.layout(frame(spark, [(i, u, "#" + h[1:] if i in wrong else h) for i, u, h in PAGES]))
    out = warc.audit(ours, theirs).collect()
    assert {r.page_id for r in out} == wrong and all(r.digest != r.their_digest for r in out)


def test_damage_that_changes_lengths_moves_what_follows(spark, ours):
    theirs = warc.layout(frame(spark, [(i, u, h + "!" if i == 2400 else h) for i, u, h in PAGES]))
    assert {r.page_id for r in warc.audit(ours, theirs).collect()} == set(range(2400, 2500))


def test_lost_records(spark, ours):
    theirs = warc.layout(frame(spark, PAGES[:-2]))
    out = warc.audit(ours, theirs).collect()
    assert {r.page_id for r in out} == {2498, 2499} and all(r.their_digest is None and r.offset is not None for r in out)


def test_nulls_empty_long_and_repeated(spark):
    rows = [(None, None, None), (1, None, ""), (1, None, ""), (2, "u", None), (3, "é", "é" * 50_000)]
    a = warc.layout(frame(spark, rows))
    assert a.count() == 5 and warc.audit(a, warc.layout(frame(spark, rows[::-1]))).collect() == []
    none = warc.layout(frame(spark, []))
    assert none.collect() == [] and warc.audit(none, none).collect() == []
    assert {r.digest is None for r in warc.audit(none, a).collect()} == {True}


def test_roots_depend_on_order(spark):
    a = warc.layout(frame(spark, [(1, "u", "a"), (2, "u", "b")]))
    b = a.withColumn("record", 1 - F.col("record"))
    assert warc.tree(a)[-1].first().digest != warc.tree(b)[-1].first().digest
