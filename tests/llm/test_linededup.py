"""Line dedup against windows counted in Python."""

from __future__ import annotations

import random
from collections import Counter

from lotmark.llm import linededup

SCHEMA = "doc_id long, text string, n_chars long, n_lines string, gone string, starts string"


def brute(rows: list[tuple]) -> Counter:
    """(doc_id, text) after the removal; rows: (doc_id, text), where equal rows are one document."""
    seen, covered = set(), {}
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    for doc in order:
        lines = doc[1].split("\n")
        for i in range(len(lines) - 2):
            run = tuple(lines[i : i + 3])
            if all(not x.strip(" ") for x in run):
                continue
            if run in seen:
                covered.setdefault(doc, set()).update((i, i + 1, i + 2))
            seen.add(run)
    return Counter((i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in covered.get((i, t), ()))) for i, t in rows)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), "a", "b", "c") for i, t in rows], SCHEMA)


def test_random_documents(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice(["", "x", "yy", " ", "long line", "z"]) for _ in range(rng.randrange(0, 14)))) for i in range(150)]
    out = linededup.dedup_lines(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.text) for r in out) == brute(rows)
    assert all(r.n_chars == len(r.text) for r in out)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a\nb"), (4, "a\nb\nc"), (5, "a\nb\nc\nd"), (6, "\n\n\n\n"), (7, "\n\n\n\n"), (None, "q\nr\ns"), (8, "q\nr\ns"), (9, "a\r\nb\r\nc"), (10, "\n".join(["k"] * 5000)), (4, "a\nb\nc")]
    out = linededup.dedup_lines(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.text) for r in out) == brute(rows)
    n = {r.doc_id: (r.n_lines, r.n_removed) for r in out}
    assert n[1] == (0, 0) and n[2] == (1, 0) and n[10] == (5000, 4999) and n[8] == (3, 3)


def test_overlapping_windows_are_merged(spark):
    passage = "one\ntwo\nthree\nfour\nfive"
    out = {r.doc_id: r for r in linededup.dedup_lines(frame(spark, [(1, f"x\n{passage}\ny"), (2, f"p\n{passage}\nq")])).collect()}
    assert out[1].n_removed == 0 and out[2].n_removed == 5 and out[2].text == "p\nq"


def test_other_columns_pass_and_empty(spark):
    docs = frame(spark, [(1, "a\nb\nc")])
    out = linededup.dedup_lines(docs.drop("n_lines"))
    assert out.columns == ["doc_id", "text", "n_chars", "gone", "starts", "n_lines", "n_removed"]
    row = out.first()
    assert (row.gone, row.starts) == ("b", "c")
    assert linededup.dedup_lines(frame(spark, []).drop("n_lines")).collect() == []
