"""Near duplicates of documents against intersections of all pairs of shingle sets."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from lotmark.llm import minhash, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bands string, node string, cluster int"
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingles(text: str | None) -> set:
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs: dict[int, str | None], percent: int = 80) -> tuple[dict, dict]:
    sets = {i: shingles(t) for i, t in docs.items()}
    group = {i: i for i in docs}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    x, y = sorted((find(i), find(j)))
                    group[y] = x
    return {i: len(s) for i, s in sets.items()}, {i: find(i) for i in docs}


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", 0, "", "", 1) for i, t in docs], SCHEMA)


def check(out, docs: dict, percent: int = 80) -> None:
    sizes, component = brute(docs, percent)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out} == {(i, sizes[i], component[i], component[i] == i) for i in docs}


def made(seed: int, groups: int, most: int, length: int) -> dict[int, str]:
    rng, docs = random.Random(seed), {}
    for _ in range(groups):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(length // 2, length))]
        for _ in range(rng.randrange(1, most)):
            copy = list(words)
            for _ in range(rng.randrange(0, max(2, length // 40))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            docs[len(docs)] = " ".join(copy)
    return docs


def test_near_copies(spark):
    docs = made(1, 40, 8, 200)
    check(minhash.near_duplicates(frame(spark, docs.items())).collect(), docs)


def test_large_group_spans_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    docs = made(2, 3, 90, 160)
    check(minhash.near_duplicates(frame(spark, docs.items())).collect(), docs)


def test_edge_texts(spark):
    texts = [None, "", " \t\n", "one", "One", "ONE ", "a b", "b a", "a b c d", "a b c d e", "A  B\nC d e", "É é é é é", "é é é é é", "x " * 30_000, "x " * 20_000, "a\xa0b c d e f"]
    docs = dict(enumerate(texts))
    check(minhash.near_duplicates(frame(spark, docs.items())).collect(), docs)


def test_repeated_rows_and_null_ids(spark):
    out = minhash.near_duplicates(frame(spark, [(5, "a b c d e f")] * 2 + [(5, "other words in this text here"), (3, "a b c d e f"), (None, "a b c d e f"), (None, None)])).collect()
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in out), key=str)
    assert len(out) == 6 and got.count((None, None, True)) == 2 and got.count((3, 3, True)) == 1
    assert all(r.component_id == 3 for r in out if r.doc_id == 5 and r.n_shingles == 2 and not r.kept)


def test_copies_of_a_row_leave_one(spark):
    rows = [(5, "a b c d e f g")] * 40 + [(7, "a b c d e f g"), (5, "quite another text of seven words"), (None, "x y z"), (None, "x y z")]
    kept = sorted(((r.doc_id, r.text) for r in minhash.keep_one(frame(spark, rows)).collect()), key=str)
    assert kept == sorted([(5, "a b c d e f g"), (5, "quite another text of seven words"), (None, "x y z"), (None, "x y z")], key=str)


def test_ids_of_another_type(spark):
    texts = {"b": "one two three four five six", "a": "one two three four five six", "c": "something else altogether in here now"}
    out = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in out} == {("a", "a", True), ("b", "a", False), ("c", "c", True)}


def test_chains_whose_ends_are_unlike(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 4)
    words = [f"w{i}" for i in range(200)]
    docs = {i: " ".join(words[i * 6 : i * 6 + 120]) for i in range(12)}  # neighbours are alike, ends aren't
    _, component = brute(docs)
    out = minhash.near_duplicates(frame(spark, docs.items())).collect()
    assert set(component.values()) == {0} and {r.component_id for r in out} == {0}


def test_empty_table(spark):
    assert minhash.near_duplicates(frame(spark, [])).collect() == []
    assert minhash.keep_one(frame(spark, [])).collect() == []


def test_keep_one_keeps_the_smallest_and_all_columns(spark):
    docs = made(3, 12, 6, 150) | {900: None, 901: ""}
    kept = minhash.keep_one(frame(spark, docs.items()))
    assert kept.columns == frame(spark, []).columns
    _, component = brute(docs)
    assert {r.doc_id for r in kept.collect()} == {i for i in docs if component[i] == i}


@pytest.mark.parametrize("percent", [85, 100])
def test_other_limits(spark, percent):
    docs = made(4, 10, 5, 120)
    _, component = brute(docs, percent)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, docs.items()), percent).collect()} == component


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_at_the_limit_are_found(spark, percent):
    # k shingles of 5 words in common and n to each alone: similarity k / (k + 2n), at the limit or just above
    k, n = {80: (120, 15), 85: (119, 10)}[percent]
    rng, docs = random.Random(5), {}
    for i in range(2000):
        words = [f"w{rng.randrange(50_000)}" for _ in range(k + 4)]
        docs[2 * i], docs[2 * i + 1] = (" ".join(words + [f"{side}{rng.randrange(50_000)}" for _ in range(n)]) for side in "xy")
    component = {}
    for i in range(0, 4000, 2):  # random words make no document like another pair's
        component |= brute({i: docs[i], i + 1: docs[i + 1]}, percent)[1]
    assert len(set(component.values())) == 2000
    out = minhash.near_duplicates(frame(spark, docs.items()), percent).collect()
    missed = sum(r.component_id != component[r.doc_id] for r in out)
    assert missed <= 0.004 * 2000


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    jumps = minhash.densifiers(minhash.BINS, 4096)
    agree = []
    for _ in range(60):
        base = rng.integers(0, 1 << 63, size=40, dtype=np.uint64)
        a, b = np.unique(base[:36]), np.unique(base[4:])
        s = minhash.signatures([a, b], minhash.BINS, jumps)
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - 32 / 40) < 0.05


def test_whole_table(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    check(queries.op9_minhash(spark, small).collect(), docs, 85)
