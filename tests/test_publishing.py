"""Published versions, arrays in pieces, patterns and frequent sets."""

from __future__ import annotations

import json
import random
from collections import Counter
from itertools import combinations, product

import pytest

from lotmark.operators import cooccurrence, patterns
from lotmark.operators.patterns import Step
from lotmark.sources import arrays, catalog
from pyspark.sql import functions as F


def counts(spark, root, name="default"):
    at = catalog.current(spark, root, name)
    return at.number, {t: spark.read.parquet(f"{at.folder}/{t}.parquet").count() for t in at.tables}


def test_a_failure_leaves_the_version_before(spark, tmp_path):
    root = str(tmp_path)
    catalog.publish(spark, root, "default", {"a": spark.range(3), "b": spark.range(4)})
    broken = spark.range(5).withColumn("x", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        catalog.publish(spark, root, "default", {"a": spark.range(9), "b": broken})
    assert counts(spark, root) == (1, {"a": 3, "b": 4})
    assert len(list((tmp_path / "default" / "versions").iterdir())) == 1
    catalog.publish(spark, root, "default", {"a": spark.range(7)}, after=1)
    assert counts(spark, root) == (2, {"a": 7})
    assert [v.number for v in catalog.versions(spark, root)] == [1, 2] and catalog.cleaned(spark, root, "default", keep=1) == 1
    assert counts(spark, root) == (2, {"a": 7}) and catalog.listed(spark, root) == ["default"]


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    catalog.publish(spark, root, "default", {"a": spark.range(1)})
    claimed = catalog._claimed

    def late(session, path, content):
        monkeypatch.setattr(catalog, "_claimed", claimed)
        catalog.publish(session, root, "default", {"a": spark.range(2)})  # another writer, just before
        return claimed(session, path, content)

    monkeypatch.setattr(catalog, "_claimed", late)
    with pytest.raises(catalog.Conflict):
        catalog.publish(spark, root, "default", {"a": spark.range(9)})
    assert counts(spark, root) == (2, {"a": 2})
    with pytest.raises(catalog.Conflict):
        catalog.publish(spark, root, "default", {"a": spark.range(9)}, after=1)
    with pytest.raises(catalog.Conflict):
        catalog.create(root, "default", {"a": spark.range(9)})
    assert not [p for p in (tmp_path / "default").rglob("*.pending")]


def test_small_files_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "x.json")
    for content in ("first", "zweite é", ""):
        catalog.replaced(spark, path, content)
        assert catalog._read(spark, path) == content
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["x.json"]


def thing(r, depth=0):
    kind = r.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return r.choice(["", "}", "{[", 'a"b}', "\\", '\\"}', "é😀}", "]},{", "\n}", 'x\\\\"'])
    if kind < 4:
        return r.choice([1, -2.5, None, True, "plain text"])
    if kind == 4:
        return [thing(r, depth + 1) for _ in range(r.randrange(4))]
    return {r.choice(["k", "}", '"', "é"]) + str(i): thing(r, depth + 1) for i in range(r.randrange(4))}


@pytest.mark.parametrize("size", ["16b", "97b", "4k", "128m"])
def test_arrays_in_pieces(spark, tmp_path, size):
    r = random.Random(size)
    want = {}
    for n, indent in enumerate((None, 2, None, None)):
        rows = [{"id": i, "v": thing(r)} for i in range((40, 25, 1, 0)[n])]
        (tmp_path / f"{n}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=n != 0), encoding="utf-8")
        want |= {(f"{n}.json", i): x for i, x in enumerate(rows)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        found = arrays.elements(spark, str(tmp_path))
        got = {(x.file.rpartition("/")[2], x.element): json.loads(x.json) for x in found.collect()}
        pieces = arrays.pieces(spark, str(tmp_path))
        assert size != "16b" or pieces.select("file", "start").distinct().count() > 30
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want


@pytest.mark.parametrize("text", ['[{"a": 1}', '[{"a": 1', '[{"a": 1}] x', "[1, 2]", '[{"a": 1}, 2]', '[{"a": "1}]'])
def test_what_is_no_array_of_objects(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="not an array"):
        arrays.elements(spark, str(tmp_path)).collect()


def test_patterns_against_all_assignments(spark):
    r = random.Random(2)
    edges = [(f"n{r.randrange(8)}", f"n{r.randrange(8)}", r.choice("xyz")) for _ in range(60)]
    frame = spark.createDataFrame(edges, "source string, target string, relation string")
    cases = [
        ([Step("x", "a", "b")], ["a"]),
        ([Step("x", "a", "b"), Step("y", "b", "c")], ["a", "c"]),
        ([Step("x", "a", "b"), Step("y", "c", "b"), Step("z", "b", "d")], ["a", "b", "c", "d"]),
        ([Step("x", "a", "b"), Step("y", "b", "a")], ["a", "b"]),
        ([Step("x", "a", "b"), Step("y", "b", "c"), Step("z", "c", "d"), Step("x", "e", "d")], ["a", "e"]),
        ([Step("x", "a", "a")], ["a"]),
    ]
    some = {(s, t, rel) for s, t, rel in edges}
    for steps, keep in cases:
        if steps[0].start == steps[0].end:
            continue
        names = sorted({n for s in steps for n in (s.start, s.end)})
        want = set()
        for values in product([f"n{i}" for i in range(8)], repeat=len(names)):
            at = dict(zip(names, values, strict=True))
            if all((at[s.start], at[s.end], s.relation) in some for s in steps):
                want.add(tuple(at[k] for k in keep))
        got = [tuple(x) for x in patterns.matches(frame, steps, keep).collect()]
        assert len(got) == len(set(got)) and set(got) == want, steps
    fixed = patterns.matches(frame, cases[1][0], ["a", "c"], where={"a": ["n1", "n2"]}, only=lambda: F.col("a") < F.col("c")).collect()
    every = {tuple(x) for x in patterns.matches(frame, *cases[1]).collect()}
    assert {tuple(x) for x in fixed} == {(a, c) for a, c in every if a in ("n1", "n2") and a < c}


def test_patterns_that_cannot_be_reduced_and_dead_ends(spark):
    with pytest.raises(ValueError, match="cycle"):
        patterns.tree([Step("x", "a", "b"), Step("x", "b", "c"), Step("x", "c", "a")])
    with pytest.raises(ValueError, match="connected"):
        patterns.tree([Step("x", "a", "b"), Step("x", "c", "d")])
    edges = [("hub", f"d{i}", "x") for i in range(500)] + [("hub", "m", "x"), ("m", "end", "y"), ("o", "p", "y")]
    tables = patterns.reduced(spark.createDataFrame(edges, "source string, target string, relation string"), [Step("x", "a", "b"), Step("y", "b", "c")])
    assert [t.count() for t in tables] == [1, 1]


def test_frequent_sets(spark):
    r = random.Random(6)
    baskets = {b: r.sample(range(30), r.randrange(1, 9)) for b in range(60)} | {99: list(range(30))}
    rows = [(b, m) for b, ms in baskets.items() for m in ms] * 2 + [(None, 1), (3, None)]
    frame = spark.createDataFrame(rows, "basket long, member long")
    for k, name in ((2, "ab"), (3, "abc")):
        want = Counter(s for ms in baskets.values() for s in combinations(sorted(ms), k))
        got = cooccurrence.pairs(frame, 3)[0] if k == 2 else cooccurrence.triples(frame, 3)
        assert {tuple(x[c] for c in name): x.support for x in got.collect()} == {s: n for s, n in want.items() if n >= 3}
    distinct = frame.dropna().distinct()
    small, large = ({tuple(x) for x in cooccurrence.meetings(distinct, block).collect()} for block in (4, 1000))
    assert small == large and cooccurrence.meetings(distinct, 4).count() == len(large)
