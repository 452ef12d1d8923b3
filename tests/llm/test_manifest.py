"""Merkle manifests: traversals, proofs and verification against trees built in plain Python."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from lotmark.llm import manifest, queries
from pyspark.sql import functions as F


def digest(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def levels(leaves: list[bytes], height: int | None = None) -> list[list[bytes]]:
    out = [leaves]
    while len(out[-1]) > 1 if height is None else len(out) <= height:
        out.append([digest(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree: list[list[bytes]], at: int) -> list[tuple[bytes, bytes]]:
    path = []
    for row in tree[:-1]:
        first = at - at % 3
        path.append((b"".join(row[first:at]), b"".join(row[at + 1 : first + 3])))
        at //= 3
    return path


def made(values: list) -> bytes:
    return digest(*[b"-" if v is None else f"{len(str(v).encode())}:{v}".encode() for v in values])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80, 81, 82, 100, 243, 244, 300, 728, 729])
def test_traversal(n):
    leaves = [digest(str(i).encode()) for i in range(n)]
    tree = levels(leaves)
    assert list(manifest.traversal(leaves, len(tree) - 1)) == [siblings(tree, i) for i in range(n)]
    high = levels(leaves, 6)
    assert list(manifest.traversal(leaves, 6)) == [siblings(high, i) for i in range(n)]


def test_a_traversal_holds_few_nodes(monkeypatch):
    leaves = [digest(str(i).encode()) for i in range(729)]
    kept, most = [], 0
    make = manifest.Subtree.__init__
    monkeypatch.setattr(manifest.Subtree, "__init__", lambda self, base: (make(self, base), kept.append(self))[0])
    for _ in manifest.traversal(leaves, 6):
        del kept[:-6]
        most = max(most, sum(sum(map(len, t.levels)) + sum(map(len, t.open)) for t in kept))
    assert most < 6 * (9 + 3 + 12)


def proven(rows):
    """(key, group, leaf, presented) -> for each row (key, leaf, subroot, root, proof, folded)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3]))
        trees[g] = levels([r[2] for r in groups[g]])
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (key, _, leaf, shown) in enumerate(groups[g]):
            path = siblings(trees[g], i) + siblings(top, k)
            at = shown
            for left, right in path:
                at = digest(left, at, right)
            out.append(tuple(x.decode() if isinstance(x, bytes) else x for x in (key, leaf, trees[g][-1][0], top[-1][0], b"".join(a + b for a, b in path), at)))
    return out


def run(spark, rows):
    frame = spark.createDataFrame([(k, g, a.decode(), b.decode(), "x", "y") for k, g, a, b in rows], "doc_id long, source string, leaf string, presented string, root string, node string")
    return manifest.proofs(frame, keep=["doc_id", "root"]).collect()


@pytest.mark.parametrize("sizes", [[1], [1, 1], [3000, 1, 40], [730, 729, 728, 1, 2, 5], [5, 4, 3, 2, 1] * 9])
def test_proofs_against_plain_trees(spark, sizes):
    rows = []
    for g, n in enumerate(sizes):
        for i in range(n):
            leaf = digest(f"{g} {i}".encode())
            rows.append((i, [None, "é", "", "z", "Z"][g] if g < 5 else f"s{g}", leaf, digest(b"other") if i % 3 == 1 else leaf))
    got = run(spark, rows)
    assert Counter((r.doc_id, r.leaf, r.subroot, r._root, r.proof, r.folded) for r in got) == Counter(proven(rows))
    assert {r.root for r in got} == {"x"} and all(r.verified == (r.folded == r._root) for r in got)
    assert sum(not r.verified for r in got) == sum(a != b for _, _, a, b in rows)


def test_ties_nulls_and_empty(spark):
    same = digest(b"same")
    rows = [(None, "a", same, same)] * 5 + [(7, "a", same, same)] * 4 + [(7, "a", digest(b"x"), same), (None, None, same, digest(b"y"))]
    got = run(spark, rows)
    assert Counter((r.doc_id, r.leaf, r.subroot, r._root, r.proof, r.folded) for r in got) == Counter(proven(rows))
    assert run(spark, []) == []


def test_leaves_and_long_texts(spark):
    rows = [(1, "a", "text é"), (None, None, None), (-5, "", "x" * 300_000)]
    got = spark.createDataFrame(rows, "k long, s string, t string").select(manifest.leaf(F.col("k"), F.col("s"), F.col("t")).alias("leaf")).collect()
    assert [r.leaf.encode() for r in got] == [made(list(r)) for r in rows]


def test_whole_table(spark, small, same_as_sql):
    assert same_as_sql(queries.op13_manifest, queries.ORACLE["op13_manifest"]) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert {r.verified for r in queries.op13_manifest(spark, small).collect()} == {True, False}
