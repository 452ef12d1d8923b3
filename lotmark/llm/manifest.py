"""A Merkle manifest of a dataset: one tree per group of rows, a tree of the groups' roots, and a proof for every row.

Rows stand in order within their group; every FANOUT consecutive nodes become one, until one is left. Nodes below the
roots of aligned blocks never leave their task: a traversal of the block holds, for every STEP levels, the subtree
that the current row is in and the one that comes next, which it builds a row at a time, and so emits one
authentication path after the other. Above the blocks, levels are grouped and joined as tables, and their part of a
path is made once a block and appended.

Digests are lowercase hexadecimal texts, and a node is the SHA-256 of those of its children put together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotmark.llm import common

FANOUT = 3
#: Levels of a subtree, and of a block.
STEP, HEIGHT = 2, 6
BLOCK = FANOUT**HEIGHT
#: Blocks whose upper proofs, of some 2 KB each, may be broadcast; more are joined by a shuffle.
BROADCAST = 20_000


def leaf(*columns: Column) -> Column:
    """The digest of a row: of each value its UTF-8 bytes, a colon and the value, or a hyphen if it is null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _hash(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


class Subtree:
    """STEP levels of nodes, the lowest of them `base` levels above the leaves, built from one leaf after the other. Below and in
    them it holds only the children of nodes that aren't complete."""

    def __init__(self, base: int):
        self.base, self.top = base, base + STEP - 1
        self.levels: list[list[bytes]] = [[] for _ in range(STEP)]
        self.open: list[list[bytes]] = [[] for _ in range(self.top)]

    def feed(self, digest: bytes) -> None:
        for height in range(self.top + 1):
            if height >= self.base:
                self.levels[height - self.base].append(digest)
            if height == self.top:
                return
            run = self.open[height]
            run.append(digest)
            if len(run) < FANOUT:
                return
            digest = _hash(*run)
            run.clear()

    def close(self) -> None:
        """No leaf follows: runs that aren't full become nodes too."""
        for height, run in enumerate(self.open):
            if run:
                digest = _hash(*run)
                run.clear()
                if height + 1 >= self.base:
                    self.levels[height + 1 - self.base].append(digest)
                if height + 1 < self.top:
                    self.open[height + 1].append(digest)


def traversal(leaves: Sequence[bytes], height: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """For each leaf of a block in turn, its siblings on `height` levels from the leaves up: those to its left, and to its right.

    Beside the leaves it holds two subtrees for every STEP levels: the leaf's, and the next, which takes one of its leaves a turn.
    """
    n, spans = len(leaves), [FANOUT ** (STEP * (i + 1)) for i in range(-(-height // STEP))]
    here, coming = [Subtree(STEP * i) for i in range(len(spans))], [Subtree(STEP * i) for i in range(len(spans))]
    for tree, span in zip(here, spans, strict=True):
        for digest in leaves[:span]:
            tree.feed(digest)
        if n <= span:
            tree.close()
    for at in range(n):
        for i, span in enumerate(spans):
            if at and at % span == 0:
                here[i], coming[i] = coming[i], Subtree(STEP * i)
        path = []
        for k in range(height):
            row = here[k // STEP].levels[k % STEP]
            node = at // FANOUT**k % FANOUT ** (STEP - k % STEP)
            first = node - node % FANOUT
            path.append((b"".join(row[first:node]), b"".join(row[node + 1 : first + FANOUT])))
        yield path
        for tree, span in zip(coming, spans, strict=True):
            if at + span < n:
                tree.feed(leaves[at + span])
                if at + span == n - 1:
                    tree.close()


def _up(nodes: DataFrame) -> DataFrame:
    """The level above nodes: (tree, node, width, run, digest), where run has the children's digests in order."""
    child = nodes.select("tree", "width", F.expr(f"node div {FANOUT}").alias("up"), F.struct("node", "digest").alias("child"))
    runs = child.groupBy("tree", "width", "up").agg(F.array_sort(F.collect_list("child"))["digest"].alias("run"))
    width = F.ceil(F.col("width") / FANOUT)
    return runs.select("tree", F.col("up").alias("node"), width.alias("width"), "run", F.sha2(F.array_join("run", ""), 256).alias("digest"))


def _path(own: Column, run: Column) -> Column:
    """A level of a path as (left, right), for the node at place `own` of a run."""
    return F.struct(F.array_join(F.slice(run, F.lit(1), own), "").alias("left"), F.array_join(F.slice(run, own + 2, F.lit(FANOUT)), "").alias("right"))


def joined(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The roots (tree, digest) of trees whose lowest nodes are (tree, node, digest), node counting from 0, and the path
    (tree, node, path) of each of these: an array of (left, right), from the lowest level up.

    Each level is a grouping of the one below; each step down a join with the level above. A tree of one node is its own root.
    """
    width = nodes.groupBy("tree").agg(F.count("*").alias("width"))
    level = common.checkpoint(nodes.join(width, "tree"))
    most = level.agg(F.max("width")).first()[0] or 0
    levels, roots = [], level.where("width = 1").select("tree", "digest", "node")
    while most > 1:
        level = level.where("width > 1")
        runs = common.checkpoint(_up(level))
        levels.append((level, runs))
        level, most = runs.select("tree", "node", "digest", "width"), -(-most // FANOUT)
        roots = roots.unionByName(level.where("width = 1").select("tree", "digest", "node"))
    none = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    paths = roots.select("tree", "node", none.alias("path"))
    for below, runs in reversed(levels):
        # a node's parent has its run, and the path of the parent what follows; parents have three children at most
        above = runs.select("tree", "node", "run").join(paths, ["tree", "node"]).withColumnRenamed("node", "up").withColumnRenamed("path", "rest")
        found = below.select("tree", "node", F.expr(f"node div {FANOUT}").alias("up")).join(above, ["tree", "up"])
        own = F.expr(f"int(node % {FANOUT})")
        down = found.select("tree", "node", F.concat(F.array(_path(own, F.col("run"))), F.col("rest")).alias("path"))
        alone = roots.join(below.select("tree").distinct(), "tree", "left_anti").select("tree", "node", none.alias("path"))
        paths = common.checkpoint(down.unionByName(alone))
    return roots.select("tree", "digest"), paths


def _reduced(leaves: str, tall: str) -> str:
    """SQL for the root of a block's leaves: HEIGHT levels if its tree goes on above it, else until one node is left."""
    out = leaves
    for _ in range(HEIGHT):
        up = f"transform(sequence(0, (size(x) - 1) div {FANOUT}), i -> sha2(array_join(slice(x, i * {FANOUT} + 1, {FANOUT}), ''), 256))"
        out = f"transform(array({out}), x -> if({tall} or size(x) > 1, {up}, x))[0]"
    return f"({out})[0]"


def proofs(leaves: DataFrame, group: str = "source", order: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """One row per row of leaves, which has the columns group, order, leaf and, if it differs from leaf where a copy of the data is
    to be verified, presented: the columns `keep` (the order alone, if None), leaf, subroot, root, proof (the siblings' digests from the leaf up to
    the root, put together), folded (the root that presented gives with these siblings) and verified (whether it is the root).

    Groups stand in order of their values, bytewise, the null group first; a group's rows in that of `order`, nulls first,
    then of their digests, so equal rows are as many leaves. One row's root is its leaf. An empty table gives an empty result.
    """
    keep = [order] if keep is None else keep
    if "presented" not in leaves.columns:
        leaves = leaves.withColumn("presented", F.col("leaf"))
    rows = leaves.select(F.col(group).alias("_group"), F.col(order).alias("_order"), "leaf", "presented", F.struct(*keep).alias("_keep"))
    groups = rows.groupBy("_group").agg(F.count("*").alias("size")).withColumn("all", F.lit(0))
    groups = common.checkpoint(common.running(groups, ["all"], [F.col("_group").asc_nulls_first()]).select("_group", "size", F.col("rank").alias("tree")))
    numbered = rows.join(common.small(groups), rows["_group"].eqNullSafe(groups["_group"])).select("tree", "size", "_order", "leaf", "presented", "_keep")
    placed = common.running(numbered, ["tree"], [F.col("_order").asc_nulls_first(), "leaf", "presented"])
    placed = placed.select("tree", F.expr(f"rank div {BLOCK}").alias("node"), F.expr(f"int(rank % {BLOCK})").alias("at"), "size", "leaf", "presented", "_keep")
    placed = common.checkpoint(placed)

    blocks = placed.groupBy("tree", "node", "size").agg(F.array_sort(F.collect_list(F.struct("at", "leaf")))["leaf"].alias("leaves"))
    blocks = blocks.select("tree", "node", F.expr(_reduced("leaves", f"size > {BLOCK}")).alias("digest"))
    subroots, paths = joined(common.checkpoint(blocks))
    # stored first: with a constant for a key, joins on it would be nested loops
    tops, over = joined(common.checkpoint(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("node"), "digest")))
    top = tops.first()
    subroots = subroots.join(over.select(F.col("node").alias("tree"), F.col("path").alias("over")), "tree").withColumnRenamed("digest", "subroot")
    above = common.checkpoint(paths.join(subroots, "tree").select("tree", "node", F.concat("path", "over").alias("path"), "subroot"))

    names = ["tree", "node", "size", "_keep", "leaf", "presented"]
    schema = placed.select(*names).schema.add("near", "string").add("folded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.grouped(batches, ["tree", "node"]):
            block = block.combine_chunks()
            size = block.column("size")[0].as_py()
            digests = [d.encode() for d in block.column("leaf").to_pylist()]
            height = HEIGHT if size > BLOCK else sum(size > FANOUT**k for k in range(HEIGHT))
            near, folded = [], []
            for path, shown in zip(traversal(digests, height), block.column("presented").to_pylist(), strict=True):
                at = shown.encode()
                for left, right in path:
                    at = _hash(left, at, right)
                near.append(b"".join(left + right for left, right in path).decode())
                folded.append(at.decode())
            columns = [block.column(c).combine_chunks() for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(near, pa.string()), pa.array(folded, pa.string())], names=[*names, "near", "folded"])

    common.small_batches(leaves.sparkSession)
    emitted = placed.repartition("tree", "node").sortWithinPartitions("tree", "node", "at").select(*names).mapInArrow(run, schema)
    whole = emitted.join(common.small(above, BROADCAST), ["tree", "node"])
    folded = F.expr("aggregate(path, folded, (a, p) -> sha2(concat(p.left, a, p.right), 256))")
    taken = {c: common.free(c, keep) for c in ("leaf", "subroot", "root", "proof", "folded", "verified")}
    root = F.lit(top.digest if top else None).cast("string")
    far = F.expr("array_join(transform(path, p -> concat(p.left, p.right)), '')")
    out = whole.select("_keep.*", F.col("leaf").alias("_leaf"), "subroot", F.concat("near", far).alias("_proof"), folded.alias("_folded"))
    return out.select(
        *keep,
        F.col("_leaf").alias(taken["leaf"]),
        F.col("subroot").alias(taken["subroot"]),
        root.alias(taken["root"]),
        F.col("_proof").alias(taken["proof"]),
        F.col("_folded").alias(taken["folded"]),
        (F.col("_folded") == root).alias(taken["verified"]),
    )
