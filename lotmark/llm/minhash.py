"""Near duplicates of documents: one-permutation MinHash with optimal densification, and exact confirmation.

1. A pass over the texts makes each document's set of hashed word shingles, its densified signature, and
   from that the keys of the bands. Only these leave the task.
2. Documents with equal sets fall into one class, so any number of copies costs one row from here on.
3. Classes that meet in a band's bucket get star-shaped candidate edges: each to the bucket's hub, its smallest.
   A bucket of n gives n - 1 edges. All of them are confirmed on full sets, a hub against blocks of its
   members. In most buckets that connects everybody, and they are done.
4. In the others, what the hub's component lacks is compared with all of the bucket: members are cut into
   blocks, and pairs of blocks that hold such a member, and whose sizes allow a link, are compared in a task as
   matrix products. A task returns one edge a member at most: to the smallest that it reaches in there.
   Buckets with the same members are compared once.
5. Components of the confirmed edges are the result.

So any two documents that share a bucket are compared on full sets or known to be connected, and nothing is
dropped in a large bucket; documents that only third ones bring together are not compared. A pair at similarity s shares a bucket with probability
1 - (1 - s^rows)^bands, for the bands of the limit: 18 of 7 rows at 0.85, which gives 0.999; 21 of 6 rows
at 0.80, which gives 0.998.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotmark.llm import common

SHINGLE = 5
ROWS = 7
BANDS = 18
BINS = ROWS * BANDS
#: The limit of similarity, unless a call names another.
PERCENT = 80
#: The least probability with which a pair at the limit shares a bucket.
FOUND = 0.998
#: Members of a block and the shingles they hold together, about.
BLOCK_ROWS = 512
BLOCK_SHINGLES = 400_000
#: Words whose hashes a task remembers.
CACHE = 200_000

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word) >> 1
        return h


def shingle_sets(texts: list[str | None], size: int, cache: WordHashes) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles; empty for no words."""
    out = []
    for text in texts:
        # ASCII letters are lowered and ASCII white space splits: bytes do just that
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        n = len(words)
        if not n:
            out.append(np.empty(0, dtype=np.uint64))
            continue
        w = np.fromiter(map(cache.__getitem__, words), dtype=np.int64, count=n).astype(np.uint64)
        k = min(n, size)
        h = np.full(n - k + 1, k, dtype=np.uint64)
        for i in range(k):
            h = mix(h * _M2 + w[i : n - k + 1 + i])
        out.append(np.unique(h))
    return out


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows) for a limit: the longest bands, of ROWS at most, that find pairs at the limit with FOUND."""
    for rows in range(ROWS, 1, -1):
        bands = BINS // rows
        if 1 - (1 - (percent / 100) ** rows) ** bands >= FOUND:
            return bands, rows
    return BINS, 1


def densifiers(bins: int, attempts: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, bins, size=(attempts, bins))


def signatures(sets: list[np.ndarray], bins: int, jumps: np.ndarray) -> np.ndarray:
    """Rows of bins: the smallest hash in each bin; an empty bin copies one that a hash of its number chooses."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full((len(sets), bins), none, dtype=np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            at = ((s >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)  # sorted, as s is
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            sig[i, at[first].astype(np.int64)] = s[first]
    full = sig != none
    rows, cols = np.nonzero(~full & full.any(axis=1)[:, None])
    for jump in jumps:
        if not len(rows):
            break
        source = jump[cols]
        ok = full[rows, source]
        sig[rows[ok], cols[ok]] = sig[rows[ok], source[ok]]
        rows, cols = rows[~ok], cols[~ok]
    for r, c in zip(rows, cols, strict=True):  # hardly ever: no attempt hit a full bin
        at = np.flatnonzero(full[r])
        sig[r, c] = sig[r, at[np.searchsorted(at, c) % len(at)]]
    return sig


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, n_shingles, h1, h2, bands): h1 and h2 are hashes of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, jumps = WordHashes(), densifiers(bands * rows, 4096)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            for part in common.chunks(batch):
                sets = shingle_sets(part.column("text").to_pylist(), size, cache)
                sig = signatures(sets, bands * rows, jumps).reshape(len(sets), bands, rows)
                keys = np.broadcast_to(salt, (len(sets), bands))
                for r in range(rows):
                    keys = mix(keys * _M1 + sig[:, :, r])
                h1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                h2 = np.array([np.bitwise_xor.reduce(mix(s ^ _STEP)) if len(s) else 0 for s in sets], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_hash"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(h1.view(np.int64)),
                        pa.array(h2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1).view(np.int64))),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "h1", "h2", "bands"],
                )

    common.small_batches(docs.sparkSession)
    narrow = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return narrow.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, n_shingles long, h1 long, h2 long, bands array<long>")


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Boolean matrix: 100 * intersection >= percent * union. right None: left against itself."""
    every = left + (right or [])
    sizes = np.array([len(s) for s in every])
    _, column, count = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(every)), sizes)
    shared = count[column] > 1  # others are in no intersection
    dense = np.cumsum(count > 1) - 1
    row, column = row[shared], dense[column[shared]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    n, width = len(every), max(1, 16_000_000 // len(every))
    a = len(left)
    common_n = np.zeros((a, n - a if right is not None else a), dtype=np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [start, start + width])
        x = np.zeros((n, min(width, int(column[-1]) + 1 - start)), dtype=np.float32)
        x[row[lo:hi], column[lo:hi] - start] = 1
        common_n += x[:a] @ (x[a:] if right is not None else x).T
    inter = common_n.astype(np.int64)
    union = sizes[:a, None] + (sizes[a:] if right is not None else sizes)[None, :] - inter
    return (100 * inter >= percent * union) & (union > 0)


def confirm_stars(dealt: DataFrame, percent: int, size: int = SHINGLE) -> DataFrame:
    """Edges (a, b) of links between a hub, b, and its members; dealt: (hub, block, node, text), sorted, with the hub in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for t in common.grouped(batches, ["hub", "block"]):
            node, hub = np.asarray(t.column("node")), int(t.column("hub")[0].as_py())
            sets = shingle_sets(t.column("text").to_pylist(), size, cache)
            centre = next((s for s, n in zip(sets, node, strict=True) if n == hub), np.empty(0, dtype=np.uint64))
            both = np.array([len(np.intersect1d(s, centre, assume_unique=True)) for s in sets])
            union = np.array([len(s) for s in sets]) + len(centre) - both
            hit = (node != hub) & (union > 0) & (100 * both >= percent * union)
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(np.full(int(hit.sum()), hub))], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def confirm(members: DataFrame, percent: int, size: int = SHINGLE) -> DataFrame:
    """Edges (a, b) of links inside each pair of blocks; members: (cluster, b1, b2, block, node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for t in common.grouped(batches, ["cluster", "b1", "b2"]):
            node = np.asarray(t.column("node"))
            by = np.argsort(node, kind="stable")
            node = node[by]
            sets = shingle_sets(t.column("text").take(pa.array(by)).to_pylist(), size, cache)
            block = np.asarray(t.column("block"))[by]
            b1, b2 = int(t.column("b1")[0].as_py()), int(t.column("b2")[0].as_py())
            if b1 == b2:
                links = linked(sets, None, percent)
            else:
                one, two = np.flatnonzero(block == b1), np.flatnonzero(block == b2)
                links = np.zeros((len(sets), len(sets)), dtype=bool)
                if len(one) and len(two):
                    m = linked([sets[i] for i in one], [sets[i] for i in two], percent)
                    links[np.ix_(one, two)] = m
                    links |= links.T
            root = common.local_roots(links)
            keep = node[root] != node
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(node[root][keep])], names=["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def in_blocks(members: DataFrame, within: str, order: list[str]) -> DataFrame:
    """members, which have n_shingles and node, with `block`: BLOCK_ROWS rows and about BLOCK_SHINGLES shingles each."""
    placed = common.running(members, [within], order, ("n_shingles",))
    return placed.withColumn("block", F.expr(f"rank div {BLOCK_ROWS} + n_shingles_before div {BLOCK_SHINGLES}")).drop("rank", "n_shingles_before")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, n_shingles, component_id, kept.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of shingles of five
    words; component_id is the smallest doc_id that links reach. A text of fewer words is one shingle.

    * Null or blank texts have an empty set and link with nothing. Rows with a null doc_id link with nothing,
      have a null component_id and are kept.
    * Repeated rows, and rows that share a doc_id, are one document with several rows: all get their rows.
    * An empty table gives an empty result; extra columns are ignored; documents of any length are hashed whole.
    """
    same_set = ["n_shingles", "h1", "h2"]
    sketches = common.checkpoint(sketch(docs, *banding(percent)))
    live = sketches.where("n_shingles > 0 and doc_id is not null")
    first = live.groupBy(*same_set).agg(F.min("doc_id").alias("first_id"))
    heads = live.join(first, same_set).where("doc_id = first_id").dropDuplicates(same_set)
    heads = common.checkpoint(heads.select(*same_set, "first_id", "text_hash", "bands").withColumn("node", F.monotonically_increasing_id()))
    buckets = heads.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    hubs = common.checkpoint(buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n"))
    met = common.checkpoint(buckets.join(hubs, "bucket"))
    wanted = common.checkpoint(met.select("node").distinct().join(heads.select("node", "first_id", "text_hash"), "node"))
    texts = docs.select(F.col("doc_id").alias("first_id"), "text", F.xxhash64("text").alias("text_hash"))
    texts = common.checkpoint(texts.join(common.small(wanted), ["first_id", "text_hash"]).select("node", "text").dropDuplicates(["node"]))
    # hubs against their members
    star = in_blocks(met.where("node <> hub").select("hub", "node", "n_shingles").distinct(), "hub", ["node"]).select("hub", "block", "node")
    star = common.checkpoint(star)
    sides = star.union(star.select("hub", "block", F.col("hub").alias("node")).distinct())
    dealt = sides.join(texts, "node").select("hub", "block", "node", "text").repartition(common.partitions(docs), "hub", "block")
    edges = common.checkpoint(confirm_stars(dealt.sortWithinPartitions("hub", "block"), percent))
    found = common.components(edges)
    # what the hub's component lacks, against all of the bucket
    state = met.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    main = F.max(F.when(F.col("node") == F.col("hub"), F.col("component")))
    mark = F.xxhash64("node")
    mixed = state.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.bit_xor(F.xxhash64(mark, F.lit(1))).alias("y"), F.min("component").alias("lo"), F.max("component").alias("hi"), main.alias("main"))
    mixed = common.checkpoint(mixed.where("lo < hi").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"), F.min("main").alias("main")).select("bucket", "main"))
    if not mixed.isEmpty():
        members = state.join(mixed, "bucket").select(F.col("bucket").alias("cluster"), (F.col("component") != F.col("main")).cast("int").alias("rest"), "n_shingles", "node")
        members = common.checkpoint(in_blocks(members, "cluster", ["rest", "n_shingles", "node"]))
        blocks = members.groupBy("cluster", "block").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"), F.max("rest").alias("rest"))
        one, two = blocks.alias("x"), blocks.alias("y")
        pairs = one.join(two, "cluster").where(f"x.block <= y.block and x.rest + y.rest > 0 and 100 * x.most >= {percent} * y.least and 100 * y.most >= {percent} * x.least")
        pairs = pairs.select("cluster", F.col("x.block").alias("b1"), F.col("y.block").alias("b2"))
        dealt = common.block_pairs(members.select("cluster", "node", "block"), ["cluster"], pairs).join(texts, "node")
        dealt = dealt.select("cluster", "b1", "b2", "block", "node", "text").repartition(common.partitions(docs), "cluster", "b1", "b2")
        more = confirm(dealt.sortWithinPartitions("cluster", "b1", "b2"), percent)
        found = common.components(found.toDF("a", "b").unionByName(more))
    placed = heads.select(*same_set, "node", "first_id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("first_id").alias("least_id"))
    placed = placed.join(least, "component").select(*same_set, "least_id")
    out = sketches.drop("bands").join(placed, same_set, "left")
    out = out.select("doc_id", "text_hash", "n_shingles", F.expr("if(n_shingles > 0 and doc_id is not null, least_id, doc_id)").alias("component_id"))
    return out.withColumn("kept", F.expr("doc_id <=> component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without the documents that near_duplicates() doesn't keep, with the same columns.

    Rows that are equal in doc_id and text are one document, of which one row stays; rows with a null doc_id all stay.
    """
    id_, hash_ = (common.free(c, docs.columns) for c in ("_id", "_hash"))
    found = near_duplicates(docs, percent).where("doc_id is not null").groupBy("doc_id", "text_hash").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n"))
    # those that go and those that repeat are fewer than those that stay: they alone meet the texts
    found = common.checkpoint(found.where("not kept or n > 1").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), "kept"))
    hashed = docs.withColumn("_h" + hash_, F.xxhash64("text"))
    same = (F.col("doc_id") == F.col(id_)) & (F.col("_h" + hash_) == F.col(hash_))
    others = hashed.join(common.small(found), same, "left_anti")
    repeated = hashed.join(common.small(found.where("kept").drop("kept")), same, "left_semi").dropDuplicates(["doc_id", "_h" + hash_])
    return others.union(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
