"""Near duplicates of embeddings: iterative quantisation, multi-index Hamming tables, exact rerank.

Rotations that make the binary codes balanced are learnt from a bounded sample. A vector's code is cut into
substrings; each substring, with the label, is a key of one hash table. Vectors that share a bucket are
compared with their original vectors in double precision. Two vectors whose codes differ in fewer bits than
there are substrings share a bucket for certain; farther ones do by chance.

Equal vectors are one node with a count. A bucket of any size is cut into blocks, and pairs of blocks are
compared in a task as a matrix product; a pair of vectors counts only in the first table where they meet. The
task returns, for each vector, its number of links and one edge to the smallest vector it reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotmark.llm import common

#: Rows that the rotations are learnt from, those with the smallest hashes of their id.
SAMPLE = 10_000
#: Bits of a key and tables, at least. keys() gives larger tables longer keys, so that buckets don't grow, and more
#: tables, so that a pair's chance to meet stays.
KEY_BITS, TABLES = 16, 8
BLOCK_ROWS = 1024
STEPS = 30
#: Cosine from which vectors of the sample count as one.
SAME = 0.95


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct(sample: np.ndarray, cosine: float = SAME) -> np.ndarray:
    """The unit vectors of the sample that are near no earlier one, compared in blocks."""
    keep = np.ones(len(sample), dtype=bool)
    for start in range(0, len(sample), 1000):
        near = sample[start : start + 1000] @ sample[: start + 1000].T >= cosine
        keep[start : start + 1000] = ~np.tril(near, start - 1).any(axis=1)
    return sample[keep]


def rotations(sample: np.ndarray, bits: int, steps: int = STEPS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection [d, bits]). Each group of at most d bits is the principal directions of the sample, turned
    by a rotation that is fitted, step by step, to the signs it gives.

    The sample counts each group of near vectors once, or a large group would be cut up to balance the codes. With
    fewer groups than dimensions nothing is left to balance, and the codes are signs about the origin."""
    sample = distinct(sample)
    mean = sample.mean(axis=0) if len(sample) > sample.shape[1] else np.zeros(sample.shape[1])
    centred = sample - mean
    d = sample.shape[1]
    _, vectors = np.linalg.eigh(centred.T @ centred)
    rng = np.random.default_rng(seed)
    parts, left = [], bits
    while left > 0:
        width = min(d, left)
        principal = vectors[:, ::-1][:, :width]
        v = centred @ principal
        turn, _ = np.linalg.qr(rng.normal(size=(width, width)))
        for _ in range(steps):
            signs = np.where(v @ turn >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(signs.T @ v)
            turn = (u @ w).T
        parts.append(principal @ turn)
        left -= width
    return mean, np.hstack(parts)


def keys(n: int, cosine: float, least_bits: int = KEY_BITS, least_tables: int = TABLES) -> tuple[int, int]:
    """(tables, bits of a key) for n vectors: log2(n) bits, and as many tables as find a pair at the cosine with the
    chance that the least numbers give. With random rotations a bit of such a pair is equal with 1 - angle / pi."""
    bits = max(least_bits, int(np.ceil(np.log2(max(n, 1)))))
    same = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
    missed = (1 - same**least_bits) ** least_tables
    if bits == least_bits or missed <= 0:
        return least_tables, bits
    return int(np.ceil(np.log(missed) / np.log1p(-(same**bits)))), bits


FINITE = "forall(embedding, e -> e is not null and not isnan(e) and abs(e) < double('infinity'))"
#: The rows that can link: id, label and vector not null, all components finite, not all zero.
USABLE = f"coalesce(vec_id is not null and label is not null and size(embedding) > 0 and {FINITE} and exists(embedding, e -> e <> 0), false)"


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, tables: int = TABLES, key_bits: int = KEY_BITS, sample: int = SAMPLE) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Rows link if their labels are equal and their cosine, in double precision, is at least `cosine`. Links are
    found by the tables, so a few may be missed; none is wrong. n_links counts the other rows that a row
    links with; component_id is the smallest vec_id that links reach. `tables` and `key_bits` are the least numbers.

    Rows whose label, vector or id is null, whose vector is empty or zero or holds null or non-finite
    components link with nothing: their component is their own id. Vectors of different numbers of
    dimensions don't link. Repeated rows link with each other like other equal vectors; rows that share a
    vec_id but not the vector or the label are rows of their own. An empty table gives an empty result; extra
    columns are ignored.
    """
    spark = vectors.sparkSession
    common.small_batches(spark)
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    usable = rows.where(USABLE)
    tables, key_bits = keys(usable.count(), cosine, key_bits, tables)
    chosen = common.sampled(usable, sample, "vec_id").select(F.size("embedding").alias("dims"), "embedding").toPandas()
    bits = tables * key_bits
    models = {}
    for d, group in chosen.groupby("dims"):
        models[int(d)] = rotations(unit(np.stack(group["embedding"].to_numpy())), bits)
    # equal vectors of a label are one class; its number, not an id of its rows, stands for it from here on
    equal = ["label", "dims", "e1", "e2"]
    hashed = rows.withColumn("e1", F.xxhash64("embedding")).withColumn("e2", F.expr("xxhash64(7L, reverse(embedding))")).withColumn("dims", F.size("embedding"))
    classes = hashed.where(USABLE).groupBy(*equal).agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.filter(pc.equal(b.column("dims"), d)) for b in batches for d in pc.unique(b.column("dims")))
        for t in parts:
            n, d = t.num_rows, int(t.column("dims")[0].as_py())
            x = unit(np.asarray(t.column("embedding").flatten()).reshape(n, d))
            mean, projection = models.get(d) or rotations(np.eye(d), bits)
            code = ((x - mean) @ projection >= 0).reshape(n, tables, key_bits)
            keyed = code @ (1 << np.arange(key_bits, dtype=np.int64))
            offsets = pa.array(np.arange(n + 1) * tables, pa.int32())
            yield pa.RecordBatch.from_arrays([*t.columns, pa.ListArray.from_arrays(offsets, pa.array(keyed.reshape(-1)))], names=[*t.schema.names, "keys"])

    types = dict(rows.dtypes)
    coded = classes.mapInArrow(run, f"label {types['label']}, dims int, e1 long, e2 long, first_id {types['vec_id']}, copies long, embedding array<double>, keys array<long>")
    coded = common.checkpoint(coded.withColumn("node", F.monotonically_increasing_id()))
    met = coded.select("label", "dims", "node", F.posexplode("keys").alias("tab", "key"))
    met = met.withColumn("bucket", F.xxhash64("label", "dims", "tab", "key"))
    shared = met.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = met.select("bucket", "tab", "node").join(shared, "bucket")
    members = common.running(members, ["bucket"], ["node"]).withColumn("block", F.expr(f"rank div {BLOCK_ROWS}"))
    blocks = members.groupBy("bucket").agg(F.max("block").alias("last"))
    pairs = blocks.select("bucket", "last", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("b1"))
    pairs = pairs.select("bucket", "b1", F.explode(F.sequence("b1", "last")).alias("b2"))
    dealt = common.block_pairs(members, ["bucket"], pairs)
    # the kind keeps apart labels and dimensions whose buckets' hashes are equal by chance
    dealt = dealt.join(coded.select("node", F.xxhash64("label", "dims").alias("kind"), "copies", "embedding", "keys"), "node")
    dealt = dealt.select("bucket", "b1", "b2", "kind", "block", "tab", "node", "copies", "embedding", "keys")
    dealt = dealt.repartition(common.partitions(vectors), "bucket", "b1", "b2").sortWithinPartitions("bucket", "b1", "b2", "kind")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.grouped(batches, ["bucket", "b1", "b2", "kind"]):
            n = t.num_rows
            by = np.argsort(np.asarray(t.column("node")), kind="stable")
            node, copies, block = (np.asarray(t.column(c))[by] for c in ("node", "copies", "block"))
            x = unit(np.asarray(t.column("embedding").combine_chunks().flatten()).reshape(n, -1)[by])
            keyed = np.asarray(t.column("keys").combine_chunks().flatten()).reshape(n, -1)[by]
            links = x @ x.T >= cosine
            np.fill_diagonal(links, False)
            b1, b2, tab = (int(t.column(c)[0].as_py()) for c in ("b1", "b2", "tab"))
            if b1 != b2:
                links &= block[:, None] != block[None, :]
            for earlier in range(tab):  # counted there
                links &= keyed[:, None, earlier] != keyed[None, :, earlier]
            if not links.any():
                continue
            root = common.local_roots(links)
            some = links.any(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root][some]), pa.array((links @ copies)[some])], names=["a", "b", "n"])

    found = common.checkpoint(dealt.mapInArrow(compare, "a long, b long, n long"))
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    groups = common.components(found.select("a", "b"))
    placed = coded.select(*equal, "node", "copies", "first_id").join(counts, "node", "left").join(groups, "node", "left")
    placed = common.checkpoint(placed.withColumn("component", F.coalesce("component", "node")))
    least = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    placed = placed.join(least, "component").select(*equal, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), "component_id")
    out = hashed.select("vec_id", *equal, F.expr(USABLE).alias("live")).join(placed, equal, "left")
    out = out.select("vec_id", F.expr("if(live, links, 0)").alias("n_links"), F.expr("if(live, component_id, vec_id)").alias("component_id"))
    return out.withColumn("kept", F.expr("vec_id <=> component_id"))
