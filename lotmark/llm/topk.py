"""Exact top-k by integer inner product, from an impact-ordered index read score-at-a-time.

The candidates are dealt into blocks. A task builds its block's index: for each dimension, postings cut into
segments by quantised value. A query gives each segment an impact, the most that its postings can add over
the dimension's least; segments are processed by descending impact in rounds. A round ends with a proof
attempt: the best candidates so far are scored exactly, which gives a score to beat, and a candidate stays
possible while its accumulated impacts plus all that unread segments may add reach that score. Once few are
possible, they are scored exactly and the block's answer stands; if the proof never comes, all segments are
read. Every block sends its k best of each query, so k rows a query and block are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmark.llm import common

SCALE = 1024
SEGMENTS = 12
ROUNDS = 6
#: Candidates of a block, at most about; small tables get as many blocks as the session has tasks.
BLOCK_ROWS = 32_768
LEAST_ROWS = 2_048


class ImpactIndex:
    """Segments of postings for integer vectors x [n, d] in order of id. A row's number, which is its own, tells it from
    others of its id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, numbers: np.ndarray | None = None):
        by = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[by], x[by].astype(np.float64)
        self.numbers = self.ids if numbers is None else numbers[by]
        n, d = x.shape
        low, high = self.x.min(axis=0), self.x.max(axis=0)
        level = np.minimum(((self.x - low) * SEGMENTS / np.maximum(high - low, 1)).astype(np.int16), SEGMENTS - 1)
        order = np.argsort(level, axis=0, kind="stable").astype(np.int32)
        self.postings = np.ascontiguousarray(order.T).reshape(-1)
        counts = np.stack([np.bincount(level[:, j], minlength=SEGMENTS) for j in range(d)])
        self.count = counts.reshape(-1)
        self.start = np.cumsum(self.count) - self.count
        # the least and the largest value in each segment; an empty one stands at its dimension's least
        self.least, self.most = np.repeat(low, SEGMENTS), np.repeat(low, SEGMENTS)
        ordered = np.take_along_axis(self.x, order, axis=0).T.reshape(-1)
        full = self.count > 0
        self.least[full] = np.minimum.reduceat(ordered, self.start[full])
        self.most[full] = np.maximum.reduceat(ordered, self.start[full])

    def best(self, query: np.ndarray, k: int, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The places in the index and the scores of the k best, ties to smaller ids, without the row `own`."""
        n, d = self.x.shape
        q = np.repeat(query.astype(np.float64), SEGMENTS)
        ends = np.stack([q * self.least, q * self.most])
        lower, upper = ends.min(axis=0), ends.max(axis=0)
        base = lower.reshape(d, SEGMENTS).min(axis=1)
        gain = upper - np.repeat(base, SEGMENTS)  # the impact, never negative
        segments = np.argsort(-gain, kind="stable")
        segments = segments[self.count[segments] > 0]
        taken = self.numbers == own if own is not None else np.zeros(n, dtype=bool)
        acc = np.zeros(n)
        want = min(k, n - int(taken.sum()))
        # rounds of about equally many postings
        ends_at = np.searchsorted(np.cumsum(self.count[segments]), np.linspace(0, 1, ROUNDS + 1)[1:] * n * d)
        done, possible = 0, np.flatnonzero(~taken)
        for stop in np.minimum(ends_at + 1, len(segments)):
            now = segments[done:stop]
            if len(now):
                counts = self.count[now]
                to = np.cumsum(counts)
                at = np.repeat(self.start[now] - (to - counts), counts) + np.arange(to[-1])
                acc += np.bincount(self.postings[at], weights=np.repeat(gain[now], counts), minlength=n)
            done = stop
            if want <= 0 or done == 0:
                break
            # what a candidate may still get: in each dimension the largest unread impact
            rest = np.zeros(d)
            np.maximum.at(rest, segments[done:] // SEGMENTS, gain[segments[done:]])
            ceiling = acc[possible] + rest.sum() + base.sum()
            probe = possible[np.argpartition(-ceiling, want - 1)[:want]]
            beat = np.partition(self.x[probe] @ query, len(probe) - want)[len(probe) - want]
            possible = possible[ceiling >= beat - 0.5]
            if len(possible) <= max(4 * k, n // 16):
                break  # proven: no other candidate reaches the k-th best
        scores = self.x[possible] @ query
        top = np.lexsort((self.ids[possible], -scores))[:k]
        return possible[top], scores[top].astype(np.int64)


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of the rows that take part: floor(1024 * component), computed as double."""
    usable = F.expr("embedding is not null and size(embedding) > 0 and forall(embedding, e -> e is not null and not isnan(e) and abs(e) < double('infinity'))")
    return vectors.where("vec_id is not null").where(usable).select("vec_id", F.expr(f"transform(embedding, e -> cast(floor({SCALE} * cast(e as double)) as bigint))").alias("x"))


def search(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, the k other rows of the
    highest score, ties to smaller vec_id; all others, if fewer.

    The score is the inner product of the components as floor(1024 * x); exact while it stays below 2^53.
    Vectors that are null or empty, or hold null or non-finite components, take no part, nor do rows with a
    null vec_id. Vectors are compared within their number of dimensions. A row is a candidate for every other
    row, also for one of its own id: rows that share a vec_id, equal or not, are queries and candidates of their
    own, so a query_id comes as often as it has rows. An empty table gives an empty result; extra columns are
    ignored.
    """
    spark = vectors.sparkSession
    common.small_batches(spark)
    usable = common.checkpoint(scaled(vectors).withColumn("dims", F.size("x")).withColumn("number", F.monotonically_increasing_id()))
    n = usable.count()
    tasks = max(spark.sparkContext.defaultParallelism, 1)
    blocks = max(1, -(-n // BLOCK_ROWS), min(tasks, -(-n // LEAST_ROWS)))
    data = usable.select(F.expr(f"int(pmod(xxhash64(number), {blocks}))").alias("block"), "dims", F.lit(0).alias("side"), "number", "vec_id", "x")
    asked = usable.where(f"vec_id % {int(every)} = 0")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "dims", F.lit(1).alias("side"), "number", "vec_id", "x")
    # one block a task
    dealt = data.union(asked).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "dims", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held = None, (None, None)
        for t in common.grouped(batches, ["block", "dims", "side"]):
            key = (t.column("block")[0].as_py(), t.column("dims")[0].as_py())
            numbers, ids = np.asarray(t.column("number")), np.asarray(t.column("vec_id"))
            x = np.asarray(t.column("x").combine_chunks().flatten()).reshape(len(ids), key[1])
            if t.column("side")[0].as_py() == 0:
                index, held = ImpactIndex(ids, x, numbers), key
            elif held == key:
                found = [index.best(q.astype(np.float64), k, int(i)) for i, q in zip(numbers, x, strict=True)]
                counts = [len(f[0]) for f in found]
                at = np.concatenate([f[0] for f in found])
                columns = [np.repeat(numbers, counts), np.repeat(ids, counts), index.ids[at], np.concatenate([f[1] for f in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["number", "query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "number long, query_id long, vec_id long, score long")
    ranked = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(ranked)).where(f"rank <= {int(k)}")
    return found.select("query_id", "rank", "vec_id", "score")
