"""Shared by the operators: checkpoints, ranks without a single task, components, and Arrow batches by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmark.operators.linking import checkpoint, components, shared_folder  # noqa: F401

#: Rows of an Arrow batch. Spark's default of 10,000 holds too much memory where texts are long.
BATCH_ROWS = 1000
#: Bytes of text that a Python task works on at a time.
CHUNK_BYTES = 4_000_000
#: Rows of keys that may be broadcast; a longer list is joined by a shuffle.
BROADCAST_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(name: str, columns: list[str]) -> str:
    """The name, with underscores before it while a column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size, if it is above BATCH_ROWS."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, which holds keys, with a hint to broadcast it if it has `rows` at most. It is counted, so it should be stored."""
    return F.broadcast(df) if df.count() <= rows else df


def sampled(df: DataFrame, size: int, key: str) -> DataFrame:
    """The `size` rows with the smallest hashes of the key, which should be unique.

    A count comes first: from it follows a bound that about twice as many rows stay below, so that tasks don't send
    `size` rows each, however many tasks there are.
    """
    n, h = df.count(), F.xxhash64(key)
    if n > 2 * size:
        df = df.where(h < F.lit(int(2 * size / n * (1 << 64)) - (1 << 63)))
    return df.orderBy(h, key).limit(size)


def running(df: DataFrame, within: list[str], order: list[str | Column], sums: tuple[str, ...] = ()) -> DataFrame:
    """Adds `rank` (from 0 in each group) and `<c>_before`, the sum of c over the group's earlier rows.

    Rows are dealt out by ranges of (group, order), so a group of any size spreads over many tasks; each
    range gets the sums of the ranges before it. The columns of `within` must not be null, and df should
    be narrow, as it is checkpointed: the ranges must not change between the two passes.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(partitions(df), *[F.col(c) for c in within], *keys)
    dealt = checkpoint(dealt.withColumn("_range", F.spark_partition_id()))
    parts = dealt.groupBy(*within, "_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{c}") for c in sums])
    earlier = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = parts.select(
        *within,
        "_range",
        F.coalesce(F.sum("_n").over(earlier), zero).alias("_n0"),
        *[F.coalesce(F.sum(f"_{c}").over(earlier), zero).alias(f"_{c}0") for c in sums],
    )
    here = Window.partitionBy(*within, "_range").orderBy(*keys)
    above = here.rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(parts, [*within, "_range"])
    out = out.withColumn("rank", F.row_number().over(here) - 1 + F.col("_n0"))
    for c in sums:
        out = out.withColumn(f"{c}_before", F.coalesce(F.sum(c).over(above), zero) + F.col(f"_{c}0"))
    return out.drop("_range", "_n0", *[f"_{c}0" for c in sums])


def chunks(batch: pa.RecordBatch | pa.Table, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Slices of the batch with about `size` bytes of text each, one row at least."""
    lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    if not len(lengths):
        return
    part = (np.cumsum(lengths) - lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    for start, stop in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(start, stop - start)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys, which must be integers and not null."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            key = tuple(int(c[start]) for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def block_pairs(members: DataFrame, group: list[str], blocks: DataFrame) -> DataFrame:
    """Deals members (group, block, ...) to pairs of blocks: adds b1 and b2, one row for each pair that a block is in.

    blocks: the pairs to compare, as (group, b1, b2).
    """
    ends = blocks.select(*group, "b1", "b2", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("block"))
    return members.join(ends, [*group, "block"])


def local_roots(links: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, each row's smallest reachable row."""
    n = len(links)
    root = np.arange(n)
    near = links | np.eye(n, dtype=bool)
    while True:
        lower = np.where(near, root[None, :], n).min(axis=1)
        lower = lower[lower]
        if (lower == root).all():
            return root
        root = lower
