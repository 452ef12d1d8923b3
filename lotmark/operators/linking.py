"""Checkpoints, and connected components of edges."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

if TYPE_CHECKING:
    import numpy as np
    import pandas as pd
    import pyarrow as pa


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, which the driver and all executors share.

    A temporary folder takes its place only where driver and executors are one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="lotmark-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in spark.checkpoint.dir."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage as checkpoint() does, by Parquet in the same folder: a checkpoint's rows aren't compressed and take some ten
    times as much disk."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    folder = f"{context.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with its rows' places, from 1, in an order that leaves no ties. Rows are dealt out by ranges of the order and stored;
    each range's rows are numbered from the number of rows before it, so no task holds all rows."""
    dealt = checkpoint(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row per range
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(before, "_range").withColumn(name, (here + F.col("_before")).cast("long")).drop("_range", "_before")


def solved(rows: DataFrame, keys: list[str], order: list[str], solve: Callable[[tuple, pd.DataFrame], list[tuple]], schema: str) -> DataFrame:
    """The rows that solve(key, group) gives for each group of equal keys, which must not be null; a group comes whole and in order.

    Groups lie behind each other in sorted partitions, and one call from Spark takes as many as there are in a batch:
    most components have a few rows, for which a call each would cost more than the work."""
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd  # workers of other operators, which have no use for it, don't load it

        held: list[pd.DataFrame] = []
        last: tuple | None = None
        for frame in frames:
            out: list[tuple] = []
            for key, part in frame.groupby(keys, sort=False, dropna=False):
                if last is not None and key != last:
                    out += solve(last, pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True))
                    held = []
                held.append(part)
                last = key
            yield pd.DataFrame(out, columns=names)
        if last is not None:
            yield pd.DataFrame(solve(last, pd.concat(held, ignore_index=True)), columns=names)

    return dealt.mapInPandas(run, schema)


#: Edges of a scope that a task takes at once.
SCOPE_EDGES = 50_000


def components_within(edges: DataFrame, scope: str) -> DataFrame:
    """components() of edges (scope, a, b) that stay within their scope. A task takes the edges of a scope at once if they are SCOPE_EDGES
    at most, so only the edges of larger scopes need rounds of joins. The edges should be stored."""
    edges = edges.where("a <> b").select(scope, "a", "b")
    large = stored(edges.groupBy(scope).count().where(F.col("count") > SCOPE_EDGES).select(scope))
    some = not large.isEmpty()
    dealt = edges.join(large, scope, "left_anti") if some else edges
    dealt = dealt.repartition(scope).sortWithinPartitions(scope)

    def found(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        parent: dict[int, int] = {}

        def root(i: int) -> int:
            while parent.setdefault(i, i) != i:
                parent[i] = i = parent[parent[i]]
            return i

        for a, b in pairs:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        return [(i, root(i)) for i in list(parent) if root(i) != i]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        last, held = None, []
        for frame in frames:
            out = []
            for key, a, b in zip(frame[scope], frame["a"], frame["b"], strict=True):
                if held and key != last:
                    out += found(held)
                    held = []
                last = key
                held.append((a, b))
            yield pd.DataFrame(out, columns=["node", "component"])
        yield pd.DataFrame(found(held), columns=["node", "component"])

    out = dealt.mapInPandas(run, "node long, component long")
    return out.unionByName(components(edges.join(large, scope, "left_semi"))) if some else out


def _roots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each edge's component."""
    import numpy as np

    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while (root[u] != root[v]).any():
        least = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], least)
        np.minimum.at(root, root[v], least)
        while (root[root] != root).any():
            root = root[root]
    return nodes[root[u]]


def labelled(edges: DataFrame, scope: str, column: str, value: str) -> DataFrame:
    """Edges (scope, a, b, ...) that lie in tasks by their scope, stored, with `component`: the least node that is reached by those edges
    of which the column has the value; the others have none. Nodes belong to one scope each.

    A task labels the edges of a scope as they pass if they are SCOPE_EDGES at most; only those of larger scopes need rounds of joins."""
    edges = edges.sortWithinPartitions(scope)
    schema, most = edges.withColumn("component", F.lit(None).cast("long")).schema, SCOPE_EDGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def out(parts: list[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(parts)
            joins = pc.equal(rows[column], value).to_numpy() & whole
            found = np.zeros(len(joins), dtype=np.int64)
            if joins.any():
                found[joins] = _roots(*(rows[c].to_numpy()[joins] for c in "ab"))
            yield from rows.append_column("component", pa.array(found, mask=~joins)).to_batches()

        held, size, over, last = [], 0, False, None  # rows of the last scope, which may go on, and whether some of it has passed already
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(scope))
            starts = (np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist()
            if last is not None and keys[0].as_py() != last:
                starts.insert(0, 0)
            if starts:
                if size + starts[0]:
                    yield from out([*held, batch.slice(0, starts[0])], not over and size + starts[0] <= most)
                if starts[-1] > starts[0]:
                    yield from out([batch.slice(starts[0], starts[-1] - starts[0])], True)
                held, size, over, batch = [], 0, False, batch.slice(starts[-1])
            held.append(batch)
            size, last = size + batch.num_rows, keys[-1].as_py()
            if size > most:
                yield from out(held, False)
                held, size, over = [], 0, True
        if held:
            yield from out(held, not over)

    rows = stored(edges.mapInArrow(run, schema))
    large = rows.where((F.col(column) == value) & F.col("component").isNull())
    if large.isEmpty():
        return rows
    parts = components(large.select("a", "b"))
    parts = stored(parts.unionByName(parts.select(F.col("component").alias("node"), "component").distinct()))
    known = rows.where((F.col(column) != value) | F.col("component").isNotNull())
    return known.unionByName(large.drop("component").join(parts.withColumnRenamed("node", "a"), "a").select(*rows.columns))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, component) for every node but the smallest of each.

    Alternates large-star and small-star steps: every node's neighbours move to its smallest neighbour. Each
    round's edges are checkpointed; only a count and a checksum come to the driver. A component of n nodes
    takes O(log n) rounds or so. All edges of a hub have its key in the join with the smallest neighbours;
    these are stored before it, so that both sides of the join are plain shuffles and adaptive execution
    can split a hub's edges over tasks.
    """
    star = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    star, last = checkpoint(star), None
    for _ in range(rounds):
        both = star.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(star.select("lo", "hi"))
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.expr("if(lo = m, hi, lo)").alias("hi"), F.col("m").alias("lo"))
        star = checkpoint(small.distinct())
        now = tuple(star.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))")).first())
        if now == last:
            return star.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        last = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
