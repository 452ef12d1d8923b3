"""Incremental jobs: receipts make a batch count once, state tables hold the latest row of each key.

A job reads a folder as a file stream, writes with foreachBatch, and keeps its progress in a checkpoint, so it
can be stopped at any time and started again. Whatever a batch writes stands in a folder of the batch's number, in
overwrite mode: a batch that runs twice changes nothing, and a reader never sees half of one. Batches are merged
when they are read.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotmark.operators import linking
from lotmark.operators.records import latest


#: Where state is kept on disk rather than in executors' memory, with a log of changes in the stream's checkpoint.
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def kept_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep their state on disk."""
    key, before = STORE[0], spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which all executors reach."""
    return f"{linking.shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def stream(spark: SparkSession, path: str, files_per_batch: int = 1000, bytes_per_batch: str | None = None) -> DataFrame:
    """Parquet files as a stream, with the schema that they have now, a bounded number of files, or bytes, at a time. A single
    file is a stream of its folder, filtered."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader.option("maxBytesPerTrigger", bytes_per_batch) if bytes_per_batch else reader.option("maxFilesPerTrigger", files_per_batch)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        return reader.option("pathGlobFilter", hadoop.getName()).parquet(hadoop.getParent().toString())
    return reader.parquet(path)


def run(df: DataFrame, folder: str, batch: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Runs the stream over all that is there now, then stops. A run that was stopped, or failed, goes on where it was."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").foreachBatch(batch).trigger(availableNow=True).start()
    query.awaitTermination()


def batches(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """All that batches have written under a name, with their number as `batch`."""
    return spark.read.option("recursiveFileLookup", "false").parquet(f"{folder}/{name}")


def latest_state(events: DataFrame, folder: str, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key over the whole stream. A batch writes the last rows of its own keys; none is written again."""

    def batch(df: DataFrame, number: int) -> None:
        latest(df, keys, *order).write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

    run(events, folder, batch)
    return latest(batches(events.sparkSession, folder, "state").drop("batch"), keys, *order)


def ingest_once(rows: DataFrame, folder: str, *keys: str) -> DataFrame:
    """All rows whose keys came first, one of each: the stream keeps the keys that it has seen as state, on disk, so a batch reads
    nothing of the batches before it. With a group and a fingerprint as keys, repeated snapshots add nothing."""
    spark = rows.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

    with kept_on_disk(spark):
        run(rows.dropDuplicates(list(keys)), folder, batch)
    return batches(spark, folder, "state").drop("batch")


def ingest_checked(rows: DataFrame, folder: str, problem: Column, retryable: Column) -> None:
    """Splits each batch: rows without a problem are accepted, the others wait to be tried again or are dead. No part of a row
    that failed is accepted. Read with outcome() and counts()."""

    def batch(df: DataFrame, number: int) -> None:
        outcome = F.when(F.col("problem").isNull(), "accepted").when(retryable, "retry").otherwise("dead")
        df.withColumn("problem", problem).withColumn("outcome", outcome).write.mode("overwrite").partitionBy("outcome").parquet(f"{folder}/checked/batch={number}")

    run(rows, folder, batch)


def outcome(spark: SparkSession, folder: str, which: str) -> DataFrame:
    """The rows of ingest_checked() that are accepted, retry or dead; those to retry can be streamed once more from here."""
    return batches(spark, folder, "checked").where(F.col("outcome") == which).drop("batch", "outcome")


#: From each state of a job, what may be asked of it and the state that this leads to.
MOVES = (
    ("created", "start", "running"),
    ("running", "pause", "paused"),
    ("running", "finish", "completed"),
    ("running", "fail", "failed"),
    ("running", "lose", "interrupted"),
    ("paused", "resume", "running"),
    ("failed", "retry", "running"),
    ("interrupted", "resume", "running"),
    ("paused", "stop", "stopped"),
    ("failed", "stop", "stopped"),
    ("interrupted", "stop", "stopped"),
)


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, state, n_refused, attempts) of jobs from their log (job_id, seq, action): every action that the state allows
    leads to the next; others are refused and change nothing. A job's log is folded in order; it is as long as its
    operators' patience."""
    table = F.create_map(*[x for a, b, c in MOVES for x in (F.lit(f"{a}>{b}"), F.lit(c))])
    log = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", "action"))).alias("log"))
    start = F.struct(F.lit("created").alias("state"), F.lit(0).alias("refused"), F.lit(0).alias("attempts"))

    def step(s: Column, e: Column) -> Column:
        following = F.element_at(table, F.concat_ws(">", s["state"], e["action"]))
        began = F.when(F.coalesce(following == "running", F.lit(False)), 1).otherwise(0)
        return F.struct(F.coalesce(following, s["state"]).alias("state"), (s["refused"] + F.when(following.isNull(), 1).otherwise(0)).alias("refused"), (s["attempts"] + began).alias("attempts"))

    return log.select("job_id", F.aggregate("log", start, step).alias("s")).select("job_id", F.col("s.state").alias("state"), F.col("s.refused").alias("n_refused"), "s.attempts")


def snapshot(progress: DataFrame, keys: list[str]) -> DataFrame:
    """Counters of notices by what their last attempt came to."""
    return progress.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "running", "pending")], F.max("attempt").alias("most_attempts"))


def stale(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, state) of sources whose SHA-256 isn't what it was when a job began: changed, gone or new; others are left out."""
    b, a = before.select(key, F.col("sha256").alias("was")), after.select(key, F.col("sha256").alias("is"))
    state = F.when(F.col("is").isNull(), "gone").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("is"), "changed")
    return b.join(a, key, "full").select(key, state.alias("state")).where("state is not null")


def windowed(events: DataFrame, folder: str, at: str, size: str, slide: str | None, late: str, keys: list[Column], aggs: list[Column]) -> DataFrame:
    """Aggregates per time window. A batch writes the windows that it changes; the last one written counts. Windows that end
    before the watermark leave the state, and events that belong to them come too late."""
    win = F.window(at, size, slide) if slide else F.window(at, size)
    grouped = events.withWatermark(at, late).groupBy(win, *keys).agg(*aggs)
    made = ["window", *[c for c in grouped.columns if c != "window"][: len(keys)]]

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/windows/batch={number}")

    run(grouped, folder, batch, "update")
    return latest(batches(events.sparkSession, folder, "windows"), made, "batch").drop("batch")


def sessions(events: DataFrame, folder: str, at: str, gap: str, late: str, key: str, aggs: list[Column]) -> DataFrame:
    """Aggregates per key and session. A session is written once, when the watermark has passed its end; until then it is
    state, so those that are still open are not in the result."""
    grouped = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("session")).agg(*aggs)

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/sessions/batch={number}")

    run(grouped, folder, batch)
    return batches(events.sparkSession, folder, "sessions").drop("batch")
