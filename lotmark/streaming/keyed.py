"""The latest row of every key as state of a stream: kept by key, read without reading batches again, and left by silent keys.

The state store holds a row a key, changed keys alone are written at each batch, and a timer lets a key go that has had no row
for a while. What stands in the store is read as a table; its size follows the keys that are there, not the stream's past.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lotmark.streaming.jobs import kept_on_disk

LAST, AT = "last", "_at"


class Latest(StatefulProcessor):
    """Keeps the row with the greatest order of each key, and a timer behind its latest row in event time."""

    def __init__(self, schema: T.StructType, keys: list[str], order: list[str], silent_ms: int):
        self.schema, self.keys, self.order, self.silent = schema, keys, order, silent_ms
        self.values = [f.name for f in schema.fields if f.name not in keys]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(LAST, T.StructType([f for f in self.schema.fields if f.name in self.values]))

    def _rank(self, row: dict) -> tuple:
        """Nulls come first; equal orders are settled by the row, so that reruns agree."""
        return tuple((row[c] is not None, row[c]) if row[c] is not None else (False, 0) for c in self.order), repr([row[c] for c in self.values])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        best = dict(zip(self.values, self.state.get(), strict=True)) if self.state.exists() else None
        before, until = best, max([best[AT]] if best else [0])
        for row in rows:
            new = {c: row[c] for c in self.values}
            until = max(until, new[AT] or 0)
            if best is None or self._rank(new) > self._rank(best):
                best = new
        best = best | {AT: until}
        self.state.update(tuple(best[c] for c in self.values))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(until + self.silent)
        if best != before:
            yield Row(**(dict(zip(self.keys, key, strict=True)) | best))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def advance(events: DataFrame, folder: str, keys: list[str], order: list[str], time: str, silent_ms: int = 86_400_000, delay: str = "0 seconds") -> None:
    """Takes the stream as far as there are rows now. `time` is the rows' event time; rows that come later than `delay` behind the
    latest one are dropped, and a key is let go when `silent_ms` have passed since its latest row, in event time. A run that was
    stopped, or failed, goes on where it was: a batch that runs again finds the state that it found before."""
    spark = events.sparkSession
    rows = events.withColumn(AT, F.unix_millis(time)).withWatermark(time, delay)
    schema = T.StructType([f for f in rows.schema.fields if f.name != time])
    latest = rows.groupBy(*keys).transformWithState(Latest(schema, keys, order, silent_ms), T.StructType([f for f in schema.fields]), "Update", "EventTime")
    with kept_on_disk(spark):
        query = latest.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").format("noop").trigger(availableNow=True).start()
        query.awaitTermination()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The keys and rows in the store as of the last batch; `_at` is a key's latest event time in milliseconds."""
    held = spark.read.format("statestore").option("stateVarName", LAST).load(f"{folder}/progress")
    return held.where("value is not null").select("key.*", "value.*")
