"""JSON arrays of objects in pieces: files of any size as rows of their elements, read by many tasks.

Spark's text reader splits a file at closing braces, wherever its byte ranges begin. What a piece does to a reader's state
is known without the pieces before it, for either state it may start in: inside a string or not. Running sums over the
pieces, first within ranges and then over them, give every piece's true state, and so the pieces at which an
element ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmark.operators.linking import checkpoint


def _depth(segments: Column, parity: int) -> Column:
    """Opening less closing brackets in every other segment between quotes, from the one at `parity`."""
    outside = F.filter(segments, lambda s, i: i % 2 == parity)
    size = lambda s: F.length(F.regexp_replace(s, "[^{\\[]", "")) - F.length(F.regexp_replace(s, "[^}\\]]", ""))
    return F.aggregate(outside, F.lit(0), lambda n, s: n + size(s))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, nth, piece, turns, open, closed): the text up to each closing brace, with it, in order of the file, range and
    place; turns: whether it ends in another state than it starts in; open and closed: what it adds to the depth if it starts outside
    of strings, or inside."""
    lines = spark.read.option("lineSep", "}").text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth"), F.concat("value", F.lit("}")).alias("piece"))
    # an escape never spans two pieces, as no valid one ends in a brace
    segments = F.split(F.regexp_replace("piece", "(?s)\\\\.", ""), '"', -1)
    rows = rows.withColumn("segments", segments)
    return rows.select("file", "start", "nth", "piece", (F.size("segments") % 2 == 0).cast("int").alias("turns"), _depth(F.col("segments"), 0).alias("open"), _depth(F.col("segments"), 1).alias("closed"))


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, element, json): the objects of the arrays in the files, numbered from 0 in each, as texts.

    An empty array has no rows. Elements that are no objects, and text behind the array, are an error when they are read; so is a
    file that ends within an element. Files that Spark can't split (compressed ones) are read whole by one task each.
    """
    own = checkpoint(pieces(spark, path))
    in_range = Window.partitionBy("file", "start").orderBy("nth")
    ranges = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = in_range.rowsBetween(Window.unboundedPreceding, -1)
    # the state at each piece if its range starts outside; then the state at each range
    flips = own.withColumn("flip", F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2)
    flips = flips.withColumn("if_out", F.when(F.col("flip") == 0, F.col("open")).otherwise(F.col("closed"))).withColumn("if_in", F.when(F.col("flip") == 0, F.col("closed")).otherwise(F.col("open")))
    per = flips.groupBy("file", "start").agg(F.sum("turns").alias("turns"), F.sum("if_out").alias("if_out"), F.sum("if_in").alias("if_in"))
    per = per.withColumn("state", F.coalesce(F.sum("turns").over(ranges), F.lit(0)) % 2)
    per = per.withColumn("depth", F.when(F.col("state") == 0, F.col("if_out")).otherwise(F.col("if_in")))
    per = checkpoint(per.withColumn("base", F.coalesce(F.sum("depth").over(ranges), F.lit(0))).select("file", "start", "state", "base"))
    added = F.when(F.col("state") == 0, F.col("if_out")).otherwise(F.col("if_in"))
    placed = flips.join(per, ["file", "start"]).withColumn("depth", F.sum(added).over(in_range) + F.col("base"))
    inside = (F.col("flip") + F.col("state") + F.col("turns")) % 2 == 1
    placed = checkpoint(placed.select("file", "start", "nth", "piece", ((F.col("depth") == 1) & ~inside).cast("int").alias("ends")))
    # an element has the pieces behind the end of the one before, up to its own
    last = F.max_by("piece", F.struct("start", "nth"))
    closed = placed.groupBy("file").agg(last.rlike("^\\s*(?:\\[\\s*)?\\]\\s*\\}$").alias("closed"))
    counts = placed.groupBy("file", "start").agg(F.sum("ends").alias("ends")).withColumn("base", F.coalesce(F.sum("ends").over(ranges), F.lit(0))).drop("ends")
    numbered = placed.join(counts, ["file", "start"]).withColumn("element", F.coalesce(F.sum("ends").over(before), F.lit(0)) + F.col("base"))
    whole = numbered.groupBy("file", "element").agg(F.array_join(F.array_sort(F.collect_list(F.struct("start", "nth", "piece")))["piece"], "").alias("json"), F.max("ends").alias("ends"))
    text = F.regexp_replace(F.regexp_replace("json", "^\\s*[\\[,]\\s*", ""), "(?s)^\\s*\\]\\s*\\}$|^\\s+\\}$|^\\}$", "")
    rows = whole.select("file", F.col("element").cast("long").alias("element"), text.alias("json"), "ends").where("json <> ''")
    good = F.col("closed") & (F.col("ends") == 1) & F.col("json").startswith("{")
    return rows.join(closed, "file").select("file", "element", F.when(good, F.col("json")).otherwise(F.raise_error(F.concat(F.lit("not an array of objects: "), "file"))).alias("json"))
