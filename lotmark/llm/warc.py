"""WARC records and their fixity: hash trees over records and ordered offset ranges, compared between replicas.

Records stand in files of FILE_RECORDS in order of their key. A file's tree has its records' digests as
leaves; each node above hashes up to FANOUT children with the offset range that they cover. An audit compares
the replicas' roots, and goes down a level at a time, only under nodes that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmark.llm import common

FILE_RECORDS = 1024
FANOUT = 16
#: Levels above the records, the last one is the root: 1024 -> 64 -> 4 -> 1.
LEVELS = 3


def record(url: Column, payload: Column, key: Column) -> Column:
    """The bytes of a WARC resource record. Null urls and payloads are written as empty."""
    body = F.coalesce(payload, F.lit(""))
    return F.encode(
        F.concat(
            F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
            F.coalesce(key.cast("string"), F.lit("")),
            F.lit(">\r\nWARC-Target-URI: "),
            F.coalesce(url, F.lit("")),
            F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
            F.octet_length(body).cast("string"),
            F.lit("\r\n\r\n"),
            body,
            F.lit("\r\n\r\n"),
        ),
        "UTF-8",
    )


def records(pages: DataFrame) -> DataFrame:
    """(page_id, length, digest): one row per page, its record's bytes and their SHA-256."""
    made = pages.select("page_id", record(F.col("url"), F.col("html"), F.col("page_id")).alias("r"))
    return made.select("page_id", F.octet_length("r").cast("long").alias("length"), F.sha2("r", 256).alias("digest"))


def layout(pages: DataFrame) -> DataFrame:
    """(file, record, page_id, offset, length, digest): records placed in files, in order of page_id (nulls
    first), then of digest; offsets count bytes from the start of the file."""
    placed = common.running(records(pages).withColumn("archive", F.lit(0)), ["archive"], ["page_id", "digest"])
    placed = placed.withColumn("file", F.expr(f"rank div {FILE_RECORDS}")).withColumn("record", F.expr(f"int(rank % {FILE_RECORDS})"))
    before = Window.partitionBy("file").orderBy("record").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))
    return common.checkpoint(placed.select("file", "record", "page_id", offset.alias("offset"), "length", "digest"))


def tree(laid: DataFrame) -> list[DataFrame]:
    """The levels of the trees, (file, node, start, end, digest), from the records, which have a page_id too, to the roots.

    Each level is stored once, 1/16 of the one below it, so that an audit reads levels and builds none.
    """
    levels = [laid.select("file", F.col("record").alias("node"), "page_id", F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), "digest")]
    for _ in range(LEVELS):
        line = F.concat_ws(":", "node", "start", "end", "digest")
        child = levels[-1].select("file", F.expr(f"int(node div {FANOUT})").alias("up"), "start", "end", F.struct("node", line.alias("line")).alias("child"))
        lines = F.array_join(F.array_sort(F.collect_list("child"))["line"], "\n")
        up = child.groupBy("file", "up").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sha2(lines, 256).alias("digest"))
        levels.append(common.checkpoint(up.withColumnRenamed("up", "node")))
    return levels


def differing(mine: DataFrame, other: DataFrame, under: DataFrame | None) -> DataFrame:
    """The nodes of a level, all or those under the given (file, up), that the replicas don't have alike: x, y structs."""
    pack = lambda t: t.select("file", "node", F.struct(*[c for c in t.columns if c not in ("file", "node")]).alias("v"))
    sides = [pack(t) for t in (mine, other)]
    if under is not None:
        sides = [t.withColumn("up", F.expr(f"int(node div {FANOUT})")).join(under, ["file", "up"], "left_semi").drop("up") for t in sides]
    x, y = (t.withColumnRenamed("v", name) for t, name in zip(sides, "xy", strict=True))
    both = x.join(y, ["file", "node"], "full")
    return both.where("not (x.digest <=> y.digest and x.start <=> y.start and x.end <=> y.end)")


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """The records at which two laid-out replicas differ: file, record, page_id, offset, length, digest and their_digest,
    root and their_root.

    Roots are compared first; each step down joins two stored levels under the stored branches that differed above.
    A record that one replica lacks has a null digest on that side, and the place that the other gives it; so has a
    file that one lacks a null root.
    """
    a, b = tree(ours), tree(theirs)
    roots = found = common.checkpoint(differing(a[-1], b[-1], None))
    for mine, other in zip(reversed(a[:-1]), reversed(b[:-1]), strict=True):
        found = common.checkpoint(differing(mine, other, found.select("file", F.col("node").alias("up"))))
    tops = roots.select("file", F.col("x.digest").alias("root"), F.col("y.digest").alias("their_root"))
    out = found.select(
        "file",
        F.col("node").alias("record"),
        F.least("x.page_id", "y.page_id").alias("page_id"),
        F.coalesce("x.start", "y.start").alias("offset"),
        F.coalesce(F.col("x.end") - F.col("x.start"), F.col("y.end") - F.col("y.start")).alias("length"),
        F.col("x.digest").alias("digest"),
        F.col("y.digest").alias("their_digest"),
    )
    return out.join(tops, "file")
