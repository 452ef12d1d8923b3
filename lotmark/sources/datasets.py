"""Tables with schemas, manifests, caches, receipts and ledgers: what goes in and out of a dataset besides documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Rejected(ValueError):
    pass


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the columns of the schema, in its order and types; columns that older data lacks are null, others go. A value that
    its type can't hold is an error."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def append(df: DataFrame, folder: str, schema: T.StructType) -> None:
    conformed(df, schema).write.mode("append").parquet(folder)


def table(spark: SparkSession, folder: str) -> DataFrame:
    """A table whose files may be older than its newest columns."""
    return spark.read.option("mergeSchema", "true").parquet(folder)


def strict_json(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """Files with a JSON document or an array of them each, or, with `lines`, a document a line; a field of another type is an error, and so is a field that the schema
    doesn't have, which a first pass over the names looks for."""
    reader = spark.read.option("multiLine", str(not lines).lower())
    seen = reader.json(path).schema.names
    extra = set(seen) - set(schema.names) - {"_corrupt_record"}
    if extra:
        raise Rejected(f"unknown fields: {', '.join(sorted(extra))}")
    return reader.schema(schema).option("mode", "FAILFAST").json(path)


def manifest(spark: SparkSession, path: str, lists: tuple[str, ...] = ("files",), key: str = "notice_id") -> DataFrame:
    """A CSV manifest with a header: the named columns are lists joined by `;`. An id that comes twice is an error."""
    df = spark.read.option("header", "true").csv(path)
    twice = df.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise Rejected(f"{key} comes twice: {twice[0][key]}")
    return df.select(*[F.array_remove(F.transform(F.split(c, ";"), lambda x: F.trim(x)), "").alias(c) if c in lists else F.col(c) for c in df.columns])


def verified(listed: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem): files of a manifest (path, sha256) that are missing or have another hash."""
    both = listed.select("path", F.col("sha256").alias("want")).join(files.select("path", "sha256"), "path", "left")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("want"), "other content")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def cache_key(identity: Column, content: Column) -> Column:
    """The key of a result: of what made it, and of what from."""
    return F.sha2(F.concat_ws("\x1f", identity, F.sha2(content, 256)), 256)


def cached(requests: DataFrame, cache: DataFrame, replay: bool = False) -> DataFrame:
    """requests (key, ...) with `result` and `hit`. A replay may not miss: then a missing key is an error when it is read."""
    out = requests.join(cache.select("key", "result").dropDuplicates(["key"]).withColumn("hit", F.lit(True)), "key", "left").fillna(False, ["hit"])
    return out.withColumn("result", F.when(F.col("hit"), F.col("result")).otherwise(F.raise_error(F.concat(F.lit("not cached: "), "key")))) if replay else out


def synthetic(spark: SparkSession, n: int) -> DataFrame:
    """Made-up notices: notice_id, project_name, buyer, html with an item table and a table of bidders."""
    row = spark.range(1, n + 1).withColumnRenamed("id", "notice_id")
    html = F.format_string(
        "<table><tr><th>标的名称</th><th>品牌</th><th>数量</th></tr><tr><td>item %d</td><td>brand %d</td><td>%d</td></tr></table><table><tr><th>供应商名称</th><th>是否中标</th><th>中标金额</th></tr><tr><td>S%d</td><td>是</td><td>%d</td></tr></table>",
        F.col("notice_id") % 7, F.col("notice_id") % 5 + 1, F.col("notice_id") % 11, "notice_id", F.col("notice_id") * 100,
    )
    return row.select("notice_id", F.format_string("project %04d", "notice_id").alias("project_name"), F.format_string("buyer %d", F.col("notice_id") % 3).alias("buyer"), html.alias("html"))


def ledger(df: DataFrame, folder: str, key: str) -> None:
    """A ledger as CSV with a header and as JSON lines, in order of its key; each is complete or not there, as a writer commits
    when all of its tasks have."""
    rows = df.repartitionByRange(key).sortWithinPartitions(key)
    rows.write.mode("errorifexists").option("header", "true").csv(f"{folder}/csv")
    rows.write.mode("errorifexists").json(f"{folder}/json")


def archived(attempts: DataFrame) -> DataFrame:
    """The attempts (notice_id, mode, attempt, ...) but the last of each notice and mode, which is the result; nothing of them is
    lost when a notice is tried again."""
    last = attempts.groupBy("notice_id", "mode").agg(F.max("attempt").alias("last"))
    return attempts.join(last, ["notice_id", "mode"]).where("attempt < last").drop("last")


def to_run(notices: DataFrame, modes: list[str], done: DataFrame, identity: str) -> DataFrame:
    """(notice_id, mode) of what a run still has to do: every notice in every mode, less what is completed under the same identity
    of inputs and settings."""
    wanted = notices.select("notice_id", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
    completed = done.where((F.col("identity") == identity) & (F.col("status") == "completed")).select("notice_id", "mode")
    return wanted.join(completed, ["notice_id", "mode"], "left_anti")
