"""Bidder details: merging what several tables say of one bidder, and joining it with participants."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmark.functions import money
from lotmark.functions.codes import DEFAULT
from lotmark.functions.text import name_key
from lotmark.operators.records import content_hash

FIELDS = ("qualification", "compliance", "review", "bid_amount", "score", "reason")
STATUSES = ("qualification", "compliance", "review")
NAME = ["notice_id", "name_key"]


def _filled(c: str) -> Column:
    """A field's value as text, decimals in their shortest form; blank is null."""
    return F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))


def anchored(records: DataFrame) -> DataFrame:
    """Records (notice_id, package_code, name, source_file, source_location, FIELDS) with name_key and source_key. A record
    without a package takes the only package that others of its notice name for the same bidder; where that isn't
    unique it stays a record of its own source row."""
    keyed = records.withColumn("name_key", name_key(F.col("name"))).withColumn("package_code", F.coalesce("package_code", F.lit(DEFAULT)))
    named = keyed.where(F.col("package_code") != DEFAULT).groupBy(*NAME).agg(F.count_distinct("package_code").alias("packages"), F.min("package_code").alias("only"))
    out = keyed.join(named, NAME, "left")
    code = F.when((F.col("package_code") == DEFAULT) & (F.col("packages") == 1), F.col("only")).otherwise(F.col("package_code"))
    out = out.withColumn("package_code", code).drop("packages", "only")
    row = F.concat_ws("\x00", F.coalesce("source_file", F.lit("")), F.coalesce("source_location", F.lit("")))
    return out.withColumn("source_key", F.when(F.col("package_code") == DEFAULT, row).otherwise(F.lit("")))


def _extents(records: DataFrame) -> list[Column]:
    """Aggregates from which _settled() makes the fields of merged records: `old` conflicts, least and greatest values."""
    sticky = F.flatten(F.collect_set("conflicts")) if "conflicts" in records.columns else F.array().cast("array<string>")
    return [sticky.alias("old"), *[x for f in FIELDS for x in (F.min(_filled(f)).alias(f"{f}_lo"), F.max(_filled(f)).alias(f"{f}_hi"))]]


def _settled(out: DataFrame, *keep: str) -> DataFrame:
    """keep, conflicts and FIELDS of rows that hold extents."""
    clash = {f: F.coalesce((F.col(f"{f}_lo") != F.col(f"{f}_hi")) | F.array_contains("old", f), F.lit(False)) for f in FIELDS}
    found = F.array_sort(F.array_compact(F.array(*[F.when(clash[f], F.lit(f)) for f in FIELDS])))
    value = {f: F.when(~clash[f], F.col(f"{f}_lo")) for f in FIELDS}
    either = F.coalesce(F.col("qualification") == "未通过", F.lit(False)) | F.coalesce(F.col("compliance") == "未通过", F.lit(False))
    review = F.when(F.col("unsure"), F.col("review")).when(either, "未通过").when((F.col("qualification") == "通过") & (F.col("compliance") == "通过"), "通过").otherwise(F.col("review"))
    unsure = functools.reduce(operator.or_, [clash[s] for s in STATUSES])
    out = out.select(*keep, found.alias("conflicts"), *[value[f].alias(f) for f in FIELDS], unsure.alias("unsure"))
    return out.withColumn("review", review).drop("unsure")


def merged(records: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: a field on which all records that fill it agree keeps its value; of several, none. `conflicts`
    lists such fields, and those that the records' own `conflicts` list, so merging again changes nothing.

    The review follows qualification and compliance where none of the three is in conflict: failed if one failed,
    passed if both passed."""
    out = records.groupBy(*keys).agg(F.min("name").alias("name"), F.count("*").alias("n_records"), *_extents(records))
    return _settled(out, *keys, "name", "n_records")


def merge(records: DataFrame) -> DataFrame:
    """One row per bidder and package of a notice, see anchored() and merged()."""
    return merged(anchored(records), ["notice_id", "package_code", "name_key", "source_key"])


def canonical(records: DataFrame) -> DataFrame:
    """Records to save: amounts and scores in shortest form, and the hash of their content; equal ones come once."""
    out = records.withColumn("bid_amount", money.canonical(F.col("bid_amount"))).withColumn("score", money.canonical(F.col("score")))
    columns = ["notice_id", "package_code", "name", "source_file", "source_location", *FIELDS]
    return out.withColumn("detail_hash", content_hash(*columns)).dropDuplicates(["notice_id", "detail_hash"])


def read_back(saved: DataFrame, notice_ids: list[int] | None = None) -> DataFrame:
    """Saved records of the notices with evidence as a map; evidence that isn't an object is empty."""
    rows = saved.where(F.col("notice_id").isin(notice_ids)) if notice_ids is not None else saved
    kind = "map<string,struct<source_file:string,source_location:string,source_evidence:string>>"
    return rows.withColumn("field_evidence", F.coalesce(F.from_json("field_evidence_json", kind), F.create_map().cast(kind))).drop("field_evidence_json")


def matched(participants: DataFrame, records: DataFrame, awards: DataFrame | None = None) -> DataFrame:
    """(notice_id, package_code, name_key, record columns): the records that belong to each participant (notice_id,
    package_code, name). Those of its package do; those without a package too, if the bidder takes part in one package
    only and no record names another one."""
    people = participants.select("notice_id", F.coalesce("package_code", F.lit(DEFAULT)).alias("package_code"), name_key(F.col("name")).alias("name_key"))
    taken = people if awards is None else people.unionByName(awards.select("notice_id", F.coalesce("package_code", F.lit(DEFAULT)).alias("package_code"), name_key(F.col("name")).alias("name_key")))
    lots = taken.groupBy(*NAME).agg(F.count_distinct("package_code").alias("lots"))
    keyed = records.withColumn("name_key", name_key(F.col("name"))).withColumn("record_package", F.coalesce("package_code", F.lit(DEFAULT))).drop("package_code")
    named = keyed.where(F.col("record_package") != DEFAULT).groupBy(*NAME).agg(F.count_distinct("record_package").alias("packages"), F.min("record_package").alias("only"))
    met = people.distinct().join(lots, NAME).join(named, NAME, "left").join(keyed, NAME)
    spare = (F.col("record_package") == DEFAULT) & (F.col("package_code") != DEFAULT) & (F.col("lots") == 1) & (F.coalesce("packages", F.lit(0)) <= 1) & (F.coalesce("only", "package_code") == F.col("package_code"))
    return met.where((F.col("record_package") == F.col("package_code")) | spare).drop("lots", "packages", "only")


def export(participants: DataFrame, awards: DataFrame, records: DataFrame, n: int | None = None) -> DataFrame:
    """The sheet of bidders: notice_id, package_code, name_key, category, amount_wan, FIELDS but the amount.

    Participants come first, 中标人 if they won and 参与人 otherwise, with what their records say, as matched() has it; winners
    that are no participants follow, then bidders that only records name, 其他. participants: notice_id, package_code, name,
    outcome; awards: notice_id, package_code, name, award_amount.

    All rows of a bidder in a notice are dealt to one of n tasks (without n, as Spark deals them) and meet there, in a window
    and a grouping by package: nothing is joined, and a row's name is read once."""
    code = F.coalesce("package_code", F.lit(DEFAULT)).alias("package_code")
    said = [*FIELDS, *(["conflicts"] if "conflicts" in records.columns else [])]
    rows = participants.select("notice_id", code, "name", F.lit("participant").alias("side"), (F.col("outcome") == "winner").alias("winner"))
    rows = rows.unionByName(awards.select("notice_id", code, "name", F.lit("award").alias("side"), "award_amount"), allowMissingColumns=True)
    rows = rows.unionByName(records.select("notice_id", code, "name", F.lit("record").alias("side"), *said), allowMissingColumns=True)
    rows = rows.withColumn("name_key", name_key(F.col("name"))).drop("name")
    # rows without a notice or a name are nobody's: each side keeps its own
    rows = rows.withColumn("apart", F.when(F.col("notice_id").isNull() | F.col("name_key").isNull(), F.col("side")))
    rows = rows.repartition(*NAME) if n is None else rows.repartition(n, *NAME)

    # records without a package belong to the bidder's one package, unless records name another one
    listed, coded, over = F.col("side") != "record", F.col("package_code") != DEFAULT, Window.partitionBy(*NAME, "apart")
    named = F.when(listed | coded, F.col("package_code"))
    rows = rows.withColumns({"lot": F.max(named).over(over), "lowest": F.min(named).over(over), "taken": F.bool_or(listed).over(over)})
    spare = F.col("taken") & (F.col("lot") == F.col("lowest"))
    rows = rows.withColumn("package_code", F.when(listed | coded | ~spare, F.col("package_code")).otherwise(F.col("lot")))
    aggs = F.bool_or(listed).alias("listed"), F.max("winner").alias("winner"), F.max("award_amount").alias("award_amount")
    per = rows.groupBy(*NAME, "apart", "package_code").agg(*aggs, *_extents(rows))
    category = F.when(~F.col("listed"), "其他").when(F.coalesce("winner", F.lit(True)), "中标人").otherwise("参与人")
    out = _settled(per.withColumn("category", category), "notice_id", "package_code", "name_key", "category", "award_amount").drop("conflicts")
    amount = F.coalesce(money.ten_thousands(F.col("award_amount")), money.ten_thousands(money.exact(F.col("bid_amount"))))
    return out.withColumn("amount_wan", amount).drop("award_amount", "bid_amount")
