"""Notices as wholes: import into tables, checks of what comes in, and the page of one notice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lotmark.functions.codes import DEFAULT
from lotmark.functions.text import organization_key
from lotmark.operators import records

TEXT, MONEY = T.StringType(), T.DecimalType(38, 6)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ITEM = _struct(product_name=TEXT, category=TEXT, brand=TEXT, model=TEXT, quantity=MONEY, unit_price=MONEY, total_price=MONEY)
BIDDER = _struct(name=TEXT, outcome=TEXT)
WINNER = _struct(name=TEXT, amount=MONEY)
PACKAGE = _struct(package_code=TEXT, package_name=TEXT, items=T.ArrayType(ITEM), bidders=T.ArrayType(BIDDER), winners=T.ArrayType(WINNER))
#: What an import takes: one row per notice.
NOTICE = _struct(
    source_key=TEXT, project_name=TEXT, project_number=TEXT, buyer=TEXT, budget=MONEY, warnings=T.ArrayType(TEXT), sources=T.ArrayType(_struct(source_file=TEXT, sha256=TEXT, byte_size=T.LongType())), packages=T.ArrayType(PACKAGE)
)
OUTCOMES = ("winner", "nonwinner", "unknown")


def _id(*columns) -> Column:
    """A stable id of a row's key: the same import gives the same ids, in any order and on any cluster."""
    return F.xxhash64(*columns)


def imported(batch: DataFrame, receipts: DataFrame) -> dict[str, DataFrame]:
    """The rows that a batch of notices (NOTICE) adds, by table; notices whose source_key has a receipt add none, and of equal
    keys in a batch one is taken. Within a notice the first of equal keys wins: packages by code, bidders and winners by
    package and organization, sources by name and hash. Winners who aren't listed as bidders are added to them."""
    fresh = records.unseen(batch, receipts, "source_key")
    # a notice's rows stay where it lies: whatever is taken once is taken by source_key and more. Where no key comes twice, nothing needs
    # all columns to tell equal keys apart
    new = fresh
    if not fresh.groupBy("source_key").count().where("count > 1").isEmpty():
        new = records.first_by_key(fresh, ["source_key"], F.xxhash64(*batch.columns))
    new = new.withColumn("notice_id", _id("source_key"))
    sources = new.select("source_key", "notice_id", F.explode("sources").alias("s")).select("source_key", "notice_id", "s.*").dropDuplicates(["source_key", "notice_id", "source_file", "sha256"]).drop("source_key")
    lots = new.select("source_key", "notice_id", F.posexplode("packages").alias("pos", "p")).withColumn("package_code", F.coalesce(F.nullif(F.trim("p.package_code"), F.lit("")), F.lit(DEFAULT)))
    lots = records.first_by_key(lots, ["source_key", "package_code"], "pos").withColumn("package_id", _id("notice_id", "package_code"))
    people = lambda name: lots.select("source_key", "notice_id", "package_id", F.posexplode(f"p.{name}").alias("seq", "x")).select("source_key", "notice_id", "package_id", "seq", "x.*").withColumn("key", organization_key(F.col("name"))).where("key <> ''")
    winners = records.first_by_key(people("winners"), ["source_key", "package_id", "key"], "seq")
    # winners come behind the bidders, in the same array
    listed = F.transform("p.bidders", lambda x: F.struct(x["name"].alias("name"), F.coalesce(x["outcome"], F.lit("unknown")).alias("outcome")))
    added = F.transform("p.winners", lambda x: F.struct(x["name"].alias("name"), F.lit("winner").alias("outcome")))
    none = F.array().cast("array<struct<name:string,outcome:string>>")
    bidders = lots.select("source_key", "notice_id", "package_id", F.posexplode(F.concat(F.coalesce(listed, none), F.coalesce(added, none))).alias("seq", "x"))
    bidders = bidders.select("source_key", "notice_id", "package_id", "seq", "x.*").withColumn("key", organization_key(F.col("name"))).where("key <> ''")
    bidders = records.first_by_key(bidders, ["source_key", "package_id", "key"], "seq")
    buyers = new.select("notice_id", organization_key(F.col("buyer")).alias("key"), F.col("buyer").alias("name")).where("key <> ''")
    names = bidders.select("notice_id", "key", "name").unionByName(buyers)
    organizations = names.groupBy("key").agg(F.min_by("name", F.struct("notice_id", "name")).alias("canonical_name")).select(_id("key").alias("organization_id"), "canonical_name", F.col("key").alias("normalized_name"))
    return {
        "receipts": new.select("source_key", "notice_id"),
        "notices": new.select("notice_id", "project_name", "project_number", "buyer", "budget", "warnings"),
        "notice_sources": sources,
        "organizations": organizations,
        "organization_aliases": names.select(_id("key").alias("organization_id"), F.col("name").alias("raw_name"), "notice_id").distinct(),
        "projects": new.select("notice_id", F.when(organization_key(F.col("buyer")) != "", _id(organization_key(F.col("buyer")))).alias("buyer_organization_id"), "budget"),
        "packages": lots.select("package_id", "notice_id", "package_code", F.col("p.package_name").alias("package_name")),
        "bid_participations": bidders.select("package_id", _id("key").alias("organization_id"), F.col("name").alias("raw_name"), "outcome"),
        "awards": winners.select("package_id", _id("key").alias("organization_id"), F.col("name").alias("raw_name"), F.col("amount").alias("award_amount")),
        "procurement_items": lots.select("notice_id", "package_id", F.posexplode("p.items").alias("item_no", "i")).select("notice_id", "package_id", "item_no", "i.*"),
    }


def totals(batch: DataFrame, receipts: DataFrame) -> DataFrame:
    """One row of counters for a batch: notices, new ones, those seen before, packages, items."""
    seen = receipts.select("source_key").distinct().withColumn("seen", F.lit(True))
    rows = batch.join(seen, "source_key", "left")
    fresh = F.col("seen").isNull()
    n_items = F.aggregate(F.coalesce("packages", F.array().cast(T.ArrayType(PACKAGE))), F.lit(0), lambda s, p: s + F.greatest(F.size(p["items"]), F.lit(0)))
    return rows.agg(F.count("*").alias("notices"), F.count_if(fresh).alias("imported"), F.count_if(~fresh).alias("seen"), F.sum(F.when(fresh, F.greatest(F.size("packages"), F.lit(0)))).alias("packages"), F.sum(F.when(fresh, n_items)).alias("items"))


def rejected(batch: DataFrame) -> DataFrame:
    """(source_key, problem): what a strict import refuses: unknown outcomes, blank names, negative amounts, package codes that
    come twice, and sources without a hash."""
    lots = batch.select("source_key", F.explode("packages").alias("p"))
    codes = F.transform("packages", lambda p: F.coalesce(F.nullif(F.trim(p["package_code"]), F.lit("")), F.lit(DEFAULT)))
    coded = batch.select("source_key", codes.alias("codes"))
    repeated = F.filter(F.array_distinct("codes"), lambda c: F.size(F.filter("codes", lambda d: d == c)) > 1)
    twice = coded.select("source_key", F.explode(repeated).alias("code")).select("source_key", F.concat(F.lit("repeated package "), "code").alias("problem"))
    people = lots.select("source_key", F.explode("p.bidders").alias("b"))
    outcome = people.where(~F.coalesce(F.col("b.outcome").isin(*OUTCOMES), F.lit(False))).select("source_key", F.lit("unknown outcome").alias("problem"))
    blank = people.where(F.coalesce(F.trim("b.name"), F.lit("")) == "").select("source_key", F.lit("blank name").alias("problem"))
    money = lots.select("source_key", F.explode("p.winners").alias("w")).where("w.amount < 0").select("source_key", F.lit("negative amount").alias("problem"))
    source = batch.select("source_key", F.explode("sources").alias("s")).where(~F.coalesce(F.col("s.sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))).select("source_key", F.lit("source without hash").alias("problem"))
    out = twice
    for part in (outcome, blank, money, source):
        out = out.unionByName(part)
    return out.distinct()


def unreferenced(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(notice_id, source_file) that rows name and no fingerprinted source of their notice has: an import needs none."""
    return rows.select("notice_id", "source_file").where("source_file is not null").distinct().join(sources, ["notice_id", "source_file"], "left_anti")


def scope_id(path: Column) -> Column:
    """The id of a dataset, from the last part of its path; `default` for anything but 32 hex digits."""
    leaf = F.regexp_extract(path, "([^/]+?)(?:[.][^./]*)?/?$", 1)
    return F.when(leaf.rlike("^[0-9a-f]{32}$"), leaf).otherwise(F.lit("default"))


def detail(projects: DataFrame, packages: DataFrame, items: DataFrame, bids: DataFrame, organizations: DataFrame) -> DataFrame:
    """One row per project, the page of a notice: buyer, budget, and its packages in order of id, each with its items, its
    participants with outcomes, and its awards with amounts. Each part is aggregated by package where it lies; a page's
    parts are as many as its document lists."""
    names = organizations.select(F.col("id").alias("organization_id"), "name")
    named = bids.join(names, "organization_id")
    people = named.groupBy("package_id").agg(
        F.array_sort(F.collect_list(F.struct("organization_id", "name", "outcome"))).alias("participants"),
        F.array_sort(F.collect_list(F.when(F.col("outcome") == "winner", F.struct("organization_id", "name", "award_amount")))).alias("awards"),
    )
    things = items.groupBy("package_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "part_id", "product_name", "brand", "quantity", "unit_price", "total_price"))).alias("items"))
    lots = packages.join(things, "package_id", "left").join(people, "package_id", "left")
    per = lots.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("package_id", "package_code", "items", "participants", "awards"))).alias("packages"))
    buyers = organizations.select(F.col("id").alias("buyer_id"), F.col("name").alias("buyer_name"))
    return projects.join(per, "project_id", "left").join(buyers, "buyer_id", "left").select("project_id", "buyer_id", "buyer_name", "budget", "packages")


def display_name(name: Column, number: Column, fallback: str) -> Column:
    """What is shown for something: its name, else its number, else the fallback."""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.nullif(F.trim(number), F.lit("")), F.lit(fallback))


def properties(**columns: Column) -> Column:
    """A map of the columns that aren't null, as text."""
    pairs = [x for k, c in columns.items() for x in (F.lit(k), c.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def numbered(rows: DataFrame, within: list[str], *order: Column | str) -> DataFrame:
    """rows with sheet_no, from 1 in the order of their sheet."""
    return rows.withColumn("sheet_no", F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("long"))


def skeletons(predicted: DataFrame) -> DataFrame:
    """Gold skeletons for annotation from documents (content, packages): an id from the content's SHA-256, one per content,
    with package codes and nothing filled in."""
    made = predicted.withColumn("notice_id", F.substring(F.sha2("content", 256), 1, 20))
    first = records.first_by_key(made, ["notice_id"], F.xxhash64("path"), "path")
    return first.select("notice_id", "path", F.transform("packages", lambda p: F.struct(p.alias("package_code"), F.lit(None).cast("string").alias("buyer"))).alias("packages"), F.lit("draft").alias("status"))
