"""Relation clues: hints with their measures, for people to look into."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotmark.operators.scenes import awards, pairs, selected

KINDS = ("common_bidding", "repeat_cooperation", "supplier_distribution", "buyer_network")
LIMIT = 500


def common_bidding(bids: DataFrame, include_winners: bool = True) -> DataFrame:
    """Every pair that bid for the same package: projects, packages, first and last date."""
    per = pairs(bids, include_winners).groupBy("project_id", "left_id", "right_id").agg(F.count("*").alias("n"), F.min("created_at").alias("a"), F.max("created_at").alias("b"))
    out = per.groupBy("left_id", "right_id").agg(F.count("*").alias("projects"), F.sum("n").alias("packages"), F.min("a").alias("first_at"), F.max("b").alias("last_at"))
    return out.withColumn("clue_id", F.concat(F.lit("common-bidding:"), "left_id", F.lit("-"), "right_id"))


def first(df: DataFrame, limit: int, *order) -> DataFrame:
    if not 1 <= limit <= LIMIT:
        raise ValueError(f"limit must be from 1 to {LIMIT}")
    return df.orderBy(*order).limit(limit)


def repeat_cooperation(bids: DataFrame, least: int = 2, limit: int = LIMIT, include_winners: bool = True) -> DataFrame:
    """The pairs with at least `least` common projects; the limit comes after, on the whole list."""
    if not 2 <= least <= 100:
        raise ValueError("least must be from 2 to 100")
    found = common_bidding(bids, include_winners).where(F.col("projects") >= least)
    found = found.withColumn("clue_id", F.concat(F.lit("repeat-cooperation:"), "left_id", F.lit("-"), "right_id"))
    return first(found, limit, F.desc("projects"), F.desc("packages"), "clue_id")


def _both(bids: DataFrame, *keys: str, include_winners: bool) -> DataFrame:
    """Participations and awards counted side by side: one pass over bids, as awards are bids too."""
    joined = (F.col("outcome") == "nonwinner") if not include_winners else F.lit(True)
    won = F.col("outcome") == "winner"
    per = bids.where(joined | won).groupBy("project_id", *keys).agg(F.count_if(joined).alias("p"), F.count_if(won).alias("w"))
    return per.groupBy(*keys).agg(
        F.count_if(F.col("p") > 0).alias("participation_projects"),
        F.count_if(F.col("w") > 0).alias("award_projects"),
        F.sum("p").alias("participation_packages"),
        F.sum("w").alias("award_packages"),
    )


def supplier_distribution(bids: DataFrame, include_winners: bool = True) -> DataFrame:
    """How each supplier's participations and awards spread."""
    out = _both(bids, "organization_id", include_winners=include_winners)
    return out.withColumn("clue_id", F.concat(F.lit("supplier-distribution:"), "organization_id"))


def buyer_network(bids: DataFrame, include_winners: bool = True) -> DataFrame:
    """The same for every buyer and supplier; projects without a buyer are in no edge."""
    out = _both(bids.where("buyer_id is not null"), "buyer_id", "organization_id", include_winners=include_winners)
    return out.withColumn("clue_id", F.concat(F.lit("buyer-network:"), "buyer_id", F.lit("-"), "organization_id"))


def envelope(bids: DataFrame, include_winners: bool = True) -> DataFrame:
    """All clues in one frame: kind, clue_id, projects, packages. Pairs are found once for both of their kinds."""
    pair = common_bidding(bids, include_winners).drop("clue_id")
    kinds = F.when(F.col("projects") >= 2, F.array(*map(F.lit, KINDS[:2]))).otherwise(F.array(F.lit(KINDS[0])))
    both = pair.withColumn("kind", F.explode(kinds)).withColumn("clue_id", F.concat(F.replace("kind", F.lit("_"), F.lit("-")), F.lit(":"), "left_id", F.lit("-"), "right_id"))
    out = both.select("kind", "clue_id", "projects", "packages")
    for kind, found in zip(KINDS[2:], (supplier_distribution, buyer_network), strict=True):
        part = found(bids, include_winners).withColumnsRenamed({"participation_projects": "projects", "participation_packages": "packages"})
        out = out.unionByName(part.select(F.lit(kind).alias("kind"), "clue_id", "projects", "packages"))
    return out


def references(bids: DataFrame) -> DataFrame:
    """Per supplier: its first and last project by date, then id, and the time between."""
    at = F.struct("created_at", "project_id")
    out = bids.groupBy("organization_id").agg(F.min(at).alias("a"), F.max(at).alias("b"))
    return out.select("organization_id", F.col("a.project_id").alias("first_project"), F.col("a.created_at").alias("first_at"), F.col("b.project_id").alias("last_project"), F.col("b.created_at").alias("last_at"))


def warnings(bids: DataFrame, include_winners: bool = True) -> DataFrame:
    """Per supplier, whether records lack a package code or a disclosed amount."""
    b = selected(bids, include_winners)
    undisclosed = (F.col("outcome") == "winner") & F.col("award_amount").isNull()
    return b.groupBy("organization_id").agg(F.bool_or(F.coalesce(F.col("package_code"), F.lit("default")) == "default").alias("default_package"), F.bool_or(undisclosed).alias("amount_missing"))


def source_projects(bids: DataFrame, organization_id: int, limit: int = 100) -> DataFrame:
    """The newest projects in which an organization bid or which it bought."""
    mine = bids.where((F.col("organization_id") == organization_id) | (F.col("buyer_id") == organization_id))
    return mine.select("project_id", "created_at").distinct().orderBy(F.desc("created_at"), F.desc("project_id")).limit(limit)


def won_without_loss(bids: DataFrame) -> DataFrame:
    """Suppliers and buyers where the supplier won and never lost for certain: an anti-join."""
    lost = selected(bids, False).select("buyer_id", "organization_id").distinct()
    return awards(bids).select("buyer_id", "organization_id").distinct().join(lost, ["buyer_id", "organization_id"], "left_anti")


#: What each kind counts, for whoever reads a clue.
DEFINITIONS = {
    "common_bidding": "pairs that bid for the same package; projects and packages count once each",
    "repeat_cooperation": "pairs that did so in at least as many projects as asked for; projects count once",
    "supplier_distribution": "a supplier's participations and awards; projects and packages count once each",
    "buyer_network": "a supplier's participations and awards at one buyer; projects and packages count once each",
}
#: Words of warnings that concern scans, and attachments that could not be read.
SCANS = "ocr|文字识别|扫描"
UNREAD = "解析|失败|不支持|不可用|无法"


def scopes(include_winners: bool = True) -> list[tuple]:
    """(kind, definition, outcomes) of all kinds: which participations were counted."""
    outcomes = "winner,nonwinner,unknown" if include_winners else "nonwinner"
    return [(kind, DEFINITIONS[kind], outcomes) for kind in KINDS]


def members(bids: DataFrame, include_winners: bool = True) -> DataFrame:
    """(kind, clue_id, role, organization_id, project_id, package_id, created_at, outcome): the participations behind the clues.
    A pair's clue has those of both in their common packages, a supplier's all of its own, an edge those at its buyer."""
    b = selected(bids, include_winners)
    cols = ["project_id", "package_id", "buyer_id", "created_at"]
    both = pairs(bids, include_winners).select(*cols, "left_id", "right_id", F.concat(F.lit("common-bidding:"), "left_id", F.lit("-"), "right_id").alias("clue_id"))
    sides = both.select("clue_id", *cols, F.explode(F.array("left_id", "right_id")).alias("organization_id")).withColumn("kind", F.lit("common_bidding"))
    own = b.select(F.concat(F.lit("supplier-distribution:"), "organization_id").alias("clue_id"), *cols, "organization_id", F.lit("supplier_distribution").alias("kind"))
    edge = b.where("buyer_id is not null").select(F.concat(F.lit("buyer-network:"), "buyer_id", F.lit("-"), "organization_id").alias("clue_id"), *cols, "organization_id", F.lit("buyer_network").alias("kind"))
    return sides.unionByName(own).unionByName(edge)


#: A day's place in an order by date and id is this many times its number; ids are smaller. Undated rows come last.
DAY, UNDATED = Decimal(10**20), 2**31 - 1


def _spans(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, projects, packages, first_at, first_project, last_at, last_project of rows of packages, by project first. Dates and
    ids are compared as one number: least structs would have the rows sorted."""
    per = rows.groupBy("project_id", *keys).agg(F.min("created_at").alias("at"), F.count_distinct("package_id").alias("n"))
    per = per.withColumn("day", F.coalesce(F.unix_date("at"), F.lit(UNDATED)))
    place = lambda day: F.col(day).cast("decimal(10,0)") * F.lit(DAY)
    per = per.withColumn("place", place("day") + F.col("project_id").cast("decimal(20,0)"))
    ends = [f(c).alias(f"{name}_{c}") for name, f in (("first", F.min), ("last", F.max)) for c in ("at", "day", "place")]
    out = per.groupBy(*keys).agg(F.count("*").alias("projects"), F.sum("n").alias("packages"), *ends)
    project = lambda end: (F.col(f"{end}_place") - place(f"{end}_day")).cast("long").alias(f"{end}_project")
    return out.select(*keys, "projects", "packages", "first_at", project("first"), "last_at", project("last"))


def evidence(bids: DataFrame, include_winners: bool = True) -> DataFrame:
    """Per clue of members(): its entities, first and last date, how many projects and packages, and the first project of each
    end, by date and id. Clues are counted by their ids, a kind at a time, and named after that."""
    b = selected(bids, include_winners)
    kinds = (
        ("common_bidding", pairs(bids, include_winners), ["left_id", "right_id"], ["left_id", "right_id"]),
        ("supplier_distribution", b, ["organization_id"], ["organization_id"]),
        ("buyer_network", b.where("buyer_id is not null"), ["buyer_id", "organization_id"], ["organization_id"]),
    )
    out = None
    for kind, rows, keys, entities in kinds:
        clue_id = F.concat(F.lit(kind.replace("_", "-") + ":"), F.concat_ws("-", *keys)).alias("clue_id")
        part = _spans(rows, *keys).select(F.lit(kind).alias("kind"), clue_id, F.array(*entities).alias("entities"), "projects", "packages", "first_at", "first_project", "last_at", "last_project")
        out = part if out is None else out.unionByName(part)
    return out


def warning_categories(found: DataFrame, notices: DataFrame, records: DataFrame) -> DataFrame:
    """(kind, clue_id, ocr, attachment, insufficient_evidence, default_package) of members(): whether a notice of the clue warns of
    scans or of attachments that weren't read, whether a record lacks file, place or quote, or a package its code.

    notices: project_id, warnings; records: package_id, organization_id, package_code, source_file, source_location,
    source_evidence."""
    said = F.concat_ws("\n", F.transform("warnings", lambda w: F.lower(w)))
    flags = notices.select("project_id", said.rlike(SCANS).alias("ocr"), (F.exists("warnings", lambda w: w.contains("附件") & w.rlike(UNREAD)) | said.contains("attachment")).alias("attachment"))
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    marks = records.select("package_id", "organization_id", (blank("source_file") | blank("source_location") | blank("source_evidence")).alias("bare"), (F.lower(F.trim(F.coalesce("package_code", F.lit("default")))) == "default").alias("unnamed"))
    rows = found.join(flags, "project_id", "left").join(marks, ["package_id", "organization_id"], "left")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return rows.groupBy("kind", "clue_id").agg(any_("ocr").alias("ocr"), any_("attachment").alias("attachment"), any_("bare").alias("insufficient_evidence"), any_("unnamed").alias("default_package"))


def evidence_links(records: DataFrame) -> DataFrame:
    """records (record_type, record_id, ...), each once, with link_status: available if there is a quote, else missing."""
    status = F.when(F.coalesce(F.trim("source_evidence"), F.lit("")) != "", "available").otherwise("missing")
    return records.dropDuplicates(["record_type", "record_id"]).withColumn("link_status", status)
