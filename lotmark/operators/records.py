"""Lookups, keyed writes, event logs, review queues, merges and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmark.functions import money, states
from lotmark.functions.text import organization_key
from lotmark.operators.reviews import PRIORITY

def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def limited(limit: int, most: int = 500) -> int:
    """A limit as it was asked for; ValueError for one that is out of bounds, rather than another in silence."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be from 1 to {most}")
    return limit


def lookup(organizations: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Organizations whose name holds the query, in order of name."""
    return organizations.where(F.col("name").ilike(f"%{escaped(query)}%")).orderBy("name", "id").limit(limited(limit))


def search_items(items: DataFrame, limit: int = 100, **holds: str) -> DataFrame:
    """Items whose columns hold the given texts, the newest projects first."""
    for column, text in holds.items():
        if text:
            items = items.where(F.col(column).ilike(f"%{escaped(text)}%"))
    order = [F.desc("project_id"), "package_id", "part_id", "supplier_id", "line_no", "quantity", "total_price"]
    return items.orderBy(*order).limit(limited(limit))


def with_notices(items: DataFrame, projects: DataFrame, packages: DataFrame, organizations: DataFrame) -> DataFrame:
    """Items with their notice's buyer and budget, and the code of their package, null for items without one."""
    buyers = organizations.select(F.col("id").alias("buyer_id"), F.col("name").alias("buyer_name"))
    heads = projects.select("project_id", "buyer_id", "budget").join(buyers, "buyer_id", "left").drop("buyer_id")
    return items.join(heads, "project_id").join(packages.select("package_id", "package_code"), "package_id", "left")


def first_by_key(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in an explicit order: what inserting with "or ignore" keeps."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def unseen(df: DataFrame, receipts: DataFrame, key: str) -> DataFrame:
    """The rows without a receipt: an import that runs twice adds nothing the second time."""
    return df.join(receipts.select(key).distinct(), key, "left_anti")


def upsert_organizations(names: DataFrame) -> DataFrame:
    """One organization per key of its name: the spelling seen first, and how many there are. names: (seq, name)."""
    keyed = names.withColumn("key", organization_key(F.col("name"))).where("key <> ''")
    return keyed.groupBy("key").agg(F.min_by("name", F.struct("seq", "name")).alias("canonical_name"), F.count_distinct("name").alias("aliases"))


def content_hash(*columns: str) -> Column:
    """SHA-256 of the columns in order, null apart from ''."""
    cells = [F.concat(F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.lit("v")), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *cells), 256)


def json_list(c: Column) -> Column:
    """A JSON list of texts; empty for anything else."""
    return F.coalesce(F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>")), F.array().cast("array<string>"))


def json_object(c: Column) -> Column:
    """A JSON object of texts; empty for anything else."""
    return F.coalesce(F.when(F.trim(c).startswith("{"), F.from_json(c, "map<string,string>")), F.create_map().cast("map<string,string>"))


def latest(events: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last event of each key, as one aggregate over structs: partial results are combined before the shuffle."""
    rest = [c for c in events.columns if c not in {*keys, *order}]
    last = events.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("e"))
    return last.select(*keys, *[F.col("e").getField(c).alias(c) for c in [*order, *rest]])


def with_previous(events: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """Every event with the value before it."""
    return events.withColumn(f"previous_{value}", F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def with_epoch(events: DataFrame, keys: list[str], ends: Column, *order: str) -> DataFrame:
    """Every event with its epoch, 1 and one more after each event that ends one."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("epoch", F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(before), F.lit(0)).cast("long") + 1)


def attempts(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Every row with the number of its attempt, from 1."""
    return rows.withColumn("attempt", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def backfilled(rows: DataFrame, additions: DataFrame, receipts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the additions of keys that have no receipt, the receipts to add): a backfill that runs twice adds once. The
    rows before it are the backup, as tables are written anew and never in place."""
    new = unseen(additions, receipts, key)
    return rows.unionByName(new, allowMissingColumns=True), new.select(key).distinct()


def filled_down(rows: DataFrame, keys: list[str], value: Column, name: str, *order: str) -> DataFrame:
    """The last value that isn't null, at or above each row: a package heading holds until the next."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(frame))


def review_reasons(candidates: DataFrame, fields: list[str]) -> DataFrame:
    """Candidates with `reasons`, sorted codes joined by commas, and `priority`, the least; those without any go.

    Amounts conflict if quantity times unit price isn't the total exactly; a missing factor is no conflict.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    missing = F.lit(False)
    for field in fields:
        missing = missing | blank(field)
    conflict = F.coalesce((F.col("quantity") * F.col("unit_price")).cast(money.EXACT) != F.col("total_price").cast(money.EXACT), F.lit(False))
    found = {"field_missing": missing, "numeric_conflict": conflict, "default_package": F.col("package_code") == "default", "source_file_missing": blank("source_file")}
    codes = F.array_compact(F.array(*[F.when(hit, code) for code, hit in sorted(found.items())]))
    least = F.least(*[F.when(hit, PRIORITY[code]) for code, hit in found.items()])
    out = candidates.withColumn("reasons", F.array_join(codes, ",")).withColumn("priority", least.cast("long"))
    return out.where("reasons <> ''")


def merged(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key: a value on which all rows agree stays, of several none, and `conflict` says so."""
    aggs = [x for v in values for x in (F.min(v).alias(v), F.max(v).alias(f"_{v}"))]
    out = df.groupBy(*keys).agg(*aggs)
    conflict = F.lit(False)
    for v in values:
        conflict = conflict | F.coalesce(F.col(v) != F.col(f"_{v}"), F.lit(False))
    kept = [F.when(F.col(v) == F.col(f"_{v}"), F.col(v)).alias(v) for v in values]
    return out.select(*keys, *kept, conflict.alias("conflict"))


def dedup_participants(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One participant per key: a known outcome beats unknown, winner against nonwinner is unknown without an amount;
    else the amount is the one stated, the largest if several are."""
    won, lost = F.bool_or(F.col("outcome") == "winner"), F.bool_or(F.col("outcome") == "nonwinner")
    out = rows.groupBy(*keys).agg(won.alias("w"), lost.alias("l"), F.max("amount").alias("amount"), F.count("*").alias("n_rows"))
    outcome = F.when(F.col("w") & F.col("l"), "unknown").when(F.col("w"), "winner").when(F.col("l"), "nonwinner").otherwise("unknown")
    return out.select(*keys, outcome.alias("outcome"), F.when(~(F.col("w") & F.col("l")), F.col("amount")).alias("amount"), "n_rows")


def export_totals(bids: DataFrame, packages: DataFrame, projects: DataFrame) -> DataFrame:
    """A row per award; for a package without one, a row without supplier, whose amount is the project's budget if it
    is the project's only package. Amounts in 万元."""
    won = bids.where("outcome = 'winner'").select("package_id", F.col("organization_id").alias("supplier_id"), "award_amount")
    lots = packages.withColumn("n", F.count("*").over(Window.partitionBy("project_id")))
    rows = lots.join(projects.select("project_id", "budget"), "project_id").join(won, "package_id", "left")
    amount = F.when(F.col("supplier_id").isNotNull(), F.col("award_amount")).when(F.col("n") == 1, F.col("budget"))
    return rows.select("project_id", "package_id", "supplier_id", money.ten_thousands(amount).alias("amount_wan"))


def export_items(items: DataFrame) -> DataFrame:
    """Items with prices in 万元, not rounded to two places."""
    wan = lambda c: money.ten_thousands(F.col(c), None).cast("decimal(38,6)")
    return items.select("project_id", "package_id", "part_id", "supplier_id", "line_no", "brand", "product_name", "quantity", wan("unit_price").alias("unit_price_wan"), wan("total_price").alias("total_price_wan"))


def export_bidders(bids: DataFrame, organizations: DataFrame) -> DataFrame:
    """Participants with their category, 中标人 or 参与人, and amount in 万元."""
    names = organizations.select(F.col("id").alias("organization_id"), "name")
    category = F.when(F.col("outcome") == "winner", "中标人").otherwise("参与人")
    return bids.join(names, "organization_id").select("project_id", "package_id", "organization_id", "name", category.alias("category"), money.ten_thousands(F.col("award_amount")).alias("amount_wan"))


def source_states(sources: DataFrame, keys: list[str], sha256: str) -> DataFrame:
    """Per source, its number of hashes and what that means."""
    out = sources.groupBy(*keys).agg(F.count_distinct(sha256).alias("hashes"))
    return out.withColumn("status", states.source_status(F.col("hashes")))
