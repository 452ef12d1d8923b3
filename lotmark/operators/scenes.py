"""Relationship scenes over bids: one row per (package, organization), each package in one project.

All scenes run for every buyer or supplier at once; a filter on the result's key for one of them is pushed
below the aggregation by Catalyst. Counts of projects are made in two steps, per project and then over
projects: no distinct aggregate expands the rows, and the first step runs where the bids lie. Money is summed
once per award, and items never meet awards before both are aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmark.sources.tables import TOTAL

TOP = 100


def selected(bids: DataFrame, include_winners: bool = True) -> DataFrame:
    """All bids, or those alone that were lost for certain: an unknown outcome is no loss."""
    return bids if include_winners else bids.where("outcome = 'nonwinner'")


def awards(bids: DataFrame) -> DataFrame:
    return bids.where("outcome = 'winner'")


def over_projects(df: DataFrame, *keys: str, amount: str | None = None) -> DataFrame:
    """keys, projects, packages and, with an amount, award_total; df has a row per package."""
    first = [F.count("*").alias("packages")] + ([F.sum(amount).alias("award_total")] if amount else [])
    per = df.groupBy("project_id", *keys).agg(*first)
    then = [F.count("*").alias("projects"), F.sum("packages").alias("packages")] + ([F.sum("award_total").cast(TOTAL).alias("award_total")] if amount else [])
    return per.groupBy(*keys).agg(*then)


def top(df: DataFrame, within: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their `place` from 1; order must leave no ties."""
    if not 1 <= k <= TOP:
        raise ValueError(f"k must be from 1 to {TOP}")
    return df.withColumn("place", F.row_number().over(Window.partitionBy(within).orderBy(*order)).cast("long")).where(F.col("place") <= k)


def named(df: DataFrame, organizations: DataFrame, key: str, name: str) -> DataFrame:
    return df.join(organizations.select(F.col("id").alias(key), F.col("name").alias(name)), key)


def buyer_awardees(bids: DataFrame, items: DataFrame, organizations: DataFrame) -> DataFrame:
    """Who wins for each buyer: projects, packages, disclosed total, and the brands of the packages won."""
    won = awards(bids)
    stats = over_projects(won, "buyer_id", "organization_id", amount="award_amount")
    lots = won.select("package_id", "buyer_id", "organization_id")
    brands = items.where("trim(brand) <> ''").select("package_id", "brand").distinct().join(lots, "package_id")
    brands = brands.groupBy("buyer_id", "organization_id").agg(F.array_join(F.array_sort(F.collect_set("brand")), ",").alias("brands"))
    return named(stats.join(brands, ["buyer_id", "organization_id"], "left"), organizations, "organization_id", "organization_name")


def brand_suppliers(items: DataFrame) -> DataFrame:
    """Brands that each buyer gets: projects, packages, items and the disclosed total of their prices."""
    cut = items.where("trim(brand) <> ''").withColumn("brand", F.trim("brand"))
    per = cut.groupBy("project_id", "package_id", "buyer_id", "brand").agg(F.count("*").alias("n"), F.sum("total_price").alias("t"))
    per = per.groupBy("project_id", "buyer_id", "brand").agg(F.count("*").alias("packages"), F.sum("n").alias("n"), F.sum("t").alias("t"))
    return per.groupBy("buyer_id", "brand").agg(
        F.count("*").alias("projects"), F.sum("packages").alias("packages"), F.sum("n").alias("n_items"), F.sum("t").cast(TOTAL).alias("disclosed_total")
    )


def brand_evidence(items: DataFrame) -> DataFrame:
    """buyer_id, brand, evidence: the items of each brand that a buyer got, each once, in order of project, package and part."""
    cut = items.where("trim(brand) <> ''").select("buyer_id", F.trim("brand").alias("brand"), "project_id", "package_id", "part_id").distinct()
    return cut.groupBy("buyer_id", "brand").agg(F.array_sort(F.collect_list(F.struct("project_id", "package_id", "part_id"))).alias("evidence"))


def buyer_bidders(bids: DataFrame, organizations: DataFrame, k: int = 5, include_winners: bool = True) -> DataFrame:
    """The k organizations that bid in most projects of each buyer; ties by name, then id."""
    counted = over_projects(selected(bids, include_winners), "buyer_id", "organization_id").drop("packages")
    ranked = named(counted, organizations, "organization_id", "organization_name")
    return top(ranked, "buyer_id", [F.desc("projects"), F.col("organization_name"), F.col("organization_id")], k)


def pairs(bids: DataFrame, include_winners: bool = True) -> DataFrame:
    """Organizations that bid for the same package: left_id < right_id, with the package's columns."""
    b = selected(bids, include_winners).select("project_id", "package_id", "buyer_id", "created_at", "organization_id")
    other = b.select(F.col("project_id").alias("_project"), F.col("package_id").alias("_package"), F.col("organization_id").alias("right_id"))
    # as two bounds, the package is no key of the join, and bids meet where they lie, by project
    same = (F.col("package_id") <= F.col("_package")) & (F.col("package_id") >= F.col("_package"))
    met = b.withColumnRenamed("organization_id", "left_id").join(other, (F.col("project_id") == F.col("_project")) & same & (F.col("left_id") < F.col("right_id")))
    return met.drop("_project", "_package")


def buyer_pairs(bids: DataFrame, organizations: DataFrame, k: int = 10, include_winners: bool = True) -> DataFrame:
    """The k pairs that bid together in most projects of each buyer; ties by their names, then ids."""
    counted = over_projects(pairs(bids, include_winners), "buyer_id", "left_id", "right_id").drop("packages")
    ranked = named(named(counted, organizations, "left_id", "left_name"), organizations, "right_id", "right_name")
    return top(ranked, "buyer_id", [F.desc("projects"), F.col("left_name"), F.col("right_name"), F.col("left_id"), F.col("right_id")], k)


def _against(bids: DataFrame, include_winners: bool) -> DataFrame:
    won = awards(bids).select("project_id", "package_id", "package_code", "award_amount", F.col("organization_id").alias("supplier_id"))
    other = selected(bids, include_winners).select("package_id", F.col("organization_id").alias("co_bidder_id"), "outcome")
    return won.join(other, "package_id")


def co_bidders(bids: DataFrame, include_winners: bool = True) -> DataFrame:
    """Who bid against each winner in the packages it won, with the winner's total in them."""
    met = _against(bids, include_winners).where("supplier_id <> co_bidder_id")
    return over_projects(met, "supplier_id", "co_bidder_id", amount="award_amount")


def won_packages(bids: DataFrame) -> DataFrame:
    """Every package that a supplier won, with a row for each participant, whatever its outcome."""
    return _against(bids, True).withColumnRenamed("co_bidder_id", "participant_id")


def common_buyers(bids: DataFrame, suppliers: list[int]) -> DataFrame:
    """Buyers from whom all the suppliers have won: a row per supplier, and one without supplier for the buyer."""
    wanted = sorted(set(suppliers))
    picked = awards(bids).where(F.col("organization_id").isin(wanted))
    per = over_projects(picked, "buyer_id", "organization_id", amount="award_amount")
    common = per.groupBy("buyer_id").count().where(F.col("count") == len(wanted)).select("buyer_id")
    total = over_projects(picked.join(common, "buyer_id", "left_semi"), "buyer_id", amount="award_amount")
    return per.join(common, "buyer_id", "left_semi").unionByName(total.withColumn("organization_id", F.lit(None).cast("long")))


def common_packages(bids: DataFrame, suppliers: list[int]) -> DataFrame:
    """Packages for which all the suppliers bid, with the awards in them: rows for packages, projects, and all."""
    wanted = sorted(set(suppliers))
    picked = bids.where(F.col("organization_id").isin(wanted)).groupBy("package_id").count().where(F.col("count") == len(wanted))
    lots = bids.join(picked.select("package_id"), "package_id", "left_semi")
    won = F.col("outcome") == "winner"
    per = lots.groupBy("project_id", "package_id").agg(F.count_if(won).alias("awards"), F.sum(F.when(won, F.col("award_amount"))).alias("award_total"))
    rolled = per.rollup("project_id", "package_id").agg(F.grouping_id().alias("g"), F.count("*").alias("packages"), F.sum("awards").alias("awards"), F.sum("award_total").cast(TOTAL).alias("award_total"))
    level = F.when(F.col("g") == 0, "package").when(F.col("g") == 1, "project").otherwise("all")
    return rolled.select(level.alias("level"), "project_id", "package_id", "packages", "awards", "award_total").where("packages > 0")
