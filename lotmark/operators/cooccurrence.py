"""Sets of organizations that meet in many baskets: pairs first, then triples of which all pairs are frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotmark.operators.linking import checkpoint

#: Members of a basket that meet in one task; larger baskets are dealt out by pairs of blocks.
BLOCK = 256


def frequent_members(rows: DataFrame, least: int) -> DataFrame:
    """(basket, member), distinct, of members that at least `least` baskets have."""
    rows = rows.where("basket is not null and member is not null").select("basket", "member").distinct()
    often = rows.groupBy("member").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return rows.join(often.select("member"), "member", "left_semi")


def meetings(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(basket, a, b), a < b, of distinct (basket, member). Baskets of more than `block` members meet block by block, so no task
    holds all pairs of a large one."""
    sizes = rows.groupBy("basket").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = rows.join(sizes, "basket").withColumn("k", F.pmod(F.xxhash64("member"), F.col("blocks")))
    left = dealt.select("basket", F.col("member").alias("a"), F.col("k").alias("i"), F.explode(F.sequence("k", F.col("blocks") - 1)).alias("j"))
    right = dealt.select("basket", F.col("member").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k"))).alias("i"), F.col("k").alias("j"))
    met = left.join(right, ["basket", "i", "j"]).where("i < j or a < b")
    return met.select("basket", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def pairs(rows: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(frequent, met): (a, b, support) with at least `least` baskets, and (basket, a, b) of these pairs."""
    met = checkpoint(meetings(frequent_members(rows, least)))
    frequent = checkpoint(met.groupBy("a", "b").agg(F.count("*").alias("support")).where(F.col("support") >= least))
    return frequent, met.join(frequent.select("a", "b"), ["a", "b"], "left_semi")


def triples(rows: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, c, support), a < b < c, of members that meet in at least `least` baskets.

    Candidates are triples of which all three pairs are frequent; only they are looked for in baskets. A basket's pairs meet by
    their first member, so the work follows the frequent pairs in baskets, not all triples.
    """
    frequent, met = pairs(rows, least)
    ab, ac = frequent.select("a", "b"), frequent.select("a", F.col("b").alias("c"))
    bc = frequent.select(F.col("a").alias("b"), F.col("b").alias("c"))
    candidates = checkpoint(ab.join(ac, "a").where("b < c").join(bc, ["b", "c"], "left_semi").select("a", "b", "c"))
    first = met.join(candidates.select("a", "b").distinct(), ["a", "b"], "left_semi")
    second = met.select("basket", "a", F.col("b").alias("c")).join(candidates.select("a", "c").distinct(), ["a", "c"], "left_semi")
    found = first.join(second, ["basket", "a"]).where("b < c").join(candidates, ["a", "b", "c"], "left_semi")
    return found.groupBy("a", "b", "c").agg(F.count("*").alias("support")).where(F.col("support") >= least)
