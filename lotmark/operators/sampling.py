"""Samples for annotation: quotas by category, and two balanced halves.

Both choose a number of notices that people can read, so the choice is made over the few with the smallest hashes of
each category, which Spark ranks; only those come to the driver.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ticket(seed: int, ident: object) -> str:
    return hashlib.sha256(f"{seed}:{ident}".encode()).hexdigest()


def stratified(notices: DataFrame, size: int, seed: int = 0) -> list:
    """Up to `size` ids of notices (notice_id, categories), every category as evenly as possible: the next one is always of a
    category that has the fewest so far, then the one with most categories that are behind, then by a seeded hash. At
    most `size` notices of a category can be chosen, so no more of each, and no more without a category, are looked at."""
    hashed = notices.withColumn("ticket", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("notice_id").cast("string")), 256))
    each = hashed.select("notice_id", "categories", "ticket", F.explode_outer("categories").alias("category"))
    w = Window.partitionBy("category").orderBy("ticket")
    # a notice may count for several categories: of each set of categories, `size` are enough
    sets = Window.partitionBy(F.array_join(F.array_sort("categories"), ",")).orderBy("ticket")
    few = each.withColumn("n", F.row_number().over(w)).where(F.col("n") <= size).select("notice_id").distinct()
    pool = hashed.withColumn("n", F.row_number().over(sets)).where(F.col("n") <= size).select("notice_id", "categories", "ticket")
    pool = pool.unionByName(hashed.join(few, "notice_id", "left_semi").select("notice_id", "categories", "ticket")).distinct().collect()
    count = {c: 0 for r in pool for c in r.categories or []}
    left, chosen = sorted(pool, key=lambda r: r.ticket), []
    while left and len(chosen) < size:
        least = min((count[c] for r in left for c in r.categories or []), default=None)
        best = min(left, key=lambda r: (-sum(count[c] == least for c in r.categories or []), r.ticket))
        left.remove(best)
        chosen.append(best.notice_id)
        for c in best.categories or []:
            count[c] += 1
    return chosen


def halves(notices: DataFrame, seed: int = 0) -> DataFrame:
    """(notice_id, half): 0 or 1, so that of every set of categories both get as many, give or take one; which of them gets the
    odd one alternates over the sets, so the halves differ by one at most."""
    key = F.array_join(F.array_sort(F.coalesce("categories", F.array().cast("array<string>"))), ",")
    rows = notices.select("notice_id", key.alias("key"), F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("notice_id").cast("string")), 256).alias("ticket"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    # one row per set of categories
    odd = sizes.withColumn("before", F.coalesce(F.sum(F.col("n") % 2).over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("key").orderBy("ticket"))
    return rows.withColumn("place", place).join(odd, "key").select("notice_id", ((F.col("place") + F.col("before")) % 2).cast("int").alias("half"))
