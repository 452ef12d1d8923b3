"""Gold against predictions, duplicates, differences and latencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotmark.operators import evaluation
from lotmark.plans.base import query
from lotmark.plans.records import SNAPSHOTS, snapshots
from lotmark.sources.tables import MODEL_SQL as M

JUDGED = "SELECT source, l.quality = 1 AS gold, coalesce(n_chars, 0) >= 600 AS predicted FROM documents JOIN labels l USING (doc_id)"
COUNTED = f"""WITH d AS ({JUDGED}), c AS (
  SELECT source, count(*) FILTER (gold AND predicted) AS tp, count(*) FILTER (NOT gold AND predicted) AS fp, count(*) FILTER (gold AND NOT predicted) AS fn, count(*) FILTER (NOT gold AND NOT predicted) AS tn FROM d GROUP BY source
)"""


def _counted(m):
    judged = m.table("documents").join(m.table("labels"), "doc_id")
    return evaluation.counts(judged, ["source"], F.col("quality") == 1, F.coalesce("n_chars", F.lit(0)) >= 600)


@query("a26_counts", f"{COUNTED} SELECT * FROM c")
def counts(m):
    return _counted(m)


@query(
    "a27_metrics",
    f"""{COUNTED}, r AS (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp * 1.0::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn > 0 THEN tp * 1.0::DOUBLE / (tp + fn) END AS q, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f,
    CASE WHEN tp + fp + fn + tn > 0 THEN 1.0::DOUBLE * (tp + tn) / (tp + fp + fn + tn) END AS a FROM c
)
SELECT source, tp, fp, fn, tn, round(p, 6) AS precision, round(q, 6) AS recall, round(f, 6) AS f1, round(a, 6) AS accuracy, round(0.4::DOUBLE * a + 0.3::DOUBLE * p + 0.3::DOUBLE * q, 6) AS weighted FROM r""",
)
def metrics(m):
    return evaluation.metrics(_counted(m))


@query(
    "f30_field_statuses",
    f"""{SNAPSHOTS}, j AS (SELECT a.quantity AS g, b.quantity AS p FROM a FULL JOIN b ON a.scope = b.scope AND a.no = b.no)
SELECT CASE WHEN g IS NULL AND p IS NULL THEN 'empty' WHEN g IS NULL THEN 'extra' WHEN p IS NULL THEN 'missing' WHEN g = p THEN 'correct' ELSE 'wrong' END AS status, count(*) AS n FROM j GROUP BY 1""",
)
def field_statuses(m):
    a, b = snapshots(m)
    both = a.select("scope", "no", F.col("quantity").alias("g")).join(b.select("scope", "no", F.col("quantity").alias("p")), ["scope", "no"], "full")
    status = evaluation.field_status(F.col("g"), F.col("p"), F.col("g") == F.col("p"))
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("j20_alignment")
def alignment(m):
    """The largest total weight isn't expressible in SQL; the tests hold it against all permutations."""
    a, b = snapshots(m)
    return evaluation.align(a, b, "scope", ["line", "part", "supplier", "quantity"])


@query(
    "j18_scopes",
    f"""{SNAPSHOTS}, x AS (SELECT scope, count(*) AS g FROM a GROUP BY 1), y AS (SELECT scope, count(*) AS p FROM b GROUP BY 1)
SELECT coalesce(x.scope, y.scope) AS scope, coalesce(g, 0) AS gold_rows, coalesce(p, 0) AS predicted_rows FROM x FULL JOIN y ON x.scope = y.scope""",
)
def scopes(m):
    a, b = snapshots(m)
    g, p = a.groupBy("scope").agg(F.count("*").alias("g")), b.groupBy("scope").agg(F.count("*").alias("p"))
    return g.join(p, "scope", "full").select("scope", F.coalesce("g", F.lit(0).cast("long")).alias("gold_rows"), F.coalesce("p", F.lit(0).cast("long")).alias("predicted_rows"))


@query(
    "a29_duplicates",
    """WITH f AS (SELECT source, sha256(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) AS f, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT source, count(*) FILTER (n > 1) AS groups, CAST(sum(n - 1) AS BIGINT) AS extra_rows FROM f GROUP BY source""",
)
def duplicates(m):
    key = F.sha2(F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " ")), 256)
    return evaluation.duplicates(m.table("documents"), ["source"], key)


@query(
    "a30_package_sets",
    f"""{M}, g AS (SELECT DISTINCT buyer_id, package_id FROM awards), p AS (SELECT DISTINCT buyer_id, package_id FROM items WHERE total_price > 50000),
j AS (SELECT coalesce(g.buyer_id, p.buyer_id) AS buyer_id, g.package_id AS g, p.package_id AS p FROM g FULL JOIN p ON g.buyer_id = p.buyer_id AND g.package_id = p.package_id)
SELECT buyer_id, count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn, count(*) FILTER (g IS NULL OR p IS NULL) = 0 AS exact FROM j GROUP BY buyer_id""",
)
def package_sets(m):
    return evaluation.set_alignment(m.bids.where("outcome = 'winner'"), m.items.where("total_price > 50000"), "buyer_id", "package_id")


@query(
    "a39_difference",
    f"""{SNAPSHOTS} SELECT 'only_first' AS side, count(*) AS n FROM (SELECT * EXCLUDE (no) FROM a EXCEPT ALL SELECT * EXCLUDE (no) FROM b) UNION ALL SELECT 'only_second', count(*) FROM (SELECT * EXCLUDE (no) FROM b EXCEPT ALL SELECT * EXCLUDE (no) FROM a)""",
)
def difference(m):
    a, b = (df.drop("no") for df in snapshots(m))
    return evaluation.difference(a, b)


@query(
    "u05_all_conflicts",
    """WITH b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS v FROM documents)
SELECT doc_id, a.n_chars AS first_value, b.v AS second_value FROM documents a JOIN b USING (doc_id) WHERE a.n_chars IS DISTINCT FROM b.v""",
)
def all_conflicts(m):
    docs = m.table("documents")
    return evaluation.conflicts(docs, docs.withColumn("n_chars", F.expr("if(doc_id % 5 = 0, n_chars + 1, n_chars)")), "doc_id", "n_chars")


@query("a34_latencies", "SELECT event_type, count(*) AS n, round(median(value), 6) AS median, quantile_disc(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY event_type")
def latencies(m):
    return evaluation.latencies(m.table("events"), ["event_type"], "value")


@query(
    "a32_recommended",
    """WITH s AS (SELECT user_id, event_type, min(CAST(value AS DECIMAL(18,2))) AS worst, count(*) AS n FROM events GROUP BY ALL)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY worst DESC, n DESC, event_type) = 1""",
)
def recommended(m):
    scores = m.table("events").groupBy("user_id", "event_type").agg(F.min(F.col("value").cast("decimal(18,2)")).alias("worst"), F.count("*").alias("n"))
    return evaluation.recommended(scores, "user_id", "event_type", F.desc("worst"), F.desc("n"))
