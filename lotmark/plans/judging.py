"""Evaluation by field, record and role, diagnostics, runs, gates and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotmark.operators import evaluation, sampling, scoring
from lotmark.plans.base import query
from lotmark.plans.records import SNAPSHOTS, snapshots
from lotmark.sources.tables import MODEL_SQL as M

FIELDS = {"line": "text", "part": "text", "supplier": "text", "quantity": "quantity"}
LOCAL = scoring.policy("local")
EXCLUSIVE = scoring.policy("exclusive")
#: Rows of both snapshots with the same number are a pair; parts divisible by 5 have no quantity in the gold standard.
PAIRED = f"""{SNAPSHOTS}, g AS (SELECT scope, no, line, part, supplier, CASE WHEN part % 5 <> 0 THEN quantity END AS quantity FROM a), p AS (SELECT scope, no, line, part, supplier, CASE WHEN part % 10 <> 0 THEN quantity END AS quantity FROM b),
j AS (SELECT coalesce(g.scope, p.scope) AS scope, g.no AS gold_no, p.no AS predicted_no, unnest(['line', 'part', 'supplier', 'quantity']) AS field, unnest([g.line, g.part, g.supplier, g.quantity]) AS x, unnest([p.line, p.part, p.supplier, p.quantity]) AS y FROM g FULL JOIN p ON g.scope = p.scope AND g.no = p.no),
s AS (SELECT *, CASE WHEN x IS NULL AND y IS NULL THEN 'empty' WHEN x IS NULL THEN 'extra' WHEN y IS NULL THEN 'missing' WHEN x = y THEN 'correct' ELSE 'wrong' END AS status FROM j)"""


def _statuses(m):
    a, b = snapshots(m)
    g = a.withColumn("quantity", F.when(F.col("part") % 5 != 0, F.col("quantity")).cast("decimal(18,2)"))
    p = b.withColumn("quantity", F.when(F.col("part") % 10 != 0, F.col("quantity")).cast("decimal(18,2)"))
    pairs = g.select("scope", F.col("no").alias("gold_no")).join(p.select("scope", F.col("no").alias("predicted_no")), "scope").where("gold_no = predicted_no")
    return scoring.statuses(pairs, g, p, "scope", FIELDS, LOCAL)


TALLY = "count(*) FILTER (status = 'correct') AS tp, count(*) FILTER (status IN ('wrong', 'extra')) AS fp, count(*) FILTER (status IN ('wrong', 'missing')) AS fn, CAST(0 AS BIGINT) AS tn"
CELLS = "count(*) FILTER (status = 'correct') AS tp, count(*) FILTER (status IN ('wrong', 'extra')) AS fp, count(*) FILTER (status = 'missing') AS fn, count(*) FILTER (status = 'empty') AS tn"


@query("a26_by_field", f"{PAIRED} SELECT coalesce(field, 'all') AS field, {TALLY} FROM s GROUP BY ROLLUP (field)")
def by_field(m):
    return scoring.by_field(_statuses(m), LOCAL)


@query("a26_by_field_exclusive", f"{PAIRED} SELECT coalesce(field, 'all') AS field, {CELLS} FROM s GROUP BY ROLLUP (field)")
def by_field_exclusive(m):
    return scoring.by_field(_statuses(m), EXCLUSIVE)


RECORDS = f"{PAIRED}, r AS (SELECT scope, gold_no, predicted_no, CASE WHEN gold_no IS NULL THEN 'extra' WHEN predicted_no IS NULL THEN 'missing' WHEN bool_and(status IN ('correct', 'empty')) THEN 'correct' ELSE 'wrong' END AS status FROM s GROUP BY scope, gold_no, predicted_no)"


@query("a26_records", f"{RECORDS} SELECT {TALLY} FROM r")
def whole_records(m):
    return scoring.records(_statuses(m), "scope", LOCAL)


@query(
    "a28_diagnosis",
    f"""{PAIRED}, r AS (SELECT scope // 10 AS notice, scope, gold_no, predicted_no, count(*) FILTER (status = 'correct') AS correct, count(*) FILTER (status = 'wrong') AS wrong, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'extra') AS extra, count(*) FILTER (status = 'empty') AS empty FROM s GROUP BY ALL)
SELECT notice, scope, count(*) AS n_records, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(wrong) AS BIGINT) AS wrong, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(extra) AS BIGINT) AS extra, CAST(sum(empty) AS BIGINT) AS empty, count(*) FILTER (wrong + missing + extra = 0) AS exact FROM r GROUP BY ROLLUP (notice, scope)""",
)
def diagnosis(m):
    return scoring.diagnosis(_statuses(m), "scope", F.expr("scope div 10"))


@query("a28_error_fields", f"{PAIRED}, c AS (SELECT field, status, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT *, round(n / sum(n) OVER (PARTITION BY field), 6) AS share FROM c) SELECT * FROM t WHERE status IN ('wrong', 'missing', 'extra')")
def error_fields(m):
    return scoring.error_fields(_statuses(m))


ENTITIES = f"""{M}, gold AS (
  SELECT package_id AS scope, 'buyer' AS role, CAST(buyer_id AS VARCHAR) AS key FROM bids JOIN (SELECT DISTINCT package_id AS k FROM packages) ON k = package_id GROUP BY ALL
  UNION ALL SELECT package_id, 'winners', CAST(organization_id AS VARCHAR) FROM awards UNION ALL SELECT package_id, 'bidders', CAST(organization_id AS VARCHAR) FROM bids
  UNION ALL SELECT package_id, 'bidder_outcomes', concat(organization_id, ':', outcome) FROM bids UNION ALL SELECT package_id, 'nonwinners', CAST(organization_id AS VARCHAR) FROM bids WHERE outcome = 'nonwinner'
), predicted AS (
  SELECT package_id AS scope, 'buyer' AS role, CAST(buyer_id + buyer_id % 4 AS VARCHAR) AS key FROM bids GROUP BY ALL
  UNION ALL SELECT package_id, 'winners', CAST(organization_id AS VARCHAR) FROM awards WHERE award_amount IS NOT NULL UNION ALL SELECT package_id, 'bidders', CAST(organization_id AS VARCHAR) FROM bids
  UNION ALL SELECT package_id, 'bidder_outcomes', concat(organization_id, ':', CASE WHEN outcome = 'unknown' THEN 'nonwinner' ELSE outcome END) FROM bids UNION ALL SELECT package_id, 'nonwinners', CAST(organization_id AS VARCHAR) FROM bids WHERE outcome <> 'winner'
), c AS (
  SELECT role, coalesce(g.n, 0) AS g, coalesce(p.n, 0) AS p FROM (SELECT scope, role, key, count(*) AS n FROM gold GROUP BY ALL) g FULL JOIN (SELECT scope, role, key, count(*) AS n FROM predicted GROUP BY ALL) p USING (scope, role, key)
)"""


@query("a26_roles", f"{ENTITIES} SELECT role, CAST(sum(least(g, p)) AS BIGINT) AS tp, CAST(sum(greatest(p - g, 0)) AS BIGINT) AS fp, CAST(sum(greatest(g - p, 0)) AS BIGINT) AS fn FROM c GROUP BY role")
def roles(m):
    """Predictions take unknown outcomes for lost ones, miss winners without an amount, and name half of the buyers wrongly."""

    buyers = {True: F.col("buyer_id"), False: F.col("buyer_id") + F.col("buyer_id") % 4}
    wins = {True: F.col("outcome") == "winner", False: (F.col("outcome") == "winner") & F.col("award_amount").isNotNull()}
    outcomes = {True: F.col("outcome"), False: F.expr("if(outcome = 'unknown', 'nonwinner', outcome)")}
    none, key = F.lit(None).cast("string"), F.col("organization_id").cast("string")
    entity = lambda gold, kind, key, outcome: F.struct(F.lit(gold).alias("gold"), F.lit(kind).alias("kind"), key.alias("key"), outcome.alias("outcome"))
    scope = ["project_id", F.col("package_id").alias("scope")]  # with the project, everything runs where its bids lie
    each = F.array_compact(F.concat(*[F.array(F.when(wins[g], entity(g, "winner", key, none)), entity(g, "bidder", key, outcomes[g])) for g in buyers]))
    rows = m.bids.select(*scope, F.explode(each).alias("e")).select("project_id", "scope", "e.*")
    named = m.bids.select(*scope, F.explode(F.array(*[F.struct(F.lit(g).alias("gold"), buyer.cast("string").alias("key")) for g, buyer in buyers.items()])).alias("e"))
    named = named.select("project_id", "scope", "e.*").distinct().select("project_id", "scope", "gold", F.lit("buyer").alias("kind"), "key", none.alias("outcome"))
    return scoring.role_counts(scoring.entity_roles(rows.unionByName(named)), ["project_id", "scope"])


AMOUNTS = f"""{M}, g AS (SELECT package_id AS scope, organization_id % 10 AS key, organization_id AS no, award_amount AS amount FROM awards), p AS (SELECT scope, key, no, CASE WHEN no % 3 = 0 THEN amount + 1 WHEN no % 7 <> 0 THEN amount END AS amount FROM g WHERE no % 5 <> 0),
e AS (SELECT x.scope, x.no AS gold_no, y.no AS predicted_no FROM (SELECT *, row_number() OVER (PARTITION BY scope, key, amount ORDER BY no) AS n FROM g WHERE amount IS NOT NULL) x JOIN (SELECT *, row_number() OVER (PARTITION BY scope, key, amount ORDER BY no) AS n FROM p WHERE amount IS NOT NULL) y USING (scope, key, amount, n)),
gr AS (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY no) AS n FROM g WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.scope = g.scope AND e.gold_no = g.no)),
pr AS (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY no) AS n FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.scope = p.scope AND e.predicted_no = p.no)),
st AS (SELECT CASE WHEN gr.amount IS NULL AND pr.amount IS NULL THEN CASE WHEN gr.no IS NOT NULL AND pr.no IS NOT NULL THEN 'empty' END WHEN gr.amount IS NULL THEN 'extra' WHEN pr.amount IS NULL THEN 'missing' WHEN abs(gr.amount - pr.amount) <= 0.01 THEN 'correct' ELSE 'wrong' END AS status FROM gr FULL JOIN pr ON gr.scope = pr.scope AND gr.key = pr.key AND gr.n = pr.n
  UNION ALL SELECT 'correct' FROM e)"""


@query("a26_winner_amounts", f"{AMOUNTS} SELECT {TALLY} FROM st")
def winner_amounts(m):
    """Names are shared by up to ten suppliers of a package; some predictions are missing, off by one, or without an amount."""
    gold = m.bids.where("outcome = 'winner'").select(F.col("package_id").alias("scope"), (F.col("organization_id") % 10).alias("key"), F.col("organization_id").alias("no"), F.col("award_amount").alias("amount"))
    predicted = gold.where("no % 5 <> 0").withColumn("amount", F.expr("case when no % 3 = 0 then amount + 1 when no % 7 <> 0 then amount end").cast("decimal(38,2)"))
    return scoring.winner_amounts(gold, predicted, LOCAL)


@query(
    "p40_gold_faults",
    """WITH r AS (SELECT l_orderkey AS notice_id, l_linenumber AS item_id, CASE WHEN l_partkey % 6 <> 0 THEN 'x' ELSE ' ' END AS name, CAST(CASE WHEN l_partkey % 11 = 0 THEN -1 ELSE 1 END AS DECIMAL(18,2)) AS quantity, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem)
SELECT DISTINCT notice_id, item_id, 'repeated id' AS fault FROM r WHERE n > 1 UNION ALL SELECT DISTINCT notice_id, item_id, 'blank name' FROM r WHERE name = ' ' UNION ALL SELECT DISTINCT notice_id, item_id, 'negative quantity' FROM r WHERE quantity < 0""",
)
def gold_faults(m):
    part = F.col("l_partkey")
    rows = m.table("lineitem").select(F.col("l_orderkey").alias("notice_id"), F.col("l_linenumber").alias("item_id"), F.when(part % 6 != 0, "x").otherwise(" ").alias("name"), F.when(part % 11 == 0, -1).otherwise(1).cast("decimal(18,2)").alias("quantity"))
    return scoring.faults(rows, "notice_id", "item_id", ["name"], ["quantity"])


@query(
    "p39_gate",
    """WITH g AS (SELECT doc_id AS notice_id, CASE WHEN doc_id % 5 = 0 THEN 'draft' ELSE 'reviewed' END AS status, sha256(coalesce(text, '')) AS h FROM documents), r AS (SELECT doc_id AS notice_id, sha256(CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE coalesce(text, '') END) AS h FROM documents WHERE doc_id % 7 <> 0)
SELECT 'not reviewed' AS problem, notice_id FROM g WHERE status = 'draft' UNION ALL SELECT 'not run', notice_id FROM g WHERE notice_id % 7 = 0 UNION ALL SELECT 'other input', g.notice_id FROM g JOIN r USING (notice_id) WHERE g.h <> r.h UNION ALL SELECT 'used for tuning', notice_id FROM g WHERE notice_id % 13 = 0""",
)
def gate(m):
    docs, text = m.table("documents"), F.coalesce("text", F.lit(""))
    key = F.col("doc_id")
    gold = docs.select(key.alias("notice_id"), F.when(key % 5 == 0, "draft").otherwise("reviewed").alias("status"), F.sha2(text, 256).alias("sha256"))
    runs = docs.where("doc_id % 7 <> 0").select(key.alias("notice_id"), F.sha2(F.when(key % 11 == 0, "x").otherwise(text), 256).alias("sha256"))
    return scoring.gate(gold, runs, docs.where("doc_id % 13 = 0").select(key.alias("notice_id")))


@query(
    "u05_disjoint_merge",
    "SELECT doc_id, part, count(*) OVER (PARTITION BY doc_id) > 1 AS conflict FROM (SELECT doc_id, 0 AS part FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 2 FROM documents WHERE doc_id % 5 = 1)",
)
def disjoint_merge(m):
    d = m.table("documents").select("doc_id")
    return scoring.merge_disjoint([d.where("doc_id % 2 = 0"), d.where("doc_id % 3 = 0"), d.where("doc_id % 5 = 1")], "doc_id")


@query(
    "a38_agreement",
    f"{SNAPSHOTS}, x AS (SELECT scope, part, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT scope, part, count(*) AS n FROM b GROUP BY ALL) SELECT coalesce(x.scope, y.scope) AS scope, bool_and(x.n IS NOT DISTINCT FROM y.n) AS agree FROM x FULL JOIN y ON x.scope = y.scope AND x.part = y.part GROUP BY 1",
)
def agreement(m):
    a, b = snapshots(m)
    return scoring.agreement(a, b, ["scope"], "part")


@query(
    "a33_run_summary",
    """WITH r AS (SELECT event_type AS mode, user_id AS notice_id, CASE WHEN event_id % 4 <> 0 THEN event_id // 3 END AS call_id, CAST(event_id % 50 AS BIGINT) AS tokens, value AS seconds FROM events),
c AS (SELECT mode, call_id, max(tokens) AS t, max(seconds) AS s FROM r WHERE call_id IS NOT NULL GROUP BY ALL), cc AS (SELECT mode, count(*) AS calls, CAST(sum(t) AS BIGINT) AS tokens, round(sum(s), 6) AS call_seconds FROM c GROUP BY mode)
SELECT mode, count(DISTINCT notice_id) AS notices, round(median(seconds), 6) AS median_seconds, max(seconds) AS most_seconds, coalesce(any_value(calls), 0) AS calls, any_value(tokens) AS tokens, any_value(call_seconds) AS call_seconds FROM (SELECT r.* EXCLUDE (tokens), cc.* EXCLUDE (mode) FROM r LEFT JOIN cc USING (mode)) GROUP BY mode""",
)
def run_summary(m):
    runs = m.table("events").select(F.col("event_type").alias("mode"), F.col("user_id").alias("notice_id"), F.when(F.col("event_id") % 4 != 0, F.floor(F.col("event_id") / 3)).alias("call_id"), (F.col("event_id") % 50).cast("long").alias("tokens"), F.col("value").alias("seconds"))
    return scoring.run_summary(runs, ["mode"])


@query(
    "a31_coverage",
    """WITH f AS (SELECT l_orderkey AS notice_id, l_shipmode AS mode, concat('f', l_linenumber) AS path, CASE WHEN l_linenumber % 4 = 0 THEN 'failed' ELSE 'parsed' END AS status, CASE WHEN l_linenumber % 4 = 0 THEN 'OCR 超时' WHEN l_linenumber % 5 = 0 THEN 'x' END AS warning FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem))
SELECT mode, count(path) AS files, count(*) FILTER (status = 'parsed') AS parsed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (contains(warning, 'OCR')) AS scanned, count(DISTINCT CASE WHEN warning IS NOT NULL THEN notice_id END) AS notices_with_warnings FROM f GROUP BY mode""",
)
def coverage(m):
    n = F.col("l_linenumber")
    files = m.table("lineitem").select(F.col("l_orderkey").alias("notice_id"), F.col("l_returnflag").alias("mode"), F.concat(F.lit("f"), n).alias("path"), F.when(n % 4 == 0, "failed").otherwise("parsed").alias("status"), F.when(n % 4 == 0, "OCR 超时").when(n % 5 == 0, "x").alias("warning"))
    return scoring.coverage(files, ["mode"])


@query("a37_filled_fields", f"{M} SELECT package_code, count(*) AS n_rows, count(nullif(trim(brand), '')) AS brand, count(total_price) AS total_price FROM items JOIN packages USING (project_id, package_id) GROUP BY package_code")
def filled_fields(m):
    return scoring.filled(m.items.join(m.packages.select("package_id", "package_code"), "package_id"), ["package_code"], ["brand", "total_price"])


@query("a40_trees", f"{M} SELECT project_id, package_id, string_agg(concat_ws('/', line_no, part_id, brand), ',' ORDER BY line_no, part_id, brand) AS items FROM items GROUP BY ALL")
def trees(m):
    out = scoring.trees(m.items, ["project_id", "package_id"], ["part_id", "brand"], "line_no")
    return out.select("project_id", "package_id", F.array_join(F.transform("items", lambda i: F.concat_ws("/", i["line_no"], i["part_id"], i["brand"])), ",").alias("items"))


@query(
    "a36_warning_distribution",
    "WITH c AS (SELECT lang, CASE WHEN doc_id % 4 = 0 THEN 'ocr_failure' WHEN doc_id % 4 = 1 THEN 'parser_failure' ELSE 'other' END AS category, count(*) AS n FROM documents GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY lang), 6) AS share FROM c",
)
def warning_distribution(m):
    said = F.when(F.col("doc_id") % 4 == 0, "OCR 失败").when(F.col("doc_id") % 4 == 1, "解析失败：x").otherwise("seen")
    return evaluation.distribution(m.table("documents").withColumn("warning", said), ["lang"], "warning")


@query(
    "f31_route_fingerprints",
    "SELECT p_partkey, lower(replace(p_name, ' ', '')) AS name, CASE WHEN p_size % 2 = 0 THEN CAST(p_size * 10000 AS VARCHAR) ELSE concat('about', p_size) END AS number FROM part",
)
def route_fingerprints(m):
    name = F.concat(F.lit("（"), F.upper("p_name"), F.lit("）。"))
    number = F.when(F.col("p_size") % 2 == 0, F.concat("p_size", F.lit(".00 万元"))).otherwise(F.concat(F.lit("About "), "p_size"))
    return m.table("part").select("p_partkey", scoring.fingerprint_text(name).alias("name"), scoring.fingerprint_number(number).alias("number"))


@query("g06_halves", "SELECT lang, 1 AS balanced FROM (SELECT DISTINCT lang FROM documents)")
def halves(m):
    """Whether each language's documents are split evenly, give or take one."""
    notices = m.table("documents").select(F.col("doc_id").alias("notice_id"), F.array("lang").alias("categories"))
    both = sampling.halves(notices).join(notices, "notice_id")
    per = both.groupBy(F.col("categories")[0].alias("lang")).agg(F.abs(F.count_if(F.col("half") == 0) - F.count_if(F.col("half") == 1)).alias("d"))
    return per.select("lang", (F.col("d") <= 1).cast("int").alias("balanced"))


@query("g05_stratified")
def stratified(m):
    """Forty documents, as evenly as can be by language and size; greedy, so not expressible in SQL."""
    notices = m.table("documents").select(F.col("doc_id").alias("notice_id"), F.array_compact(F.array("lang", F.when(F.col("n_chars") > 2000, F.lit("long")))).alias("categories"))
    chosen = sampling.stratified(notices, 40, 7)
    return m.spark.createDataFrame([(n, i) for n, i in enumerate(chosen)], "place long, notice_id long")
