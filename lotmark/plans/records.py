"""Lookups, logs, reviews, merges, exports and version comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmark.functions import money
from lotmark.operators import records, versions
from lotmark.plans.base import query
from lotmark.sources.tables import MODEL_SQL as M


@query("p01_lookup", f"{M} SELECT * FROM organizations WHERE name ILIKE '%1%' ORDER BY name, id LIMIT 50")
def lookup(m):
    return records.lookup(m.organizations, "1")


@query(
    "p03_item_search",
    f"""{M} SELECT project_id, package_id, part_id, supplier_id, line_no, brand, product_name, quantity, total_price FROM items WHERE product_name ILIKE '%WIDGET%' AND brand ILIKE '%brand#1%'
ORDER BY project_id DESC, package_id, part_id, supplier_id, line_no, quantity, total_price NULLS FIRST LIMIT 100""",
)
def item_search(m):
    columns = ["project_id", "package_id", "part_id", "supplier_id", "line_no", "brand", "product_name", "quantity", "total_price"]
    return records.search_items(m.items, product_name="WIDGET", brand="brand#1").select(*columns)


@query(
    "p04_counts",
    f"""{M} SELECT 'organizations' AS entity, count(*) AS n FROM organizations UNION ALL SELECT 'projects', count(*) FROM projects UNION ALL SELECT 'packages', count(*) FROM packages
UNION ALL SELECT 'bids', count(*) FROM bids UNION ALL SELECT 'awards', count(*) FROM awards UNION ALL SELECT 'items', count(*) FROM items""",
)
def counts(m):
    frames = {"organizations": m.organizations, "projects": m.projects, "packages": m.packages, "bids": m.bids, "awards": m.bids.where("outcome = 'winner'"), "items": m.items}
    out = None
    for name, df in frames.items():
        one = df.agg(F.lit(name).alias("entity"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


EV = "SELECT event_id, epoch_us(ts) AS at_us, user_id, event_type, CAST(value AS DECIMAL(18,2)) AS amount, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"


def _events(m):
    e = m.table("events")
    return e.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "user_id", "event_type", F.col("value").cast(money.EXACT).cast("decimal(18,2)").alias("amount"), F.from_json("props", "k long")["k"].alias("k"))


@query(
    "j13_latest_event",
    f"WITH e AS ({EV}) SELECT user_id, event_type, at_us, event_id, amount, k FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY at_us DESC, event_id DESC) = 1",
)
def latest_event(m):
    return records.latest(_events(m), ["user_id", "event_type"], "at_us", "event_id")


@query("w01_first_event", f"WITH e AS ({EV}) SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def first_event(m):
    return records.first_by_key(_events(m), ["user_id", "event_type"], "event_id")


@query("w06_previous_decision", f"WITH e AS ({EV}) SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS previous_event_type FROM e")
def previous_decision(m):
    return records.with_previous(_events(m), ["user_id"], "event_type", "at_us", "event_id").select("event_id", "user_id", "event_type", "previous_event_type")


@query(
    "k15_epochs",
    f"""WITH e AS ({EV}) SELECT event_id, user_id, CAST(1 + coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY at_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS epoch FROM e""",
)
def epochs(m):
    return records.with_epoch(_events(m), ["user_id"], F.col("event_type") == "error", "at_us", "event_id").select("event_id", "user_id", "epoch")


@query(
    "w07_filled_down",
    "SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM conversations",
)
def filled_down(m):
    turns = m.table("conversations")
    return records.filled_down(turns, ["conv_id"], F.when(F.col("role") == "user", F.col("turn")), "heading", "turn", "role", "text").drop("text")


NAMES = """WITH names AS (
  SELECT c_custkey AS seq, c_name AS name FROM customer UNION ALL SELECT c_custkey + 1000000, concat(' ', upper(c_name)) FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 2000000, replace(c_name, '#', ' # ') FROM customer WHERE c_custkey % 4 = 0
)"""


@query(
    "k02_organizations",
    NAMES + " SELECT lower(regexp_replace(name, '\\s+', '', 'g')) AS key, arg_min(name, (seq, name)) AS canonical_name, count(DISTINCT name) AS aliases FROM names GROUP BY 1 HAVING key <> ''",
)
def organizations(m):
    c = m.table("customer").select(F.col("c_custkey").alias("seq"), F.col("c_name").alias("name"))
    loud = c.where("seq % 3 = 0").select((F.col("seq") + 1_000_000).alias("seq"), F.concat(F.lit(" "), F.upper("name")).alias("name"))
    wide = c.where("seq % 4 = 0").select((F.col("seq") + 2_000_000).alias("seq"), F.replace("name", F.lit("#"), F.lit(" # ")).alias("name"))
    return records.upsert_organizations(c.unionByName(loud).unionByName(wide))


@query(
    "k04_content_hashes",
    f"""{M} SELECT supplier_id, sha256(concat_ws(chr(31), concat('v', project_id), concat('v', part_id), concat('v', line_no))) AS sha256, count(*) AS n_rows FROM items GROUP BY 1, 2""",
)
def content_hashes(m):
    return m.items.groupBy("supplier_id", records.content_hash("project_id", "part_id", "line_no").alias("sha256")).agg(F.count("*").alias("n_rows"))


@query(
    "k01_unseen_bids",
    f"{M} SELECT project_id, package_id, organization_id, outcome FROM bids b WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = b.project_id AND o_orderstatus = 'F')",
)
def unseen(m):
    receipts = m.table("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("project_id"))
    return records.unseen(m.bids.select("project_id", "package_id", "organization_id", "outcome"), receipts, "project_id")


REVIEW = f"""{M}, c AS (
  SELECT project_id, package_id, part_id, supplier_id, line_no, quantity, unit_price, total_price, CASE WHEN package_id % 2 = 0 THEN 'default' ELSE 'O' END AS package_code,
    CASE WHEN line_no = 7 THEN ' ' ELSE 'notice.html' END AS source_file FROM items
), flags AS (
  SELECT *, total_price IS NULL AS missing, coalesce(quantity * unit_price <> total_price, false) AS conflict, package_code = 'default' AS no_code, trim(source_file) = '' AS no_file FROM c
), r AS (
  SELECT project_id, package_id, part_id, supplier_id, line_no,
    concat_ws(',', CASE WHEN no_code THEN 'default_package' END, CASE WHEN missing THEN 'field_missing' END, CASE WHEN conflict THEN 'numeric_conflict' END, CASE WHEN no_file THEN 'source_file_missing' END) AS reasons,
    CAST(CASE WHEN conflict OR no_file THEN 1 WHEN missing THEN 2 WHEN no_code THEN 3 END AS BIGINT) AS priority
  FROM flags
)"""


def _reviewed(m):
    code = F.when(F.col("package_id") % 2 == 0, "default").otherwise("O")
    file = F.when(F.col("line_no") == 7, " ").otherwise("notice.html")
    candidates = m.items.withColumn("package_code", code).withColumn("source_file", file)
    return records.review_reasons(candidates, ["total_price"]).select("project_id", "package_id", "part_id", "supplier_id", "line_no", "reasons", "priority")


@query("p31_review_reasons", f"{REVIEW} SELECT * FROM r WHERE reasons <> ''")
def review_reasons(m):
    return _reviewed(m)


@query("t07_review_queue", f"{REVIEW} SELECT * FROM r WHERE reasons <> '' ORDER BY priority, project_id, package_id, part_id, supplier_id, line_no, reasons LIMIT 50 OFFSET 20")
def review_queue(m):
    return _reviewed(m).orderBy("priority", "project_id", "package_id", "part_id", "supplier_id", "line_no", "reasons").offset(20).limit(50)


@query(
    "a23_detail_merge",
    f"""{M} SELECT package_id, supplier_id, CASE WHEN min(brand) = max(brand) THEN min(brand) END AS brand, CASE WHEN min(quantity) = max(quantity) THEN min(quantity) END AS quantity,
  coalesce(min(brand) <> max(brand), false) OR coalesce(min(quantity) <> max(quantity), false) AS conflict FROM items GROUP BY package_id, supplier_id""",
)
def detail_merge(m):
    return records.merged(m.items, ["package_id", "supplier_id"], ["brand", "quantity"])


@query(
    "a24_participants",
    """WITH r AS (
  SELECT l_orderkey AS project_id, 2 * l_suppkey + 1 AS organization_id, bool_or(l_returnflag = 'R') AS w, bool_or(l_returnflag = 'A') AS l, max(CASE WHEN l_tax > 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS amount, count(*) AS n_rows
  FROM lineitem GROUP BY 1, 2
)
SELECT project_id, organization_id, CASE WHEN w AND l THEN 'unknown' WHEN w THEN 'winner' WHEN l THEN 'nonwinner' ELSE 'unknown' END AS outcome, CASE WHEN NOT (w AND l) THEN amount END AS amount, n_rows FROM r""",
)
def participants(m):
    rows = m.table("lineitem").select(
        F.col("l_orderkey").alias("project_id"),
        (2 * F.col("l_suppkey") + 1).alias("organization_id"),
        F.when(F.col("l_returnflag") == "R", "winner").when(F.col("l_returnflag") == "A", "nonwinner").otherwise("unknown").alias("outcome"),
        F.when(F.col("l_tax") > 0, F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"),
    )
    return records.dedup_participants(rows, ["project_id", "organization_id"])


@query(
    "a20_export_totals",
    f"""{M}, lots AS (SELECT *, count(*) OVER (PARTITION BY project_id) AS n FROM packages)
SELECT l.project_id, l.package_id, a.organization_id AS supplier_id, CAST(round(CAST(CASE WHEN a.organization_id IS NOT NULL THEN a.award_amount WHEN l.n = 1 THEN p.budget END AS DECIMAL(30,2)) * CAST(0.0001 AS DECIMAL(5,4)), 2) AS DECIMAL(38,2)) AS amount_wan
FROM lots l JOIN projects p ON p.project_id = l.project_id LEFT JOIN awards a ON a.package_id = l.package_id""",
)
def export_totals(m):
    return records.export_totals(m.bids, m.packages, m.projects)


@query(
    "a21_export_items",
    f"""{M} SELECT project_id, package_id, part_id, supplier_id, line_no, brand, product_name, quantity, CAST(unit_price * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(38,6)) AS unit_price_wan, CAST(total_price * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(38,6)) AS total_price_wan FROM items""",
)
def export_items(m):
    return records.export_items(m.items)


@query(
    "a22_export_bidders",
    f"""{M} SELECT project_id, package_id, organization_id, name, CASE WHEN outcome = 'winner' THEN '中标人' ELSE '参与人' END AS category,
  CAST(round(CAST(award_amount AS DECIMAL(30,2)) * CAST(0.0001 AS DECIMAL(5,4)), 2) AS DECIMAL(38,2)) AS amount_wan FROM bids JOIN organizations ON id = organization_id""",
)
def export_bidders(m):
    return records.export_bidders(m.bids, m.organizations)


@query(
    "p15_source_states",
    "SELECT lang, source, count(DISTINCT sha256(text)) AS hashes, CASE WHEN count(DISTINCT sha256(text)) = 1 THEN 'available' WHEN count(DISTINCT sha256(text)) > 1 THEN 'ambiguous' ELSE 'not_saved' END AS status FROM documents GROUP BY lang, source",
)
def source_states(m):
    return records.source_states(m.table("documents").withColumn("sha256", F.sha2("text", 256)), ["lang", "source"], "sha256")


PARTS = """WITH a AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part), b AS (
  SELECT id, CASE WHEN id % 5 = 0 THEN replace(name, ' ', '  ') ELSE name END AS name, CASE WHEN id % 7 = 0 THEN 'Brand#0' ELSE brand END AS brand, CASE WHEN id % 11 = 0 THEN NULL ELSE size END AS size FROM a WHERE id % 10 <> 3
  UNION ALL SELECT id + 10000000, name, brand, size FROM a WHERE id % 13 = 0
), u AS (
  SELECT id, f.field, f.va AS va, a.id AS aid FROM a, LATERAL (VALUES ('name', name), ('brand', brand), ('size', size)) AS f(field, va)
), v AS (
  SELECT id, f.field, f.vb AS vb, b.id AS bid FROM b, LATERAL (VALUES ('name', name), ('brand', brand), ('size', size)) AS f(field, vb)
), j AS (
  SELECT coalesce(u.id, v.id) AS id, coalesce(u.field, v.field) AS field, va AS before, vb AS after,
    CASE WHEN aid IS NULL THEN 'added' WHEN bid IS NULL THEN 'removed' WHEN va IS NOT DISTINCT FROM vb THEN 'unchanged' ELSE 'changed' END AS change
  FROM u FULL JOIN v ON u.id = v.id AND u.field = v.field
), c AS (
  SELECT *, CASE WHEN change = 'unchanged' THEN 'none' WHEN change = 'changed' AND trim(regexp_replace(before, '\\s+', ' ', 'g')) IS NOT DISTINCT FROM trim(regexp_replace(after, '\\s+', ' ', 'g')) THEN 'format_only' ELSE 'possible_semantic' END AS kind FROM j
)"""


def _compared(m, unchanged=False):
    a = m.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").cast("string").alias("size"))
    b = a.where("id % 10 <> 3").select(
        "id",
        F.expr("if(id % 5 = 0, replace(name, ' ', '  '), name)").alias("name"),
        F.expr("if(id % 7 = 0, 'Brand#0', brand)").alias("brand"),
        F.expr("if(id % 11 = 0, null, size)").alias("size"),
    )
    b = b.unionByName(a.where("id % 13 = 0").withColumn("id", F.col("id") + 10_000_000))
    return versions.compare(a, b, ["id"], ["name", "brand", "size"], unchanged)


@query("j17_field_changes", f"{PARTS} SELECT id, field, before, after, change, kind FROM c WHERE change <> 'unchanged'")
def field_changes(m):
    return _compared(m)


@query("a25_change_summary", f"{PARTS} SELECT field, change, kind, count(*) AS n FROM c GROUP BY ALL")
def change_summary(m):
    return versions.summary(_compared(m, unchanged=True))


SNAPSHOTS = """WITH a AS (
  SELECT l_orderkey AS scope, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS no, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part, l_suppkey AS supplier, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem
), b AS (
  SELECT scope, no, CASE WHEN part % 4 = 0 THEN line + 10 ELSE line END AS line, part, supplier, CASE WHEN line % 3 = 0 THEN quantity + 1 ELSE quantity END AS quantity FROM a WHERE line <> 5
)"""


def snapshots(m):
    """Two snapshots of each order's lines: in the second, lines are gone, renumbered, or have other quantities."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    a = m.table("lineitem").select(
        F.col("l_orderkey").alias("scope"),
        F.row_number().over(order).cast("long").alias("no"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_quantity").cast("long").alias("quantity"),
    )
    b = a.where("line <> 5").select("scope", "no", F.expr("if(part % 4 = 0, line + 10, line)").alias("line"), "part", "supplier", F.expr("if(line % 3 = 0, quantity + 1, quantity)").alias("quantity"))
    return a, b


@query(
    "j16_matched_rows",
    f"""{SNAPSHOTS}, p0 AS (
  SELECT x.scope, x.no AS before_no, y.no AS after_no FROM (SELECT *, row_number() OVER (PARTITION BY scope, line, part, supplier, quantity ORDER BY no) AS n FROM a) x
  JOIN (SELECT *, row_number() OVER (PARTITION BY scope, line, part, supplier, quantity ORDER BY no) AS n FROM b) y USING (scope, line, part, supplier, quantity, n)
), a1 AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM p0 WHERE p0.scope = a.scope AND before_no = no)), b1 AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM p0 WHERE p0.scope = b.scope AND after_no = no)
), p1 AS (
  SELECT x.scope, x.no AS before_no, y.no AS after_no FROM (SELECT * FROM a1 QUALIFY count(*) OVER (PARTITION BY scope, line, part) = 1) x JOIN (SELECT * FROM b1 QUALIFY count(*) OVER (PARTITION BY scope, line, part) = 1) y USING (scope, line, part)
), a2 AS (SELECT * FROM a1 WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.scope = a1.scope AND before_no = no)), b2 AS (SELECT * FROM b1 WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.scope = b1.scope AND after_no = no)
), p2 AS (
  SELECT x.scope, x.no AS before_no, y.no AS after_no FROM (SELECT * FROM a2 QUALIFY count(*) OVER (PARTITION BY scope, part) = 1) x JOIN (SELECT * FROM b2 QUALIFY count(*) OVER (PARTITION BY scope, part) = 1) y USING (scope, part)
)
SELECT *, CAST(0 AS BIGINT) AS pass_no FROM p0 UNION ALL SELECT *, 1 FROM p1 UNION ALL SELECT *, 2 FROM p2""",
)
def matched_rows(m):
    a, b = snapshots(m)
    return versions.match_rows(a, b, "scope", ["line", "part", "supplier", "quantity"], [["line", "part"], ["part"]])


@query(
    "u07_multiset_left",
    f"{SNAPSHOTS} SELECT scope, line, part, supplier, quantity FROM a EXCEPT ALL SELECT scope, line, part, supplier, quantity FROM b",
)
def multiset_left(m):
    a, b = (df.drop("no") for df in snapshots(m))
    return a.exceptAll(b)


@query(
    "u04_shared_rows",
    f"{SNAPSHOTS} SELECT scope, line, part, supplier, quantity FROM a INTERSECT SELECT scope, line, part, supplier, quantity FROM b",
)
def shared_rows(m):
    a, b = (df.drop("no") for df in snapshots(m))
    return a.intersect(b)


@query("f21_fingerprints")
def fingerprints(m):
    """Spark's hash has no counterpart in SQL; the tests hold it against reordered rows."""
    return versions.fingerprint(m.table("lineitem"), ["l_orderkey"], ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity"])
