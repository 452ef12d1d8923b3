"""Pages of notices, imports, merged candidates, clue evidence, searches, intents, and what goes in and out of datasets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotmark.functions import codes, money
from lotmark.operators import clues, dedup, graph, intake, intents, linking, notices, records
from lotmark.plans.base import query
from lotmark.plans.relations import NODES, PAIRS, ROLES
from lotmark.sources import datasets, documents
from lotmark.sources.tables import MODEL_SQL as M
from lotmark.sources.tables import dealt


@query(
    "a19_notice_detail",
    f"""{M}, i AS (SELECT package_id, string_agg(concat_ws('/', line_no, part_id, brand), ',' ORDER BY line_no, part_id, product_name, brand, quantity) AS items FROM items GROUP BY 1),
p AS (SELECT package_id, string_agg(concat_ws('/', organization_id, name, outcome), ',' ORDER BY organization_id) AS people, string_agg(concat_ws('/', organization_id, CAST(award_amount AS DECIMAL(38,2))), ',' ORDER BY organization_id) FILTER (outcome = 'winner') AS awards FROM bids JOIN organizations ON id = organization_id GROUP BY 1)
SELECT pr.project_id, buyer_id, name AS buyer_name, CAST(budget AS DECIMAL(38,2)) AS budget, string_agg(CASE WHEN k.package_id IS NOT NULL THEN concat_ws('|', k.package_id, package_code, coalesce(items, ''), coalesce(people, ''), coalesce(awards, '')) END, ';' ORDER BY k.package_id) AS packages
FROM projects pr LEFT JOIN organizations ON id = buyer_id LEFT JOIN packages k USING (project_id) LEFT JOIN i USING (package_id) LEFT JOIN p USING (package_id) GROUP BY ALL""",
)
def notice_detail(m):
    out = notices.detail(m.projects, m.packages, m.items, m.bids, m.organizations)
    line = lambda a, *fs: F.array_join(F.transform(a, lambda x: F.concat_ws("/", *[x[f].cast("string") for f in fs])), ",")
    each = F.transform("packages", lambda p: F.concat_ws("|", p["package_id"], p["package_code"], F.coalesce(line(p["items"], "line_no", "part_id", "brand"), F.lit("")), F.coalesce(line(p["participants"], "organization_id", "name", "outcome"), F.lit("")), F.coalesce(line(p["awards"], "organization_id", "award_amount"), F.lit(""))))
    packages = F.when(F.col("packages").isNotNull(), F.array_join(each, ";"))
    return out.select("project_id", "buyer_id", "buyer_name", F.col("budget").cast("decimal(38,2)").alias("budget"), packages.alias("packages"))


def _batch(m):
    """A notice per order with a package per line state, bidders spelled in two ways, and one winner each."""
    name = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Supplier "), "l_suppkey")).otherwise(F.concat(F.lit("SUPPLIER　"), "l_suppkey"))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", name.alias("name"), "l_returnflag", F.col("l_quantity").cast("decimal(38,6)").alias("q"))
    # lines and orders are dealt once, by the key that the import goes by
    key = lambda c: F.concat(F.lit("order-"), c).alias("source_key")
    lines = dealt(m.table("lineitem").select(key("l_orderkey"), "l_linestatus", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity"), "source_key", m.pieces)
    lots = lines.groupBy("source_key", "l_linestatus").agg(F.array_sort(F.collect_list(line)).alias("ls"))
    null = F.lit(None).cast("string")
    dec = F.lit(None).cast("decimal(38,6)")
    item = lambda x: F.struct(F.concat(F.lit("part "), x["l_partkey"]).alias("product_name"), null.alias("category"), null.alias("brand"), null.alias("model"), x["q"].alias("quantity"), dec.alias("unit_price"), dec.alias("total_price"))
    outcome = lambda x: F.when(x["l_returnflag"] == "A", "nonwinner").otherwise("unknown")
    winners = F.transform(F.filter("ls", lambda x: x["l_returnflag"] == "R"), lambda x: F.struct(x["name"].alias("name"), x["q"].alias("amount")))
    lot = F.struct(F.col("l_linestatus").alias("package_code"), null.alias("package_name"), F.transform("ls", item).alias("items"), F.transform("ls", lambda x: F.struct(x["name"].alias("name"), outcome(x).alias("outcome"))).alias("bidders"), winners.alias("winners"))
    per = lots.groupBy("source_key").agg(F.array_sort(F.collect_list(F.struct("l_linestatus", lot.alias("p")))).alias("ps"))
    heads = dealt(m.table("orders").select(key("o_orderkey"), "o_orderkey", "o_custkey", "o_totalprice"), "source_key", m.pieces).join(per, "source_key", "left")
    source = F.array(F.struct(F.lit("n.html").alias("source_file"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"), F.lit(1).cast("long").alias("byte_size")))
    made = heads.select(
        "source_key", F.concat(F.lit("p "), "o_orderkey").alias("project_name"), null.alias("project_number"), F.concat(F.lit("Customer "), "o_custkey").alias("buyer"),
        F.col("o_totalprice").cast("decimal(38,6)").alias("budget"), F.array().cast("array<string>").alias("warnings"), source.alias("sources"), F.transform("ps", lambda p: p["p"]).alias("packages"),
    )
    return datasets.conformed(made, notices.NOTICE)


def _receipts(m):
    return dealt(m.table("orders").where("o_orderkey % 10 = 0").select(F.concat(F.lit("order-"), "o_orderkey").alias("source_key")), "source_key", m.pieces)


IMPORT = """WITH l AS (SELECT * FROM lineitem WHERE l_orderkey % 10 <> 0), b AS (SELECT l_orderkey, l_linestatus, l_suppkey, arg_min(CASE WHEN l_returnflag = 'A' THEN 'nonwinner' ELSE 'unknown' END, (l_linenumber, l_partkey, l_suppkey)) AS outcome FROM l GROUP BY ALL)"""


@query("k01_packages", f"{IMPORT} SELECT DISTINCT l_linestatus AS package_code, concat('p ', l_orderkey) AS project_name FROM l")
def imported_packages(m):
    tables = notices.imported(_batch(m), _receipts(m))
    return tables["packages"].join(tables["notices"], "notice_id").select("package_code", "project_name")


@query("k01_bids", f"{IMPORT} SELECT concat('p ', l_orderkey) AS project_name, l_linestatus AS package_code, concat('supplier', l_suppkey) AS organization, outcome FROM b")
def imported_bids(m):
    tables = notices.imported(_batch(m), _receipts(m))
    lots = tables["packages"].join(tables["notices"], "notice_id").select("package_id", "package_code", "project_name")
    names = tables["organizations"].select("organization_id", F.col("normalized_name").alias("organization"))
    return tables["bid_participations"].join(lots, "package_id").join(names, "organization_id").select("project_name", "package_code", "organization", "outcome")


@query("k01_organizations", f"{IMPORT} SELECT DISTINCT concat('supplier', l_suppkey) AS normalized_name FROM l UNION SELECT DISTINCT concat('customer', o_custkey) FROM orders WHERE o_orderkey % 10 <> 0")
def imported_organizations(m):
    return notices.imported(_batch(m), _receipts(m))["organizations"].select("normalized_name")


@query("k01_awards", f"{IMPORT} SELECT concat('p ', l_orderkey) AS project_name, l_linestatus AS package_code, count(DISTINCT l_suppkey) AS n FROM l WHERE l_returnflag = 'R' GROUP BY ALL")
def imported_awards(m):
    tables = notices.imported(_batch(m), _receipts(m))
    lots = tables["packages"].join(tables["notices"], "notice_id").select("package_id", "package_code", "project_name")
    return tables["awards"].join(lots, "package_id").groupBy("project_name", "package_code").agg(F.count("*").alias("n"))


@query(
    "s27_import_totals",
    "SELECT count(*) AS notices, count(*) FILTER (o_orderkey % 10 <> 0) AS imported, count(*) FILTER (o_orderkey % 10 = 0) AS seen, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linestatus FROM lineitem WHERE l_orderkey % 10 <> 0)) AS packages, (SELECT count(*) FROM lineitem WHERE l_orderkey % 10 <> 0) AS items FROM orders",
)
def import_totals(m):
    return notices.totals(_batch(m), _receipts(m))


@query(
    "p46_rejected_imports",
    """SELECT concat('order-', o_orderkey) AS source_key, unnest(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'repeated package A' END, CASE WHEN o_orderkey % 3 = 0 THEN 'unknown outcome' END, CASE WHEN o_orderkey % 5 = 0 THEN 'blank name' END, CASE WHEN o_orderkey % 7 = 0 THEN 'negative amount' END, CASE WHEN o_orderkey % 11 = 0 THEN 'source without hash' END], lambda x: x IS NOT NULL)) AS problem FROM orders""",
)
def rejected_imports(m):
    key = F.col("o_orderkey")
    null, dec = F.lit(None).cast("string"), F.lit(None).cast("decimal(38,6)")
    bidders = F.array(F.struct(F.when(key % 5 == 0, " ").otherwise("b").alias("name"), F.when(key % 3 == 0, "second").otherwise("winner").alias("outcome")))
    winners = F.array(F.struct(F.lit("b").alias("name"), F.when(key % 7 == 0, -1).otherwise(1).cast("decimal(38,6)").alias("amount")))
    lot = lambda code: F.struct(F.lit(code).alias("package_code"), null.alias("package_name"), F.array().cast(T.ArrayType(notices.ITEM)).alias("items"), bidders.alias("bidders"), winners.alias("winners"))
    packages = F.when(key % 2 == 0, F.array(lot("A"), lot("A"))).otherwise(F.array(lot("A"), lot("B")))
    source = F.array(F.struct(F.lit("n").alias("source_file"), F.when(key % 11 == 0, "?").otherwise(F.sha2(key.cast("string"), 256)).alias("sha256"), F.lit(1).cast("long").alias("byte_size")))
    made = m.table("orders").select(F.concat(F.lit("order-"), key).alias("source_key"), null.alias("buyer"), dec.alias("budget"), source.alias("sources"), packages.alias("packages"))
    return notices.rejected(datasets.conformed(made, notices.NOTICE))


@query("p45_unreferenced_sources", "SELECT DISTINCT l_orderkey AS notice_id, concat('f', l_linenumber) AS source_file FROM lineitem WHERE l_linenumber > 3 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey % 7 = l_linenumber)")
def unreferenced_sources(m):
    rows = m.table("lineitem").where("l_linenumber > 3").select(F.col("l_orderkey").alias("notice_id"), F.concat(F.lit("f"), "l_linenumber").alias("source_file"))
    sources = m.table("orders").select(F.col("o_orderkey").alias("notice_id"), F.concat(F.lit("f"), F.col("o_custkey") % 7).alias("source_file"))
    return notices.unreferenced(rows, sources)


@query("p42_scope_ids", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN md5(CAST(s_suppkey AS VARCHAR)) ELSE 'default' END AS scope FROM supplier")
def scope_ids(m):
    path = F.concat(F.lit("/data/"), F.when(F.col("s_suppkey") % 2 == 0, F.md5(F.col("s_suppkey").cast("string"))).otherwise("other"), F.lit(".db"))
    return m.table("supplier").select("s_suppkey", notices.scope_id(path).alias("scope"))


@query("p09_display_names", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN concat('n ', o_orderkey) WHEN o_orderkey % 3 = 1 THEN CAST(o_orderkey AS VARCHAR) ELSE 'unnamed' END AS shown FROM orders")
def display_names(m):
    key = F.col("o_orderkey")
    name = F.when(key % 3 == 0, F.concat(F.lit("n "), key)).when(key % 3 == 1, " ")
    return m.table("orders").select("o_orderkey", notices.display_name(name, F.when(key % 3 != 2, key.cast("string")), "unnamed").alias("shown"))


@query("p11_properties", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax > 0 THEN concat('part=', l_partkey, ';tax=yes') ELSE concat('part=', l_partkey) END AS properties FROM lineitem")
def properties(m):
    bag = notices.properties(part=F.col("l_partkey"), tax=F.when(F.col("l_tax") > 0, "yes"), none=F.lit(None))
    shown = F.array_join(F.transform(F.map_entries(bag), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return m.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", shown.alias("properties"))


@query("w10_sheet_numbers", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS sheet_no FROM lineitem")
def sheet_numbers(m):
    rows = notices.numbered(m.table("lineitem"), ["l_orderkey"], "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "sheet_no")


@query("s29_skeletons", "SELECT substr(sha256(text), 1, 20) AS notice_id, 'draft' AS status FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def skeletons(m):
    """Documents with equal contents give one skeleton."""
    docs = m.table("documents").where("text is not null").select(F.encode("text", "UTF-8").alias("content"), F.col("doc_id").cast("string").alias("path"), F.array(F.lit("1")).alias("packages"))
    return notices.skeletons(docs).select("notice_id", "status")


FILES = """WITH i AS (SELECT l_orderkey AS notice_id, (l_linenumber * 100000 + l_partkey) * 10000 + l_suppkey AS no, concat('f', l_suppkey % 3) AS source_file, CASE WHEN l_suppkey % 4 = 0 THEN 'default' ELSE l_linestatus END AS package_code, concat('part ', l_partkey % 5) AS product_name,
  CASE WHEN l_linenumber % 2 = 0 THEN concat('m', l_partkey % 3) END AS model, CAST(l_partkey % 4 AS DECIMAL(18,2)) AS quantity, CASE WHEN l_tax > 0.02 THEN CAST(l_partkey % 2 AS DECIMAL(18,2)) END AS unit_price FROM lineitem)"""


@query(
    "j22_duplicate_links",
    f"""{FILES}, c AS (SELECT notice_id, product_name, package_code, model, quantity, unit_price, min(no) AS first, count(DISTINCT source_file) AS files, min(source_file) AS f FROM i GROUP BY ALL)
SELECT x.notice_id, x.product_name, count(*) AS n FROM c x JOIN c y ON x.notice_id = y.notice_id AND x.product_name = y.product_name AND (x.package_code, x.first, coalesce(x.model, ''), x.quantity, coalesce(x.unit_price, -1)) < (y.package_code, y.first, coalesce(y.model, ''), y.quantity, coalesce(y.unit_price, -1))
WHERE (x.package_code = y.package_code OR 'default' IN (x.package_code, y.package_code)) AND coalesce(x.model = y.model, true) AND x.quantity = y.quantity AND coalesce(x.unit_price = y.unit_price, true)
  AND ((x.model IS NOT NULL AND y.model IS NOT NULL) OR (x.unit_price IS NOT NULL AND y.unit_price IS NOT NULL)) AND NOT (x.files = 1 AND y.files = 1 AND x.f = y.f) GROUP BY ALL""",
)
def duplicate_links(m):
    """Links between candidates of one name in several files, per notice and name."""
    classes, edges = dedup.duplicate_edges(_files(m))
    heads = classes.select(F.col("class_id").alias("a"), "notice_id", F.col("name").alias("product_name"))
    return edges.select("a", "b").join(heads, "a").groupBy("notice_id", F.regexp_replace("product_name", "part", "part ").alias("product_name")).agg(F.count("*").alias("n"))


def _files(m):
    null = F.lit(None).cast("string")
    return dealt(m.table("lineitem"), "l_orderkey", m.pieces).select(
        F.col("l_orderkey").alias("notice_id"), ((F.col("l_linenumber") * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("no"), F.concat(F.lit("f"), F.col("l_suppkey") % 3).alias("source_file"), F.when(F.col("l_suppkey") % 4 == 0, "default").otherwise(F.col("l_linestatus")).alias("package_code"),
        F.concat(F.lit("part "), F.col("l_partkey") % 5).alias("product_name"), null.alias("category"), null.alias("brand"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("m"), F.col("l_partkey") % 3)).alias("model"), (F.col("l_partkey") % 4).cast("decimal(18,2)").alias("quantity"),
        null.alias("quantity_unit"), F.when(F.col("l_tax") > 0.02, (F.col("l_partkey") % 2).cast("decimal(18,2)")).alias("unit_price"), F.lit(None).cast("decimal(18,2)").alias("total_price"),
    )


@query("j22_merged_items")
def merged_items(m):
    """Cliques of candidates aren't expressible in SQL without recursion over pairs; tests hold them against all pairs."""
    return dedup.merge_files(_files(m).dropDuplicates(["notice_id", "no"])).select("notice_id", "item_no", "status", "n_rows", "package_code", "model", "quantity", "unit_price")


@query("j21_forced_pairs")
def forced_pairs(m):
    """Rows of tables and models of an order that share a part number's last digit; tests hold them against all matchings."""
    line = m.table("lineitem").select(F.col("l_orderkey").alias("scope"), F.col("l_linenumber").cast("long").alias("no"), (F.col("l_partkey") % 10).alias("k"), F.col("l_linestatus").alias("side"))
    left, right = (line.where(F.col("side") == s).select("scope", "k", F.col("no").alias(n)) for s, n in (("F", "left_no"), ("O", "right_no")))
    return dedup.forced(left.join(right, ["scope", "k"]).select("scope", "left_no", "right_no").distinct(), "scope")


@query(
    "f38_merged_models",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN upper(p_name) ELSE p_name END AS product_name, CASE WHEN p_partkey % 3 = 0 THEN CAST(9 AS DECIMAL(18,2)) ELSE CAST(p_size AS DECIMAL(18,2)) END AS quantity, CASE WHEN p_partkey % 2 = 0 THEN 'B' ELSE 'default' END AS package_code,
  array_to_string(list_filter([CASE WHEN p_partkey % 5 = 0 THEN 'brand' END, CASE WHEN p_partkey % 3 <> 0 AND p_size <> 9 THEN 'quantity' END], lambda x: x IS NOT NULL), ',') AS conflicts FROM part""",
)
def merged_models(m):
    key, null, none = F.col("p_partkey"), F.lit(None).cast("string"), F.lit(None).cast("decimal(18,2)")
    rule = F.struct(F.lit("default").alias("package_code"), F.col("p_name").alias("product_name"), null.alias("category"), F.col("p_brand").alias("brand"), null.alias("model"), null.alias("quantity_unit"), F.when(key % 3 != 0, F.col("p_size").cast("decimal(18,2)")).alias("quantity"), none.alias("unit_price"), none.alias("total_price"))
    model = F.struct(F.when(key % 2 == 0, "B").otherwise("default").alias("package_code"), F.when(key % 4 != 0, F.upper("p_name")).otherwise("").alias("product_name"), null.alias("category"), F.when(key % 5 == 0, "other").otherwise(F.lower("p_brand")).alias("brand"), null.alias("model"), null.alias("quantity_unit"), F.lit(9).cast("decimal(18,2)").alias("quantity"), none.alias("unit_price"), none.alias("total_price"))
    out = dedup.merge_models(m.table("part").select("p_partkey", rule.alias("r"), model.alias("m")))
    return out.select("p_partkey", "product_name", "quantity", "package_code", F.array_join("conflicts", ",").alias("conflicts"))


@query("p14_carried_evidence", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'brand=model;name=rule' WHEN p_partkey % 3 = 1 THEN 'brand=rule' ELSE 'brand=rule;name=rule' END AS evidence FROM part")
def carried_evidence(m):
    key = F.col("p_partkey") % 3
    own, other = F.create_map(F.lit("brand"), F.lit("rule"), F.lit("name"), F.lit("rule")), F.create_map(F.lit("brand"), F.lit("model"))
    changed = F.when(key == 0, F.array(F.lit("brand"))).when(key == 1, F.array(F.lit("name"))).otherwise(F.array().cast("array<string>"))
    out = dedup.carried_evidence(own, changed, other)
    shown = F.array_join(F.transform(F.array_sort(F.map_keys(out)), lambda k: F.concat_ws("=", k, out[k])), ";")
    return m.table("part").select("p_partkey", shown.alias("evidence"))


@query("p18_supplier_brands", "SELECT p_partkey, p_partkey % 2 = 0 AS supplier, p_size % 3 <> 2 AS amount_stated FROM part")
def supplier_brands(m):
    text = F.concat(F.when(F.col("p_partkey") % 2 == 0, "中标 供应商： ").otherwise("品牌："), F.col("p_brand"), F.lit("，共 "), F.when(F.col("p_size") % 3 == 0, "1,234.50 元").when(F.col("p_size") % 3 == 1, "0.12345万元").otherwise("99 元"))
    return m.table("part").select("p_partkey", dedup.brand_is_supplier(F.col("p_brand"), text).alias("supplier"), dedup.amount_in(text, F.lit("1234.5").cast("decimal(38,6)")).alias("amount_stated"))


CLUE_ROWS = f"""{M}, b AS (SELECT * FROM bids), p AS ({PAIRS}), mem AS (
  SELECT 'common_bidding' AS kind, concat('common-bidding:', left_id, '-', right_id) AS clue_id, project_id, package_id, created_at, unnest([left_id, right_id]) AS organization_id FROM p
  UNION ALL SELECT 'supplier_distribution', concat('supplier-distribution:', organization_id), project_id, package_id, created_at, organization_id FROM b
  UNION ALL SELECT 'buyer_network', concat('buyer-network:', buyer_id, '-', organization_id), project_id, package_id, created_at, organization_id FROM b
)"""


@query(
    "a11_clue_evidence",
    f"""{CLUE_ROWS} SELECT kind, clue_id, array_to_string(list_sort(list_distinct(list(organization_id))), ',') AS entities, count(DISTINCT project_id) AS projects, count(DISTINCT package_id) AS packages,
  strftime(min(created_at), '%Y-%m-%d') AS first_at, min((created_at, project_id))[2] AS first_project, strftime(max(created_at), '%Y-%m-%d') AS last_at, max((created_at, project_id))[2] AS last_project FROM mem GROUP BY ALL""",
)
def clue_evidence(m):
    out = clues.evidence(m.bids)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return out.withColumns({"entities": F.array_join("entities", ","), "first_at": day("first_at"), "last_at": day("last_at")})


@query(
    "a17_warning_categories",
    f"""{CLUE_ROWS} SELECT kind, clue_id, bool_or(project_id % 11 = 0) AS ocr, bool_or(project_id % 13 = 0) AS attachment, bool_or((package_id + organization_id) % 5 = 0) AS insufficient_evidence, bool_or(package_id % 7 = 0) AS default_package FROM mem GROUP BY ALL""",
)
def clue_warnings(m):
    notes = m.projects.select("project_id", F.array_compact(F.array(F.when(F.col("project_id") % 11 == 0, "第 2 页为扫描件"), F.when(F.col("project_id") % 13 == 0, "附件 a.doc 解析失败"), F.lit("附件 1 份"))).alias("warnings"))
    quote = F.when((F.col("package_id") + F.col("organization_id")) % 5 != 0, "q")
    marks = m.bids.select("package_id", "organization_id", F.when(F.col("package_id") % 7 != 0, F.col("package_code")).alias("package_code"), F.lit("f").alias("source_file"), F.lit("l").alias("source_location"), quote.alias("source_evidence"))
    return clues.warning_categories(clues.members(m.bids), notes, marks)


@query("a42_evidence_links", f"{M} SELECT 'bid' AS record_type, package_id * 1000000 + organization_id AS record_id, CASE WHEN organization_id % 3 = 0 THEN 'missing' ELSE 'available' END AS link_status FROM bids")
def evidence_links(m):
    rows = m.bids.select(F.lit("bid").alias("record_type"), (F.col("package_id") * 1_000_000 + F.col("organization_id")).alias("record_id"), F.when(F.col("organization_id") % 3 != 0, "q").otherwise(" ").alias("source_evidence"))
    return clues.evidence_links(rows.unionByName(rows)).drop("source_evidence")


@query(
    "t05_search_page",
    f"""{ROLES}, found AS (
  SELECT 'organization' AS kind, id, name FROM roles WHERE contains(lower(name), '1') AND (is_buyer OR is_supplier) UNION ALL SELECT 'project', project_id, concat('project ', project_id) FROM projects WHERE contains(concat('project ', project_id), '1')
)
SELECT *, (SELECT count(*) FROM found) AS total, CASE WHEN (SELECT count(*) FROM found) > 30 THEN CAST(30 AS BIGINT) END AS next_offset FROM found ORDER BY lower(name), kind, id LIMIT 20 OFFSET 10""",
)
def search_page(m):
    return graph.search_page(m, "1", 10, 20).drop("is_buyer", "is_supplier")


@query("t04_truncation", f"{NODES}, e AS (SELECT * FROM edges WHERE source = 'organization:1' OR target = 'organization:1' ORDER BY project_id DESC, relation, source, target LIMIT 5) SELECT *, (SELECT count(*) FROM edges WHERE source = 'organization:1' OR target = 'organization:1') > 5 AS truncated FROM e")
def truncation(m):
    at = graph.edges(m).where("source = 'organization:1' or target = 'organization:1'")
    return graph.probed(at, [F.desc("project_id"), F.col("relation"), F.col("source"), F.col("target")], 5)


@query(
    "j12_subgraph",
    f"""{NODES}, e AS (SELECT *, row_number() OVER (ORDER BY project_id DESC, relation, source, target) AS place FROM (SELECT * FROM edges WHERE source = 'organization:1' OR target = 'organization:1' ORDER BY project_id DESC, relation, source, target LIMIT 100)),
f AS (SELECT uid, min((place, side)) AS pos FROM (SELECT place, unnest([0, 1]) AS side, unnest([source, target]) AS uid FROM e) GROUP BY uid ORDER BY pos LIMIT 30) SELECT nodes.* FROM nodes WHERE uid IN (SELECT uid FROM f)""",
)
def subgraph(m):
    return graph.subgraph(m, graph.neighbourhood(m, "organization:1", limit=100), 30)


@query("a41_totals", f"{NODES} SELECT label AS entity, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT relation, count(*) FROM edges GROUP BY 1")
def totals(m):
    return graph.totals(m)


@query("n06_paths", f"{NODES} SELECT a.source AS start, a.target AS middle, b.target AS end, a.project_id FROM edges a JOIN edges b ON a.relation = 'HAS_PACKAGE' AND b.relation = 'AWARDED_TO' AND a.target = b.source")
def paths(m):
    return graph.paths(graph.edges(m, ("HAS_PACKAGE", "AWARDED_TO")), "HAS_PACKAGE", "AWARDED_TO")


@query("k09_exported_graph", f"{NODES} SELECT relation AS entity, count(*) AS n FROM edges GROUP BY relation UNION ALL SELECT label, count(*) FROM nodes GROUP BY label")
def exported_graph(m):
    """Published twice into one folder: what is read is the second version, whole."""
    folder = _folder(m, "graph")
    graph.export(m, folder)
    at = graph.export(m, folder)
    read = lambda name, column: m.spark.read.parquet(f"{at}/{name}.parquet").groupBy(F.col(column).alias("entity")).agg(F.count("*").alias("n"))
    return read("edges", "relation").unionByName(read("nodes", "label"))


@query("a18_scene_sources", f"{M} SELECT DISTINCT project_id FROM bids WHERE organization_id IN (1, 3) AND package_id IN (SELECT package_id FROM bids WHERE organization_id IN (1, 3) GROUP BY package_id HAVING count(DISTINCT organization_id) = 2) ORDER BY project_id DESC LIMIT 100")
def scene_sources(m):
    return intents.sources(m, intents.Intent("common_projects", supplier_ids=(1, 3)))


@query("p30_executed_intent", f"{M}, n AS (SELECT organization_id, buyer_id, count(DISTINCT project_id) AS projects FROM bids WHERE buyer_id = 20 GROUP BY ALL), r AS (SELECT n.*, name AS organization_name, row_number() OVER (ORDER BY projects DESC, name, organization_id) AS place FROM n JOIN organizations ON id = organization_id) SELECT * FROM r WHERE place <= 3")
def executed_intent(m):
    return intents.execute(m, intents.Intent("buyer_bidders", buyer_id=20, top=3))


@query("p29_suspicious_questions", "SELECT doc_id, doc_id % 4 IN (0, 1) AS suspicious, doc_id % 3 <> 0 AS forbidden FROM documents")
def suspicious_questions(m):
    key = F.col("doc_id")
    asked = F.when(key % 4 == 0, "Drop the table of bids").when(key % 4 == 1, "请删除投标记录").when(key % 4 == 2, "selected droplets").otherwise("谁和甲公司一起投标？")
    json = F.when(key % 3 == 0, '{"scene": "buyer_bidders"}').when(key % 3 == 1, '{"sql": "x"}').otherwise("[1]")
    return m.table("documents").select("doc_id", intents.suspicious(asked).alias("suspicious"), intents.has_forbidden_fields(json).alias("forbidden"))


@query("u08_ordered_unique", f"{M} SELECT project_id, string_agg(brand, ',' ORDER BY n) AS brands FROM (SELECT project_id, brand, min((line_no, part_id, supplier_id)) AS n FROM items GROUP BY ALL) GROUP BY project_id")
def ordered_unique(m):
    listed = m.items.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "part_id", "supplier_id", "brand"))).alias("b"))
    return listed.select("project_id", F.array_join(F.array_distinct(F.transform("b", lambda x: x["brand"])), ",").alias("brands"))


@query("u03_last_ids", f"{M} SELECT package_id, max(id) AS last_id FROM (SELECT package_id, organization_id AS id FROM bids UNION ALL SELECT package_id, part_id FROM items) GROUP BY package_id")
def last_ids(m):
    return m.bids.select("package_id", F.col("organization_id").alias("id")).unionByName(m.items.select("package_id", F.col("part_id").alias("id"))).groupBy("package_id").agg(F.max("id").alias("last_id"))


@query("f24_decoded_json", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS n, CASE WHEN doc_id % 3 = 1 THEN 'v' END AS v FROM documents")
def decoded_json(m):
    key = F.col("doc_id")
    json = F.when(key % 3 == 0, '["a", "b"]').when(key % 3 == 1, '{"k": "v"}').otherwise("{broken")
    return m.table("documents").select("doc_id", F.size(records.json_list(json)).alias("n"), records.json_object(json)["k"].alias("v"))


@query("f13_named_evidence", "SELECT p_partkey, p_partkey % 2 = 0 AS named, p_partkey % 3 = 0 AS is_name FROM part")
def named_evidence(m):
    key = F.col("p_partkey")
    evidence = F.when(key % 2 == 0, F.concat(F.lit("分包名称： 教学 "), "p_size", F.lit("\n数量"))).otherwise(F.concat(F.lit("品目：教学"), "p_size"))
    return m.table("part").select("p_partkey", codes.named_by(F.concat(F.lit("教学"), "p_size"), evidence).alias("named"), codes.is_named(F.when(key % 3 == 0, "教学仪器").otherwise("包2")).alias("is_name"))


@query("f14_nearby_labels", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '12' WHEN p_partkey % 3 = 1 THEN 'B' ELSE 'default' END AS code FROM part")
def nearby_labels(m):
    key = F.col("p_partkey")
    return m.table("part").select("p_partkey", codes.nearby(F.when(key % 3 == 0, "第一包结果如下，第十二包：").when(key % 3 == 1, "合同包A 与 采购包B 的评审").otherwise("评审结果")).alias("code"))


@query("f08_units", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '万元' WHEN 1 THEN '元' END AS unit, CASE WHEN p_size % 2 = 0 THEN CAST(p_size * 1000 AS DECIMAL(38,2)) END AS amount FROM part")
def units(m):
    key = F.col("p_partkey") % 3
    header, context = F.when(key == 0, "报价（万元）").otherwise("报价"), F.when(key == 1, "金额单位：人民币元").when(key == 2, "单位：元，合计单位：万元")
    cell = F.when(F.col("p_size") % 2 == 0, F.concat("p_size", F.lit(",000"))).otherwise("约 5")
    return m.table("part").select("p_partkey", money.table_unit(header, context).alias("unit"), money.strict(cell).cast("decimal(38,2)").alias("amount"))


@query("f29_shown_amounts", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS DECIMAL(38,2)) * 10000 END AS stored, CASE WHEN p_partkey % 4 = 0 THEN '—' ELSE format('{:,}.00', CAST(p_size * 10000 AS BIGINT)) END AS shown, p_size % 2 = 0 AS equal FROM part")
def shown_amounts(m):
    typed = F.when(F.col("p_partkey") % 4 == 0, " ").otherwise(F.col("p_size").cast("string"))
    whole = money.equal(money.exact(F.concat("p_size", F.lit(".9"))), money.exact(F.when(F.col("p_size") % 2 == 0, F.concat("p_size", F.lit(".1"))).otherwise(F.concat(F.col("p_size") + 1, F.lit(".0")))), whole=True)
    return m.table("part").select("p_partkey", money.stored(typed, "万元").cast("decimal(38,2)").alias("stored"), money.shown(money.stored(typed, "万元")).alias("shown"), whole.alias("equal"))


@query("s02_conformed", "SELECT o_orderkey AS notice_id, CAST(o_custkey AS VARCHAR) AS buyer, CAST(NULL AS DECIMAL(38,6)) AS budget FROM orders")
def conformed(m):
    """An older table without a budget, with a buyer of another type and a column too many."""
    schema = T.StructType([T.StructField("notice_id", T.LongType()), T.StructField("buyer", T.StringType()), T.StructField("budget", T.DecimalType(38, 6))])
    return datasets.conformed(m.table("orders").select(F.col("o_orderkey").alias("Notice_ID"), F.col("o_custkey").alias("buyer"), "o_orderstatus"), schema)


def _folder(m, name: str) -> str:
    return f"{linking.shared_folder(m.spark)}/{name}-{uuid.uuid4().hex}"


@query("s17_strict_json", "SELECT o_orderkey AS notice_id, CAST(o_custkey AS VARCHAR) AS buyer FROM orders")
def strict_json(m):
    """Gold documents, written and read again under their schema."""
    folder = _folder(m, "gold")
    m.table("orders").select(F.col("o_orderkey").alias("notice_id"), F.col("o_custkey").cast("string").alias("buyer")).write.mode("overwrite").json(folder)
    return datasets.strict_json(m.spark, folder, T.StructType([T.StructField("notice_id", T.LongType()), T.StructField("buyer", T.StringType())]), lines=True)


@query("s18_manifest", "SELECT CAST(o_orderkey AS VARCHAR) AS notice_id, 2 AS n_files, concat('f', o_custkey) AS first FROM orders")
def manifest(m):
    folder = _folder(m, "manifest")
    rows = m.table("orders").select(F.col("o_orderkey").alias("notice_id"), F.concat(F.lit("f"), "o_custkey", F.lit("; g;")).alias("files"))
    rows.write.mode("overwrite").option("header", "true").csv(folder)
    return datasets.manifest(m.spark, folder).select("notice_id", F.size("files").alias("n_files"), F.col("files")[0].alias("first"))


@query("s26_verified_files", "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 5 = 0 THEN 'missing' ELSE 'other content' END AS problem FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def verified_files(m):
    text, path = F.coalesce("text", F.lit("")), F.col("doc_id").cast("string").alias("path")
    files = m.table("documents").where("doc_id % 5 <> 0").select(path, F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat(text, F.lit("!"))).otherwise(text), 256).alias("sha256"))
    return datasets.verified(m.table("documents").select(path, F.sha2(text, 256).alias("sha256")), files)


@query("s24_cached_results", "SELECT doc_id, doc_id % 3 = 0 AS hit, CASE WHEN doc_id % 3 = 0 THEN concat('r', doc_id) END AS result FROM documents")
def cached_results(m):
    content = F.concat_ws("-", F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))
    docs = m.table("documents").select("doc_id", datasets.cache_key(F.lit("parser 1"), content).alias("key"))
    cache = docs.where("doc_id % 3 = 0").select("key", F.concat(F.lit("r"), "doc_id").alias("result"))
    return datasets.cached(docs, cache).drop("key")


@query("s25_synthetic_items", "SELECT CAST(i AS VARCHAR) AS path, concat('item ', i % 7) AS product_name, concat('brand ', i % 5 + 1) AS brand, CAST(i % 11 AS DECIMAL(38,2)) AS quantity FROM range(1, (SELECT count(*) FROM supplier) + 1) t(i)")
def synthetic_items(m):
    """As many made-up notices as there are suppliers, read back."""
    made = datasets.synthetic(m.spark, m.table("supplier").count())
    found = intake.items(documents.html_cells(made.select(F.col("notice_id").cast("string").alias("path"), "html")))
    return found.select("path", "product_name", "brand", F.col("quantity").cast("decimal(38,2)").alias("quantity"))


@query("k13_ledger", "SELECT s_suppkey, s_name FROM supplier")
def ledger(m):
    folder = _folder(m, "ledger")
    datasets.ledger(m.table("supplier").select("s_suppkey", "s_name"), folder, "s_suppkey")
    return m.spark.read.json(f"{folder}/json").select("s_suppkey", "s_name").intersectAll(m.spark.read.option("header", "true").csv(f"{folder}/csv").select(F.col("s_suppkey").cast("long"), "s_name"))


@query("k14_backfill", f"{M} SELECT project_id, count(*) AS n FROM (SELECT project_id FROM packages UNION ALL SELECT project_id FROM projects WHERE project_id % 3 <> 0) GROUP BY project_id")
def backfill(m):
    rows, _ = records.backfilled(m.packages.select("project_id", "package_id"), m.projects.select("project_id"), m.projects.where("project_id % 3 = 0").select("project_id"), "project_id")
    return rows.groupBy("project_id").agg(F.count("*").alias("n"))


RUNS = "WITH r AS (SELECT user_id AS notice_id, event_type AS mode, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS attempt FROM events)"


@query("k16_archived_attempts", f"{RUNS} SELECT notice_id, mode, attempt, event_id FROM r QUALIFY attempt < max(attempt) OVER (PARTITION BY notice_id, mode)")
def archived_attempts(m):
    runs = records.attempts(m.table("events").select(F.col("user_id").alias("notice_id"), F.col("event_type").alias("mode"), "event_id"), ["notice_id", "mode"], "event_id")
    return datasets.archived(runs)


@query("s30_left_to_run", "SELECT s_suppkey AS notice_id, mo AS mode FROM supplier, unnest(['rules', 'model', 'both']) AS u(mo) WHERE NOT (s_suppkey % 2 = 0 AND mo = 'rules') AND NOT (s_suppkey % 3 = 0 AND mo = 'both' AND s_suppkey % 2 = 1)")
def left_to_run(m):
    key = F.col("s_suppkey")
    rules = m.table("supplier").where("s_suppkey % 2 = 0").select(key.alias("notice_id"), F.lit("rules").alias("mode"), F.lit("now").alias("identity"), F.lit("completed").alias("status"))
    both = m.table("supplier").where("s_suppkey % 3 = 0").select(key.alias("notice_id"), F.lit("both").alias("mode"), F.when(key % 2 == 1, "now").otherwise("then").alias("identity"), F.lit("completed").alias("status"))
    return datasets.to_run(m.table("supplier").select(key.alias("notice_id")), ["rules", "model", "both"], rules.unionByName(both), "now")
