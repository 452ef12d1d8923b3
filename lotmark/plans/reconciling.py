"""Queries that reconcile item rows across the documents of a notice."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotmark.operators import reconciliation
from lotmark.plans.base import query
from lotmark.sources.tables import dealt

#: Every order has three documents: a page, a quote that the page of an even customer's order names, and a list; the last two carry the
#: order's number if the customer is divisible by three. What a row quotes, and whether it knows its package, follows from its line.
SOURCES_SQL = """
WITH documents AS (
  SELECT o_orderkey AS notice_id, k, concat(['notice', 'quote', 'list'][k + 1], '-', o_orderkey, ['.html', '.pdf', '.pdf'][k + 1]) AS path,
    CASE WHEN k > 0 AND o_custkey % 3 = 0 THEN concat('n', o_orderkey) END AS number, concat('project', o_custkey % 7) AS project,
    k = 0 AND o_custkey % 2 = 0 AS names_quote, k = 2 AND o_orderkey % 5 = 0 AS says_two, k = 1 AND o_custkey % 5 = 0 AS equates
  FROM orders, unnest([0, 1, 2]) AS u(k)
), base AS (
  SELECT d.*, l_suppkey, l_partkey, CASE WHEN (l_suppkey + k) % 4 = 0 THEN 'default' WHEN l_linestatus = 'F' THEN '1' WHEN equates AND l_suppkey % 5 = 0 THEN 'l-2' ELSE '2' END AS code,
    CASE WHEN l_linenumber = 1 AND k = 0 THEN d.project ELSE concat('part', l_partkey % 3) END AS name,
    CASE WHEN l_partkey % 11 = 0 THEN '通用' WHEN l_linenumber % 3 <> 0 OR k > 0 THEN concat('m', l_partkey % 40) END AS model,
    CASE WHEN k < 2 OR l_suppkey % 3 > 0 THEN CAST(l_quantity AS DECIMAL(18,2)) + CASE WHEN k = 2 AND l_partkey % 13 = 0 THEN 1 ELSE 0 END END AS quantity,
    CASE WHEN l_tax > 0.02 THEN CAST(l_extendedprice AS DECIMAL(18,2)) + CASE WHEN k = 1 AND l_partkey % 7 = 0 THEN 1 ELSE 0 END END AS total_price,
    CASE WHEN l_discount > 0.04 THEN 1 WHEN l_discount > 0.02 THEN 2 ELSE 0 END AS quotes
  FROM documents d JOIN lineitem ON l_orderkey = notice_id WHERE k = 0 OR l_linenumber % 2 = k % 2 OR l_suppkey % 2 = 0
), items AS (
  SELECT *, name = project AS generic, CASE WHEN equates AND code IN ('2', 'l-2') THEN '2' ELSE code END AS package,
    code <> 'default' AND (quotes = 1 OR (quotes = 2 AND code = '1') OR (equates AND code IN ('2', 'l-2'))) AS supported
  FROM base
)"""


def _documents(m):
    orders = dealt(m.table("orders").select("o_orderkey", "o_custkey"), "o_orderkey", m.pieces)
    orders = orders.select("o_orderkey", "o_custkey", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k"))
    k, key, cust = F.col("k"), F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), k + 1)
    text = F.concat_ws(
        "\n",
        F.when((k == 0) & (cust % 2 == 0), F.concat(F.lit("附件：quote-"), key, F.lit(".pdf"))),
        F.when((k == 2) & (key % 5 == 0), F.lit("采购包1、2")),
        F.when((k == 1) & (cust % 5 == 0), F.lit("包号：2（采购包编号：L-2）")),
    )
    return orders.select(
        key.alias("notice_id"),
        F.concat(pick("notice", "quote", "list"), F.lit("-"), key, pick(".html", ".pdf", ".pdf")).alias("path"),
        text.alias("text"),
        F.when((k > 0) & (cust % 3 == 0), F.concat(F.lit("N"), key)).alias("project_number"),
        F.concat(F.lit("Project "), cust % 7).alias("project_name"),
        "k",
        ((k == 1) & (cust % 5 == 0)).alias("equates"),
    )


LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _items(m, once: bool = False):
    """The rows of all documents; once: of equal numbers in a notice the least row only, the same whenever it is read."""
    line = dealt(m.table("lineitem").select("l_orderkey", *LINE), "l_orderkey", m.pieces)
    docs = _documents(m).select("notice_id", F.col("path").alias("source_file"), "k", "project_name")
    k, part, supp = F.col("k"), F.col("l_partkey"), F.col("l_suppkey")
    code = F.when((supp + k) % 4 == 0, "default").when(F.col("l_linestatus") == "F", "1").otherwise("2")
    some = docs.join(line, F.col("notice_id") == F.col("l_orderkey")).where((k == 0) | (F.col("l_linenumber") % 2 == k % 2) | (supp % 2 == 0))
    some = some.select("notice_id", (((F.col("l_linenumber") * 100_000 + part) * 10_000 + supp) * 10 + k).cast("long").alias("no"), *LINE, "k", "source_file", "project_name")
    if once:
        some = some.groupBy("notice_id", "no").agg(F.min(F.struct(*some.columns[2:])).alias("row")).select("notice_id", "no", "row.*")
    null, money = F.lit(None).cast("string"), "decimal(18,2)"
    more = lambda when: F.when(when, F.lit(1)).otherwise(0).cast(money)
    return some.select(
        "notice_id",
        "no",
        "source_file",
        F.concat(F.lit("row "), F.col("l_linenumber")).alias("source_location"),
        F.when(F.col("l_discount") > 0.04, F.concat(F.lit("包号："), code, F.lit(" row"))).when(F.col("l_discount") > 0.02, F.lit("1-7 row")).otherwise("row").alias("source_evidence"),
        code.alias("package_code"),
        F.when((F.col("l_linenumber") == 1) & (k == 0), F.col("project_name")).otherwise(F.concat(F.lit("Part"), part % 3)).alias("product_name"),
        null.alias("category"), null.alias("brand"),
        F.when(part % 11 == 0, "通用").when((F.col("l_linenumber") % 3 != 0) | (k > 0), F.concat(F.lit("M"), part % 40)).alias("model"),
        F.when((k < 2) | (supp % 3 > 0), (F.col("l_quantity").cast(money) + more((k == 2) & (part % 13 == 0))).cast(money)).alias("quantity"),
        null.alias("quantity_unit"), F.lit(None).cast(money).alias("unit_price"),
        F.when(F.col("l_tax") > 0.02, (F.col("l_extendedprice").cast(money) + more((k == 1) & (part % 7 == 0))).cast(money)).alias("total_price"),
    )


@query(
    "j23_row_pairs",
    f"""{SOURCES_SQL}, met AS (
  SELECT x.notice_id, x.name = y.name AS named, x.package AS p, y.package AS q, x.supported AS ps, y.supported AS qs,
    coalesce(x.model = y.model, false) AS m, coalesce(x.quantity = y.quantity, false) AS n, coalesce(x.total_price = y.total_price, false) AS t, x.generic OR y.generic AS generic, x.model <> '通用' AS tells,
    coalesce(x.model <> y.model, false) AS dm, coalesce(x.quantity <> y.quantity, false) AS dn, coalesce(x.total_price <> y.total_price, false) AS dt
  FROM items x JOIN items y ON x.notice_id = y.notice_id AND x.k < y.k AND (x.number = y.number OR (x.k = 0 AND y.k = 1 AND x.names_quote))
)
SELECT notice_id, CASE WHEN p <> q AND p <> 'default' AND q <> 'default' THEN 'packages' WHEN dm OR dn OR dt THEN 'fields'
  WHEN (p <> 'default' OR q <> 'default') AND NOT (CASE WHEN p = 'default' THEN qs WHEN q = 'default' THEN ps ELSE ps OR qs END) THEN 'unsupported' ELSE 'same' END AS verdict, CAST(count(*) AS BIGINT) AS n
FROM met WHERE CASE WHEN named THEN (m AND n AND tells) OR (t AND (n OR m)) ELSE generic AND m AND n AND tells END GROUP BY ALL""",
)
def row_pairs(m):
    """Pairs of rows that agree in what tells items apart, per order and verdict."""
    documents = _documents(m)
    found = reconciliation.classes(reconciliation.prepared(_items(m), documents))
    judged = reconciliation.pairs(found, reconciliation.document_pairs(documents))
    return judged.groupBy("notice_id", "verdict").agg(F.sum("n").alias("n"))


@query("j23_reconciled_items")
def reconciled_items(m):
    """Cliques need recursion over pairs; tests hold them against all pairs of small notices."""
    rows, _ = reconciliation.reconcile(_items(m, once=True), _documents(m), n=m.pieces)
    return rows.select("notice_id", "item_no", "status", "n_rows", "package_code", "product_name", "model", "quantity", "total_price", F.to_json("sources").alias("sources"))


@query("j23_messages")
def messages(m):
    """What forbids links, and what became of components; held against plain Python in the tests as well."""
    return reconciliation.reconcile(_items(m, once=True), _documents(m), n=m.pieces)[1]
