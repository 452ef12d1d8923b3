"""Documents made of the tables' rows, read back through the intake operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotmark.operators import intake
from lotmark.plans.base import query
from lotmark.sources import documents


def _notices(m):
    """An HTML notice per part: an item table with a header, one item and a sum, and a bidder table."""
    price = F.col("p_retailprice").cast("decimal(18,2)")
    html = F.concat(
        F.lit("<html><body><table><tr><th>包号</th><th>标的名称</th><th>品牌</th><th>数量（单位）</th><th>单价(元)</th></tr><tr><td>包"), F.col("p_size"), F.lit("</td><td>"), F.col("p_name"), F.lit("</td><td>"),
        F.col("p_brand"), F.lit("</td><td>"), F.col("p_size"), F.lit(" 台</td><td>¥"), price, F.lit("</td></tr><tr><td></td><td>合计</td><td></td><td></td><td>"), price, F.lit("</td></tr></table>"),
        F.lit("<table><tr><th>包号</th><th>供应商名称</th><th>是否中标</th><th>中标金额（万元）</th></tr><tr><td>1</td><td>A "), F.col("p_partkey"), F.lit("</td><td>是</td><td>1.5</td></tr>"),
        F.lit("<tr><td>1</td><td>B</td><td>否</td><td></td></tr></table></body></html>"),
    )
    # parsing is dear, and the table may be one file of one split
    parts = m.table("part").repartition(m.spark.sparkContext.defaultParallelism)
    return parts.select(F.col("p_partkey").cast("string").alias("path"), html.alias("html"))


@query(
    "f33_item_candidates",
    """SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(p_size AS VARCHAR) AS package_code, p_name AS product_name, p_brand AS brand, CAST(p_size AS DECIMAL(38,2)) AS quantity, '台' AS quantity_unit,
  CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DECIMAL(38,2)) AS unit_price FROM part""",
)
def item_candidates(m):
    found = intake.items(documents.html_cells(_notices(m)))
    return found.select("path", "package_code", "product_name", "brand", F.col("quantity").cast("decimal(38,2)").alias("quantity"), "quantity_unit", F.col("unit_price").cast("decimal(38,2)").alias("unit_price"))


@query(
    "f34_participant_candidates",
    """SELECT CAST(p_partkey AS VARCHAR) AS path, '1' AS package_code, concat('A ', p_partkey) AS name, 'winner' AS outcome, CAST(15000 AS DECIMAL(38,2)) AS amount FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), '1', 'B', 'nonwinner', NULL FROM part""",
)
def participant_candidates(m):
    found = intake.participants(documents.html_cells(_notices(m)))
    return found.select("path", "package_code", "name", "outcome", F.col("amount").cast("decimal(38,2)").alias("amount"))


@query("s04_formats", "SELECT 'html' AS format, count(*) AS n FROM pages UNION ALL SELECT 'pdf', count(*) FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'unknown', count(*) FROM part WHERE p_size % 2 = 1")
def formats(m):
    pages = m.table("pages").select(F.encode("html", "UTF-8").alias("content"))
    parts = m.table("part").select(F.encode(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("%PDF-1."), "p_size")).otherwise(F.col("p_name")), "UTF-8").alias("content"))
    return pages.unionByName(parts).groupBy(documents.detected(F.col("content")).alias("format")).agg(F.count("*").alias("n"))


@query(
    "f32_metadata",
    "SELECT CAST(o_orderkey AS VARCHAR) AS path, unnest(['buyer', 'number']) AS field, unnest([CAST(o_custkey AS VARCHAR), concat('N-', o_orderkey)]) AS value, unnest([1, 3])::BIGINT AS line_no FROM orders",
)
def metadata(m):
    text = F.concat(F.lit("notice\n采购单位： "), F.col("o_custkey"), F.lit("\nother\n 项目编号:N-"), F.col("o_orderkey"), F.lit("\n采购人：second"))
    docs = m.table("orders").select(F.col("o_orderkey").cast("string").alias("path"), text.alias("text"))
    return intake.metadata(docs, {"buyer": "采购单位|采购人", "number": "项目编号"})


@query(
    "j24_attachments",
    """WITH n AS (SELECT o_custkey AS s, count(*) AS n, min(o_orderkey) AS k FROM orders GROUP BY 1)
SELECT concat('files/notice ', s_suppkey, '.zip') AS path, CASE WHEN n.n = 1 THEN concat('in/', k, '/Notice  ', s_suppkey, '.html') END AS notice FROM supplier LEFT JOIN n ON n.s = s_suppkey""",
)
def attachments(m):
    """A notice per order, named by its customer; a file per supplier finds that of the customer with its number, if only one."""
    notices = m.table("orders").select(F.expr("concat('in/', o_orderkey, '/Notice  ', o_custkey, '.html')").alias("path"))
    files = m.table("supplier").select(F.expr("concat('files/notice ', s_suppkey, '.zip')").alias("path"))
    return intake.attach(notices, files)


ORDER_NOTICE = "concat('in/', o_orderkey, '/Notice  ', o_custkey, ' ', o_orderpriority, '_附件.html')"
ORDER_ARCHIVE = "concat('files/NOTICE-', o_custkey, '-', o_orderpriority, '.zip!/a', o_orderkey, '.pdf')"
ORDER_FOLDER = "concat('in/', o_orderkey, '/spec.pdf')"


@query(
    "j24_order_attachments",
    f"""SELECT {ORDER_ARCHIVE} AS path, CASE WHEN count(*) OVER (PARTITION BY o_custkey, o_orderpriority) = 1 THEN {ORDER_NOTICE} END AS notice FROM orders
UNION ALL SELECT {ORDER_FOLDER}, {ORDER_NOTICE} FROM orders""",
)
def order_attachments(m):
    """A notice per order. Archives are named by customer and priority, which several orders may share; folders by order."""
    orders = m.table("orders")
    notices = orders.select(F.expr(ORDER_NOTICE).alias("path"))
    files = orders.select(F.explode(F.array(F.expr(ORDER_ARCHIVE), F.expr(ORDER_FOLDER))).alias("path"))
    return intake.attach(notices, files)
