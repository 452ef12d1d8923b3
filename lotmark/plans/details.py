"""Bidder details, attachments, and documents of Office and text formats."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from lotmark.functions.codes import DEFAULT
from lotmark.operators import bidders, intake, scopes
from lotmark.plans.base import query
from lotmark.sources import documents
from lotmark.sources.tables import MODEL_SQL as M

DETAILS = """WITH d AS (
  SELECT l_orderkey AS notice_id, CASE WHEN l_linenumber % 3 = 0 THEN 'default' ELSE l_linestatus END AS package_code, concat('s ', l_suppkey % 40) AS name, 'f' AS source_file, concat('row ', l_linenumber, '-', l_partkey) AS source_location,
    CASE WHEN l_returnflag = 'R' THEN '通过' WHEN l_returnflag = 'A' THEN '未通过' END AS qualification, CASE WHEN l_returnflag = 'R' THEN '通过' END AS compliance, CAST(NULL AS VARCHAR) AS review,
    CASE WHEN l_tax > 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS bid_amount, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_partkey % 3 AS VARCHAR) END AS score, CAST(NULL AS VARCHAR) AS reason
  FROM lineitem
)"""


def details(m):
    line = F.col("l_linenumber")
    none = F.lit(None).cast("string")
    return m.table("lineitem").select(
        F.col("l_orderkey").alias("notice_id"), F.when(line % 3 == 0, DEFAULT).otherwise(F.col("l_linestatus")).alias("package_code"), F.concat(F.lit("S "), F.col("l_suppkey") % 40).alias("name"), F.lit("f").alias("source_file"),
        F.concat(F.lit("row "), line, F.lit("-"), "l_partkey").alias("source_location"), F.when(F.col("l_returnflag") == "R", "通过").when(F.col("l_returnflag") == "A", "未通过").alias("qualification"),
        F.when(F.col("l_returnflag") == "R", "通过").alias("compliance"), none.alias("review"), F.when(F.col("l_tax") > 0, F.col("l_quantity").cast("long").cast("string")).alias("bid_amount"),
        F.when(line % 2 == 0, (F.col("l_partkey") % 3).cast("string")).alias("score"), none.alias("reason"),
    )


ONE = lambda f: f"CASE WHEN min({f}) = max({f}) THEN min({f}) END AS {f}"
CLASH = lambda f: f"CASE WHEN min({f}) <> max({f}) THEN '{f}' END"
MERGED = f"""{', '.join(ONE(f) for f in bidders.FIELDS)}, array_to_string(list_sort(list_filter([{', '.join(CLASH(f) for f in bidders.FIELDS)}], lambda x: x IS NOT NULL)), ',') AS conflicts"""
REVIEW = """CASE WHEN contains(conflicts, 'qualification') OR contains(conflicts, 'compliance') OR contains(conflicts, 'review') THEN review WHEN coalesce(qualification = '未通过', false) OR coalesce(compliance = '未通过', false) THEN '未通过' WHEN qualification = '通过' AND compliance = '通过' THEN '通过' ELSE review END"""
ANCHORED = f"""{DETAILS}, k AS (SELECT *, replace(name, ' ', '') AS name_key FROM d), n AS (SELECT notice_id, name_key, count(DISTINCT package_code) AS c, min(package_code) AS p FROM k WHERE package_code <> 'default' GROUP BY ALL),
a AS (SELECT k.* REPLACE (CASE WHEN k.package_code = 'default' AND n.c = 1 THEN n.p ELSE k.package_code END AS package_code) FROM k LEFT JOIN n USING (notice_id, name_key))"""


@query(
    "a23_bidder_details",
    f"""{ANCHORED}, g AS (SELECT notice_id, package_code, name_key, CASE WHEN package_code = 'default' THEN source_location ELSE '' END AS s, count(*) AS n_records, {MERGED} FROM a GROUP BY ALL)
SELECT notice_id, package_code, name_key, n_records, conflicts, qualification, compliance, {REVIEW} AS review, bid_amount, score FROM g""",
)
def bidder_details(m):
    out = bidders.merge(details(m))
    return out.select("notice_id", "package_code", "name_key", "n_records", F.array_join("conflicts", ",").alias("conflicts"), "qualification", "compliance", "review", "bid_amount", "score")


PEOPLE = """, people AS (SELECT DISTINCT l_orderkey AS notice_id, l_linestatus AS package_code, concat('s', l_suppkey % 40) AS name_key FROM lineitem),
lots AS (SELECT notice_id, name_key, count(DISTINCT package_code) AS lots FROM people GROUP BY ALL),
met AS (SELECT p.*, k.* EXCLUDE (notice_id, name_key, package_code), k.package_code AS record_package FROM people p JOIN lots USING (notice_id, name_key) LEFT JOIN n USING (notice_id, name_key) JOIN k USING (notice_id, name_key)
  WHERE k.package_code = p.package_code OR (k.package_code = 'default' AND lots = 1 AND coalesce(n.c, 0) <= 1 AND coalesce(n.p, p.package_code) = p.package_code))"""


def _participants(m):
    return m.table("lineitem").select(F.col("l_orderkey").alias("notice_id"), F.col("l_linestatus").alias("package_code"), F.concat(F.lit("S "), F.col("l_suppkey") % 40).alias("name"), F.when(F.col("l_returnflag") == "R", "winner").otherwise("unknown").alias("outcome"))


@query("j26_matched_details", f"{ANCHORED}{PEOPLE} SELECT notice_id, package_code, name_key, record_package, source_location FROM met")
def matched_details(m):
    return bidders.matched(_participants(m), details(m)).select("notice_id", "package_code", "name_key", "record_package", "source_location")


@query(
    "a22_bidder_sheet",
    f"""{ANCHORED}{PEOPLE}, said AS (SELECT notice_id, package_code, name_key, {MERGED} FROM met GROUP BY ALL), won AS (
  SELECT l_orderkey AS notice_id, l_linestatus AS package_code, concat('s', l_suppkey % 40) AS name_key, bool_or(l_returnflag = 'R') AS w FROM lineitem GROUP BY ALL
), rest AS (SELECT k.* FROM k WHERE NOT EXISTS (SELECT 1 FROM met WHERE met.notice_id = k.notice_id AND met.name_key = k.name_key AND met.record_package = k.package_code)),
other AS (SELECT notice_id, package_code, name_key, {MERGED} FROM rest GROUP BY ALL)
SELECT notice_id, package_code, name_key, CASE WHEN w THEN '中标人' ELSE '参与人' END AS category, qualification, {REVIEW} AS review, CAST(round(CAST(bid_amount AS DECIMAL(30,2)) * CAST(0.0001 AS DECIMAL(5,4)), 2) AS DECIMAL(38,2)) AS amount_wan
FROM won LEFT JOIN said USING (notice_id, package_code, name_key)
UNION ALL SELECT notice_id, package_code, name_key, '其他', qualification, {REVIEW}, CAST(round(CAST(bid_amount AS DECIMAL(30,2)) * CAST(0.0001 AS DECIMAL(5,4)), 2) AS DECIMAL(38,2)) FROM other""",
)
def bidder_sheet(m):
    people = _participants(m)
    awards = people.where("outcome = 'winner'").withColumn("award_amount", F.lit(None).cast("decimal(38,2)"))
    return bidders.export(people, awards, details(m), m.pieces).select("notice_id", "package_code", "name_key", "category", "qualification", "review", "amount_wan")


@query("k05_read_back", f"""{DETAILS} SELECT notice_id, source_location, CASE WHEN notice_id % 3 = 0 THEN 'f.html' END AS source_file FROM d""")
def read_back(m):
    """Evidence of every third notice is an object, of the others broken or a list."""
    json = F.when(F.col("notice_id") % 3 == 0, '{"score": {"source_file": "f.html", "source_location": "r", "source_evidence": "e"}}').when(F.col("notice_id") % 3 == 1, "{broken").otherwise("[1]")
    out = bidders.read_back(details(m).drop("source_file").withColumn("field_evidence_json", json))
    return out.select("notice_id", "source_location", F.col("field_evidence")["score"]["source_file"].alias("source_file"))


@query("k04_canonical_details", f"{DETAILS} SELECT notice_id, count(DISTINCT (package_code, name, source_location, qualification, compliance, bid_amount, score)) AS n FROM d GROUP BY notice_id")
def canonical_details(m):
    """Every record once with a plain amount and once with zeros behind it."""
    d = details(m)
    amount = F.col("bid_amount").cast("decimal(18,2)")
    twice = d.withColumn("bid_amount", amount.cast("decimal(20,2)")).withColumn("score", F.col("score").cast("decimal(9,1)"))
    again = d.withColumn("bid_amount", amount.cast("decimal(20,4)").cast("decimal(20,2)")).withColumn("score", F.col("score").cast("decimal(9,1)"))
    return bidders.canonical(twice.unionByName(again)).groupBy("notice_id").agg(F.count("*").alias("n"))


def _review_tables(m):
    """A table per part: suppliers with both reviews, an offer, a score, and a second header with other columns below."""
    part = F.col("p_partkey")
    html = F.concat(
        F.lit("<table><tr><th>供应商名称</th><th>资格审查</th><th>符合性审查</th><th>投标报价（万元）</th><th>得分</th></tr><tr><td>A "), part, F.lit("</td><td>通过</td><td>通过</td><td>"), F.col("p_size"), F.lit("</td><td>9.50</td></tr>"),
        F.lit("<tr><td>B</td><td>不通过：缺材料</td><td></td><td></td><td></td></tr><tr><th>投标人名称</th><th>综合得分</th><th>备注</th></tr><tr><td>C</td><td>1,0</td><td>资格审查不合格</td></tr></table>"),
    )
    return m.table("part").repartition(m.spark.sparkContext.defaultParallelism).select(part.cast("string").alias("path"), html.alias("html"))


@query(
    "f35_bidder_records",
    """SELECT CAST(p_partkey AS VARCHAR) AS path, concat('A ', p_partkey) AS name, '2' AS package_code, '通过' AS review, CAST(p_size * 10000 AS DECIMAL(38,2)) AS bid_amount, CAST(9.5 AS DECIMAL(38,2)) AS score, NULL AS reason FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'B', '2', '未通过', NULL, NULL, '不通过：缺材料' FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'C', '2', '未通过', NULL, 10, '资格审查不合格' FROM part""",
)
def bidder_records(m):
    tables = _review_tables(m)
    contexts = tables.select("path", F.lit(0).cast("long").alias("table_no"), F.lit("采购包2评审情况").alias("context"))
    out = intake.bidder_details(documents.html_cells(tables), contexts)
    return out.select("path", "name", "package_code", "review", F.col("bid_amount").cast("decimal(38,2)").alias("bid_amount"), F.col("score").cast("decimal(38,2)").alias("score"), "reason")


@query(
    "p25_cell_statuses",
    """SELECT CAST(p_partkey AS VARCHAR) AS path, f AS field, CASE f WHEN 'product_name' THEN 'present' WHEN 'quantity' THEN CASE p_size % 3 WHEN 0 THEN 'present' WHEN 1 THEN 'blank_in_source' ELSE 'explicitly_not_published' END WHEN 'brand' THEN 'present' ELSE 'unknown' END AS status
FROM part, unnest(['package_code', 'product_name', 'category', 'brand', 'model', 'quantity', 'unit_price', 'total_price']) AS u(f)""",
)
def cell_statuses(m):
    cell = F.when(F.col("p_size") % 3 == 0, "5").when(F.col("p_size") % 3 == 1, " ").otherwise("未 公布")
    html = F.concat(F.lit("<table><tr><th>标的名称</th><th>品牌</th><th>数量</th></tr><tr><td>x</td><td>y</td><td>"), cell, F.lit("</td></tr></table>"))
    parts = m.table("part").repartition(m.spark.sparkContext.defaultParallelism).select(F.col("p_partkey").cast("string").alias("path"), html.alias("html"))
    return intake.field_states(documents.html_cells(parts)).select("path", "field", "status")


@query(
    "w08_header_switch",
    "SELECT CAST(p_partkey AS VARCHAR) AS path, unnest(['one', 'two']) AS product_name, unnest([p_brand, NULL]) AS brand, unnest([NULL, CAST(p_size AS VARCHAR)]) AS model FROM part",
)
def header_switch(m):
    html = F.concat(
        F.lit("<table><tr><th>标的名称</th><th>品牌</th><th>数量</th></tr><tr><td>one</td><td>"), F.col("p_brand"), F.lit("</td><td>1</td></tr><tr><th>数量</th><th>型号</th><th>标的名称</th></tr><tr><td>2</td><td>"), F.col("p_size"), F.lit("</td><td>two</td></tr></table>")
    )
    parts = m.table("part").repartition(m.spark.sparkContext.defaultParallelism).select(F.col("p_partkey").cast("string").alias("path"), html.alias("html"))
    return intake.items(documents.html_cells(parts)).select("path", "product_name", "brand", "model")


@query("f34_key_value_winners", "SELECT CAST(p_partkey AS VARCHAR) AS path, concat('W ', p_partkey) AS name, CAST(p_size * 10000 AS DECIMAL(38,2)) AS amount FROM part")
def key_value_winners(m):
    html = F.concat(F.lit("<table><tr><td>项目</td><td>x</td></tr><tr><td>中标供应商</td><td>W "), F.col("p_partkey"), F.lit("</td></tr><tr><td>中标金额（万元）</td><td>"), F.col("p_size"), F.lit("</td></tr></table>"))
    parts = m.table("part").repartition(m.spark.sparkContext.defaultParallelism).select(F.col("p_partkey").cast("string").alias("path"), html.alias("html"))
    return intake.winners(documents.html_cells(parts)).select("path", "name", F.col("amount").cast("decimal(38,2)").alias("amount"))


def office_file(kind: str, rows: list[list[str]]) -> bytes:
    """A small Word or Excel file with one table, for queries and tests."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if kind == "docx":
            w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
            cells = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>" for row in rows)
            z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:tbl>{cells}</w:tbl></w:body></w:document>')
        else:
            x = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
            words = [c for row in rows for c in row]
            z.writestr("xl/workbook.xml", "<workbook/>")
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{x}">' + "".join(f"<si><t>{c}</t></si>" for c in words) + "</sst>")
            at = iter(range(len(words)))
            cells = "".join(f'<row r="{r + 1}">' + "".join(f'<c r="{chr(65 + c)}{r + 1}" t="s"><v>{next(at)}</v></c>' for c in range(len(row))) + "</row>" for r, row in enumerate(rows))
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{x}"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def _files(m):
    """A file per part: Word, Excel, text with tabs, an archive with a Word file, HTML, or a download that failed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, name in zip(frame["p_partkey"], frame["p_name"], strict=True):
                table, kind = [["标的名称", "品牌"], [name, str(key)]], key % 6
                if kind == 0:
                    rows.append((f"{key}.docx", office_file("docx", table)))
                elif kind == 1:
                    rows.append((f"{key}.xlsx", office_file("xlsx", table)))
                elif kind == 2:
                    rows.append((f"{key}.txt", "\n".join(["head", *["\t".join(r) for r in table]]).encode()))
                elif kind == 3:
                    out = io.BytesIO()
                    with zipfile.ZipFile(out, "w") as z:
                        z.writestr("in.docx", office_file("docx", table))
                    rows.append((f"{key}.zip", out.getvalue()))
                elif kind == 4:
                    rows.append((f"{key}.html", f"<table><tr><td>标的名称</td><td>品牌</td></tr><tr><td>{name}</td><td>{key}</td></tr></table>".encode()))
                else:
                    rows.append((f"{key}.pdf", b'{"success": false, "msg": "gone"}'))
            yield pd.DataFrame(rows, columns=["path", "content"])

    parts = m.table("part").select("p_partkey", "p_name").repartition(m.spark.sparkContext.defaultParallelism)
    return parts.mapInPandas(run, "path string, content binary")


@query(
    "s15_dispatched_cells",
    """WITH p AS (SELECT *, p_partkey % 6 AS k FROM part WHERE p_partkey % 6 <> 5), t AS (SELECT p_partkey, k, unnest([0, 0, 1, 1]) AS r, unnest([0, 1, 0, 1]) AS col_no, unnest(['标的名称', '品牌', p_name, CAST(p_partkey AS VARCHAR)]) AS text FROM p)
SELECT concat(p_partkey, CASE k WHEN 0 THEN '.docx' WHEN 1 THEN '.xlsx' WHEN 2 THEN '.txt' WHEN 3 THEN '.zip!/in.docx' ELSE '.html' END) AS path, CAST(CASE WHEN k = 2 THEN r + 1 ELSE r END AS BIGINT) AS row_no, CAST(col_no AS BIGINT) AS col_no, text FROM t""",
)
def dispatched_cells(m):
    cells, _ = documents.dispatched(documents.expand(_files(m)))
    return cells.select("path", "row_no", "col_no", "text")


@query("s15_dispatch_warnings", "SELECT concat(p_partkey, '.pdf') AS path, 'json error' AS warning FROM part WHERE p_partkey % 6 = 5")
def dispatch_warnings(m):
    _, warnings = documents.dispatched(documents.expand(_files(m)))
    return warnings.select("path", "warning")


@query("s20_paired_files", "SELECT concat('in/', s_suppkey, '.html') AS notice, CASE WHEN s_suppkey % 2 = 0 THEN concat('in/', s_suppkey, '.zip') END AS archive FROM supplier")
def paired_files(m):
    path = F.concat(F.lit("in/"), "s_suppkey")
    files = m.table("supplier").select(F.explode(F.array(F.concat(path, F.lit(".html")), F.when(F.col("s_suppkey") % 2 == 0, F.concat(path, F.lit(".zip"))).otherwise(F.concat(path, F.lit(".txt"))))).alias("path"))
    return documents.paired(files)


PURPOSES = ("一、本项目采购清单\n货物 10 台", "附件3：类似项目业绩一览表\n合同签订日期 2020", "评审结果\n得分 90", "一、采购清单\n x\n二、业绩一览表\ny", "just prose about 业绩一览表 and others", "")


def _papers(m):
    text = F.element_at(F.array(*[F.lit(p) for p in PURPOSES]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return m.table("part").select(F.concat(F.lit("a.zip!/p"), "p_partkey", F.lit(".txt")).alias("path"), text.alias("text"), "p_partkey")


@query(
    "p26_purposes",
    """SELECT concat('a.zip!/p', p_partkey, '.txt') AS path, k[1] AS scope, k[2] = 'y' AS items, k[3] = 'y' AS participants, k[4] = 'y' AS metadata FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ['current_procurement', 'y', 'y', 'y'] WHEN 1 THEN ['historical_qualification', 'n', 'n', 'n']
  WHEN 2 THEN ['current_evaluation', 'n', 'y', 'n'] WHEN 3 THEN ['mixed', 'y', 'y', 'n'] ELSE ['unknown', 'y', 'y', 'y'] END AS k FROM part)""",
)
def purposes(m):
    return scopes.classified(_papers(m).select("path", "text"))


@query(
    "p27_in_scope",
    "SELECT concat('a.zip!/p', p_partkey, '.txt') AS path, e AS evidence_no FROM part, unnest([1, 2]) AS u(e) WHERE p_partkey % 6 IN (0, 4, 5) OR (p_partkey % 6 = 3 AND e = 1)",
)
def in_scope(m):
    """Two quotes a paper: of a mixed one, the first stands under current items, the second under history."""
    papers = _papers(m)
    quotes = papers.select("path", F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("evidence_no"), F.lit(q).alias("quote")) for n, q in ((1, "x"), (2, "y"))])).alias("q")).select("path", "q.*")
    placed = scopes.placed(papers.select("path", "text"), quotes)
    return scopes.in_scope(quotes, scopes.classified(papers.select("path", "text")), placed, "items").select("path", F.col("evidence_no").cast("int").alias("evidence_no"))


@query("w09_nearest_headings", "SELECT concat('a.zip!/p', p_partkey, '.txt') AS path, CASE p_partkey % 6 WHEN 0 THEN 'current' WHEN 3 THEN 'current' END AS purpose FROM part")
def nearest_headings(m):
    papers = _papers(m)
    quote = F.when(F.col("p_partkey") % 6 == 0, "10 台").when(F.col("p_partkey") % 6 == 3, "x").otherwise("absent")
    placed = scopes.placed(papers.select("path", "text"), papers.select("path", F.lit(1).cast("long").alias("evidence_no"), quote.alias("quote")))
    return placed.select("path", "purpose")


@query(
    "p28_references",
    "SELECT p_partkey, p_partkey % 3 = 0 AS reference, p_size % 2 = 0 AS unfilled FROM part",
)
def references(m):
    path = F.when(F.col("p_partkey") % 3 == 0, "x/招标文件.pdf").when(F.col("p_partkey") % 3 == 1, "招标文件.zip!/list.pdf").otherwise("中标结果及招标文件.pdf")
    text = F.when(F.col("p_size") % 2 == 0, "名称：________ 日期：______ 盖章（  ）").otherwise(F.concat(F.lit("名称：full "), F.col("p_name")))
    return m.table("part").select("p_partkey", scopes.is_reference(path).alias("reference"), scopes.is_unfilled(text).alias("unfilled"))


@query(
    "p35_categories",
    "SELECT o_orderkey AS notice_id, array_to_string(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'attachment' END, CASE WHEN o_custkey % 2 = 0 THEN 'html_table' END, CASE WHEN o_orderkey % 3 <> 0 THEN 'no_zip' END, CASE WHEN o_orderkey % 5 = 0 THEN 'ocr' END, CASE WHEN o_custkey % 3 > 1 THEN 'multi_package' END, CASE WHEN o_custkey % 7 >= 5 THEN 'high' END, CASE WHEN o_custkey % 7 = 0 THEN 'zero' END], lambda x: x IS NOT NULL), ',') AS categories FROM orders",
)
def categories(m):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = m.table("orders").select(key.alias("notice_id"), ((key + 1) % 2).alias("n_attachments"), ((cust + 1) % 2).alias("n_tables"), (key % 3 == 0).alias("has_zip"), (key % 5 == 0).alias("scanned"), (cust % 3).alias("n_packages"), (cust % 7).alias("n_items"), F.lit(5).alias("high"))
    return scopes.categories(rows).select("notice_id", F.array_join("categories", ",").alias("categories"))


@query(
    "p37_warning_sources",
    "SELECT o_orderkey AS notice_id, unnest([1, 2]) AS warning_no, unnest([concat('f', o_custkey % 3, '.zip!/a.pdf'), NULL]) AS path FROM orders",
)
def warning_sources(m):
    archive = F.concat(F.lit("f"), F.col("o_custkey") % 3, F.lit(".zip"))
    warnings = m.table("orders").select(F.col("o_orderkey").alias("notice_id"), F.posexplode(F.array(F.concat(archive, F.lit("!/a.pdf: 解析失败：x")), F.lit("no file"))).alias("n", "warning"))
    sources = m.table("orders").select(F.col("o_orderkey").alias("notice_id"), F.explode(F.array(archive, F.concat(archive, F.lit("!/a.pdf")))).alias("path"))
    return scopes.warning_sources(warnings.select("notice_id", (F.col("n") + 1).alias("warning_no"), "warning"), sources)


STATES = (("源附件不可用：x", 0, None, "unavailable"), ("附件容器展开失败", 1, None, "failed"), ("暂不支持附件格式", 1, None, "unsupported"), (None, 3, "historical_qualification", "historical"), ("仅提取文本", 1, None, "partial"), (None, 2, "mixed", "parsed"), (None, 0, None, "empty"))


@query(
    "p38_attachment_states",
    f"SELECT status, count(*) AS n FROM (SELECT CASE l_partkey % 7 {' '.join(f'WHEN {i} THEN {chr(39)}{s[3]}{chr(39)}' for i, s in enumerate(STATES))} END AS status FROM lineitem) GROUP BY status",
)
def attachment_states(m):
    k = (F.col("l_partkey") % 7 + 1).cast("int")
    pick = lambda i, kind: F.element_at(F.array(*[F.lit(s[i]).cast(kind) for s in STATES]), k)
    return m.table("lineitem").groupBy(scopes.attachment_status(pick(0, "string"), pick(1, "int"), pick(2, "string")).alias("status")).agg(F.count("*").alias("n"))


@query(
    "j25_document_links",
    "SELECT o_orderkey AS notice_id, unnest([concat('z/spec-', o_orderkey, '.pdf'), 'z/other.pdf']) AS path, unnest([o_orderkey % 2 = 0, false]) AS linked FROM orders",
)
def document_links(m):
    key = F.col("o_orderkey")
    texts = m.table("orders").select(key.alias("notice_id"), F.concat(F.lit("see spec - "), F.when(key % 2 == 0, key.cast("string")).otherwise(F.lit("x")), F.lit(".pdf and a.pdf")).alias("text"))
    files = m.table("orders").select(key.alias("notice_id"), F.explode(F.array(F.concat(F.lit("z/spec-"), key, F.lit(".pdf")), F.lit("z/other.pdf"), F.lit("a.pdf"))).alias("path"))
    return scopes.document_links(texts, files)


@query(
    "p44_referenced_names",
    "WITH p AS (SELECT page_id, list_distinct(list_transform(regexp_extract_all(html, '(?i)(?:href|src)=[\"'']?([^\"''\\s>]+)', 1), lambda u: regexp_extract(regexp_replace(u, '[?#].*$', ''), '([^/]*)$', 1))) AS names FROM pages) SELECT CAST(page_id AS VARCHAR) AS path, n AS name FROM (SELECT page_id, unnest(names) AS n FROM p) WHERE n <> ''",
)
def referenced_names(m):
    return scopes.referenced(m.table("pages").select(F.col("page_id").cast("string").alias("path"), "html"))


@query("s28_admitted_details", "SELECT CAST(p_partkey AS VARCHAR) AS path, n AS name FROM part, unnest(['A', 'B', 'C']) AS u(n) WHERE p_partkey % 6 <> 1")
def admitted_details(m):
    """Review tables of documents for six purposes: those of history give nothing."""
    papers = _papers(m).select(F.col("p_partkey").cast("string").alias("path"), "text")
    found = intake.bidder_details(documents.html_cells(_review_tables(m))).select("path", F.substring("name", 1, 1).alias("name"))
    return scopes.admitted(found, papers)
