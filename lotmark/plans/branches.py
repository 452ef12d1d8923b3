"""Branches of functions and operators that the other queries don't reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotmark.functions import codes, money, states, text
from lotmark.operators import intake, linking, records, scenes
from lotmark.plans.base import query
from lotmark.sources import catalog, documents
from lotmark.sources.tables import MODEL_SQL as M

CATEGORIES = [*[name for name, _ in states.WARNINGS], "other"]


@query(
    "p16_all_categories",
    f"SELECT p_partkey, CASE p_partkey % {len(CATEGORIES)} {' '.join(f'WHEN {i} THEN {chr(39)}{c}{chr(39)}' for i, c in enumerate(CATEGORIES))} END AS category FROM part",
)
def all_categories(m):
    """A warning of every category, by the last of its ways to say it."""
    said = [" ".join(ways[-1]) for _, ways in states.WARNINGS] + ["nothing known"]
    pick = F.element_at(F.array(*[F.lit(s) for s in said]), (F.col("p_partkey") % len(said) + 1).cast("int"))
    return m.table("part").select("p_partkey", states.warning_category(pick).alias("category"))


TENS = "concat(CASE WHEN n >= 1000 THEN concat(substr('一二三四五六七八九', n // 1000, 1), '千') ELSE '' END, CASE WHEN n % 1000 >= 100 THEN concat(substr('一二三四五六七八九', n % 1000 // 100, 1), '百') ELSE '' END, CASE WHEN n % 100 >= 10 THEN concat(substr('一二三四五六七八九', n % 100 // 10, 1), '十') ELSE '' END, CASE WHEN n % 10 > 0 THEN substr('一二三四五六七八九', n % 10, 1) ELSE '' END)"


@query("f12_large_numerals", f"SELECT n, CAST(CASE WHEN n % 3 = 0 THEN n * 10000 + n ELSE n END AS VARCHAR) AS number FROM (SELECT p_partkey % 9999 + 1 AS n FROM part)")
def large_numerals(m):
    """Every number up to 9999, every third of them once more before 万."""
    rows = m.table("part").select((F.col("p_partkey") % 9999 + 1).alias("n"))
    one = F.expr(TENS.replace("//", "div"))
    return rows.select("n", codes.chinese_number(F.when(F.col("n") % 3 == 0, F.concat(one, F.lit("万"), one)).otherwise(one)).alias("number"))


LABELS = (("包名：{n}", "{n}"), ("分包名称：", "default"), ("合同包{n}（项目）", "{n}"), ("豫政采(2)2026-{n}", "{n}"), ("详见招标文件", "default"), ("K-{n}包", "K-{n}"), ("标段名称：仪器{n}", "仪器{n}"))


@query("f11_all_labels", f"SELECT l_orderkey, l_linenumber, replace(CASE l_partkey % {len(LABELS)} {' '.join(f'WHEN {i} THEN {chr(39)}{want}{chr(39)}' for i, (_, want) in enumerate(LABELS))} END, '{{n}}', CAST(l_linenumber AS VARCHAR)) AS code FROM lineitem")
def all_labels(m):
    pick = F.element_at(F.array(*[F.lit(label) for label, _ in LABELS]), (F.col("l_partkey") % len(LABELS) + 1).cast("int"))
    label = F.replace(pick, F.lit("{n}"), F.col("l_linenumber").cast("string"))
    return m.table("lineitem").select("l_orderkey", "l_linenumber", codes.package_code(label).alias("code"))


@query("f27_package_labels", f"{M} SELECT package_id, CASE WHEN package_id % 3 = 0 THEN 'name' WHEN package_id % 3 = 1 THEN package_code ELSE '' END AS label FROM packages")
def package_labels(m):
    k = F.col("package_id") % 3
    return m.packages.select("package_id", codes.label(F.when(k == 2, "Default").otherwise(F.col("package_code")), F.when(k == 0, " name ").otherwise(" ")).alias("label"))


@query("f06_first_decimals", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size + 1000.5 AS DECIMAL(38,2)) WHEN 1 THEN CAST(-p_size AS DECIMAL(38,2)) END AS number FROM part")
def first_decimals(m):
    k = F.col("p_partkey") % 3
    grouped = F.format_number((F.col("p_size") + F.lit(1000.5)).cast("decimal(18,1)"), 1)
    cell = F.when(k == 0, F.concat(F.lit("约 "), grouped, F.lit(" 元，另 7"))).when(k == 1, F.concat(F.lit("-"), "p_size")).otherwise("无")
    return m.table("part").select("p_partkey", money.first_decimal(cell).cast("decimal(38,2)").alias("number"))


@query("f15_review_statuses", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '通过' WHEN 1 THEN '未通过' WHEN 2 THEN '未通过' END AS status FROM part")
def review_statuses(m):
    k = F.col("p_partkey") % 4
    return m.table("part").select("p_partkey", states.review_status(F.when(k == 0, "审查 合格").when(k == 1, "不 符合要求").when(k == 2, "报价无效").otherwise("—")).alias("status"))


@query("f28_tolerances", "SELECT p_partkey, p_size % 2 = 0 AS near, p_size % 3 = 0 AS relative FROM part")
def tolerances(m):
    a = F.col("p_retailprice").cast("decimal(18,2)")
    near = money.equal(money.exact(a.cast("string")), money.exact((a + F.when(F.col("p_size") % 2 == 0, 0.01).otherwise(0.02).cast("decimal(3,2)")).cast("string")))
    relative = money.equal(money.exact(a.cast("string")), money.exact((a * F.when(F.col("p_size") % 3 == 0, 1.0009).otherwise(1.0021).cast("decimal(6,4)")).cast("string")), "0", "0.001")
    return m.table("part").select("p_partkey", near.alias("near"), relative.alias("relative"))


@query("t09_natural_order", "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS place FROM supplier")
def natural_order(m):
    """Locations such as page 10 come after page 9; places are numbered by prefix sums over ranges, not in one task."""
    rows = m.table("supplier").select("s_suppkey", text.natural_key(F.concat(F.lit("page "), "s_suppkey")).alias("key"))
    return linking.ranked(rows, ["key", "s_suppkey"], "place").drop("key")


@query("t02_sorted_awardees", f"{M} SELECT organization_id, count(DISTINCT project_id) AS projects FROM awards GROUP BY 1 ORDER BY projects DESC, organization_id")
def sorted_awardees(m):
    return scenes.over_projects(scenes.awards(m.bids), "organization_id").select("organization_id", "projects").orderBy(F.desc("projects"), "organization_id")


@query("p02_point_lookup", f"{M} SELECT * FROM organizations WHERE id = 3")
def point_lookup(m):
    return m.organizations.where("id = 3")


@query(
    "a02_brand_evidence",
    f"""{M}, d AS (SELECT DISTINCT buyer_id, trim(brand) AS brand, project_id, package_id, part_id FROM items WHERE trim(brand) <> '')
SELECT buyer_id, brand, count(*) AS n, min((project_id, package_id, part_id))[1] AS first_project, max((project_id, package_id, part_id))[3] AS last_part FROM d GROUP BY ALL""",
)
def brand_evidence(m):
    found = scenes.brand_evidence(m.items)
    return found.select("buyer_id", "brand", F.size("evidence").cast("long").alias("n"), F.col("evidence")[0]["project_id"].alias("first_project"), F.element_at("evidence", -1)["part_id"].alias("last_part"))


@query(
    "j07_items_with_notices",
    f"""{M} SELECT i.project_id, p.package_code, i.part_id, i.line_no, o.name AS buyer_name FROM items i JOIN projects USING (project_id) JOIN organizations o ON o.id = projects.buyer_id LEFT JOIN packages p ON p.package_id = i.package_id AND i.part_id % 2 = 0 WHERE i.product_name ILIKE '%WIDGET%'""",
)
def items_with_notices(m):
    """Items of odd parts have no package here: the item stays."""
    items = m.items.withColumn("package_id", F.when(F.col("part_id") % 2 == 0, F.col("package_id")))
    out = records.with_notices(items.where(F.col("product_name").ilike("%WIDGET%")), m.projects, m.packages, m.organizations)
    return out.select("project_id", "package_code", "part_id", "line_no", "buyer_name")


@query("s05_expanded_members", "SELECT concat('z', s_suppkey, '.zip!/', n) AS path, octet_length(CAST(s_suppkey AS VARCHAR)::BLOB) AS bytes FROM supplier, unnest(['one.txt', 'in.zip!/文件.txt']) AS u(n)")
def expanded_members(m):
    import io
    import zipfile

    import pandas as pd

    def run(frames):
        for frame in frames:
            rows = []
            for key in frame["s_suppkey"]:
                inner, outer = io.BytesIO(), io.BytesIO()
                with zipfile.ZipFile(inner, "w") as z:
                    z.writestr("文件.txt", str(key))
                with zipfile.ZipFile(outer, "w") as z:
                    z.writestr("one.txt", str(key))
                    z.writestr("in.zip", inner.getvalue())
                rows.append((f"z{key}.zip", outer.getvalue()))
            yield pd.DataFrame(rows, columns=["path", "content"])

    found = documents.expand(m.table("supplier").select("s_suppkey").mapInPandas(run, "path string, content binary"))
    return found.select("path", F.octet_length("content").cast("long").alias("bytes"))


@query("s03_created_dataset", "SELECT 'supplier' AS name, count(*) AS n FROM supplier UNION ALL SELECT 'part', count(*) FROM part")
def created_dataset(m):
    import uuid

    root, ident = f"{linking.shared_folder(m.spark)}/sets-{uuid.uuid4().hex}", uuid.uuid4().hex
    catalog.create(root, ident, {"supplier": m.table("supplier"), "part": m.table("part")})
    folder = catalog.resolve(m.spark, root, ident)
    count = lambda n: m.spark.read.parquet(f"{folder}/{n}.parquet").agg(F.lit(n).alias("name"), F.count("*").alias("n"))
    return count("supplier").unionByName(count("part"))


@query("f36_package_aliases", "SELECT CAST(p_partkey AS VARCHAR) AS path, unnest(['1', '2']) AS package_code, unnest([concat('仪器', p_size), p_name]) AS name FROM part")
def package_aliases(m):
    doc = F.concat(F.lit("第一包：仪器"), F.col("p_size"), F.lit("\n说明\n包2 分包名称："), F.col("p_name"), F.lit("\n第三包：\n"))
    return intake.package_aliases(m.table("part").select(F.col("p_partkey").cast("string").alias("path"), doc.alias("text")))


@query(
    "f19_page_structures",
    "SELECT count(*) AS pages, count(DISTINCT sha256(lower(array_to_string(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>', '', 'g'), '<(/?[A-Za-z][A-Za-z0-9]*)', 1), ' ')))) AS structures FROM pages",
)
def page_structures(m):
    return m.table("pages").agg(F.count("*").alias("pages"), F.count_distinct(text.structure(F.col("html"))).alias("structures"))
