"""Scalar functions over whole tables. Their SQL writes the expected values down from what the inputs were built of."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotmark.functions import codes, money, states, text
from lotmark.plans.base import query

#: White space for an engine whose \s is ASCII.
SPACES = "[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
HOSTS = ["example.org", "example.com"]


@query("f10_collapsed", f"SELECT doc_id, trim(regexp_replace(text, '{SPACES}', ' ', 'g')) AS text FROM documents")
def collapsed(m):
    return m.table("documents").select("doc_id", text.collapse(F.col("text")).alias("text"))


@query("f01_organization_keys", f"SELECT c_custkey, lower(regexp_replace(concat(' ', upper(c_name), '　'), '{SPACES}', '', 'g')) AS key FROM customer")
def organization_keys(m):
    return m.table("customer").select("c_custkey", text.organization_key(F.concat(F.lit(" "), F.upper("c_name"), F.lit("　"))).alias("key"))


@query("f02_name_keys", "SELECT s_suppkey, lower(replace(s_name, ' ', '')) AS key FROM supplier")
def name_keys(m):
    wide = F.translate("s_name", "0123456789", "０１２３４５６７８９")
    return m.table("supplier").select("s_suppkey", text.name_key(wide).alias("key"))


@query("a09_exact_sums", "SELECT l_suppkey, CASE WHEN count(*) FILTER (l_linenumber NOT IN (1, 2)) > 0 THEN CAST(coalesce(sum(CASE WHEN l_linenumber > 3 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END), 0) AS DECIMAL(38,2)) END AS total FROM lineitem GROUP BY l_suppkey")
def exact_sums(m):
    shown = F.when(F.col("l_linenumber") == 1, "").when(F.col("l_linenumber") == 2, None).when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    return m.table("lineitem").groupBy("l_suppkey").agg(money.exact_sum(shown).cast("decimal(38,2)").alias("total"))


@query(
    "f05_amounts",
    "SELECT p_partkey, CASE p_size % 5 WHEN 4 THEN NULL WHEN 3 THEN CAST(p_retailprice AS DECIMAL(18,2)) * 10000 ELSE CAST(p_retailprice AS DECIMAL(18,2)) * (CASE p_size % 5 WHEN 1 THEN 10000 WHEN 2 THEN 100000000 ELSE 1 END) END::DECIMAL(38,2) AS amount FROM part",
)
def amounts(m):
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    kind = F.col("p_size") % 5
    cell = F.when(kind == 0, F.concat(F.lit("¥ "), price, F.lit("元"))).when(kind == 1, F.concat(price, F.lit("万元"))).when(kind == 2, F.concat(F.lit("人民币"), price, F.lit("亿元"))).when(kind == 3, price).otherwise(F.concat(price, F.lit("%")))
    header = F.when(kind == 3, "总价（万元）").otherwise("总价")
    return m.table("part").select("p_partkey", money.amount(cell, header).cast("decimal(38,2)").alias("amount"))


@query(
    "f04_numbers",
    "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 1234567.5 + p_size WHEN 1 THEN p_size * 10000 WHEN 2 THEN NULL ELSE p_size * 100 END::DECIMAL(38,2) AS number FROM part",
)
def numbers(m):
    kind, size = F.col("p_size") % 4, F.col("p_size")
    grouped = F.format_number((F.lit(1234567.5) + size).cast("decimal(18,1)"), 1)
    cell = F.when(kind == 0, F.concat(F.lit("CNY "), grouped)).when(kind == 1, F.concat(size, F.lit(" 万元"))).when(kind == 2, F.concat(size, F.lit(",1"))).otherwise(F.concat(size, F.lit("e2")))
    return m.table("part").select("p_partkey", money.number(cell, monetary=True).cast("decimal(38,2)").alias("number"))


@query("f16_canonical_decimals", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN concat(p_size, '.5') ELSE concat(p_size, '.05') END AS number FROM part")
def canonical_decimals(m):
    more = F.when(F.col("p_size") % 3 == 0, "0").when(F.col("p_size") % 3 == 1, "0.50").otherwise("0.05")
    return m.table("part").select("p_partkey", money.canonical((F.col("p_size").cast(money.EXACT) + more.cast(money.EXACT)).cast(money.EXACT)).alias("number"))


NUMERAL = "concat(CASE WHEN p_size >= 20 THEN substr('一二三四五六七八九', p_size // 10, 1) ELSE '' END, CASE WHEN p_size >= 10 THEN '十' ELSE '' END, CASE WHEN p_size % 10 > 0 THEN substr('一二三四五六七八九', p_size % 10, 1) ELSE '' END)"


@query("f12_chinese_numbers", f"SELECT p_partkey, {NUMERAL} AS numeral, CAST(p_size AS VARCHAR) AS number FROM part")
def chinese_numbers(m):
    rows = m.table("part").select("p_partkey", F.expr(NUMERAL.replace("//", "div")).alias("numeral"))
    return rows.withColumn("number", codes.chinese_number(F.col("numeral")))


@query(
    "f11_package_codes",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 7 = 6 THEN 'default' WHEN l_linenumber % 7 = 5 THEN concat('A-', l_linenumber) ELSE CAST(l_linenumber AS VARCHAR) END AS code FROM lineitem",
)
def package_codes(m):
    n = F.col("l_linenumber").cast("string")
    one = F.translate(n, "123456789", "一二三四五六七八九")
    kind = F.col("l_linenumber") % 7
    label = F.when(kind == 0, F.concat(F.lit("合同包"), n)).when(kind == 1, F.concat(F.lit("包号：0"), n)).when(kind == 2, F.concat(F.lit("第"), one, F.lit("包")))
    label = label.when(kind == 3, F.concat(n, F.lit("标段"))).when(kind == 4, F.concat(F.lit("标段名称：第"), one, F.lit("标段"))).when(kind == 5, F.concat(F.lit(" A-"), n, F.lit("；"))).otherwise("详见采购文件")
    return m.table("lineitem").select("l_orderkey", "l_linenumber", codes.package_code(label).alias("code"))


@query(
    "p13_field_states",
    """WITH s AS (SELECT l_orderkey, l_tax > 0 AS filled, CASE l_linenumber % 5 WHEN 0 THEN 'present' WHEN 1 THEN 'blank_in_source' WHEN 2 THEN 'unverified' WHEN 3 THEN 'nonsense' END AS saved, l_returnflag = 'R' AS backed FROM lineitem)
SELECT l_orderkey, CASE WHEN filled THEN CASE WHEN coalesce(saved = 'present', false) AND backed THEN 'present' ELSE 'unverified' END WHEN saved IS NULL OR saved = 'nonsense' THEN 'unknown'
  WHEN saved = 'blank_in_source' THEN CASE WHEN backed THEN saved ELSE 'unknown' END ELSE 'unverified' END AS state, count(*) AS n FROM s GROUP BY ALL""",
)
def field_states(m):
    k = F.col("l_linenumber") % 5
    saved = F.when(k == 0, "present").when(k == 1, "blank_in_source").when(k == 2, "unverified").when(k == 3, "nonsense")
    state = states.field_state(F.when(F.col("l_tax") > 0, F.col("l_extendedprice")), saved, F.col("l_returnflag") == "R")
    return m.table("lineitem").groupBy("l_orderkey", state.alias("state")).agg(F.count("*").alias("n"))


@query(
    "p16_warning_categories",
    "SELECT CASE l_linenumber % 4 WHEN 0 THEN 'source_unavailable' WHEN 1 THEN 'ocr_failure' WHEN 2 THEN 'format_mismatch' ELSE 'other' END AS category, count(*) AS n FROM lineitem GROUP BY 1",
)
def warning_categories(m):
    k = F.col("l_linenumber") % 4
    said = F.when(k == 0, "源附件不可用：a.zip").when(k == 1, "本地 OCR 超时").when(k == 2, "扩展名为 doc，已按内容读取").otherwise("page by page")
    return m.table("lineitem").groupBy(states.warning_category(said).alias("category")).agg(F.count("*").alias("n"))


@query(
    "p34_allowed_urls",
    "SELECT page_id, coalesce(regexp_matches(lower(url), '^https?://([^/?#@:]*\\.)?(example\\.org|example\\.com)(:(80|443))?([/?#]|$)'), false) AS allowed FROM pages",
)
def allowed_urls(m):
    return m.table("pages").select("page_id", text.allowed(F.col("url"), HOSTS).alias("allowed"))


@query(
    "f40_links",
    "WITH p AS (SELECT page_id, list_distinct(list_transform(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=\"([^\"]*)\"', 1), lambda u: regexp_replace(u, '#.*$', ''))) AS links FROM pages) SELECT page_id, unnest(links) AS link FROM p",
)
def links(m):
    return m.table("pages").select("page_id", F.explode(text.links(F.col("html"))).alias("link"))


VISIBLE = "regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"


@query(
    "f18_visible_text",
    f"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace({VISIBLE}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '{SPACES}', ' ', 'g')) AS text FROM pages",
)
def visible_text(m):
    return m.table("pages").select("page_id", text.visible(F.col("html")).alias("text"))


@query(
    "p17_grounded",
    f"SELECT doc_id, contains(regexp_replace(text, '{SPACES}', '', 'g'), regexp_replace(substr(text, 11, 40), '{SPACES}', '', 'g')) AND regexp_replace(substr(text, 11, 40), '{SPACES}', '', 'g') <> '' AS grounded FROM documents",
)
def grounded(m):
    return m.table("documents").select("doc_id", text.grounded(F.substring("text", 11, 40), F.col("text")).alias("grounded"))


QUOTES = "SELECT doc_id, d.text, unnest(['own', 'changed', 'foreign']) AS origin, unnest([substr(d.text, 11, 40), concat(substr(d.text, 11, 20), '#~', substr(d.text, 31, 20)), substr(b.text, 11, 40)]) AS quote FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)"


@query(
    "p17_quotes",
    f"""WITH q AS ({QUOTES}), k AS (SELECT doc_id, origin, regexp_replace(text, '{SPACES}', '', 'g') AS text, regexp_replace(quote, '{SPACES}', '', 'g') AS quote FROM q)
SELECT doc_id, origin, coalesce(quote <> '' AND contains(text, quote), false) AS grounded FROM k""",
)
def quotes(m):
    """Three quotes a document: of its own text, of its own with a change in the middle, and of a benchmark text."""
    n = m.table("benchmark").agg(F.count("*").alias("n"))
    docs = m.table("documents").crossJoin(F.broadcast(n)).withColumn("item_id", F.expr("doc_id % n"))
    both = docs.join(m.table("benchmark").select("item_id", F.col("text").alias("other")), "item_id", "left")
    changed = F.expr("substr(text, 11, 20) || '#~' || substr(text, 31, 20)")
    made = {"own": F.substring("text", 11, 40), "changed": changed, "foreign": F.substring("other", 11, 40)}
    each = both.select("doc_id", "text", F.explode(F.array(*[F.struct(F.lit(k).alias("origin"), q.alias("quote")) for k, q in made.items()])).alias("q"))
    return each.select("doc_id", "q.origin", text.grounded(F.col("q.quote"), F.col("text")).alias("grounded"))


@query("f26_source_uuids", "SELECT s_suppkey, concat(lpad(CAST(s_suppkey AS VARCHAR), 8, '0'), '-0000-4000-8000-00000000000a') AS uuid FROM supplier")
def source_uuids(m):
    path = F.concat(F.lit("in/"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0"), F.lit("-0000-4000-8000-00000000000a_notice.zip!/inner.docx"))
    return m.table("supplier").select("s_suppkey", text.source_uuid(path).alias("uuid"))
