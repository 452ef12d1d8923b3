"""Versions of notices: identity, groups, capture, history and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotmark.operators import versions
from lotmark.plans.base import query
from lotmark.plans.records import snapshots

FINGERPRINT = """concat_ws(chr(31), concat('v', l_partkey), concat('v', l_suppkey), concat('v', l_linenumber), concat('v', CAST(CAST(l_quantity AS DECIMAL(18,2)) AS INTEGER)))"""


@query(
    "f21_content_fingerprints",
    f"""WITH h AS (SELECT l_orderkey, sha256({FINGERPRINT}) AS h FROM lineitem),
s AS (SELECT l_orderkey, count(*) AS n, {', '.join(f"sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS BIGINT)::HUGEINT) AS s{i}" for i in range(4))} FROM h GROUP BY l_orderkey)
SELECT l_orderkey, n, sha256(concat_ws('-', n, s0, s1, s2, s3)) AS fingerprint FROM s""",
)
def content_fingerprints(m):
    """Quantities are decimals that end in .00, and an id that says nothing of the content is among the columns."""
    rows = m.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("decimal(18,2)").alias("l_quantity"), F.monotonically_increasing_id().alias("id"))
    return versions.fingerprint(rows, ["l_orderkey"], ["id", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"])


NOTICES = """WITH n AS (SELECT o_orderkey AS notice_id, CASE WHEN o_orderkey % 3 = 0 THEN concat('off-', o_orderkey // 6) END AS official, CASE WHEN o_orderkey % 4 = 0 THEN '无' ELSE concat('P-', o_orderkey // 4) END AS number, concat('buyer ', o_custkey % 5) AS buyer FROM orders)"""
TOKENS = f"""{NOTICES}, t AS (
  SELECT notice_id, 'official_notice_id' AS kind, sha256(concat_ws(chr(31), 'official_notice_id', 'local-import', official)) AS token FROM n WHERE official IS NOT NULL
  UNION ALL SELECT notice_id, 'project_buyer', sha256(concat_ws(chr(31), 'project_buyer', number, buyer)) FROM n WHERE number <> '无'
)"""


def _notices(m):
    """Every third order has an official number, which it may share with the sixth after it; some numbers say nothing."""
    key = F.col("o_orderkey")
    official = F.when(key % 3 == 0, F.concat(F.lit("off-"), F.floor(key / 6)))
    number = F.when(key % 4 == 0, F.lit("无")).otherwise(F.concat(F.lit("P-"), F.floor(key / 4)))
    none = F.lit(None).cast("string")
    return m.table("orders").select(key.alias("notice_id"), none.alias("namespace"), official.alias("official_notice_id"), none.alias("source_unique_id"), number.alias("project_number"), F.concat(F.lit("buyer "), F.col("o_custkey") % 5).alias("procurement_unit"))


@query("f22_identity_tokens", f"{TOKENS} SELECT * FROM t")
def identity_tokens(m):
    return versions.identity_tokens(_notices(m))


RESOLVED = f"""{TOKENS}, known AS (SELECT concat('g', notice_id) AS group_id, kind, token FROM t WHERE notice_id % 2 = 0), new AS (SELECT * FROM t WHERE notice_id % 2 = 1),
has AS (SELECT notice_id, bool_or(kind <> 'project_buyer') AS strong FROM new GROUP BY 1),
used AS (SELECT new.* FROM new JOIN has USING (notice_id) WHERE kind <> 'project_buyer' OR NOT strong),
hits AS (SELECT notice_id, count(DISTINCT group_id) AS n, min(group_id) AS g FROM used JOIN known USING (kind, token) GROUP BY 1),
clash AS (SELECT DISTINCT h.notice_id FROM hits h JOIN new ON new.notice_id = h.notice_id JOIN known k ON k.group_id = h.g AND k.kind = new.kind WHERE h.n = 1 AND new.kind <> 'project_buyer' AND k.token <> new.token),
weak AS (SELECT w.notice_id, count(DISTINCT k.group_id) AS n, min(k.group_id) AS g, bool_or(k.group_id IN (SELECT group_id FROM known WHERE kind <> 'project_buyer')) AS held
  FROM new w JOIN has ON has.notice_id = w.notice_id AND strong JOIN known k ON k.kind = w.kind AND k.token = w.token WHERE w.kind = 'project_buyer' GROUP BY 1),
r AS (SELECT n.notice_id, h.n AS hn, h.g AS hg, c.notice_id IS NOT NULL AS clash, w.n AS wn, w.g AS wg, w.held, s.strong
  FROM n LEFT JOIN has s USING (notice_id) LEFT JOIN hits h USING (notice_id) LEFT JOIN clash c USING (notice_id) LEFT JOIN weak w USING (notice_id) WHERE n.notice_id % 2 = 1),
resolved AS (SELECT notice_id, CASE WHEN hn = 1 AND NOT clash THEN hg WHEN hn IS NULL AND wn = 1 AND NOT held THEN wg END AS group_id,
  CASE WHEN (hn = 1 AND NOT clash) OR (hn IS NULL AND wn = 1 AND NOT held) THEN 'new_version' WHEN hn IS NOT NULL THEN 'identity_ambiguous' WHEN strong IS NOT NULL THEN 'matched' ELSE 'manual_link_required' END AS status FROM r)"""


def _resolved(m):
    """Odd orders arrive, even ones are known groups of their own."""
    notices = _notices(m)
    tokens = versions.identity_tokens(notices)
    known = tokens.where("notice_id % 2 = 0").select(F.concat(F.lit("g"), "notice_id").alias("group_id"), "kind", "token")
    return versions.resolve_groups(notices.where("notice_id % 2 = 1"), tokens.where("notice_id % 2 = 1"), known)


@query("f23_resolved_groups", f"{RESOLVED} SELECT * FROM resolved")
def resolved_groups(m):
    return _resolved(m)


@query(
    "k06_captured",
    f"""{RESOLVED}, p AS (SELECT o_orderkey AS notice_id, concat('f', o_custkey % 3) AS fingerprint FROM orders), known_prints AS (SELECT concat('g', o_orderkey) AS group_id, 'f1' AS fingerprint FROM orders WHERE o_orderkey % 2 = 0),
x AS (SELECT notice_id, coalesce(group_id, concat('new:', notice_id)) AS group_id, fingerprint, status FROM resolved JOIN p USING (notice_id)),
y AS (SELECT *, row_number() OVER (PARTITION BY group_id, fingerprint ORDER BY notice_id) AS nth FROM x)
SELECT notice_id, group_id, fingerprint, CASE WHEN nth > 1 OR EXISTS (SELECT 1 FROM known_prints k WHERE k.group_id = y.group_id AND k.fingerprint = y.fingerprint) THEN 'duplicate_snapshot' ELSE status END AS status FROM y""",
)
def captured(m):
    prints = m.table("orders").select(F.col("o_orderkey").alias("notice_id"), F.concat(F.lit("f"), F.col("o_custkey") % 3).alias("fingerprint"))
    known = m.table("orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("g"), "o_orderkey").alias("group_id"), F.lit("f1").alias("fingerprint"))
    return versions.captured(_resolved(m), prints, known)


@query(
    "j15_history",
    "SELECT o_custkey AS group_id, o_orderkey AS version_id, row_number() OVER w AS version_no, row_number() OVER w = count(*) OVER (PARTITION BY o_custkey) AS is_latest FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
)
def version_history(m):
    rows = m.table("orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").alias("imported_at"))
    return versions.history(rows).drop("imported_at")


@query(
    "f41_frozen_evidence",
    """WITH f AS (SELECT l_orderkey AS version_id, CAST(l_linenumber AS VARCHAR) AS field, l_tax > 0 AS filled, CASE WHEN l_linenumber % 2 = 0 THEN concat('s', l_linenumber % 4) END AS source_file, l_returnflag FROM lineitem),
s AS (SELECT l_orderkey AS version_id, concat('s', l_linenumber % 3) AS source_file, count(DISTINCT l_partkey) AS hashes FROM lineitem GROUP BY ALL)
SELECT f.version_id, field, CASE WHEN filled THEN CASE WHEN l_returnflag = 'R' AND f.source_file IS NOT NULL THEN 'present' ELSE 'unverified' END ELSE 'unverified' END AS state,
  CASE WHEN hashes = 1 THEN 'available' WHEN hashes > 1 THEN 'ambiguous' ELSE 'not_saved' END AS source_status
FROM f LEFT JOIN s ON s.version_id = f.version_id AND s.source_file = f.source_file""",
)
def frozen_evidence(m):
    """Values without a tax are blank; evidence is complete for returned lines that name a source; saved states all say present."""
    line = m.table("lineitem")
    fields = line.select(
        F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").cast("string").alias("field"), F.when(F.col("l_tax") > 0, F.col("l_partkey")).alias("value"), F.lit("present").alias("saved"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("s"), F.col("l_linenumber") % 4)).alias("source_file"), F.when(F.col("l_returnflag") == "R", "quote").alias("evidence"),
    )
    sources = line.select(F.col("l_orderkey").alias("version_id"), F.concat(F.lit("s"), F.col("l_linenumber") % 3).alias("source_file"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("sha256"))
    return versions.frozen_evidence(fields, sources)


@query(
    "w03_ordinals",
    "SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN key ELSE concat(key, ' #', n) END AS key FROM (SELECT *, concat('item ', l_returnflag) AS key, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS n FROM lineitem)",
)
def ordinals(m):
    rows = m.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("item "), "l_returnflag").alias("key"))
    return versions.with_ordinals(rows, "l_orderkey", "key", "l_linenumber", "l_partkey").drop("l_partkey")


@query(
    "p36_filtered_changes",
    """WITH a AS (SELECT s_suppkey AS id, s_name AS name, concat('p.', s_nationkey) AS place FROM supplier)
SELECT id, 'place' AS field, place AS before, concat(place, '-1') AS after, 'changed' AS change, 'provenance_only' AS kind FROM a WHERE id % 2 = 0""",
)
def filtered_changes(m):
    """Names change in white space only, and places, which say where something is from, for even suppliers."""
    a = m.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("p."), "s_nationkey").alias("place"))
    b = a.select("id", F.concat("name", F.lit(" ")).alias("name"), F.when(F.col("id") % 2 == 0, F.concat("place", F.lit("-1"))).otherwise(F.col("place")).alias("place"))
    return versions.filtered(versions.compare(a, b, ["id"], ["name", "place"], provenance=("place",)), change="changed", kind="provenance_only")


@query(
    "f43_row_signatures",
    "SELECT scope, concat_ws('|', line, part, supplier) AS signature, count(*) AS n FROM (SELECT l_orderkey AS scope, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier FROM lineitem) GROUP BY ALL",
)
def row_signatures(m):
    a, _ = snapshots(m)
    return a.groupBy("scope", F.concat_ws("|", "line", "part", "supplier").alias("signature")).agg(F.count("*").alias("n"))
