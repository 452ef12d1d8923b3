"""The queries of this subpackage: each applies an operator to its whole table, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotmark.llm import bpe, fim, itq, linededup, manifest, minhash, mixing, pii, secrets, sharding, topk, toxicity, warc
from lotmark.llm.common import table

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text, digests the ids, decodes them, digests the result."""
    encoded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary_path(), keep=["doc_id"])
    digested = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_sha256(F.col("ids")).alias("ids_sha256"), "ids")
    decoded = bpe.decode(digested, vocabulary_path())
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.plan(docs, score=mixing.fitted_quality(docs, table(spark, sf_dir, "labels"))).select("doc_id", "size", "source_size", "target", "taken")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates themselves stay out of the result; their digests stand for them."""
    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.train(secrets.labelled_findings(spark)))
    return found.select("doc_id", "pos", "nth", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "probability", "secret")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), [1.0] * 16)


def op6_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade(docs, table(spark, sf_dir, "labels")).select("doc_id", "severity", "rejected")


def decayed(pages: DataFrame) -> DataFrame:
    """A replica with damage for the audit to find: in one page of 211, by id, the middle character is another."""
    middle = "int(length(html) div 2)"
    damaged = f"concat(substr(html, 1, {middle}), '#', substr(html, {middle} + 2))"
    return pages.withColumn("html", F.expr(f"if(page_id % 211 = 7, {damaged}, html)"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.audit(warc.layout(pages), warc.layout(decayed(pages)))


OP8 = """
WITH replica AS (
  SELECT page_id, url, html, 0 AS side FROM pages
  UNION ALL
  SELECT page_id, url, CASE WHEN page_id % 211 = 7 THEN concat(substr(html, 1, CAST(length(html) // 2 AS INT)), '#', substr(html, CAST(length(html) // 2 AS INT) + 2)) ELSE html END, 1 FROM pages
), made AS (
  SELECT side, page_id, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', CAST(page_id AS VARCHAR), '>', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10),
    'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', CAST(strlen(coalesce(html, '')) AS VARCHAR), chr(13), chr(10), chr(13), chr(10), coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) AS r
  FROM replica
), digested AS (
  SELECT side, page_id, strlen(r) AS length, sha256(r) AS digest, row_number() OVER (PARTITION BY side ORDER BY page_id NULLS FIRST, sha256(r)) - 1 AS rnk FROM made
), laid AS (
  SELECT side, rnk // 1024 AS file, rnk % 1024 AS record, page_id, length, digest,
    coalesce(sum(length) OVER (PARTITION BY side, rnk // 1024 ORDER BY rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM digested
), level1 AS (
  SELECT side, file, record // 16 AS node, CAST(min(off) AS BIGINT) AS s, CAST(max(off + length) AS BIGINT) AS e, sha256(string_agg(concat_ws(':', record, CAST(off AS BIGINT), CAST(off + length AS BIGINT), digest), chr(10) ORDER BY record)) AS digest FROM laid GROUP BY ALL
), level2 AS (
  SELECT side, file, level1.node // 16 AS node, min(s) AS s, max(e) AS e, sha256(string_agg(concat_ws(':', level1.node, level1.s, level1.e, level1.digest), chr(10) ORDER BY level1.node)) AS digest FROM level1 GROUP BY side, file, level1.node // 16
), roots AS (
  SELECT side, file, sha256(string_agg(concat_ws(':', node, s, e, digest), chr(10) ORDER BY node)) AS digest FROM level2 GROUP BY side, file
)
SELECT a.file, CAST(a.record AS INT) AS record, a.page_id, CAST(a.off AS BIGINT) AS "offset", a.length, a.digest, b.digest AS their_digest, x.digest AS root, y.digest AS their_root
FROM laid a JOIN laid b ON a.side = 0 AND b.side = 1 AND a.file = b.file AND a.record = b.record
JOIN roots x ON x.side = 0 AND x.file = a.file JOIN roots y ON y.side = 1 AND y.file = a.file
WHERE a.digest <> b.digest OR a.off <> b.off OR a.length <> b.length
"""


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


OP10 = """
WITH cut AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), w AS (
  SELECT doc_id, unnest(range(0, greatest(len(ls) - 2, 0))) AS pos, ls FROM cut WHERE len(ls) >= 3
), seen AS (
  SELECT doc_id, pos, ls[pos + 1 : pos + 3] AS run FROM w
  WHERE NOT (trim(ls[pos + 1]) = '' AND trim(ls[pos + 2]) = '' AND trim(ls[pos + 3]) = '')
), later AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS nth FROM seen) WHERE nth > 1
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM later) GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS INT) AS n_lines, CAST(coalesce(len(gone), 0) AS INT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(0, len(ls)), lambda i: NOT list_contains(gone, i)), lambda i: ls[i + 1]), chr(10)), '') END) AS text_sha256
FROM cut LEFT JOIN gone USING (doc_id)
"""

def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(table(spark, sf_dir, "documents"), keep=["doc_id"])
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), *digests)


OP11 = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256(concat('1:', CAST(doc_id AS VARCHAR))) AS h FROM documents
), cuts AS (
  SELECT doc_id, t, n, CAST(concat('0x', h[1:8]) AS BIGINT) % (n + 1) AS a, CAST(concat('0x', h[9:16]) AS BIGINT) % (n + 1) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST(concat('0x', h[17:24]) AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST(concat('0x', h[25:32]) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), pieces AS (
  SELECT doc_id, t, n, form, least(a, b) AS f, greatest(a, b) - least(a, b) AS m, substr(t, 1, least(a, b)) AS p, substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS mid, substr(t, greatest(a, b) + 1) AS s FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN f END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', mid) ELSE concat('<S>', s, '<P>', p, '<M>', mid) END) AS output_sha256, sha256(t) AS restored_sha256
FROM pieces
"""


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), pii.train(spark), keep=["doc_id"])
    known = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter(known, lambda s: s["kind"] == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(known), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other document, by the checksum of its id, is verified as a copy that lost its line ends."""
    docs = table(spark, sf_dir, "documents")
    row = lambda text: manifest.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    shown = F.when(tampered & F.col("text").contains("\n"), row(F.replace("text", F.lit("\n"), F.lit(""))))
    leaves = docs.select("doc_id", "source", row(F.col("text")).alias("leaf"), shown.alias("shown"))
    leaves = leaves.withColumn("presented", F.coalesce("shown", "leaf"))
    out = manifest.proofs(leaves)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified")


OP13 = """
WITH RECURSIVE crc AS (
  SELECT doc_id, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT)), lambda r, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[],
    lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(r, b)), 4294967295::UBIGINT) AS r FROM documents
), texts AS (
  SELECT d.doc_id, source, CASE WHEN xor(r, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS shown, text,
    concat(coalesce(concat(strlen(CAST(d.doc_id AS VARCHAR)), ':', CAST(d.doc_id AS VARCHAR)), '-'), coalesce(concat(strlen(source), ':', source), '-'), coalesce(concat(strlen(lang), ':', lang), '-'),
      coalesce(concat(strlen(CAST(n_chars AS VARCHAR)), ':', CAST(n_chars AS VARCHAR)), '-')) AS head
  FROM documents d JOIN crc ON crc.doc_id = d.doc_id
), leaves AS (
  SELECT doc_id, source, sha256(concat(head, coalesce(concat(strlen(text), ':', text), '-'))) AS leaf, sha256(concat(head, coalesce(concat(strlen(shown), ':', shown), '-'))) AS shown FROM texts
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos FROM leaves
), tree AS (
  SELECT source, 0 AS height, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY source
  UNION ALL
  SELECT source, height + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], ''))) FROM tree WHERE len(nodes) > 1
), subroots AS (
  SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM tree WHERE len(nodes) = 1
), upper_tree AS (
  SELECT 0 AS height, list(subroot ORDER BY pos) AS nodes FROM subroots
  UNION ALL
  SELECT height + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], ''))) FROM upper_tree WHERE len(nodes) > 1
), steps AS (
  SELECT p.doc_id, p.pos AS leaf_at, p.source, t.height, t.nodes, CAST(p.pos // CAST(pow(3, t.height) AS BIGINT) AS BIGINT) AS node FROM placed p JOIN tree t ON t.source IS NOT DISTINCT FROM p.source AND len(t.nodes) > 1
  UNION ALL
  SELECT p.doc_id, p.pos, p.source, 1000 + u.height, u.nodes, CAST(s.pos // CAST(pow(3, u.height) AS BIGINT) AS BIGINT) FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN upper_tree u ON len(u.nodes) > 1
), sides AS (
  SELECT doc_id, leaf_at, source, row_number() OVER (PARTITION BY source, leaf_at ORDER BY height) AS nth, array_to_string(nodes[node - node % 3 + 1 : node], '') AS l, array_to_string(nodes[node + 2 : node - node % 3 + 3], '') AS r FROM steps
), folded AS (
  SELECT source, pos AS leaf_at, 0 AS nth, shown AS acc FROM placed
  UNION ALL
  SELECT f.source, f.leaf_at, f.nth + 1, sha256(concat(s.l, f.acc, s.r)) FROM folded f JOIN sides s ON s.source IS NOT DISTINCT FROM f.source AND s.leaf_at = f.leaf_at AND s.nth = f.nth + 1
), proof AS (
  SELECT source, leaf_at, string_agg(concat(l, r), '' ORDER BY nth) AS proof, max(nth) AS depth FROM sides GROUP BY source, leaf_at
), root AS (SELECT nodes[1] AS root FROM upper_tree WHERE len(nodes) = 1)
SELECT p.doc_id, p.leaf, s.subroot, root.root, sha256(coalesce(q.proof, '')) AS proof_sha256, f.acc AS folded_root, f.acc = root.root AS verified
FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN proof q ON q.source IS NOT DISTINCT FROM p.source AND q.leaf_at = p.pos
JOIN folded f ON f.source IS NOT DISTINCT FROM p.source AND f.leaf_at = p.pos AND f.nth = coalesce(q.depth, 0) JOIN root ON true
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_topk": op3_topk,
    "op4_secrets": op4_secrets,
    "op5_sharding": op5_sharding,
    "op6_itq": op6_itq,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_minhash": op9_minhash,
    "op10_lines": op10_lines,
    "op11_fim": op11_fim,
    "op12_pii": op12_pii,
    "op13_manifest": op13_manifest,
}

ORACLE: dict[str, str] = {"op8_warc": OP8, "op10_lines": OP10, "op11_fim": OP11, "op13_manifest": OP13}
