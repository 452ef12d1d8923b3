"""Scenes, clues and the graph, for all buyers and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotmark.operators import clues, graph, scenes
from lotmark.plans.base import query
from lotmark.sources.tables import MODEL_SQL as M

BOTH = [1, 3]
LOST = "WHERE outcome = 'nonwinner'"
PAIRS = "SELECT x.project_id, x.package_id, x.buyer_id, x.created_at, x.organization_id AS left_id, y.organization_id AS right_id FROM b x JOIN b y ON x.package_id = y.package_id AND x.organization_id < y.organization_id"


@query(
    "a01_buyer_awardees",
    f"""{M}, stats AS (
  SELECT buyer_id, organization_id, count(DISTINCT project_id) AS projects, count(*) AS packages, CAST(sum(award_amount) AS DECIMAL(38,2)) AS award_total FROM awards GROUP BY ALL
), brands AS (
  SELECT a.buyer_id, a.organization_id, string_agg(DISTINCT i.brand, ',' ORDER BY i.brand) AS brands FROM awards a JOIN items i ON i.package_id = a.package_id WHERE trim(i.brand) <> '' GROUP BY ALL
)
SELECT buyer_id, organization_id, projects, packages, award_total, brands, name AS organization_name
FROM stats LEFT JOIN brands USING (buyer_id, organization_id) JOIN organizations ON id = organization_id""",
)
def awardees(m):
    return scenes.buyer_awardees(m.bids, m.items, m.organizations)


@query(
    "a02_brand_suppliers",
    f"""{M} SELECT buyer_id, trim(brand) AS brand, count(DISTINCT project_id) AS projects, count(DISTINCT package_id) AS packages, count(*) AS n_items, CAST(sum(total_price) AS DECIMAL(38,2)) AS disclosed_total
FROM items WHERE trim(brand) <> '' GROUP BY buyer_id, trim(brand)""",
)
def brands(m):
    return scenes.brand_suppliers(m.items)


def _bidders_sql(where: str) -> str:
    return f"""{M}, n AS (
  SELECT buyer_id, organization_id, count(DISTINCT project_id) AS projects FROM bids {where} GROUP BY ALL
), r AS (
  SELECT n.*, name AS organization_name, row_number() OVER (PARTITION BY buyer_id ORDER BY projects DESC, name, organization_id) AS place FROM n JOIN organizations ON id = organization_id
)
SELECT buyer_id, organization_id, organization_name, projects, place FROM r WHERE place <= 5"""


@query("a03_buyer_top_bidders", _bidders_sql(""))
def top_bidders(m):
    return scenes.buyer_bidders(m.bids, m.organizations)


@query("p05_buyer_top_losers", _bidders_sql(LOST))
def top_losers(m):
    return scenes.buyer_bidders(m.bids, m.organizations, include_winners=False)


def _pairs_sql(where: str) -> str:
    return f"""{M}, b AS (SELECT * FROM bids {where}), p AS ({PAIRS}), n AS (
  SELECT buyer_id, left_id, right_id, count(DISTINCT project_id) AS projects FROM p GROUP BY ALL
), r AS (
  SELECT n.*, l.name AS left_name, g.name AS right_name, row_number() OVER (PARTITION BY buyer_id ORDER BY projects DESC, l.name, g.name, left_id, right_id) AS place
  FROM n JOIN organizations l ON l.id = left_id JOIN organizations g ON g.id = right_id
)
SELECT buyer_id, left_id, right_id, projects, left_name, right_name, place FROM r WHERE place <= 10"""


@query("a04_buyer_pairs", _pairs_sql(""))
def buyer_pairs(m):
    return scenes.buyer_pairs(m.bids, m.organizations)


@query("j02_buyer_loser_pairs", _pairs_sql(LOST))
def loser_pairs(m):
    return scenes.buyer_pairs(m.bids, m.organizations, include_winners=False)


def _against_sql(where: str) -> str:
    return f"""{M} SELECT a.organization_id AS supplier_id, b.organization_id AS co_bidder_id, count(DISTINCT a.project_id) AS projects, count(*) AS packages, CAST(sum(a.award_amount) AS DECIMAL(38,2)) AS award_total
FROM awards a JOIN (SELECT * FROM bids {where}) b ON a.package_id = b.package_id AND a.organization_id <> b.organization_id GROUP BY ALL"""


@query("a05_co_bidders", _against_sql(""))
def co_bidders(m):
    return scenes.co_bidders(m.bids)


@query("j03_co_losers", _against_sql(LOST))
def co_losers(m):
    return scenes.co_bidders(m.bids, include_winners=False)


@query(
    "a06_won_packages",
    f"""{M} SELECT a.project_id, a.package_id, a.package_code, CAST(a.award_amount AS DECIMAL(38,2)) AS award_amount, a.organization_id AS supplier_id, b.organization_id AS participant_id, b.outcome
FROM awards a JOIN bids b ON a.package_id = b.package_id""",
)
def won_packages(m):
    return scenes.won_packages(m.bids)


@query(
    "a07_common_buyers",
    f"""{M}, p AS (SELECT * FROM awards WHERE organization_id IN (1, 3)), c AS (
  SELECT * FROM p WHERE buyer_id IN (SELECT buyer_id FROM p GROUP BY buyer_id HAVING count(DISTINCT organization_id) = 2)
)
SELECT buyer_id, organization_id, count(DISTINCT project_id) AS projects, count(*) AS packages, CAST(sum(award_amount) AS DECIMAL(38,2)) AS award_total FROM c GROUP BY GROUPING SETS ((buyer_id, organization_id), (buyer_id))""",
)
def common_buyers(m):
    return scenes.common_buyers(m.bids, BOTH)


@query(
    "a08_common_packages",
    f"""{M}, c AS (
  SELECT * FROM bids WHERE package_id IN (SELECT package_id FROM bids WHERE organization_id IN (1, 3) GROUP BY package_id HAVING count(DISTINCT organization_id) = 2)
), per AS (
  SELECT project_id, package_id, count(*) FILTER (outcome = 'winner') AS awards, sum(award_amount) FILTER (outcome = 'winner') AS award_total FROM c GROUP BY ALL
), r AS (
  SELECT CASE grouping(project_id, package_id) WHEN 0 THEN 'package' WHEN 1 THEN 'project' ELSE 'all' END AS level, project_id, package_id, count(*) AS packages, CAST(sum(awards) AS BIGINT) AS awards, CAST(sum(award_total) AS DECIMAL(38,2)) AS award_total
  FROM per GROUP BY ROLLUP (project_id, package_id)
)
SELECT * FROM r WHERE packages > 0""",
)
def common_packages(m):
    return scenes.common_packages(m.bids, BOTH)


def _dated(df, *columns):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in columns})


CLUES = f"""{M}, b AS (SELECT * FROM bids), p AS ({PAIRS}), c AS (
  SELECT left_id, right_id, count(DISTINCT project_id) AS projects, count(*) AS packages, strftime(min(created_at), '%Y-%m-%d') AS first_at, strftime(max(created_at), '%Y-%m-%d') AS last_at,
    concat('common-bidding:', left_id, '-', right_id) AS clue_id FROM p GROUP BY left_id, right_id
)"""
BOTH_SQL = """count(DISTINCT project_id) AS participation_projects, count(DISTINCT CASE WHEN outcome = 'winner' THEN project_id END) AS award_projects,
  count(*) AS participation_packages, count(*) FILTER (outcome = 'winner') AS award_packages"""


@query("a11_common_bidding", f"{CLUES} SELECT * FROM c")
def common_bidding(m):
    return _dated(clues.common_bidding(m.bids), "first_at", "last_at")


@query(
    "a12_repeat_cooperation",
    f"{CLUES} SELECT * REPLACE (replace(clue_id, 'common-bidding', 'repeat-cooperation') AS clue_id) FROM c WHERE projects >= 2 ORDER BY projects DESC, packages DESC, clue_id LIMIT 500",
)
def repeat_cooperation(m):
    return _dated(clues.repeat_cooperation(m.bids), "first_at", "last_at")


@query("a13_supplier_distribution", f"{M} SELECT organization_id, {BOTH_SQL}, concat('supplier-distribution:', organization_id) AS clue_id FROM bids GROUP BY organization_id")
def supplier_distribution(m):
    return clues.supplier_distribution(m.bids)


@query("a14_buyer_network", f"{M} SELECT buyer_id, organization_id, {BOTH_SQL}, concat('buyer-network:', buyer_id, '-', organization_id) AS clue_id FROM bids GROUP BY buyer_id, organization_id")
def buyer_network(m):
    return clues.buyer_network(m.bids)


@query(
    "a15_clue_envelope",
    f"""{CLUES}, u AS (
  SELECT 'common_bidding' AS kind, projects, packages FROM c
  UNION ALL SELECT 'repeat_cooperation', projects, packages FROM c WHERE projects >= 2
  UNION ALL SELECT 'supplier_distribution', count(DISTINCT project_id), count(*) FROM bids GROUP BY organization_id
  UNION ALL SELECT 'buyer_network', count(DISTINCT project_id), count(*) FROM bids GROUP BY buyer_id, organization_id
)
SELECT kind, count(*) AS n_clues, max(projects) AS most_projects, CAST(sum(packages) AS BIGINT) AS packages FROM u GROUP BY kind""",
)
def envelope(m):
    return clues.envelope(m.bids).groupBy("kind").agg(F.count("*").alias("n_clues"), F.max("projects").alias("most_projects"), F.sum("packages").alias("packages"))


@query(
    "a16_references",
    f"""{M}, r AS (SELECT organization_id, min((created_at, project_id)) AS a, max((created_at, project_id)) AS b FROM bids GROUP BY organization_id)
SELECT organization_id, a[2] AS first_project, strftime(a[1], '%Y-%m-%d') AS first_at, b[2] AS last_project, strftime(b[1], '%Y-%m-%d') AS last_at FROM r""",
)
def references(m):
    return _dated(clues.references(m.bids), "first_at", "last_at")


@query(
    "a17_clue_warnings",
    f"{M} SELECT organization_id, bool_or(coalesce(package_code, 'default') = 'default') AS default_package, bool_or(outcome = 'winner' AND award_amount IS NULL) AS amount_missing FROM bids GROUP BY organization_id",
)
def warnings(m):
    return clues.warnings(m.bids)


@query(
    "a18_source_projects",
    f"{M}, d AS (SELECT DISTINCT project_id, created_at FROM bids WHERE organization_id = 1 OR buyer_id = 1) SELECT project_id, strftime(created_at, '%Y-%m-%d') AS created_at FROM d ORDER BY d.created_at DESC, project_id DESC LIMIT 100",
)
def source_projects(m):
    return _dated(clues.source_projects(m.bids, 1), "created_at")


@query(
    "j11_won_without_loss",
    f"{M} SELECT DISTINCT buyer_id, organization_id FROM awards a WHERE NOT EXISTS (SELECT 1 FROM bids b WHERE b.outcome = 'nonwinner' AND b.buyer_id = a.buyer_id AND b.organization_id = a.organization_id)",
)
def won_without_loss(m):
    return clues.won_without_loss(m.bids)


@query(
    "j10_contested_projects",
    f"{M} SELECT project_id, buyer_id FROM projects WHERE project_id IN (SELECT project_id FROM bids GROUP BY project_id, package_id HAVING count(*) >= 4)",
)
def contested(m):
    lots = m.bids.groupBy("project_id", "package_id").count().where("count >= 4")
    return m.projects.join(lots, "project_id", "left_semi").select("project_id", "buyer_id")


@query(
    "j08_relation_records",
    f"""{M} SELECT 'bid' AS record, b.project_id, b.package_id, b.package_code, b.buyer_id, c.name AS buyer_name, b.organization_id, s.name AS supplier_name, b.outcome
FROM bids b JOIN organizations s ON s.id = b.organization_id LEFT JOIN organizations c ON c.id = b.buyer_id
UNION ALL SELECT 'award', b.project_id, b.package_id, b.package_code, b.buyer_id, c.name, b.organization_id, s.name, b.outcome
FROM awards b JOIN organizations s ON s.id = b.organization_id LEFT JOIN organizations c ON c.id = b.buyer_id""",
)
def relation_records(m):
    kinds = F.when(F.col("outcome") == "winner", F.array(F.lit("bid"), F.lit("award"))).otherwise(F.array(F.lit("bid")))
    buyers = m.organizations.select(F.col("id").alias("buyer_id"), F.col("name").alias("buyer_name"))
    rows = scenes.named(m.bids, m.organizations, "organization_id", "supplier_name").join(buyers, "buyer_id", "left")
    return rows.select(F.explode(kinds).alias("record"), "project_id", "package_id", "package_code", "buyer_id", "buyer_name", "organization_id", "supplier_name", "outcome")


NODES = f"""{M}, lots AS (SELECT DISTINCT project_id, package_id, part_id, product_name FROM items), nodes AS (
  SELECT concat('organization:', id) AS uid, 'Organization' AS label, name FROM organizations
  UNION ALL SELECT concat('project:', project_id), 'Project', CAST(project_id AS VARCHAR) FROM projects
  UNION ALL SELECT concat('package:', package_id), 'Package', package_code FROM packages
  UNION ALL SELECT concat('item:', package_id, '-', part_id), 'Item', product_name FROM lots
), edges AS (
  SELECT concat('organization:', buyer_id) AS source, concat('project:', project_id) AS target, 'PURCHASES' AS relation, project_id FROM projects
  UNION ALL SELECT concat('project:', project_id), concat('package:', package_id), 'HAS_PACKAGE', project_id FROM packages
  UNION ALL SELECT concat('organization:', organization_id), concat('package:', package_id), 'BID_IN', project_id FROM bids
  UNION ALL SELECT concat('package:', package_id), concat('organization:', organization_id), 'AWARDED_TO', project_id FROM awards
  UNION ALL SELECT concat('package:', package_id), concat('item:', package_id, '-', part_id), 'HAS_ITEM', project_id FROM lots
)"""


@query("n01_nodes", f"{NODES} SELECT * FROM nodes")
def nodes(m):
    return graph.nodes(m)


@query("n01_edges", f"{NODES} SELECT * FROM edges")
def edges(m):
    return graph.edges(m)


@query("n04_award_edges", f"{NODES} SELECT * FROM edges WHERE relation = 'AWARDED_TO'")
def award_edges(m):
    return graph.edges(m, ("AWARDED_TO",))


@query("n02_preview", f"{NODES} SELECT * FROM edges WHERE project_id IN (SELECT project_id FROM projects ORDER BY project_id DESC LIMIT 50)")
def preview(m):
    return graph.preview(m)


@query("n03_neighbourhood", f"{NODES} SELECT * FROM edges WHERE source = 'organization:1' OR target = 'organization:1' ORDER BY project_id DESC, relation, source, target LIMIT 200")
def neighbourhood(m):
    return graph.neighbourhood(m, "organization:1")


@query("n06_degrees", f"{NODES}, ends AS (SELECT source AS uid, relation FROM edges UNION ALL SELECT target, relation FROM edges) SELECT uid, relation, count(*) AS degree FROM ends GROUP BY ALL")
def degrees(m):
    return graph.degrees(m)


ROLES = f"""{M}, roles AS (
  SELECT id, name, EXISTS (SELECT 1 FROM projects WHERE buyer_id = id) AS is_buyer, EXISTS (SELECT 1 FROM bids WHERE organization_id = id) AS is_supplier FROM organizations
)"""


@query("j09_roles", f"{ROLES} SELECT * FROM roles")
def roles(m):
    return graph.roles(m)


@query(
    "n05_search",
    f"""{ROLES}, found AS (
  SELECT 'organization' AS kind, id, name, is_buyer, is_supplier FROM roles WHERE contains(lower(name), '1') AND (is_buyer OR is_supplier)
  UNION ALL SELECT 'project', project_id, concat('project ', project_id), true, false FROM projects WHERE contains(concat('project ', project_id), '1')
)
SELECT * FROM found ORDER BY lower(name), kind, id LIMIT 20 OFFSET 10""",
)
def search(m):
    return graph.search(m, "1", offset=10)
