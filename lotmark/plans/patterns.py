"""Queries of graph patterns, of sets of suppliers that meet, and of arrays read in pieces."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lotmark.operators import cooccurrence, graph, patterns
from lotmark.operators.linking import shared_folder
from lotmark.operators.patterns import Step
from lotmark.plans.base import query
from lotmark.plans.relations import NODES
from lotmark.sources import arrays
from lotmark.sources.tables import MODEL_SQL as M

BUYS, HAS, WON = Step("PURCHASES", "buyer", "project"), Step("HAS_PACKAGE", "project", "package"), Step("AWARDED_TO", "package", "supplier")
BIDS = Step("BID_IN", "bidder", "package")
SOME = ["organization:3", "organization:5"]


def _found(m, steps, keep, **more):
    """Matches of steps that meet in projects and packages, whose edges are therefore one project's; `keep` names it as project_id."""
    return patterns.matches(graph.edges(m, tuple({s.relation for s in steps})), steps, keep, scope="project_id", n=m.pieces, **more)


@query("n06_buyer_awardees", f"{M} SELECT concat('organization:', buyer_id) AS buyer, concat('organization:', organization_id) AS supplier, count(DISTINCT project_id) AS projects, count(DISTINCT package_id) AS packages FROM awards GROUP BY ALL")
def buyer_awardees(m):
    found = _found(m, [BUYS, HAS, WON], ["buyer", "supplier", "project_id", "package"])
    return patterns.counted(found, ["buyer", "supplier"], "project_id", "package")


@query("n06_product_suppliers", f"{NODES} SELECT concat('organization:', buyer_id) AS buyer, concat('item:', package_id, '-', part_id) AS item, 1 AS projects FROM lots JOIN projects USING (project_id)")
def product_suppliers(m):
    """Items of a buyer, awarded or not."""
    return _found(m, [BUYS, HAS, Step("HAS_ITEM", "package", "item")], ["buyer", "item", "project_id"]).select("buyer", "item", F.lit(1).alias("projects"))


@query("n06_buyer_bidders", f"{M} SELECT concat('organization:', buyer_id) AS buyer, concat('organization:', organization_id) AS bidder, count(DISTINCT project_id) AS projects FROM bids GROUP BY ALL")
def buyer_bidders(m):
    return _found(m, [BUYS, HAS, BIDS], ["buyer", "bidder", "project_id"]).groupBy("buyer", "bidder").agg(F.count("*").alias("projects"))


@query(
    "n06_buyer_pairs",
    f"""{M} SELECT concat('organization:', x.buyer_id) AS buyer, concat('organization:', x.organization_id) AS a, concat('organization:', y.organization_id) AS b, count(DISTINCT x.project_id) AS projects
FROM bids x JOIN bids y ON x.package_id = y.package_id AND concat('organization:', x.organization_id) < concat('organization:', y.organization_id) GROUP BY ALL""",
)
def buyer_pairs(m):
    steps = [BUYS, HAS, Step("BID_IN", "a", "package"), Step("BID_IN", "b", "package")]
    return _found(m, steps, ["buyer", "a", "b", "project_id"], only=lambda: F.col("a") < F.col("b")).groupBy("buyer", "a", "b").agg(F.count("*").alias("projects"))


@query(
    "n06_co_bidders",
    f"""{M} SELECT concat('organization:', a.organization_id) AS supplier, concat('organization:', b.organization_id) AS bidder, count(DISTINCT a.project_id) AS projects, count(DISTINCT a.package_id) AS packages
FROM awards a JOIN bids b ON a.package_id = b.package_id AND a.organization_id <> b.organization_id GROUP BY ALL""",
)
def co_bidders(m):
    found = _found(m, [WON, HAS, BIDS], ["supplier", "bidder", "project_id", "package"], only=lambda: F.col("supplier") != F.col("bidder"))
    return patterns.counted(found, ["supplier", "bidder"], "project_id", "package")


@query(
    "n06_common_buyers",
    f"""{M}, n AS (SELECT buyer_id, organization_id, count(DISTINCT project_id) AS projects, count(DISTINCT package_id) AS packages FROM awards WHERE organization_id IN (3, 5) GROUP BY ALL)
SELECT concat('organization:', buyer_id) AS buyer, concat('organization:', organization_id) AS supplier, projects, CAST(packages AS BIGINT) AS packages FROM n WHERE buyer_id IN (SELECT buyer_id FROM n GROUP BY buyer_id HAVING count(*) = 2)""",
)
def common_buyers(m):
    """Buyers of whom both suppliers won: of matches whose supplier is one of them, those buyers that have as many."""
    found = _found(m, [BUYS, HAS, WON], ["buyer", "supplier", "project_id", "package"], where={"supplier": SOME})
    per = patterns.counted(found, ["buyer", "supplier"], "project_id", "package")
    both = per.groupBy("buyer").agg(F.count("*").alias("n")).where(F.col("n") == len(SOME))
    return per.join(both.select("buyer"), "buyer", "left_semi")


@query(
    "n06_common_packages",
    f"""{M} SELECT concat('package:', package_id) AS package, concat('project:', project_id) AS project, concat('organization:', organization_id) AS bidder FROM bids
WHERE package_id IN (SELECT package_id FROM bids WHERE organization_id IN (3, 5) GROUP BY package_id HAVING count(DISTINCT organization_id) = 2)""",
)
def common_packages(m):
    """Packages that both bid for, with their project and all bidders: a star of three bids, two of them fixed."""
    steps = [Step("BID_IN", "first", "package"), Step("BID_IN", "second", "package"), HAS, BIDS]
    return _found(m, steps, ["package", "project", "bidder", "project_id"], where={"first": SOME[:1], "second": SOME[1:]}).drop("project_id")


TRIPLES = f"""{M}, w AS (SELECT DISTINCT buyer_id, organization_id AS o FROM awards)"""


@query("j27_supplier_pairs", f"{TRIPLES} SELECT x.o AS a, y.o AS b, count(*) AS support FROM w x JOIN w y ON x.buyer_id = y.buyer_id AND x.o < y.o GROUP BY ALL HAVING count(*) >= 3")
def supplier_pairs(m):
    """All suppliers who won from the same buyers, three at least."""
    won = m.bids.where("outcome = 'winner'").select(F.col("buyer_id").alias("basket"), F.col("organization_id").alias("member"))
    return cooccurrence.pairs(won, 3)[0]


@query("j27_supplier_triples", f"{TRIPLES} SELECT x.o AS a, y.o AS b, z.o AS c, count(*) AS buyers FROM w x JOIN w y ON x.buyer_id = y.buyer_id AND x.o < y.o JOIN w z ON z.buyer_id = x.buyer_id AND y.o < z.o GROUP BY ALL HAVING count(*) >= 2")
def supplier_triples(m):
    """All triples of suppliers who won from the same buyers, two at least."""
    won = m.bids.where("outcome = 'winner'").select(F.col("buyer_id").alias("basket"), F.col("organization_id").alias("member"))
    return cooccurrence.triples(won, 2).withColumnRenamed("support", "buyers")


#: Elements of an array that a query writes, so that no task holds more.
ELEMENTS = 50_000


@query("s19_array_elements", "SELECT conv_id, turn, role, text FROM conversations")
def array_elements(m):
    """All turns written as one-line arrays, a file each, and read in pieces."""
    folder = f"{shared_folder(m.spark)}/arrays-{uuid.uuid4().hex}"
    turns = m.table("conversations")
    row = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    parts = turns.select(row.alias("j"), F.monotonically_increasing_id().alias("id")).groupBy(F.spark_partition_id().alias("p"), F.expr(f"id div {ELEMENTS}").alias("part"))
    # a task may get several arrays; text behind a file's first one would be an error
    parts.agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ", "), F.lit("]")).alias("value")).write.partitionBy("p", "part").text(folder, lineSep="\n")
    found = arrays.elements(m.spark, folder)
    return found.select(F.from_json("json", turns.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")).alias("r")).select("r.*")
