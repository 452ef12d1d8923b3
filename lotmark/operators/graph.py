"""The property graph: organizations, projects, packages, items and the five relations between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmark.operators.reviews import page
from lotmark.sources import catalog
from lotmark.sources.tables import Model, dealt

RELATIONS = ("PURCHASES", "HAS_PACKAGE", "BID_IN", "AWARDED_TO", "HAS_ITEM")
EDGES, NODES, PAGE, PREVIEW = 200, 100, 20, 50


def uid(kind: str, *parts: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.concat_ws("-", *parts))


def _items(model: Model) -> DataFrame:
    items = model.table("lineitem").select(
        F.col("l_orderkey").alias("project_id"), (2 * F.col("l_orderkey") + F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("package_id"), F.col("l_partkey").alias("part_id")
    )
    return dealt(items, "project_id", model.pieces).distinct()


def nodes(model: Model) -> DataFrame:
    """uid, label, name. An item is a part in a package."""
    parts = [
        model.organizations.select(uid("organization", "id").alias("uid"), F.lit("Organization").alias("label"), "name"),
        model.projects.select(uid("project", "project_id").alias("uid"), F.lit("Project").alias("label"), F.col("project_id").cast("string").alias("name")),
        model.packages.select(uid("package", "package_id").alias("uid"), F.lit("Package").alias("label"), F.col("package_code").alias("name")),
        _items(model)
        .join(model.table("part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("name")), "part_id")
        .select(uid("item", "package_id", "part_id").alias("uid"), F.lit("Item").alias("label"), "name"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def edges(model: Model, relations: tuple[str, ...] = RELATIONS) -> DataFrame:
    """source, target, relation, project_id; relations that aren't wanted are not read."""
    row = lambda df, r, a, b: df.select(a.alias("source"), b.alias("target"), F.lit(r).alias("relation"), "project_id")
    make = {
        "PURCHASES": lambda: row(model.projects, "PURCHASES", uid("organization", "buyer_id"), uid("project", "project_id")),
        "HAS_PACKAGE": lambda: row(model.packages, "HAS_PACKAGE", uid("project", "project_id"), uid("package", "package_id")),
        "BID_IN": lambda: row(model.bids, "BID_IN", uid("organization", "organization_id"), uid("package", "package_id")),
        "AWARDED_TO": lambda: row(model.bids.where("outcome = 'winner'"), "AWARDED_TO", uid("package", "package_id"), uid("organization", "organization_id")),
        "HAS_ITEM": lambda: row(_items(model), "HAS_ITEM", uid("package", "package_id"), uid("item", "package_id", "part_id")),
    }
    out = None
    for relation in RELATIONS:
        if relation in relations:
            out = make[relation]() if out is None else out.unionByName(make[relation]())
    if out is None:
        raise ValueError("no known relation")
    return out


def checked(limit: int, most: int) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be from 1 to {most}")
    return limit


def neighbourhood(model: Model, anchor: str, relations: tuple[str, ...] = RELATIONS, limit: int = EDGES) -> DataFrame:
    """The edges at a node, newest projects first, up to the limit."""
    at = edges(model, relations).where((F.col("source") == anchor) | (F.col("target") == anchor))
    return at.orderBy(F.desc("project_id"), "relation", "source", "target").limit(checked(limit, EDGES))


def preview(model: Model, projects: int = PREVIEW) -> DataFrame:
    """The edges of the newest projects: a bounded list of ids, then the rows that belong to it."""
    newest = model.projects.select("project_id").orderBy(F.desc("project_id")).limit(checked(projects, PREVIEW))
    return edges(model).join(newest, "project_id", "left_semi")


def degrees(model: Model) -> DataFrame:
    """How many edges of each relation every node has, on either side."""
    e = edges(model)
    ends = e.select(F.col("source").alias("uid"), "relation").unionByName(e.select(F.col("target").alias("uid"), "relation"))
    return ends.groupBy("uid", "relation").agg(F.count("*").alias("degree"))


def roles(model: Model) -> DataFrame:
    """id, name, is_buyer, is_supplier of every organization: existence by semi-joins, no counting."""
    buyers = model.projects.select(F.col("buyer_id").alias("id"), F.lit(True).alias("is_buyer")).distinct()
    suppliers = model.table("lineitem").select((2 * F.col("l_suppkey") + 1).alias("id"), F.lit(True).alias("is_supplier")).distinct()
    out = model.organizations.join(buyers, "id", "left").join(suppliers, "id", "left")
    return out.select("id", "name", F.coalesce("is_buyer", F.lit(False)).alias("is_buyer"), F.coalesce("is_supplier", F.lit(False)).alias("is_supplier"))


def found(model: Model, query: str) -> DataFrame:
    """Organizations with a role and projects whose name holds the query: kind, id, name, is_buyer, is_supplier. Names are
    filtered first; only what is left looks for its roles."""
    has = lambda c: F.contains(F.lower(c), F.lower(F.lit(query)))
    people = model.organizations.where(has(F.col("name")))
    bought = model.projects.select(F.col("buyer_id").alias("id")).join(people.select("id"), "id", "left_semi").distinct().withColumn("is_buyer", F.lit(True))
    sold = model.table("lineitem").select((2 * F.col("l_suppkey") + 1).alias("id")).join(people.select("id"), "id", "left_semi").distinct().withColumn("is_supplier", F.lit(True))
    people = people.join(bought, "id", "left").join(sold, "id", "left").fillna(False, ["is_buyer", "is_supplier"]).where("is_buyer or is_supplier")
    people = people.select(F.lit("organization").alias("kind"), "id", "name", "is_buyer", "is_supplier")
    name = F.concat(F.lit("project "), "project_id")
    projects = model.projects.select(F.lit("project").alias("kind"), F.col("project_id").alias("id"), name.alias("name"), F.col("buyer_id").isNotNull().alias("is_buyer"), F.lit(False).alias("is_supplier"))
    return people.unionByName(projects.where(has(F.col("name"))))


def search(model: Model, query: str, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """A page of found(), in order of name without case, kind and id."""
    return found(model, query).orderBy(F.lower("name"), "kind", "id").offset(offset).limit(checked(limit, PAGE))


def search_page(model: Model, query: str, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """The same with `total` of all that is found, and `next_offset`, null on the last page."""
    return page(found(model, query), [F.lower("name"), F.col("kind"), F.col("id")], offset, checked(limit, PAGE))


def probed(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows and whether there are more: one row more is asked for, and no count."""
    probe = rows.orderBy(*order).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(*order))
    return probe.withColumn("_n", place).withColumn("truncated", F.count("*").over(Window.partitionBy()) > limit).where(F.col("_n") <= limit).drop("_n")


def subgraph(model: Model, some: DataFrame, node_limit: int = NODES) -> DataFrame:
    """(uid, label, name) of the nodes of some edges, a page of them in order, up to the limit by their first appearance: ids
    first, rows of their nodes after."""
    placed = some.withColumn("place", F.row_number().over(Window.orderBy(F.desc("project_id"), "relation", "source", "target")))
    ends = placed.select("place", F.posexplode(F.array("source", "target")).alias("side", "uid"))
    first = ends.groupBy("uid").agg(F.min(F.struct("place", "side")).alias("at")).orderBy("at").limit(checked(node_limit, NODES))
    return nodes(model).join(F.broadcast(first.select("uid")), "uid", "left_semi")


def totals(model: Model) -> DataFrame:
    """How many nodes of each label, and edges of each relation, there are: entity, n."""
    labels = nodes(model).groupBy(F.col("label").alias("entity")).agg(F.count("*").alias("n"))
    return labels.unionByName(edges(model).groupBy(F.col("relation").alias("entity")).agg(F.count("*").alias("n")))


def export(model: Model, folder: str) -> str:
    """All nodes and edges, edges by relation, as the next version of a dataset in the folder: readers see both as they were, or both
    anew. Gives the version's folder."""
    tables = {"nodes": nodes(model), "edges": edges(model)}
    return catalog.publish(model.spark, folder, "default", tables, partitioned={"edges": ["relation"]}).folder


def paths(some: DataFrame, first: str, second: str, keep: str = "source") -> DataFrame:
    """Two-step patterns: (start, middle, end, project_id) of an edge `first` and an edge `second` that meet at the end of the
    first, which is the second's source or, with keep="target", its target."""
    a = some.where(F.col("relation") == first).select(F.col("source").alias("start"), F.col("target").alias("middle"), "project_id")
    b = some.where(F.col("relation") == second)
    b = b.select(F.col("source").alias("middle"), F.col("target").alias("end")) if keep == "source" else b.select(F.col("target").alias("middle"), F.col("source").alias("end"))
    return a.join(b, "middle").select("start", "middle", "end", "project_id")
