"""Merging item candidates: equal rows of several files, and rows of rules with rows of models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmark.functions.codes import DEFAULT
from lotmark.functions.text import compact, half_width
from lotmark.operators.linking import checkpoint, components, components_within, solved, stored

#: Fields that are compared, those that a model reads better, and those that tables state exactly.
FIELDS = ("category", "brand", "model", "quantity", "quantity_unit", "unit_price", "total_price")
SEMANTIC = ("product_name", "category", "brand", "model", "quantity_unit")
NUMERIC = ("quantity", "unit_price", "total_price")
#: Fields that, equal together, make two rows of one name the same item.
STRONG = (("unit_price", "quantity"), ("unit_price", "model"), ("total_price", "quantity"), ("total_price", "model"), ("model", "quantity"))


def plain(c: Column) -> Column:
    return F.nullif(F.lower(compact(half_width(c.cast("string")))), F.lit(""))


def _keyed(items: DataFrame) -> DataFrame:
    """notice_id, no, source_file and what rows are compared by: name, package and FIELDS."""
    fields = [(plain(F.col(f)) if f not in NUMERIC else F.col(f)).alias(f) for f in FIELDS]
    return items.select("notice_id", "no", "source_file", F.coalesce("package_code", F.lit(DEFAULT)).alias("package"), plain(F.col("product_name")).alias("name"), *fields)


def duplicate_edges(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, edges) of items (notice_id, no, source_file, package_code, product_name, FIELDS); edges: notice_id, a, b.

    Rows of a notice with equal name, package and fields are one class: class_id, rows, files, only_file. Two classes
    have an edge if they have the same name, packages that are equal or of which one is missing, no field that both
    fill differently, a pair of STRONG fields equal, and not all rows in one file. They meet by equal STRONG values,
    so only distinct rows of one notice, name and such a pair are compared."""
    keyed, same = _keyed(items), ["notice_id", "name", "package", *FIELDS]
    classes = keyed.where("name is not null").groupBy(*same).agg(F.min("no").alias("first"), F.count("*").alias("rows"), F.count_distinct("source_file").alias("files"), F.min("source_file").alias("only_file"))
    classes = stored(classes.withColumn("class_id", F.monotonically_increasing_id()))
    tell = [F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.lit(n).alias("n"), F.col(a).cast("string").alias("u"), F.col(b).cast("string").alias("v"))) for n, (a, b) in enumerate(STRONG)]
    told = classes.select("notice_id", "name", F.struct("class_id", "package", "files", "only_file", *FIELDS).alias("x"), F.explode(F.array_compact(F.array(*tell))).alias("t")).select("notice_id", "name", "t.*", "x")
    on = ["notice_id", "name", "n", "u", "v"]
    both = told.join(told.withColumnRenamed("x", "y"), on).where("x.class_id < y.class_id")
    fine = (F.col("x.package") == F.col("y.package")) | (F.col("x.package") == DEFAULT) | (F.col("y.package") == DEFAULT)
    for f in FIELDS:
        fine = fine & F.coalesce(F.col(f"x.{f}") == F.col(f"y.{f}"), F.lit(True))
    apart = ~((F.col("x.files") == 1) & (F.col("y.files") == 1) & (F.col("x.only_file") == F.col("y.only_file")))
    edges = both.where(fine & apart).select("notice_id", F.col("x.class_id").alias("a"), F.col("y.class_id").alias("b"))
    return classes, stored(edges.distinct())


def _strong(have: Column) -> Column:
    """Whether a class, which fills the fields that have() names, is strong with itself."""
    out = F.lit(False)
    for a, b in STRONG:
        out = out | (have[a] & have[b])
    return out


def merge_files(items: DataFrame) -> DataFrame:
    """notice_id, item_no, n_rows, status and the fields: items with those of other files that are the same one.

    What edges link is merged if everything in it has an edge with everything else, each row from another file:
    `merged`. Otherwise its rows stay as they are, `ambiguous`: a row without a package must not bridge two packages.
    All others are `single`. A merged item has the package and the fields that any of its rows fills."""
    classes, edges = duplicate_edges(items)
    linked = components_within(edges, "notice_id")
    linked = linked.union(linked.select(F.col("component").alias("node"), "component").distinct())
    placed = stored(classes.join(linked.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id")))
    links = edges.select("a", "b").join(placed.select(F.col("class_id").alias("a"), "notice_id", "component"), "a").groupBy("notice_id", "component").agg(F.count("*").alias("links"))
    have = {f: F.col(f).isNotNull() for f in FIELDS}
    # a class is told by its first row, so its rows meet it by two numbers instead of all that they are compared by
    first = F.min("no").over(Window.partitionBy("notice_id", "name", "package", *FIELDS))
    keyed = _keyed(items).where("name is not null").select("notice_id", "no", "source_file", first.alias("first"))
    member = keyed.join(placed.select("notice_id", "first", "component"), ["notice_id", "first"]).select("notice_id", "no", "source_file", "component")
    files = member.groupBy("notice_id", "component").agg(F.count_distinct("source_file").alias("all_files"))
    per = placed.groupBy("notice_id", "component").agg(F.count("*").alias("classes"), F.sum("rows").alias("rows"), F.bool_and(_strong(have) | (F.col("rows") == 1)).alias("strong"))
    per = per.join(links, ["notice_id", "component"], "left").join(files, ["notice_id", "component"])
    full = F.coalesce("links", F.lit(0)) * 2 == F.col("classes") * (F.col("classes") - 1)
    status = F.when(F.col("rows") == 1, "single").when(full & F.col("strong") & (F.col("rows") == F.col("all_files")), "merged").when((F.col("classes") == 1) & (~F.col("strong") | (F.col("all_files") == 1)), "single").otherwise("ambiguous")
    per = per.select("notice_id", "component", status.alias("status"))
    least = F.min("no").over(Window.partitionBy("notice_id", "component"))
    told = member.drop("source_file").join(per, ["notice_id", "component"]).select("notice_id", "no", "status", F.when(F.col("status") == "merged", least).otherwise(F.col("no")).alias("item_no"))
    rows = items.join(told, ["notice_id", "no"], "left").withColumns({"status": F.coalesce("status", F.lit("single")), "item_no": F.coalesce("item_no", "no")})
    code = F.max(F.when(F.col("package_code") != DEFAULT, F.col("package_code")))
    return rows.groupBy("notice_id", "item_no", "status").agg(F.count("*").alias("n_rows"), F.coalesce(code, F.lit(DEFAULT)).alias("package_code"), F.min_by("product_name", "no").alias("product_name"), *[F.max(f).alias(f) for f in FIELDS])


def forced_pairs(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The edges (left, right) of a bipartite graph that every largest matching has.

    With one largest matching at hand, an edge of it can be left out if it lies on an alternating cycle, or on an
    alternating path from a free node. So edges of the matching point right to left, the others left to right;
    what a free node reaches is out, and so is what returns to itself."""
    of: dict[int, list[int]] = {}
    for a, b in sorted(edges):
        of.setdefault(a, []).append(b)
    owner: dict[int, int] = {}
    for start in of:
        via: dict[int, int] = {}  # right node to the left node that reached it, breadth first
        layer, end = [start], None
        while layer and end is None:
            following = []
            for a in layer:
                for b in of[a]:
                    if b in via:
                        continue
                    via[b] = a
                    if b not in owner:
                        end = b
                        break
                    following.append(owner[b])
                if end is not None:
                    break
            layer = following
        while end is not None:
            a = via[end]
            previous = next((b for b, o in owner.items() if o == a), None)
            owner[end], end = a, previous
    mate = {a: b for b, a in owner.items()}
    into: dict[int, list[int]] = {}
    for a, b in edges:
        into.setdefault(b, []).append(a)

    def reached(starts: set[int], step) -> set[int]:
        seen, todo = set(starts), list(starts)
        while todo:
            for x in step(todo.pop()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    to_lefts = lambda a: [owner[b] for b in of[a] if b in owner and owner[b] != a]
    loose_left = reached({a for a in of if a not in mate}, to_lefts)
    to_rights = lambda b: [mate[a] for a in into[b] if a in mate and mate[a] != b]
    loose_right = reached({b for b in into if b not in owner}, to_rights)
    out = []
    for a, b in sorted(mate.items()):
        returns = any(a in reached({x}, to_lefts) for x in to_lefts(a))
        if a not in loose_left and b not in loose_right and not returns:
            out.append((a, b))
    return out


def forced(edges: DataFrame, scope: str) -> DataFrame:
    """(scope, left_no, right_no) of edges that every largest one-to-one pairing of a scope has. A scope's edges are split into
    components first; each is one Python call."""
    nodes = edges.select(scope, "left_no", "right_no", F.xxhash64(F.lit("l"), scope, "left_no").alias("a"), F.xxhash64(F.lit("r"), scope, "right_no").alias("b"))
    nodes = checkpoint(nodes)
    parts = components(nodes.select("a", "b"))
    parts = parts.union(parts.select(F.col("component").alias("node"), "component").distinct())
    placed = nodes.join(parts.withColumnRenamed("node", "a"), "a").select(scope, "component", "left_no", "right_no")
    kind = dict(edges.dtypes)[scope]

    def solve(key: tuple, group: pd.DataFrame) -> list[tuple]:
        return [(key[0], a, b) for a, b in forced_pairs(list(zip(group["left_no"], group["right_no"], strict=True)))]

    return solved(placed, [scope, "component"], ["left_no", "right_no"], solve, f"{scope} {kind}, left_no long, right_no long")


def merge_models(pairs: DataFrame) -> DataFrame:
    """A row of a table with a model's row, structs r and m: names from the model, numbers from the table, each from the other
    side where one is blank, the package where the table has none; `conflicts` lists fields that both fill differently."""
    filled = lambda side, f: F.nullif(F.col(f"{side}.{f}").cast("string"), F.lit("")).isNotNull()
    out = {f: F.when(filled("m", f), F.col(f"m.{f}")).otherwise(F.col(f"r.{f}")) for f in SEMANTIC}
    out |= {f: F.coalesce(f"r.{f}", f"m.{f}") for f in NUMERIC}
    out["package_code"] = F.when(F.col("r.package_code") == DEFAULT, F.coalesce("m.package_code", F.lit(DEFAULT))).otherwise(F.col("r.package_code"))
    differ = [F.when(F.coalesce(plain(F.col(f"r.{f}")) != plain(F.col(f"m.{f}")), F.lit(False)), F.lit(f)) for f in SEMANTIC]
    differ += [F.when(F.coalesce(F.col(f"r.{f}") != F.col(f"m.{f}"), F.lit(False)), F.lit(f)) for f in NUMERIC]
    keep = [c for c in pairs.columns if c not in ("r", "m")]
    return pairs.select(*keep, *[c.alias(f) for f, c in out.items()], F.array_compact(F.array(*differ)).alias("conflicts"))


def carried_evidence(own: Column, changed: Column, other: Column) -> Column:
    """Evidence by field after fields have changed: that of a changed field is the other side's, or gone if it has none."""
    mine = F.map_filter(own, lambda k, v: ~F.array_contains(changed, k))
    theirs = F.map_filter(other, lambda k, v: F.array_contains(changed, k))
    return F.map_concat(mine, theirs)


def brand_is_supplier(brand: Column, text: Column) -> Column:
    """True if a text labels the brand as a supplier: then it isn't a brand."""
    key, body = compact(half_width(brand)), compact(half_width(text))
    hit = F.lit(False)
    for label in ("供应商", "供应商名称", "中标供应商", "成交供应商", "投标人", "投标人名称"):
        hit = hit | F.contains(body, F.concat(F.lit(f"{label}:"), key))
    return F.coalesce((key != "") & hit, F.lit(False))


def amount_in(text: Column, amount: Column) -> Column:
    """True if a number of the text, thousands separators left out, equals the amount, as it stands or in 万元."""
    numbers = F.transform(F.regexp_extract_all(F.regexp_replace(half_width(text), "(?<=[0-9]),(?=[0-9]{3})", ""), F.lit("([0-9]+(?:[.][0-9]+)?)"), F.lit(1)), lambda x: x.try_cast("decimal(38,6)"))
    return F.coalesce(F.exists(numbers, lambda n: (n == amount) | (n * 10_000 == amount)), F.lit(False))
