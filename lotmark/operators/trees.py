"""Pages as trees: hashes of their subtrees, and the subtrees that pages share.

The pieces of a page (tags, texts, comments) are found by one pattern and become rows. Which element each stands in is decided by
a stack of open tags, one page at a time; all else is joins and groupings of rows. A node's hash is made of its own label and
its children's hashes, a level of all pages at once, from the deepest up, so equal subtrees of any pages have equal hashes.

An end tag closes the nearest open element of its name and all within it, and is ignored if there is none; elements that are
never closed reach to the end of what they stand in. Void elements, and tags that end in `/>`, hold nothing. Scripts and styles
hold one text, which is no markup. A bare `<` begins a new text, and a tag that isn't closed at the end of a page is text.
Elements may be nested DEEPEST deep; what stands deeper hangs side by side at that depth, so that levels are bounded.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotmark.functions.text import collapse, let, unescape
from lotmark.operators.linking import checkpoint, shared_folder

#: Elements that have no end tag, and elements whose content is no markup.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
RAW = ("script", "style")
#: Nesting that is kept apart; a parameter of nodes(). Browsers have the same bound.
DEEPEST = 512

_ATTRIBUTES = "(?:[^>=]*+=\\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\\s\"']))){0,200}+[^>]*+>"
PIECE = f"(?is)<!--.*?(?:-->|\\z)|<({'|'.join(RAW)})\\b[^>]*+>.*?(?:</\\1\\s*>|\\z)|<[!?][^>]*+>|</?[a-z]{_ATTRIBUTES}|<?[^<]++|<"
ATTRIBUTE = "(?s)([^\\s\"'>/=]+)(?:\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+))?"
TAG = "^</?([A-Za-z][^\\s/>]*)"


def said(text: Column) -> Column:
    """A text as it reads: references replaced, white space collapsed, and none between CJK characters."""
    return F.regexp_replace(collapse(unescape(text)), "(?<=[\\u3400-\\u9fff]) (?=[\\u3400-\\u9fff])", "")


def pieces(html: Column) -> Column:
    """The pieces of a page in order; of null, null."""
    return F.regexp_extract_all(html, F.lit(PIECE), F.lit(0))


def kind(piece: Column) -> Column:
    """comment, declaration, raw, end, void, start or text."""
    tag = F.lower(F.regexp_extract(piece, TAG, 1))
    return (
        F.when(F.startswith(piece, F.lit("<!--")), "comment")
        .when(piece.rlike("(?s)^<[!?].*>$"), "declaration")
        .when(~piece.rlike(f"(?s)^</?[A-Za-z].*>$") & ~tag.isin(*RAW), "text")
        .when(F.startswith(piece, F.lit("</")), "end")
        .when(tag.isin(*RAW), "raw")
        .when(tag.isin(*VOID) | F.endswith(piece, F.lit("/>")), "void")
        .otherwise("start")
    )


def body_text(html: Column) -> Column:
    """The texts of a page behind each other, without comments, scripts, styles and tags."""
    texts = F.transform(F.filter(pieces(html), lambda p: kind(p) == "text"), said)
    return F.regexp_replace(F.array_join(F.filter(texts, lambda t: t != ""), " "), "(?<=[\\u3400-\\u9fff]) (?=[\\u3400-\\u9fff])", "")


def attributes(tag: Column) -> Column:
    """The attributes of a start tag as (name, value), by name; of a name that stands twice, the last value. Classes have single blanks."""
    bare = F.regexp_replace(tag, "^<[A-Za-z][^\\s/>]*|/?>$", "")
    found = lambda g: F.regexp_extract_all(bare, F.lit(ATTRIBUTE), F.lit(g))

    def entry(pair: Column, i: Column) -> Column:
        name = F.lower(pair["name"])
        value = unescape(F.regexp_replace(pair["value"], "(?s)^([\"'])(.*)\\1$", "$2"))
        return F.struct(name.alias("name"), (-i).alias("place"), F.when(name == "class", collapse(value)).otherwise(value).alias("value"))

    # names and values are found once each, and sorted once: a tag may have thousands
    pairs = F.zip_with(found(1), found(2), lambda name, value: F.struct(name.alias("name"), value.alias("value")))
    last = lambda all_: F.filter(all_, lambda a, i: (i == 0) | (F.get(all_, i - 1)["name"] != a["name"]))
    once = let(F.array_sort(F.transform(pairs, entry)), last)
    return F.transform(once, lambda a: F.struct(a["name"].alias("name"), a["value"].alias("value")))


def _places(deepest: int):
    """(parent, depth) of each piece of a page, by the marks of its pieces: a name opens an element, /name closes one, '' is a
    leaf. The root is -1; what closes has depth 0, as it is no node."""

    def stack(marks) -> list[dict]:
        opened: list[tuple[int, str]] = []
        count: dict[str, int] = {}
        out = []
        for i, mark in enumerate(marks):
            if mark.startswith("/"):
                out.append({"parent": -1, "depth": 0})
                if count.get(mark[1:]):
                    while True:
                        name = opened.pop()[1]
                        count[name] -= 1
                        if name == mark[1:]:
                            break
                continue
            depth = min(len(opened), deepest - 1)
            out.append({"parent": opened[depth - 1][0] if depth else -1, "depth": depth + 1})
            if mark:
                opened.append((i, mark))
                count[mark] = count.get(mark, 0) + 1
        return out

    @F.pandas_udf("array<struct<parent int, depth int>>")
    def places(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(stack)

    return places


def nodes(pages: DataFrame, keys: list[str], html: str, deepest: int = DEEPEST) -> DataFrame:
    """keys, pos, parent, depth, kind, name, label: the nodes of each page below its root, which is -1.

    kind: start, void, raw, text, comment or declaration; name: of elements; label: attributes or text, as JSON. Texts and comments
    that are blank are no nodes. Pages that are null or empty have none."""
    if deepest < 1:
        raise ValueError("deepest must be at least 1")
    of = pages.select(*keys, pieces(F.col(html)).alias("_pieces")).where("size(_pieces) > 0")
    name = lambda p: F.lower(F.regexp_extract(p, TAG, 1))
    mark = lambda p: F.when(kind(p) == "start", name(p)).when(kind(p) == "end", F.concat(F.lit("/"), name(p))).otherwise("")
    placed = of.withColumn("_places", _places(deepest)(F.transform("_pieces", mark)))
    each = placed.select(*keys, F.posexplode(F.arrays_zip("_pieces", "_places")).alias("pos", "_p")).select(*keys, "pos", F.col("_p._places.parent").alias("parent"), F.col("_p._places.depth").alias("depth"), F.col("_p._pieces").alias("_piece"))
    each = each.where("depth > 0").withColumn("kind", kind(F.col("_piece")))
    element = F.col("kind").isin("start", "void", "raw")
    inner = F.regexp_replace("_piece", "(?is)^<!--|-->$|^<[!?]|^<(?:script|style)\\b[^>]*+>|</(?:script|style)\\s*>$", "")
    opening = F.when(F.col("kind") == "raw", F.regexp_extract("_piece", "(?s)^<[^>]*>", 0)).otherwise(F.col("_piece"))
    text = F.when(F.col("kind") == "text", said(F.col("_piece"))).when(F.col("kind").isin("comment", "declaration", "raw"), collapse(inner))
    label = F.to_json(F.struct(F.when(element, attributes(opening)).alias("attributes"), text.alias("text")))
    kept = each.where(~F.col("kind").isin("text", "comment") | (said(inner) != ""))
    return kept.select(*keys, "pos", "parent", "depth", "kind", F.when(element, name(F.col("_piece"))).alias("name"), label.alias("label"))


def hashed(of: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of nodes(), and one for each page's root, with hash and size (nodes in the subtree, itself included).

    Nodes are stored by depth, and each level reads its own rows and the hashes of the level below. Children come as
    lists in order; a list is no longer than its page, which is one row to begin with."""
    spark = of.sparkSession
    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    of.write.partitionBy("depth").parquet(path)
    stored = spark.read.schema(of.schema).parquet(path)
    depths = [r.depth for r in stored.select("depth").distinct().orderBy("depth").collect()]  # as many as levels
    below, out = None, None
    for depth in [*reversed(depths), 0]:
        if depth:
            level = stored.where(F.col("depth") == depth)
        else:
            root = {"pos": F.lit(-1), "parent": F.lit(None).cast("int"), "kind": F.lit("root"), "name": F.lit(None).cast("string"), "label": F.lit(""), "depth": F.lit(0)}
            level = stored.select(*keys).distinct().select(*keys, *[c.alias(n) for n, c in root.items()]).select(*of.columns)
        if below is None:
            level = level.withColumn("_kids", F.lit("")).withColumn("_n", F.lit(0).cast("long"))
        else:
            kids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda k: k["hash"]), "")
            per = below.groupBy(*keys, F.col("parent").alias("pos")).agg(kids.alias("_kids"), F.sum("size").alias("_n"))
            level = level.join(per, [*keys, "pos"], "left")
        own = F.sha2(F.to_json(F.struct(F.when(F.col("name").isNull(), F.col("kind")).alias("kind"), "name", "label")), 256)
        kids = F.coalesce("_kids", F.lit(""))
        below = checkpoint(level.select(*of.columns, F.sha2(F.concat(own, kids), 256).alias("hash"), (F.coalesce("_n", F.lit(0)) + 1).alias("size")))
        out = below if out is None else out.unionByName(below)
    return out


def structures(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """keys, structure, n_nodes, text: one row per row of pages, whose keys must be unique: the hash of its whole tree, the nodes below
    its root, and its text. A null page has nulls; an empty one has no structure, no nodes and the text ''."""
    roots = hashed(nodes(pages, keys, html), keys).where("parent is null").select(*keys, F.col("hash").alias("structure"), (F.col("size") - 1).alias("n_nodes"))
    out = pages.select(*keys, body_text(F.col(html)).alias("text"), F.col(html).isNotNull().alias("_is")).join(roots, keys, "left")
    return out.select(*keys, "structure", F.when(F.col("_is"), F.coalesce("n_nodes", F.lit(0))).alias("n_nodes"), "text")


def shared(pages: DataFrame, keys: list[str], html: str, least: int = 2, size: int = 2) -> DataFrame:
    """keys, pos, name, hash, size, n_pages: the largest elements that stand on at least `least` pages alike: not those within an element that
    does so itself. Elements of fewer than `size` nodes don't count."""
    of = checkpoint(hashed(nodes(pages, keys, html), keys).select(*keys, "pos", "parent", "kind", "name", "hash", "size"))
    seen = of.where((F.col("kind") == "start") & (F.col("size") >= size))
    per = seen.select("hash", *keys).distinct().groupBy("hash").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= least)
    met = checkpoint(seen.join(per, "hash"))
    inside = met.select(*keys, F.col("pos").alias("parent"))
    return met.join(inside, [*keys, "parent"], "left_anti").select(*keys, "pos", "name", "hash", "size", "n_pages")
