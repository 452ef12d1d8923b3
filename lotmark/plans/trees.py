"""Queries of pages as trees, and of character references."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import functions as F

from lotmark.functions import text
from lotmark.operators import trees
from lotmark.plans.base import query
from lotmark.plans.grammars import crossed, values

_SPLIT = "(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<[!?/a-z][^>]*>"
#: References by name in the given pages; the ampersand comes last, as what it makes is no reference.
_NAMES = [*(n for n in ("copy", "middot", "quot", "lt", "gt", "nbsp")), "amp"]


def _replaced(c: str) -> str:
    for name in _NAMES:
        c = f"replace({c}, '&{name};', chr({name2codepoint[name]}))"
    return c


@query(
    "f19_body_text",
    f"""WITH p AS (SELECT page_id, html IS NULL AS none, string_split(regexp_replace(coalesce(html, ''), '{_SPLIT}', chr(1), 'g'), chr(1)) AS parts FROM pages),
t AS (SELECT page_id, none, list_filter(list_transform(parts, lambda x: trim(regexp_replace({_replaced('x')}, '[\\s\\x{{A0}}]+', ' ', 'g'))), lambda x: x <> '') AS parts FROM p)
SELECT page_id, CASE WHEN NOT none THEN coalesce(array_to_string(parts, ' '), '') END AS text FROM t""",
)
def body_texts(m):
    return m.table("pages").select("page_id", trees.body_text(F.col("html")).alias("text"))


@query("f19_trees")
def structures(m):
    """One row per page: the hash of its tree, its nodes and its text."""
    return trees.structures(m.table("pages"), ["page_id"], "html")


@query("f19_shared_subtrees")
def shared(m):
    """The largest elements that several pages have alike."""
    return trees.shared(m.table("pages"), ["page_id"], "html")


def _references() -> list[tuple[str, str]]:
    named = [(f"&{name};", chr(point)) for name, point in sorted(name2codepoint.items())]
    numbers = [(f"&#{p};", chr(p)) for p in (9, 38, 65, 8364, 20013, 0x1F600)] + [(f"&#{x}{p:X};", chr(p)) for x in "xX" for p in (38, 0xE9, 0x4E2D, 0x10FFFF)]
    kept = [(r, r) for r in ("&", "&amp", "&nope;", "&;", "&#;", "&#x;", "&#0;", "&#xD800;", "&#x110000;", "&#99999999;", "& amp;", "&&")]
    return [*named, *numbers, *kept, ("&amp;lt;", "&lt;"), ("&amp;amp;", "&amp;"), ("&lt;&gt;", "<>"), ("&&lt;", "&<")]


@query("f18_references", f"SELECT n_nationkey, c0 AS reference, concat(n_name, c1, n_nationkey) AS text FROM nation, {values(_references())}")
def references(m):
    """Every named reference, numbers of each kind, and what is no reference, within texts of a table."""
    rows = crossed(m.table("nation").select("n_nationkey", "n_name"), _references())
    return rows.select("n_nationkey", F.col("case.c0").alias("reference"), text.unescape(F.concat("n_name", "case.c0", F.col("n_nationkey").cast("string"))).alias("text"))
