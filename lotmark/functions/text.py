"""Text functions on columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode defines it.
SPACES = "(?U)\\s+"
WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
NARROW = "".join(chr(0x21 + i) for i in range(94)) + " "


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value evaluated once however often it is used: a lambda's variable stands for it."""
    return F.transform(F.array(value), use)[0]


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def compact(c: Column) -> Column:
    return F.regexp_replace(c, SPACES, "")


def organization_key(c: Column) -> Column:
    """The identity of an organization's name: without white space, in lower case."""
    return F.lower(compact(c))


def half_width(c: Column) -> Column:
    """Full-width forms of ASCII and the ideographic space as ASCII: what NFKC changes in most notices."""
    return F.translate(c, WIDE, NARROW)


@F.pandas_udf(T.StringType())
def name_key(names: pd.Series) -> pd.Series:
    """NFKC, casefold, no white space; empty becomes null. Spark has no built-in normalization."""
    return names.map(lambda s: None if s is None else "".join(unicodedata.normalize("NFKC", s).casefold().split()) or None)


def grounded(evidence: Column, text: Column) -> Column:
    """True if the evidence, without white space, is part of the text."""
    key = compact(half_width(evidence))
    return F.coalesce((key != "") & F.contains(compact(half_width(text)), key), F.lit(False))


def header_key(c: Column) -> Column:
    """The key of a table header: no punctuation, no currency word, no unit at the end."""
    plain = F.regexp_replace(F.lower(half_width(c)), "(?U)[\\s()【】\\[\\]:,、/\\\\_-]", "")
    return F.regexp_replace(F.replace(plain, F.lit("人民币"), F.lit("")), "(?:亿元|万元|元)$", "")


def visible(html: Column) -> Column:
    """The text of HTML: without comments, scripts, styles and tags, entities for the common marks replaced."""
    out = F.regexp_replace(html, "(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>", " ")
    out = F.regexp_replace(out, "(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return collapse(out)


def structure(html: Column) -> Column:
    """A SHA-256 of a page's tags in order, without comments, scripts, styles and attributes: equal for pages of one make."""
    bare = F.regexp_replace(html, "(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>", "")
    return F.sha2(F.lower(F.array_join(F.regexp_extract_all(bare, F.lit("<(/?[A-Za-z][A-Za-z0-9]*)"), F.lit(1)), " ")), 256)


def links(html: Column) -> Column:
    """The targets of a page's links in order, each once, without fragments."""
    found = F.regexp_extract_all(html, F.lit("(?i)<a\\s[^>]*?href=\"([^\"]*)\""), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, "#.*$", "")))


def allowed(url: Column, hosts: list[str]) -> Column:
    """True for http and https without user or odd port, on one of the hosts or below it."""
    scheme, host = (F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#@:]*)(?::([0-9]+))?(?:[/?#]|$)", g)) for g in (1, 2))
    port = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#@:]*:([0-9]+)", 1)
    on = [(host == h) | host.endswith(f".{h}") for h in hosts]
    any_host = on[0]
    for one in on[1:]:
        any_host = any_host | one
    return F.coalesce(scheme.isin("http", "https") & port.isin("", "80", "443") & any_host, F.lit(False))


@F.pandas_udf(T.StringType())
def casefold(values: pd.Series) -> pd.Series:
    """Spark's lower() keeps apart what casefold makes equal, such as ß and ss."""
    return values.map(lambda s: None if s is None else s.casefold())


#: What names of attachments end in.
ENDINGS = "(?U)(?:[_\\-\\s]*(?:附件材料|附件资料|附件|attachments?|annex|files?))+$"


def stems(path: Column) -> Column:
    """The stems of a path's folders, archives and file, each once: without suffix, endings such as _附件 or -attachment,
    punctuation and case; of archive members, those of every layer. Empty stems are left out."""

    def normal(part: Column) -> Column:
        name = F.regexp_replace(F.regexp_replace(part, "(?s)^(.+)\\.[^.]+$", "$1"), ENDINGS, "")
        return F.regexp_replace(name, "[^\\p{L}\\p{N}_]+", "")

    parts = F.split(F.replace(casefold(path), F.lit("\\"), F.lit("/")), "!?/")
    return F.array_remove(F.array_distinct(F.transform(parts, normal)), "")


def source_uuid(path: Column) -> Column:
    """The UUID that a file name begins with or holds, or ''."""
    leaf = F.regexp_extract(F.split_part(path, F.lit("!/"), F.lit(1)), "([^/\\\\]*)$", 1)
    return F.regexp_extract(leaf, "(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", 1)


def natural_key(location: Column) -> Column:
    """A sort key that orders digits as numbers: each run of digits padded to twelve."""
    return F.regexp_replace(F.regexp_replace(location, "([0-9]+)", "000000000000$1"), "0*([0-9]{12})(?![0-9])", "$1")


def unescape(c: Column) -> Column:
    """Character references replaced, each once: numbers, decimal or hexadecimal, and the names of HTML 4, which Python lists.
    A reference needs its semicolon; what names no character stays as it is."""
    names = F.create_map(*[F.lit(x) for name, point in sorted(name2codepoint.items()) for x in (name, chr(point))])
    point = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    real = lambda n: ((n > 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n < 0x110000))

    def one(piece: Column) -> Column:
        def said(ref: Column) -> Column:
            number = F.when(ref.rlike("^#[0-9]"), F.substring(ref, 2, 9)).when(ref.rlike("^#[xX]"), F.conv(F.substring(ref, 3, 9), 16, 10)).cast("long")
            char = let(number, lambda n: F.when(real(n), point(n)).when(n.isNull(), F.try_element_at(names, ref)))
            return let(char, lambda v: F.when(v.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(v, F.substr(piece, F.length(ref) + 2))))

        return let(F.regexp_extract(piece, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{0,31});", 1), said)

    pieces = F.split(c, "&")
    rest = F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), one), "")
    return F.when(F.contains(c, F.lit("&")), F.concat(pieces[0], rest)).otherwise(c)
