"""Comparing snapshots: fields of keyed entities, and rows without a key of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmark.functions import states
from lotmark.functions.money import canonical
from lotmark.functions.text import collapse
from lotmark.operators.linking import checkpoint


def long_form(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, field, value: one row per field, values as text."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return df.select(*keys, cells.alias("c")).select(*keys, "c.field", "c.value")


def compare(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str], unchanged: bool = False, provenance: tuple[str, ...] = ()) -> DataFrame:
    """keys, field, before, after, change, kind.

    change: added, removed, changed or unchanged. kind: format_only if only white space differs, provenance_only for
    the fields that say where a value is from, else possible_semantic; unchanged fields are left out unless asked
    for. Keys must be unique on each side.
    """
    a = long_form(before, keys, fields).withColumnsRenamed({"value": "before"}).withColumn("in_a", F.lit(True))
    b = long_form(after, keys, fields).withColumnsRenamed({"value": "after"}).withColumn("in_b", F.lit(True))
    both = a.join(b, [*keys, "field"], "full")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("changed")
    same = collapse(F.col("before")).eqNullSafe(collapse(F.col("after"))) & (change == "changed")
    kind = F.when(change == "unchanged", "none").when(same, "format_only").when(F.col("field").isin(*provenance), "provenance_only").otherwise("possible_semantic")
    out = both.select(*keys, "field", "before", "after", change.alias("change"), kind.alias("kind"))
    return out if unchanged else out.where("change <> 'unchanged'")


def summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("field", "change", "kind").agg(F.count("*").alias("n"))


def match_rows(before: DataFrame, after: DataFrame, scope: str, columns: list[str], passes: list[list[str]]) -> DataFrame:
    """scope, before_no, after_no, pass_no: rows of two snapshots that are the same one.

    Both sides have scope, `no` (unique in the scope) and the columns. Pass 0 pairs equal rows, as often as both
    sides have them, in order of `no`. Each later pass pairs what is left by a key that is unique on both sides of
    the scope. Rows left over are in no pair. Every pass is a join on the scope and a key; none compares all pairs.
    A pass reads what the one before it left from storage.
    """
    a, b = (checkpoint(df.select(scope, "no", *columns)) for df in (before, after))
    found = []
    for n, key in enumerate([columns, *passes]):
        if n == 0:
            # struct() of the columns compares nulls as equal in windows; the join uses their hash and null-safe equality
            nth = lambda df: df.withColumn("_nth", F.row_number().over(Window.partitionBy(scope, *key).orderBy("no")))  # noqa: B023, E731
        else:
            nth = lambda df: df.withColumn("_nth", F.count("*").over(Window.partitionBy(scope, *key))).where("_nth = 1")  # noqa: B023, E731
        x = nth(a).select(scope, F.col("no").alias("before_no"), "_nth", F.xxhash64(*key).alias("_h"), F.struct(*key).alias("_x"))
        y = nth(b).select(scope, F.col("no").alias("after_no"), "_nth", F.xxhash64(*key).alias("_h"), F.struct(*key).alias("_y"))
        pairs = x.join(y, [scope, "_h", "_nth"]).where(F.col("_x").eqNullSafe(F.col("_y")))
        pairs = pairs.select(scope, "before_no", "after_no", F.lit(n).cast("long").alias("pass_no"))
        if n < len(passes):
            pairs = checkpoint(pairs)
            a = checkpoint(a.join(pairs.select(scope, F.col("before_no").alias("no")), [scope, "no"], "left_anti"))
            b = checkpoint(b.join(pairs.select(scope, F.col("after_no").alias("no")), [scope, "no"], "left_anti"))
        found.append(pairs)
    out = found[0]
    for pairs in found[1:]:
        out = out.unionByName(pairs)
    return out


#: Columns of a snapshot that say nothing about its content.
VOLATILE = ("id", "notice_id", "package_id", "project_id", "organization_id", "raw_name", "imported_at", "confidence", "extraction_method", "warnings")


def normal(df: DataFrame, column: str) -> Column:
    """A column's value as text that means the same: decimals without trailing zeros, text with white space collapsed."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("decimal"):
        return canonical(F.col(column))
    return collapse(F.col(column).cast("string"))


def fingerprint(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, n, fingerprint: a SHA-256 of each entity's rows, whatever their order and their volatile columns.

    Each row's normal values give a SHA-256 of their own; its words are summed over the entity, so no group is
    collected, and the sums and the number of rows give the fingerprint."""
    cells = [F.coalesce(F.concat(F.lit("v"), normal(df, c)), F.lit("n")) for c in columns if c not in VOLATILE]
    hashed = df.select(*keys, F.sha2(F.concat_ws("\x1f", *cells), 256).alias("_h"))
    sums = [F.sum(F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"_{i}") for i in range(4)]
    out = hashed.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    return out.select(*keys, "n", F.sha2(F.concat_ws("-", F.col("n").cast("string"), *[f"_{i}" for i in range(4)]), 256).alias("fingerprint"))


def with_ordinals(rows: DataFrame, scope: str, key: str, *order: str) -> DataFrame:
    """Rows whose `key` comes again in its scope get ` #2`, ` #3`, ... behind it, so that keys are unique."""
    n = F.row_number().over(Window.partitionBy(scope, key).orderBy(*order))
    return rows.withColumn("_n", n).withColumn(key, F.when(F.col("_n") == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit(" #"), F.col("_n")))).drop("_n")


def filtered(changes: DataFrame, field: str | None = None, change: str | None = None, kind: str | None = None) -> DataFrame:
    """The changes of a field, a change and a kind, of those that are given."""
    for column, wanted in (("field", field), ("change", change), ("kind", kind)):
        if wanted:
            changes = changes.where(F.col(column) == wanted)
    return changes


#: Texts that stand for no value.
NOTHING = ("", "无", "未知", "未公示", "未提供", "见附件", "详见附件", "none", "null", "n/a", "-", "—")
STRONG = ("official_notice_id", "source_unique_id")
WEAK = "project_buyer"


def identity_tokens(notices: DataFrame) -> DataFrame:
    """(notice_id, kind, token): what identifies a notice, hashed. An official or a source's own id is strong, a project's
    number with its buyer is weak. Placeholders identify nothing. notices: notice_id, namespace, the two ids,
    project_number, procurement_unit."""
    space = F.coalesce(F.nullif(F.trim("namespace"), F.lit("")), F.lit("local-import"))
    token = lambda kind, *cells: F.struct(F.lit(kind).alias("kind"), F.sha2(F.concat_ws("\x1f", F.lit(kind), *cells), 256).alias("token"))
    strong = [F.when(F.coalesce(F.trim(k), F.lit("")) != "", token(k, space, F.trim(k))) for k in STRONG]
    number, buyer = collapse(F.col("project_number")), collapse(F.col("procurement_unit"))
    weak = F.when(~F.lower(number).isin(*NOTHING) & ~F.lower(buyer).isin(*NOTHING), token(WEAK, number, buyer))
    found = F.array_compact(F.array(*strong, weak))
    return notices.select("notice_id", F.explode(found).alias("t")).select("notice_id", "t.*")


def resolve_groups(notices: DataFrame, tokens: DataFrame, identities: DataFrame) -> DataFrame:
    """(notice_id, group_id, status): the group of versions that each notice belongs to.

    tokens are those of the notices, identities (group_id, kind, token) those of known groups. A notice goes by its
    strong tokens, if it has any. One group: it is a new version of it, unless the group has another strong token of
    the same kind. Several groups, or such a conflict: identity_ambiguous. None: a notice with strong tokens joins the
    only group of its project and buyer if that has no strong identity; else it is a group of its own, `matched`, or
    manual_link_required if it has no token at all. Notices of one batch don't see each other: a stream hands them over
    batch by batch.
    """
    is_strong = F.col("kind") != WEAK
    has = tokens.groupBy("notice_id").agg(F.bool_or(is_strong).alias("strong"))
    used = tokens.join(has, "notice_id").where((F.col("kind") != WEAK) | ~F.col("strong"))
    hits = used.join(identities, ["kind", "token"]).groupBy("notice_id").agg(F.count_distinct("group_id").alias("n"), F.min("group_id").alias("group_id"))
    known = identities.where(is_strong).select("group_id", "kind", F.col("token").alias("theirs"))
    clash = hits.where("n = 1").join(tokens.where(is_strong), "notice_id").join(known, ["group_id", "kind"]).where("token <> theirs").select("notice_id").distinct().withColumn("clash", F.lit(True))
    weak = tokens.where(~is_strong).join(has.where("strong"), "notice_id", "left_semi").join(identities, ["kind", "token"]).select("notice_id", "group_id").distinct()
    held = identities.where(is_strong).select("group_id").distinct().withColumn("held", F.lit(True))
    weak = weak.join(held, "group_id", "left").groupBy("notice_id").agg(F.count("*").alias("weak_n"), F.min("group_id").alias("weak_id"), F.bool_or(F.col("held").isNotNull()).alias("held"))
    all_ = notices.select("notice_id").join(has, "notice_id", "left").join(hits, "notice_id", "left").join(clash, "notice_id", "left").join(weak, "notice_id", "left")
    single = (F.col("n") == 1) & F.col("clash").isNull()
    adopted = F.col("n").isNull() & (F.col("weak_n") == 1) & ~F.col("held")
    status = F.when(single | adopted, "new_version").when(F.col("n").isNotNull(), "identity_ambiguous").when(F.col("strong").isNotNull(), "matched").otherwise("manual_link_required")
    return all_.select("notice_id", F.when(single, F.col("group_id")).when(adopted, F.col("weak_id")).alias("group_id"), status.alias("status"))


def captured(resolved: DataFrame, prints: DataFrame, known: DataFrame) -> DataFrame:
    """(notice_id, group_id, fingerprint, status): what a batch adds to the append-only versions.

    A snapshot whose fingerprint its group has already is a duplicate_snapshot and adds nothing; of equal ones in the
    batch, that of the smallest notice_id is added. A notice without a group founds one named by its id.
    known: (group_id, fingerprint).
    """
    rows = resolved.join(prints.select("notice_id", "fingerprint"), "notice_id").withColumn("group_id", F.coalesce("group_id", F.concat(F.lit("new:"), F.col("notice_id").cast("string"))))
    first = F.row_number().over(Window.partitionBy("group_id", "fingerprint").orderBy("notice_id"))
    there = known.select("group_id", "fingerprint").distinct().withColumn("there", F.lit(True))
    rows = rows.withColumn("nth", first).join(there, ["group_id", "fingerprint"], "left")
    return rows.select("notice_id", "group_id", "fingerprint", F.when(F.col("there").isNotNull() | (F.col("nth") > 1), "duplicate_snapshot").otherwise(F.col("status")).alias("status"))


def history(versions: DataFrame) -> DataFrame:
    """versions (group_id, version_id, imported_at, ...) with version_no from 1 and is_latest."""
    w = Window.partitionBy("group_id").orderBy("imported_at", "version_id")
    last = Window.partitionBy("group_id")
    out = versions.withColumn("version_no", F.row_number().over(w).cast("long"))
    return out.withColumn("is_latest", F.col("version_no") == F.count("*").over(last))


def frozen_evidence(fields: DataFrame, sources: DataFrame) -> DataFrame:
    """(version_id, field, state, source_status): the states of a version's fields, derived again from what it holds, and
    whether the source that each names was saved, from the hashes that the version has of it.

    fields: version_id, field, value, saved, source_file, evidence; sources: version_id, source_file, sha256."""
    per = sources.groupBy("version_id", "source_file").agg(F.count_distinct("sha256").alias("hashes"))
    backed = (F.coalesce(F.trim("source_file"), F.lit("")) != "") & (F.coalesce(F.trim("evidence"), F.lit("")) != "")
    state = states.field_state(F.col("value"), F.col("saved"), backed)
    rows = fields.withColumn("state", state).join(per, ["version_id", "source_file"], "left")
    return rows.select("version_id", "field", "state", states.source_status(F.coalesce("hashes", F.lit(0))).alias("source_status"))
