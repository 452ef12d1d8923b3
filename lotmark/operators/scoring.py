"""Evaluation of predictions against a gold standard: fields, records and roles, diagnostics, runs and routes.

Items are compared along an alignment (evaluation.align); names, whose weight is equal or not, need none: the largest
matching of equal names is the smaller of both counts, so roles are counted by joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmark.functions import money
from lotmark.operators import evaluation

COUNTS = ("tp", "fp", "fn", "tn")


@dataclass(frozen=True)
class Policy:
    """How values are compared. `exclusive` counts a wrong value once, as fp, and an empty slot as tn; otherwise a wrong
    value is fp and fn. `missing_is_unknown` leaves out fields that one side lacks."""

    absolute: str = "0.01"
    relative: str = "0"
    whole: bool = False
    exclusive: bool = False
    missing_is_unknown: bool = False


#: Profiles by name; whoever evaluates names one.
PROFILES = {"local": Policy(), "integers": Policy(whole=True), "exclusive": Policy(exclusive=True)}


def policy(name: str) -> Policy:
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name}; there are {', '.join(sorted(PROFILES))}")
    return PROFILES[name]


def statuses(pairs: DataFrame, gold: DataFrame, predicted: DataFrame, scope: str, fields: dict[str, str], how: Policy = Policy()) -> DataFrame:  # noqa: B008
    """scope, gold_no, predicted_no, field, status, for pairs and for rows of both sides that are in none. fields maps names to
    `text`, `quantity` or `money`."""
    sides = [df.select(scope, F.col("no").alias(no), F.struct(*fields).alias(v)) for df, no, v in ((gold, "gold_no", "g"), (predicted, "predicted_no", "p"))]
    rows = pairs.select(scope, "gold_no", "predicted_no").join(sides[0], [scope, "gold_no"], "right").join(sides[1], [scope, "predicted_no"], "full")
    each = []
    for field, kind in fields.items():
        a, b = F.col(f"g.{field}"), F.col(f"p.{field}")
        same = a == b if kind == "text" else money.equal(a, b, "0" if kind == "quantity" else how.absolute, how.relative, how.whole and kind == "money")
        status = evaluation.field_status(a, b, same)
        if how.missing_is_unknown:
            status = F.when(a.isNull() | b.isNull(), "empty").otherwise(status)
        each.append(F.struct(F.lit(field).alias("field"), status.alias("status")))
    return rows.select(scope, "gold_no", "predicted_no", F.explode(F.array(*each)).alias("s")).select(scope, "gold_no", "predicted_no", "s.*")


def tally(status: Column, how: Policy) -> list[Column]:
    """tp, fp, fn and tn of statuses, as aggregates."""
    hit = lambda *names: F.count_if(status.isin(*names))
    if how.exclusive:
        cells = (hit("correct"), hit("wrong", "extra"), hit("missing"), hit("empty"))
    else:
        cells = (hit("correct"), hit("wrong", "extra"), hit("wrong", "missing"), F.count_if(F.lit(False)))
    return [c.alias(n) for c, n in zip(cells, COUNTS, strict=True)]


def by_field(found: DataFrame, how: Policy = Policy()) -> DataFrame:  # noqa: B008
    """field, tp, fp, fn, tn, and a row for all of them."""
    return found.rollup("field").agg(*tally(F.col("status"), how)).withColumn("field", F.coalesce("field", F.lit("all")))


def records(found: DataFrame, scope: str, how: Policy = Policy()) -> DataFrame:  # noqa: B008
    """tp, fp, fn, tn of whole records: exact if both sides are there and no field is wrong, missing or extra."""
    row = found.groupBy(scope, "gold_no", "predicted_no").agg(F.bool_and(F.col("status").isin("correct", "empty")).alias("right"))
    status = F.when(F.col("gold_no").isNull(), "extra").when(F.col("predicted_no").isNull(), "missing").when(F.col("right"), "correct").otherwise("wrong")
    return row.agg(*tally(status, how))


def roles(gold: DataFrame, predicted: DataFrame, scope: str) -> DataFrame:
    """role, tp, fp, fn of named entities (scope, role, key) as multisets: of a key that one side has g and the other p times,
    the smaller number matches."""
    sides = [df.select(scope, "role", "key", F.lit(g).alias("gold")) for df, g in ((gold, True), (predicted, False))]
    return role_counts(sides[0].unionByName(sides[1]), [scope])


def role_counts(entities: DataFrame, scope: list[str]) -> DataFrame:
    """The same of both sides' entities in one frame, `gold` telling them apart: they are counted together, no side is sorted to meet
    the other. Of a null scope or key none match."""
    both = entities.groupBy(*scope, "role", "key").agg(F.count_if(F.col("gold")).alias("g"), F.count_if(~F.col("gold")).alias("p"))
    known = F.col("key").isNotNull() & F.col("role").isNotNull()
    for c in scope:
        known = known & F.col(c).isNotNull()
    hit = F.when(known, F.least("g", "p")).otherwise(F.lit(0))
    return both.groupBy("role").agg(F.sum(hit).alias("tp"), F.sum(F.col("p") - hit).alias("fp"), F.sum(F.col("g") - hit).alias("fn"))


def entity_roles(packages: DataFrame) -> DataFrame:
    """(role, key and the other columns) from entities (scope, kind, key, outcome), kind being buyer, winner or bidder: bidders are
    counted as such, with their outcome, and those that lost once more."""
    kind, key = F.col("kind"), F.col("key")
    role = lambda name, k: F.struct(F.lit(name).alias("role"), k.alias("key"))
    each = (
        F.when(kind == "buyer", F.array(role("buyer", key)))
        .when(kind == "winner", F.array(role("winners", key)))
        .when(F.col("outcome") == "nonwinner", F.array(role("bidders", key), role("bidder_outcomes", F.concat_ws(":", key, "outcome")), role("nonwinners", key)))
        .otherwise(F.array(role("bidders", key), role("bidder_outcomes", F.concat_ws(":", key, "outcome"))))
    )
    others = [c for c in packages.columns if c not in ("kind", "key", "outcome")]
    return packages.select(*others, F.explode(each).alias("r")).select(*others, "r.*")


def winner_amounts(gold: DataFrame, predicted: DataFrame, how: Policy = Policy()) -> DataFrame:  # noqa: B008
    """tp, fp, fn, tn of winners' amounts: (scope, key, no, amount) on both sides. Winners pair by name, those with equal amounts
    first, the rest in order of `no`; an unpaired winner counts if it has an amount."""
    cols = ["scope", "key", "amount"]
    nth = Window.partitionBy(*cols).orderBy("no")
    a, b = (df.where("amount is not null").withColumn("n", F.row_number().over(nth)) for df in (gold, predicted))
    equal = a.select(*cols, "n", F.col("no").alias("gold_no")).join(b.select(*cols, "n", F.col("no").alias("predicted_no")), [*cols, "n"])
    rest = []
    for df, no in ((gold, "gold_no"), (predicted, "predicted_no")):
        left = df.join(equal.select("scope", F.col(no).alias("no")), ["scope", "no"], "left_anti")
        rest.append(left.withColumn("n", F.row_number().over(Window.partitionBy("scope", "key").orderBy("no"))).select("scope", "key", "n", F.col("no").alias(no), F.col("amount").alias(f"{no}_amount")))
    both = rest[0].join(rest[1], ["scope", "key", "n"], "full")
    g, p = F.col("gold_no_amount"), F.col("predicted_no_amount")
    status = evaluation.field_status(g, p, money.equal(g, p, how.absolute, how.relative, how.whole))
    paired = F.col("gold_no").isNotNull() & F.col("predicted_no").isNotNull()
    status = F.when(paired | g.isNotNull() | p.isNotNull(), status)
    all_ = both.select(status.alias("status")).unionByName(equal.select(F.lit("correct").alias("status"))).where("status is not null")
    return all_.agg(*tally(F.col("status"), how))


def diagnosis(found: DataFrame, scope: str, notice: Column) -> DataFrame:
    """Statuses counted for each package (scope), each notice, and all: notice, scope, n_fields, one count per status, and
    exact, the records without a fault. One aggregation per record, then a rollup."""
    names = ("correct", "wrong", "missing", "extra", "empty")
    per = found.withColumn("notice", notice).groupBy("notice", scope, "gold_no", "predicted_no").agg(*[F.count_if(F.col("status") == s).alias(s) for s in names])
    exact = (F.col("wrong") + F.col("missing") + F.col("extra") == 0).cast("long")
    return per.withColumn("exact", exact).rollup("notice", scope).agg(F.count("*").alias("n_records"), *[F.sum(s).alias(s) for s in names], F.sum("exact").alias("exact"))


def error_fields(found: DataFrame) -> DataFrame:
    """field, status, n of the faults, and their share of the field's slots."""
    per = found.groupBy("field", "status").agg(F.count("*").alias("n"))
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy("field")), 6)
    return per.withColumn("share", share).where(F.col("status").isin("wrong", "missing", "extra"))


def faults(rows: DataFrame, scope: str, ident: str, required: list[str], numbers: list[str]) -> DataFrame:
    """(scope, ident, fault): rows that a gold standard may not have: an id that comes twice in its scope, blank required
    values, negative numbers, and items without any value. No row means that it is sound."""
    twice = F.count("*").over(Window.partitionBy(scope, ident)) > 1
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    rows = rows.withColumn("_twice", twice)
    cells = [F.when(F.col("_twice"), F.lit("repeated id"))] + [F.when(blank(c), F.lit(f"blank {c}")) for c in required] + [F.when(F.col(c) < 0, F.lit(f"negative {c}")) for c in numbers]
    return rows.select(scope, ident, F.explode(F.array_compact(F.array(*cells))).alias("fault")).distinct()


def gate(gold: DataFrame, runs: DataFrame, tuning: DataFrame | None = None) -> DataFrame:
    """What keeps a report from being made, as rows (problem, notice_id): gold notices that aren't reviewed, that a run lacks or
    whose input hash differs from the gold's, and notices of the tuning set among them. gold: notice_id, status,
    sha256; runs: notice_id, sha256. A report needs this to be empty."""
    draft = gold.where("status <> 'reviewed'").select(F.lit("not reviewed").alias("problem"), "notice_id")
    missing = gold.join(runs, "notice_id", "left_anti").select(F.lit("not run").alias("problem"), "notice_id")
    other = gold.alias("g").join(runs.alias("r"), "notice_id").where("not g.sha256 <=> r.sha256").select(F.lit("other input").alias("problem"), "notice_id")
    out = draft.unionByName(missing).unionByName(other)
    if tuning is not None:
        out = out.unionByName(gold.join(tuning, "notice_id", "left_semi").select(F.lit("used for tuning").alias("problem"), "notice_id"))
    return out


def merge_disjoint(parts: list[DataFrame], key: str) -> DataFrame:
    """The parts as one frame, and `conflict`, true for keys that more than one part has: such rows are reported, not picked."""
    tagged = [df.withColumn("part", F.lit(n)) for n, df in enumerate(parts)]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    w = Window.partitionBy(key)
    return out.withColumn("conflict", F.min("part").over(w) < F.max("part").over(w))


def agreement(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, agree: whether two annotators give the same multiset of values for a key. Counts of values are compared, so no
    list of them is collected."""
    per = lambda df, n: df.groupBy(*keys, value).agg(F.count("*").alias(n))
    x, y = per(a, "a").alias("x"), per(b, "b").alias("y")
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in [*keys, value]]
    cond = on[0]
    for one in on[1:]:
        cond = cond & one
    both = x.join(y, cond, "full").select(*[F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in keys], F.col("a").eqNullSafe(F.col("b")).alias("same"))
    return both.groupBy(*keys).agg(F.bool_and("same").alias("agree"))


def run_summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: notices, distinct model calls with their tokens and time, median and largest duration. A call that several rows
    report counts once. runs: notice_id, call_id (null for none), tokens, seconds."""
    calls = runs.where("call_id is not null").groupBy(*keys, "call_id").agg(F.max("tokens").alias("tokens"), F.max("seconds").alias("call_seconds"))
    calls = calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("call_seconds"), 6).alias("call_seconds"))
    per = runs.groupBy(*keys).agg(F.count_distinct("notice_id").alias("notices"), F.round(F.median("seconds"), 6).alias("median_seconds"), F.max("seconds").alias("most_seconds"))
    return per.join(calls, keys, "left").fillna(0, ["calls"])


def coverage(files: DataFrame, keys: list[str]) -> DataFrame:
    """Counters of attachments (notice_id, path, status, warning) by key: files, read, failed, scanned, notices with a warning."""
    scanned = F.coalesce(F.lower("warning").contains("ocr"), F.lit(False))
    return files.groupBy(*keys).agg(
        F.count("path").alias("files"), F.count_if(F.col("status") == "parsed").alias("parsed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(scanned).alias("scanned"), F.count_distinct(F.when(F.col("warning").isNotNull(), F.col("notice_id"))).alias("notices_with_warnings"),
    )


def filled(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, n_rows and, for each field, how many rows fill it: what modes of extraction are compared by."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), *[F.count(F.nullif(F.trim(F.col(f).cast("string")), F.lit(""))).alias(f) for f in fields])


def trees(rows: DataFrame, scope: list[str], fields: list[str], order: str) -> DataFrame:
    """One row per scope with its rows as an array of structs in order: predictions as trees. A package's rows are few; a scope
    must not be larger than a document."""
    return rows.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order]))).alias("items"))


def fingerprint_text(c: Column) -> Column:
    """What texts are compared by across routes: half-width, lower case, no white space and punctuation; null for nothing."""
    from lotmark.functions.text import compact, half_width

    return F.nullif(F.regexp_replace(F.lower(compact(half_width(c))), "[\\p{P}\\p{S}]", ""), F.lit(""))


def fingerprint_number(c: Column) -> Column:
    """The same for numbers: canonical if it is one, else the text's."""
    return F.coalesce(money.canonical(money.number(c, True)), fingerprint_text(c))
