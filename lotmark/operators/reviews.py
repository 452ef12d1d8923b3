"""The review queue: candidates with reasons to look at them, and decisions about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmark.functions import money, states

#: The fields of an item, and what a decision may correct for each type of candidate.
ITEM_FIELDS = ("product_name", "category", "brand", "model", "quantity", "unit_price", "total_price")
EDITABLE = {
    "item": ("package_code", "product_name", "category", "brand", "model", "quantity", "quantity_unit", "unit_price", "total_price"),
    "bid": ("package_code", "organization_name", "outcome"),
    "award": ("package_code", "organization_name", "award_amount"),
}
NUMBERS = ("quantity", "unit_price", "total_price", "award_amount")
OUTCOMES = ("winner", "nonwinner", "unknown")
TYPES = ("item", "bid", "award")
#: Priorities of reasons, 1 first.
PRIORITY = {
    "numeric_conflict": 1,
    "source_evidence_missing": 1,
    "source_file_missing": 1,
    "source_location_missing": 1,
    "field_evidence_missing": 1,
    "field_missing": 2,
    "parsing_warning": 2,
    "default_package": 3,
}
#: Categories of warnings that call for no review.
QUIET = ("other", "role_skipped")
KEY = ("candidate_type", "candidate_id")


def candidates(items: DataFrame, bids: DataFrame, awards: DataFrame) -> DataFrame:
    """All three kinds as one frame, with candidate_type; columns that a kind lacks are null."""
    parts = [df.withColumn("candidate_type", F.lit(kind)) for kind, df in zip(TYPES, (items, bids, awards), strict=True)]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""


def with_reasons(found: DataFrame) -> DataFrame:
    """The candidates with reasons, see reasoned(); those without any go."""
    return reasoned(found).where("size(reasons) > 0")


def reasoned(found: DataFrame) -> DataFrame:
    """The candidates with `reasons`, sorted `code` or `code:field`, and `priority`, the least.

    An empty field is missing if its state is unknown or unverified; a filled one lacks evidence if it isn't present.
    Amounts conflict if quantity times unit price isn't the total exactly. saved_states and backed map fields to their
    saved states and whether their evidence is complete; warnings are those of the candidate's notice.
    """
    item = F.col("candidate_type") == "item"
    hits: list[tuple[str, Column, Column]] = []
    for field in ITEM_FIELDS:
        value = F.col(field).cast("string")
        state = states.field_state(value, F.col("saved_states")[field], F.col("backed")[field])
        hits.append(("field_missing", F.lit(field), item & _blank(value) & state.isin("unknown", "unverified")))
        hits.append(("field_evidence_missing", F.lit(field), item & ~_blank(value) & (state != "present")))
    product = (F.col("quantity") * F.col("unit_price")).cast(money.EXACT)
    hits.append(("numeric_conflict", F.lit(None).cast("string"), item & F.coalesce(product != F.col("total_price").cast(money.EXACT), F.lit(False))))
    hits.append(("default_package", F.lit(None).cast("string"), F.coalesce(F.col("package_code") == "default", F.lit(False))))
    hits += [(f"{c}_missing", F.lit(None).cast("string"), _blank(F.col(c))) for c in ("source_evidence", "source_file", "source_location")]
    loud = F.exists(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: ~F.coalesce(states.warning_category(w), F.lit("other")).isin(*QUIET))
    hits.append(("parsing_warning", F.lit(None).cast("string"), loud))
    codes = F.array_compact(F.array(*[F.when(hit, F.concat_ws(":", F.lit(code), field)) for code, field, hit in hits]))
    least = F.array_min(F.array_compact(F.array(*[F.when(hit, F.lit(PRIORITY[code])) for code, _, hit in hits])))
    return found.withColumn("reasons", F.array_sort(codes)).withColumn("priority", least.cast("long"))


def latest_decisions(events: DataFrame) -> DataFrame:
    """The last event of each candidate and epoch: action, and the values after it."""
    last = events.groupBy(*KEY, "candidate_epoch").agg(F.max(F.struct("id", "action", "reason", F.to_json("after_values").alias("after"))).alias("e"))
    return last.select(*KEY, "candidate_epoch", F.col("e.id").alias("id"), F.col("e.action").alias("action"), F.col("e.reason").alias("reason"), F.from_json("e.after", "map<string,string>").alias("after_values"))


def with_epochs(found: DataFrame, epochs: DataFrame) -> DataFrame:
    """candidate_epoch of each candidate, 1 unless epochs (candidate_type, candidate_id, epoch) has more."""
    return found.join(epochs.select(*KEY, F.col("epoch").alias("candidate_epoch")), list(KEY), "left").withColumn("candidate_epoch", F.coalesce("candidate_epoch", F.lit(1).cast("long")))


def queue(found: DataFrame, epochs: DataFrame, events: DataFrame, status: str | None = None, kind: str | None = None) -> DataFrame:
    """Candidates with reasons, and status: processed if their current epoch has a decision, else pending."""
    rows = with_epochs(with_reasons(found), epochs)
    done = latest_decisions(events).select(*KEY, "candidate_epoch", F.col("action").alias("latest_action"))
    rows = rows.join(done, [*KEY, "candidate_epoch"], "left").withColumn("status", F.when(F.col("latest_action").isNotNull(), "processed").otherwise("pending"))
    if status:
        rows = rows.where(F.col("status") == status)
    return rows.where(F.col("candidate_type") == kind) if kind else rows


def ordered() -> list[Column]:
    """The order of the queue: priority, notice, type, id."""
    rank = F.when(F.col("candidate_type") == "item", 0).when(F.col("candidate_type") == "bid", 1).otherwise(2)
    return [F.col("priority"), F.col("notice_id"), rank, F.col("candidate_id")]


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of the rows, with total, of all rows, and next_offset, null on the last page."""
    total = rows.agg(F.count("*")).scalar()
    out = rows.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)
    return out.withColumn("next_offset", F.when(F.col("total") > offset + limit, F.lit(offset + limit).cast("long")))


def corrections(decisions: DataFrame) -> DataFrame:
    """decisions with `corrected` (field to text) made normal, and `problem`: why it can't be, or null."""
    allowed = F.create_map(*[x for kind, fields in EDITABLE.items() for x in (F.lit(kind), F.array(*[F.lit(f) for f in fields]))])[F.col("candidate_type")]
    given = F.coalesce("corrected", F.create_map().cast("map<string,string>"))
    number = lambda v: money.canonical(money.exact(F.trim(v)))
    unknown = F.exists(F.map_keys(given), lambda k: ~F.array_contains(allowed, k))
    entries = F.map_entries(given)
    wrong_number = F.exists(entries, lambda e: e["key"].isin(*NUMBERS) & (F.trim(e["value"]) != "") & number(e["value"]).isNull())
    wrong_outcome = F.exists(entries, lambda e: (e["key"] == "outcome") & ~F.coalesce(e["value"].isin(*OUTCOMES), F.lit(False)))
    no_package = F.exists(entries, lambda e: (e["key"] == "package_code") & (F.coalesce(F.trim(e["value"]), F.lit("")) == ""))
    problem = F.when(unknown, "unknown_field").when(wrong_number, "not_a_number").when(wrong_outcome, "not_an_outcome").when(no_package, "empty_package")
    normal = F.transform_values(given, lambda k, v: F.when(k.isin(*NUMBERS), number(v)).otherwise(F.trim(v)))
    return decisions.withColumn("problem", problem).withColumn("corrected", normal)


def decide(decisions: DataFrame, found: DataFrame, epochs: DataFrame, events: DataFrame) -> DataFrame:
    """One row per decision: its key, verdict, and, if accepted, before_values, after_values and changes for the event log.

    decisions: candidate_type, candidate_id, candidate_epoch, seq, action, reason, corrected. The verdict is the first
    that holds of: invalid:<problem>, missing_reason, missing_values, values_not_allowed, not_found, not_queued,
    stale_epoch, superseded (a batch takes one decision of a candidate, the first), unchanged, duplicate, accepted.
    """
    made = corrections(decisions).withColumn("nth", F.row_number().over(Window.partitionBy(*KEY).orderBy("seq")))
    every = sorted({f for fields in EDITABLE.values() for f in fields})
    have = [f for f in every if f in found.columns]
    values = F.map_from_arrays(F.array(*[F.lit(f) for f in have]), F.array(*[F.when(F.col(f"now.{f}").isNotNull(), money.canonical(F.col(f"now.{f}")) if f in NUMBERS else F.col(f"now.{f}").cast("string")) for f in have]))
    mine = F.create_map(*[x for kind, fields in EDITABLE.items() for x in (F.lit(kind), F.array(*[F.lit(f) for f in fields]))])[F.col("candidate_type")]
    # each side is dealt once, by candidate, and a candidate's fields as they are: they become a map where its decision has met them
    current = with_epochs(reasoned(found).select(*KEY, (F.size("reasons") > 0).alias("queued"), F.struct(*have).alias("now")), epochs).withColumnRenamed("candidate_epoch", "epoch")
    last = latest_decisions(events).select(*[F.col(c).alias(f"of_{c}") for c in (*KEY, "candidate_epoch")], F.col("action").alias("last_action"), F.col("reason").alias("last_reason"), F.col("after_values").alias("last_values"))
    same_key = [F.col(c) == F.col(f"of_{c}") for c in KEY]
    # the epoch isn't written as an equality, as rows would be dealt by it as well
    same_epoch = (F.col("epoch") <= F.col("of_candidate_epoch")) & (F.col("epoch") >= F.col("of_candidate_epoch"))
    rows = made.join(current, list(KEY), "left").join(last, same_key[0] & same_key[1] & same_epoch, "left")
    rows = rows.withColumn("values", F.when(F.col("queued").isNotNull(), F.map_filter(values, lambda k, v: F.array_contains(mine, k))))
    before = F.coalesce("last_values", "values")
    given = F.size(F.col("corrected")) > 0
    after = F.map_from_entries(F.concat(F.map_entries(F.map_filter(before, lambda k, v: ~F.map_contains_key(F.col("corrected"), k))), F.map_entries(F.col("corrected"))))
    changes = F.map_filter(F.col("corrected"), lambda k, v: ~v.eqNullSafe(before[k]))
    same = (F.col("last_action") == F.col("action")) & (F.col("last_reason") == F.trim("reason")) & (F.size(changes) == 0)
    corrected = F.col("action") == "corrected"
    verdict = (
        F.when(F.col("problem").isNotNull(), F.concat(F.lit("invalid:"), F.col("problem")))
        .when(_blank(F.col("reason")), "missing_reason")
        .when(corrected & ~given, "missing_values")
        .when(~corrected & given, "values_not_allowed")
        .when(F.col("values").isNull(), "not_found")
        .when(~F.col("queued"), "not_queued")
        .when(F.col("candidate_epoch") != F.col("epoch"), "stale_epoch")
        .when(F.col("nth") > 1, "superseded")
        .when(corrected & (F.size(changes) == 0), "unchanged")
        .when(F.coalesce(same, F.lit(False)), "duplicate")
        .otherwise("accepted")
    )
    rows = rows.withColumn("verdict", verdict)
    fine = lambda c: F.when(F.col("verdict") == "accepted", c)
    return rows.select(*KEY, "candidate_epoch", "seq", "action", F.trim("reason").alias("reason"), "verdict", fine(before).alias("before_values"), fine(after).alias("after_values"), fine(changes).alias("changes"))
