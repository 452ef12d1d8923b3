"""Rows that lack cells: each cell under the column that it belongs to.

A table may leave cells out of a row (a package that holds for several rows, a result that nobody states), which shifts those behind them to the
left. Where a row has fewer cells than its header, its cells are dealt to columns in order, each to one of its own, at the
least cost: what a cell looks like against what its column holds. The fold over columns keeps, for each number of
cells dealt so far, the cheapest way, so it looks at all alignments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotmark.functions import codes, money
from lotmark.functions.text import compact, half_width, let
from lotmark.operators import intake

#: What names of organizations end in, and what a result's cell says.
ORGANIZATION = "(?:公司|集团|厂|店|院|所|中心|大学|学校|局|社|部)$"
RESULT = "^(?:是|否|中标|成交|已中标|已成交|未中标|未成交|落标|不中标|不成交)$"
REVIEW = "^(?:通过|合格|符合|不通过|未通过|不合格|不符合)$"
#: What a cell of a kind costs under a column; of what isn't here, OTHER under columns without a field and WRONG under the rest. Blank cells fit all.
COSTS = {
    ("code", "package_code"): 0, ("number", "package_code"): 1, ("number", "amount"): 1, ("amount", "amount"): 0, ("status", "result"): 0, ("name", "name"): 0,
    ("review", "qualification"): 0, ("review", "compliance"): 0, ("review", "result"): 4, ("review", "reason"): 1,
    ("text", "name"): 1, ("text", "reason"): 0, ("reason", "reason"): 0, ("reason", "result"): 3, ("status", "reason"): 3,
}
OTHER, WRONG = 2, 5
#: What it costs to leave a column empty: a row without a name says nothing.
EMPTY = {"name": 10}
#: The widest header whose rows are aligned; a parameter of aligned().
WIDEST = 64
_FAR = 1_000_000


def cell_kind(text: Column) -> Column:
    """blank, status, review, reason, number (three digits at most), amount, code, name or text."""

    def of(t: Column) -> Column:
        return (
            F.when(F.coalesce(t, F.lit("")).rlike("^[/—-]*$"), "blank")
            .when(t.rlike(RESULT), "status")
            .when(t.rlike(REVIEW), "review")
            .when(t.rlike("|".join(intake.REASONS)), "reason")
            .when(t.rlike("^[0-9]{1,3}$"), "number")
            .when(money.amount(t).isNotNull(), "amount")
            .when(t.rlike(ORGANIZATION), "name")
            .when(t.rlike("包|标段") & (F.length(t) <= 12) & (codes.package_code(t) != codes.DEFAULT), "code")
            .otherwise("text")
        )

    return let(compact(half_width(text)), of)


def cost(kind: Column, field: Column) -> Column:
    """The cost of a cell under a column; the field of a column without one is ''."""
    known = F.create_map(*[F.lit(x) for (k, f), c in COSTS.items() for x in (f"{k} {f}", c)])
    return F.when(kind == "blank", 0).otherwise(F.coalesce(F.try_element_at(known, F.concat_ws(" ", kind, field)), F.when(field == "", OTHER).otherwise(WRONG)))


def least_cost(kinds: Column, fields: Column) -> Column:
    """The columns, from 0, of cells of the kinds among columns of the fields, which are no fewer: at the least cost, of equal ones the first
    in order, so that cells stand as far to the left as can be."""
    empty = lambda f: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EMPTY.items() for x in kv]), f), F.lit(0))
    way = lambda c, path: F.struct(c.cast("int").alias("cost"), path.cast("array<int>").alias("path"))
    nothing = F.array().cast("array<int>")
    start = F.transform(F.sequence(F.lit(0), F.size(kinds)), lambda i: way(F.when(i == 0, 0).otherwise(_FAR), nothing))

    def column(ways: Column, j: Column) -> Column:
        field = F.get(fields, j)

        def dealt(i: Column) -> Column:
            skipped = let(F.get(ways, i), lambda w: way(w["cost"] + empty(field), w["path"]))
            taken = let(F.get(ways, i - 1), lambda w: way(w["cost"] + cost(F.get(kinds, i - 1), field), F.concat(w["path"], F.array(j))))
            return F.when(i == 0, skipped).otherwise(F.least(skipped, taken))

        return F.transform(F.sequence(F.lit(0), F.size(kinds)), dealt)

    return F.aggregate(F.sequence(F.lit(0), F.size(fields) - 1), start, column, lambda ways: F.element_at(ways, -1)["path"])


def aligned(found: DataFrame, widest: int = WIDEST) -> DataFrame:
    """The rows of intake.rows() with the cells of short rows moved under their columns, and `shifted`: true for a row with a cell that moved.
    Rows as wide as their header, or below a header of more than `widest` cells, stay as they are."""
    short = (F.size("cells") > 0) & (F.size("cells") < F.col("width")) & (F.col("width") <= widest)
    at = F.map_from_entries(F.transform(F.map_entries("columns"), lambda e: F.struct(e["value"]["col_no"].cast("int"), e["key"])))
    fields = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda j: F.coalesce(F.try_element_at("_at", j), F.lit("")))
    # kinds and fields are stored as columns before the fold, which reads them at every step
    out = found.withColumn("_cells", F.array_sort(F.transform(F.map_entries("cells"), lambda e: F.struct(e["key"].cast("int").alias("col"), e["value"].alias("text"))))).withColumn("_at", at)
    out = out.withColumn("_kinds", F.when(short, F.transform("_cells", lambda c: cell_kind(c["text"])))).withColumn("_fields", F.when(short, fields))
    out = out.withColumn("_path", F.when(short, least_cost(F.col("_kinds"), F.col("_fields"))))
    moved = F.map_from_arrays("_path", F.transform("_cells", lambda c: c["text"]))
    shifted = F.coalesce(F.col("_path") != F.transform("_cells", lambda c: c["col"]), F.lit(False))
    key = found.schema["cells"].dataType.keyType.simpleString()
    return out.withColumn("shifted", shifted).withColumn("cells", F.when(F.col("shifted"), moved.cast(f"map<{key},string>")).otherwise(F.col("cells"))).drop("_cells", "_at", "_kinds", "_fields", "_path")


def participants(cells: DataFrame, widest: int = WIDEST) -> DataFrame:
    """Participant candidates as those of intake.participants(), from rows that may lack cells; a package holds for the rows below it. A row without a
    name, or with a sum's or a header's word in its place, is none. `shifted` tells rows whose cells were moved."""
    found = aligned(intake.rows(cells, intake.PARTICIPANT_HEADERS, ("name",)), widest)
    named = intake.named(found, intake.PARTICIPANT_HEADERS, ("shifted",)).withColumn("_code", intake.carried("package_code")).where(intake.names_participant(F.col("name")))
    price = money.amount(F.col("amount"), F.col("amount_header"))
    how = intake.outcome(F.col("result"), F.col("reason"), price, F.col("qualification"), F.col("compliance"))
    return named.select(*intake.TABLE, "row_no", F.col("_code").alias("package_code"), "name", how.alias("outcome"), F.when(how == "winner", price).alias("amount"), "shifted")
