"""Exact amounts: decimals all the way, never doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotmark.functions.text import compact, half_width

EXACT = "decimal(38,6)"
#: Units of money and what they multiply by.
UNITS = {"亿元": 100_000_000, "万元": 10_000, "元": 1}


def exact(c: Column) -> Column:
    """A decimal from text; null where it isn't one."""
    return c.try_cast(EXACT)


def exact_sum(c: Column) -> Column:
    """Aggregate: the sum of disclosed amounts in text. Null and '' are not disclosed; all undisclosed gives null.
    What isn't a number counts as disclosed and adds nothing."""
    disclosed = F.count(F.nullif(c, F.lit("")))
    return F.when(disclosed > 0, F.coalesce(F.sum(exact(c)), F.lit(0).cast(EXACT)))


def first_decimal(c: Column) -> Column:
    """The first number in a text, thousands separators left out."""
    return exact(F.nullif(F.regexp_extract(F.regexp_replace(c, "[,，]", ""), "(-?[0-9]+(?:\\.[0-9]+)?)", 1), F.lit("")))


def quantity(c: Column) -> tuple[Column, Column]:
    """The leading quantity of a cell and the unit behind it."""
    pattern = "(-?[0-9]+(?:[,.，][0-9]+)*)\\s*(.*)"
    number = exact(F.nullif(F.regexp_replace(F.regexp_extract(c, pattern, 1), "[,，]", ""), F.lit("")))
    return number, F.nullif(F.trim(F.regexp_extract(c, pattern, 2)), F.lit(""))


def amount(cell: Column, header: Column | None = None) -> Column:
    """One amount of money in yuan; the unit is the cell's, else the header's, else yuan. Null for anything else."""
    text = F.regexp_replace(half_width(cell), "(?U)[\\s,¥￥()]|人民币", "")
    pattern = "^(-?[0-9]+(?:\\.[0-9]+)?)(亿元|万元|元)?$"
    unit = F.regexp_extract(text, pattern, 2)
    head = F.coalesce(header, F.lit("")) if header is not None else F.lit("")
    scale = F.when(unit == "亿元", UNITS["亿元"]).when(unit == "万元", UNITS["万元"]).when(unit == "元", 1)
    scale = scale.when(F.contains(head, F.lit("亿元")), UNITS["亿元"]).when(F.contains(head, F.lit("万元")), UNITS["万元"]).otherwise(1)
    return (exact(F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))) * scale).cast(EXACT)


#: A currency, a number with or without thousands separators and exponent, a scale, 元 and a currency; all but the number may lack.
_MARK = "(?:人民币|CNY|RMB|¥)?"
NUMBER = "([+-]?(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:[.][0-9]+)?(?:[eE][+-]?[0-9]+)?)"
MONETARY = f"(?i)^{_MARK}{NUMBER}([万亿]?)元?{_MARK}$"


def number(c: Column, monetary: bool = False) -> Column:
    """A strict number: well-formed grouping, an exponent; for money a currency before or after it and 万 or 亿."""
    text, pattern = compact(half_width(c)), MONETARY if monetary else f"^{NUMBER}$"
    value = exact(F.nullif(F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit("")), F.lit("")))
    if not monetary:
        return value
    scales = F.create_map(*[F.lit(x) for unit in ("万元", "亿元") for x in (unit[0], UNITS[unit])])
    scale = F.coalesce(F.element_at(scales, F.nullif(F.regexp_extract(text, pattern, 2), F.lit(""))), F.lit(1))
    return (value * scale).cast(EXACT)


def strict(c: Column) -> Column:
    """A whole cell that is a decimal, thousands separators and white space left out; null for anything else."""
    text = F.replace(compact(half_width(c)), F.lit(","), F.lit(""))
    return F.when(text.rlike("^-?[0-9]+(?:[.][0-9]+)?$"), exact(text))


def unit(c: Column) -> Column:
    """The unit of money that a text names first; null without one."""
    return F.nullif(F.regexp_extract(c, "(亿元|万元|元)", 1), F.lit(""))


def table_unit(header: Column, context: Column) -> Column:
    """The unit of a column: its header's, else that of the text around the table if it says `单位` and names just one."""
    said = F.array_distinct(F.regexp_extract_all(compact(half_width(F.coalesce(context, F.lit("")))), F.lit("单位:?(?:人民币)?(亿元|万元|元)"), F.lit(1)))
    return F.coalesce(unit(header), F.when(F.size(said) == 1, said[0]))


def stored(c: Column, scale: str = "元") -> Column:
    """A typed-in amount as it is stored, in yuan; blank is null."""
    return (exact(F.nullif(F.trim(c), F.lit(""))) * UNITS[scale]).cast(EXACT)


def shown(c: Column, places: int = 2) -> Column:
    """An amount for display: grouped thousands, rounded half up, a dash for none."""
    return F.coalesce(F.format_number(F.round(c.cast(EXACT), places), places), F.lit("—"))


def canonical(c: Column) -> Column:
    """A decimal as text without an exponent and without zeros at the end."""
    text = c.cast("string")
    return F.regexp_replace(F.regexp_replace(text, "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")


def ten_thousands(c: Column, places: int | None = 2) -> Column:
    """Yuan as 万元, rounded half up; places None keeps all digits."""
    out = c.cast(EXACT) / F.lit(10_000).cast("decimal(5,0)")
    return out.cast("decimal(38,10)") if places is None else F.round(out, places).cast(f"decimal(38,{places})")


def equal(a: Column, b: Column, absolute: str = "0.01", relative: str = "0", whole: bool = False) -> Column:
    """Amounts equal within a tolerance, or, with `whole`, in their integer parts; null equals null alone."""
    if whole:
        near = F.when(a >= 0, F.floor(a)).otherwise(F.ceil(a)) == F.when(b >= 0, F.floor(b)).otherwise(F.ceil(b))
    else:
        most = F.greatest(F.lit(absolute).cast(EXACT), (F.lit(relative).cast("decimal(10,6)") * F.greatest(F.abs(a), F.abs(b))).cast(EXACT))
        near = F.abs(a - b) <= most
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(near)


def shown_quantity(c: Column) -> Column:
    """A quantity for a sheet: a number without zeros at its end, any other text as it stands; blank is null."""
    text = F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(canonical(text.try_cast("decimal(38,10)")), text)


def score(c: Column) -> Column:
    """A score with two decimals, rounded half up; null for what is no number."""
    return F.round(F.trim(c).try_cast("decimal(38,10)"), 2).cast("decimal(38,2)")
