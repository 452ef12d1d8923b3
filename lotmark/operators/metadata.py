"""What a notice's text says of itself under labels: cells of tables first, then labelled lines, with a status and the line as evidence.

Every place where a label stands is a candidate of its own; a field's value is its first candidate that can be read,
and what the others are tells its status where there is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotmark.functions import money
from lotmark.functions.text import collapse, half_width, header_key

#: Labels by field, fields that are amounts, values that say that there is none, and how a reference begins and what it is to.
LABELS = {
    "project_name": ("采购项目名称", "项目名称"),
    "project_number": ("采购项目编号", "项目编号", "采购计划编号"),
    "procurement_unit": ("采购单位名称", "采购单位", "采购人名称", "采购人", "采购机构"),
    "project_budget": ("采购预算金额", "采购预算", "预算金额", "项目预算金额", "项目预算"),
    "announced_total_award": ("总中标金额", "总成交金额", "总中标/成交金额", "中标（成交）金额", "中标/成交金额", "中标金额", "成交金额", "项目成交金额"),
}
AMOUNTS = ("project_budget", "announced_total_award")
UNPUBLISHED = ("未公示", "未公布", "未披露", "未提供", "不予公示", "信息未公开", "未公开")
REFERENCE = ("详见", "见", "具体见", "以"), ("附件", "文件", "清单", "响应", "为准")
#: Characters of a number or another value at most; what ends a value in a line: a tab or stop, another label, the number of a section.
LONGEST_NUMBER, LONGEST = 120, 160
ENDS = ("[\\t；;。]", "\\s+[\\u4e00-\\u9fff]{2,16}\\s*[：:]", "\\s*[一二三四五六七八九十]+\\s*[、）)]", "\\s+[0-9]+\\s*[、）)]")
OPEN, SHUT = "\u0001", "\u0002"


def _words(labels: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    return sorted(((word, field) for field, words in labels.items() for word in words), key=lambda x: (-len(x[0]), x[0]))


def candidates(docs: DataFrame, labels: dict[str, tuple[str, ...]] = LABELS) -> DataFrame:
    """(path, field, place, line_no, line, label, raw) of documents (path, text): place orders them, cells before lines. A cell is the
    value of the label in the cell before it, two by two, unless it is a label itself; a labelled value goes up to the next label or
    to what ends it."""
    lines = docs.select("path", F.posexplode(F.split("text", "\\r\\n|[\\n\\r]")).alias("n", "line"))
    words = _words(labels)
    keys = F.map_from_entries(F.array_distinct(F.array(*[F.struct(header_key(F.lit(word)), F.lit(field)) for word, field in words])))
    cells = F.split(F.regexp_replace("line", " +$", ""), "\\t", -1)
    pair = lambda i: F.struct((2 * i).alias("nth"), F.get(F.col("cells"), 2 * i).alias("label"), F.get(F.col("cells"), 2 * i + 1).alias("raw"))
    of = lambda label: F.try_element_at(F.col("keys"), header_key(label))
    tabbed = lines.where(F.col("line").contains("\t")).withColumn("cells", cells).where(F.size("cells") > 1).withColumn("keys", keys)
    tabbed = tabbed.select("path", "n", "line", "keys", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("cells") / 2).cast("int") - 1), pair)).alias("c"))
    tabbed = tabbed.where(of(F.col("c.label")).isNotNull() & of(F.col("c.raw")).isNull()).select("path", "n", "line", F.lit(0).alias("kind"), "c.nth", of(F.col("c.label")).alias("field"), "c.label", "c.raw")
    marked = F.regexp_replace("line", f"({'|'.join(word.replace('/', '[/]') for word, _ in words)})\\s*[：:]\\s*", f"{OPEN}$1{SHUT}")
    exact = F.create_map(*[F.lit(x) for pair in words for x in pair])
    said = lines.where(F.col("line").rlike("[：:]")).select("path", "n", "line", F.posexplode(F.split(marked, OPEN, -1)).alias("nth", "part")).where("nth > 0")
    label, rest = F.substring_index("part", SHUT, 1), F.substr("part", F.instr("part", F.lit(SHUT)) + 1)
    said = said.select("path", "n", "line", F.lit(1).alias("kind"), "nth", exact[label].alias("field"), label.alias("label"), F.split(rest, "|".join(ENDS), 2)[0].alias("raw"))
    return tabbed.unionByName(said).select("path", "field", F.struct("kind", "n", "nth").alias("place"), (F.col("n") + 1).cast("long").alias("line_no"), "line", "label", "raw")


def _read(field: Column, value: Column, label: Column) -> Column:
    """A value in its field's form, as text; null if it has none."""
    cut = F.split(value, "[）)](?=.*(?:公告|采购项目))", 2)[0]
    number = F.when(F.length(cut) <= LONGEST_NUMBER, cut)
    return F.when(field.isin(*AMOUNTS), money.canonical(money.amount(value, label))).when(field == "project_number", number).otherwise(F.when(F.length(value) <= LONGEST, value))


def facts(docs: DataFrame, labels: dict[str, tuple[str, ...]] = LABELS) -> DataFrame:
    """(path, field, value, status, line_no, evidence): a row for every field of every document (path, text), paths being unique.

    status: present; explicitly_not_published, if a candidate says so; else that of the first candidate, blank_in_source or unverified (a
    reference to another paper, or nothing that can be read); unknown without one, as for null and empty texts. line_no and
    evidence are those of the value, of the last that says that it isn't published, or of the first candidate.
    """
    found = candidates(docs, labels)
    value = F.regexp_replace(collapse(F.col("raw")), "^[ ：:，,。]+|[ ：:，,。]+$", "")
    hidden = F.regexp_replace(half_width(value), "[\\s：:，,。；;、]+", "").isin(*UNPUBLISHED)
    refers = value.rlike(f"^(?:{'|'.join(REFERENCE[0])}).*(?:{'|'.join(REFERENCE[1])})")
    judged = found.withColumn("text", value)
    read = F.when(~refers & ~hidden, _read(F.col("field"), F.col("text"), F.col("label")))
    state = F.when(F.col("text") == "", "blank_in_source").when(hidden, "explicitly_not_published").when(F.col("read").isNotNull(), "present").otherwise("unverified")
    judged = judged.withColumn("read", F.when(F.col("text") != "", read)).withColumn("state", state)
    one = F.struct("read", "state", "line_no", "line")
    pick = lambda by, when: by(F.when(when, one), F.when(when, F.col("place")))
    per = judged.groupBy("path", "field").agg(
        pick(F.min_by, F.col("state") == "present").alias("good"),
        pick(F.max_by, F.col("state") == "explicitly_not_published").alias("hidden"),
        F.min_by(one, "place").alias("first"),
    )
    every = docs.select("path", F.explode(F.array(*[F.lit(f) for f in labels])).alias("field"))
    out = every.join(per, ["path", "field"], "left").withColumn("one", F.coalesce("good", "hidden", "first"))
    line = F.regexp_replace("one.line", "\\r+$", "")
    return out.select("path", "field", F.col("one.read").alias("value"), F.coalesce("one.state", F.lit("unknown")).alias("status"), F.col("one.line_no").alias("line_no"), line.alias("evidence"))
