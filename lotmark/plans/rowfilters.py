"""Queries that cross every word that decides whether a table's row counts, and who won, with the rows of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotmark.operators import intake
from lotmark.plans.base import query
from lotmark.plans.grammars import crossed, values


def _labels() -> list[tuple[str, str]]:
    """(label, item or '' for none), {n} for a key."""
    out = [(word, "x" if word in intake.BEFORE_COLON else "") for word in intake.NO_ITEM]
    out += [(f"{word}{colon}{{n}}", "") for word in intake.NO_ITEM for colon in (":", "： ", " ：")] + [(f"{word}用品{{n}}", "x") for word in intake.NO_ITEM]
    out += [(f"{number}{mark}打印机{{n}}", "" if mark in ("、", ")", "）", " 、") else "x") for number in ("一", "十二", "3", "百") for mark in ("、", ")", "）", " 、", "号", ".")]
    out += [(f"{refers}{{n}}号{paper}", "") for refers in intake.REFERS for paper in intake.PAPERS] + [(f"{refers}{{n}}号产品", "x") for refers in intake.REFERS]
    out += [(word, "") for field in ("product_name", "category") for word in intake.ITEM_HEADERS[field]]
    return [*out, ("打印机{n}", "x"), ("附件打印机{n}", "x"), ("标的名称：", ""), ("", "")]


def _names() -> list[tuple[str, str]]:
    out = [(word, "") for word in (*intake.NO_NAME, *intake.PARTICIPANT_HEADERS["name"])] + [(f" {word}：", "") for word in intake.NO_NAME]
    out += [(f"{word}{{n}}公司", "x") for word in intake.NO_NAME if word not in intake.REASONS and not word.startswith(intake.REASONS)]
    out += [(f"甲{{n}}{phrase}", "") for phrase in intake.REASONS]
    return [*out, ("甲{n}公司", "x"), ("", ""), ("/", ""), ("--", ""), ("——", ""), ("详见{n}号文件", ""), ("甲{n}有限公司（联合体）", "x")]


_COUNTED = "SELECT s_suppkey, replace(c0, '{{n}}', CAST(s_suppkey AS VARCHAR)) AS text, c1 <> '' AS counts FROM supplier, {}"


def _judged(m, cases, use):
    rows = crossed(m.table("supplier").select("s_suppkey"), cases)
    rows = rows.select("s_suppkey", F.replace("case.c0", F.lit("{n}"), F.col("s_suppkey").cast("string")).alias("text"))
    return rows.select("s_suppkey", "text", use(F.col("text")).alias("counts"))


@query("p22_item_labels", _COUNTED.format(values(_labels())))
def item_labels(m):
    return _judged(m, _labels(), intake.is_item)


@query("p23_participant_names", _COUNTED.format(values(_names())))
def participant_names(m):
    return _judged(m, _names(), intake.names_participant)


RESULTS = [*((w, "nonwinner") for lost in intake.LOST for w in (lost, f"第二名，{lost}")), *((w, "nonwinner") for w in intake.NO), *((w, "winner") for w in intake.YES), *((w, "winner") for w in ("中标", "成交", "第一名 中标", "成交（包1）")), *((w, "") for w in ("", "中标候选人", "第一成交候选", "第1名", "95.5"))]
REASONS = [*((r, "") for r in ("", "-", "/", "：", *intake.NO_REASON)), ("报价偏高", "nonwinner"), ("无效投标", "nonwinner")]
REVIEWS = [*((r, "") for r in ("", "通过", "合格")), *((f"{r}{end}", "nonwinner") for r in intake.FAILED for end in ("", "（缺材料）"))]


@query(
    "p24_crossed_outcomes",
    f"""SELECT s_suppkey, r.c0 AS result, w.c0 AS reason, v.c0 AS review, amount, coalesce(nullif(w.c1, ''), nullif(r.c1, ''), nullif(v.c1, ''), CASE WHEN amount IS NOT NULL THEN 'winner' ELSE 'unknown' END) AS outcome
FROM (SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN CAST(s_acctbal AS DECIMAL(18,2)) END AS amount FROM supplier), {values(RESULTS).replace(' AS k', ' AS r')}, {values(REASONS).replace(' AS k', ' AS w')}, {values(REVIEWS).replace(' AS k', ' AS v')}""",
)
def crossed_outcomes(m):
    """Every result with every reason, every review, and an amount or none."""
    rows = m.table("supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal").cast("decimal(18,2)")).alias("amount"))
    # a row becomes thousands, so that few bytes of rows are work for every core
    rows = rows.repartition(m.spark.sparkContext.defaultParallelism, "s_suppkey")
    for name, cases in (("result", RESULTS), ("reason", REASONS), ("review", REVIEWS)):
        rows = crossed(rows, cases).withColumn(name, F.col("case.c0")).drop("case")
    how = intake.outcome(F.col("result"), F.col("reason"), F.col("amount"), F.lit(None).cast("string"), F.col("review"))
    return rows.select("s_suppkey", "result", "reason", "review", "amount", how.alias("outcome"))
