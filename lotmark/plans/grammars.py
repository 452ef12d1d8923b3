"""Queries that cross every alternative of a grammar of labels, headings or questions with the rows of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotmark.functions import codes
from lotmark.operators import intents, metadata, scopes
from lotmark.plans.base import query


def crossed(rows: DataFrame, cases: list[tuple]) -> DataFrame:
    """rows with every case as a column of its own, `case`, a struct of texts c0, c1, ..."""
    made = [F.struct(*[F.lit(v).alias(f"c{i}") for i, v in enumerate(case)]) for case in cases]
    return rows.withColumn("case", F.explode(F.array(*made)))


def values(cases: list[tuple]) -> str:
    """The cases as a table for SQL, columns c0, c1, ..."""
    text = lambda v: "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(text, case)) + ')' for case in cases)}) AS k({', '.join(f'c{i}' for i in range(len(cases[0])))})"


def _labels() -> list[tuple[str, str]]:
    """(label, code), {n} for a number: every lot word before and behind a number, with and without ordinal, number word and
    colon; every name label with and without colon."""
    out = []
    for word in (*codes.BEFORE, "标段", "标包"):
        for number in ("", "号", "编号"):
            for colon in ("", ":", "： "):
                out += [(f"{lead}{word}{number}{colon}{{n}}", "{n}" if word in codes.BEFORE else f"{lead}{word}{number}{colon.strip().replace('：', ':')}{' ' if colon == '： ' else ''}{{n}}") for lead in ("", "第")]
    for word in (*codes.BEHIND, "段"):
        out += [(f"{{n}}{number}{word}", "{n}" if word in codes.BEHIND else f"{{n}}{number}{word}") for number in ("", "号", " 号 ")]
        out += [(f"第{{n}}{word}", "{n}" if word == "包" else f"第{{n}}{word}")]
    for word in codes.NAMES:
        out += [(f"{word}:{{n}}", "{n}"), (f"{word}：仪器{{n}}", "仪器{n}"), (f"{word}：第{{n}}标段", "{n}" if word != "包名" else "{n}"), (f"{word}{{n}}", "{n}" if word == "包名" else f"{word}{{n}}"), (f"{word}：详见附件", "default"), (f"{word}:", "default")]
    out += [(f"（{word}）", "default") for word in (*codes.EMPTY, *codes.NO_CODE, "附件", "见附件", "详见招标文件", "见采购文件", "详见文件", "")]
    return [*out, ("政采(2)2026-{n}", "{n}"), ("政采(x)a_b/{n}", "{n}"), ("政采2026-{n}", "政采2026-{n}"), ("政采(2) 2026-{n}", "政采(2) 2026-{n}"), ("K-{n}", "K-{n}")]


@query("f11_crossed_labels", f"SELECT s_suppkey, c0 AS label, replace(c1, '{{n}}', CAST(s_suppkey + 1 AS VARCHAR)) AS code FROM supplier, {values(_labels())}")
def crossed_labels(m):
    rows = crossed(m.table("supplier").select("s_suppkey"), _labels())
    label = F.replace("case.c0", F.lit("{n}"), (F.col("s_suppkey") + 1).cast("string"))
    return rows.select("s_suppkey", F.col("case.c0").alias("label"), codes.package_code(label).alias("code"))


def _headings() -> list[tuple[str, str, str, str]]:
    """(line before the text, purpose, file name, scope): every title behind every kind of numbering, within prose, and with hints of a name."""
    scope = {"history": "historical_qualification", "current": "current_procurement", "evaluation": "current_evaluation"}
    out = []
    for purpose in scopes.MAKES:
        for title in scopes.titles(purpose):
            out += [(f"{lead}{title}", purpose, "a.txt", scope[purpose]) for lead in ("", "附件3：", "[page:2/ocr] 第一章 ")]
            other = "unknown" if title.endswith(scopes.SECTION_ENDS) else ""  # a title of something else
            out += [(f"应提供{title}", "current" if purpose == "current" else other, "a.txt", "current_procurement" if purpose == "current" else "unknown")]
    out += [("供应商类似项目业绩表", "history", "招标文件.txt", "mixed"), ("合同签订日期", "", "业绩.txt", "historical_qualification"), ("日期", "", "业绩.txt", "unknown"), ("营业执照", "", "a.txt", "historical_qualification"), ("附件2：资质证书", "", "a.txt", "historical_qualification")]
    return [*out, ("技术参数", "unknown", "a.txt", "unknown"), ("技术参数及要求", "", "a.txt", "unknown"), ("名称 品牌 数量", "current", "a.txt", "current_procurement"), ("名称 数量 单价", "", "a.txt", "unknown")]


@query("p26_crossed_headings", f"SELECT r_regionkey, c0 AS line, c1 AS purpose, c3 AS scope FROM region, {values(_headings())}")
def crossed_headings(m):
    """The first heading and the scope of a paper for every title, numbering and hint, with a region's name as its prose."""
    rows = crossed(m.table("region").select("r_regionkey", "r_name"), _headings())
    papers = rows.select("r_regionkey", "case", F.concat(F.lit("招标文件.zip!/"), "r_regionkey", F.lit("/"), F.md5("case.c0"), F.lit("/"), "case.c2").alias("path"), F.concat("case.c0", F.lit("\n"), F.lower("r_name")).alias("text"))
    first = scopes.headings(papers.select("path", "text")).groupBy("path").agg(F.min_by("purpose", "offset").alias("purpose"))
    out = papers.join(first, "path", "left").join(scopes.classified(papers.select("path", "text")).select("path", "scope"), "path")
    return out.select("r_regionkey", F.col("case.c0").alias("line"), F.coalesce("purpose", F.lit("")).alias("purpose"), "scope")


def _questions() -> list[tuple[str, str]]:
    """(question, y or n): every statement, word and name as it counts, and as a word like others."""
    out = [("Select name from {x}", "y"), ("select\n*\nfrom {x}", "y"), ("please select {x}", "n"), ("match ({x})", "y"), ("MATCH({x})", "y"), ("which bids match {x}", "n"), ("cypher {x}", "y"), ("{x} sql?", "y"), ("{x} sqlite", "n"), ("写入 {x}", "y"), ("{x}，写入", "y"), ("请写入 {x}", "n")]
    out += [(f"{word} {{x}}", "y") for word in ("create", "DELETE", "drop", "Update", "merge", "insert")]
    out += [(f"{{x}} {word}", "n") for word in ("create", "delete", "drop", "update", "merge", "insert", "created", "select", "match")]
    return [*out, *[(f"请{word} {{x}}", "y") for word in ("删除", "修改", "执行命令")], ("{x}的供应商有哪些？", "n")]


@query("p29_crossed_questions", f"SELECT n_nationkey, c0 AS question, c1 = 'y' AS suspicious FROM nation, {values(_questions())}")
def crossed_questions(m):
    rows = crossed(m.table("nation").select("n_nationkey", "n_name"), _questions())
    asked = F.replace("case.c0", F.lit("{x}"), F.lower("n_name"))
    return rows.select("n_nationkey", F.col("case.c0").alias("question"), intents.suspicious(asked).alias("suspicious"))


def _papers() -> list[tuple[str, str, str, str]]:
    """(text, field, value, status): every label in a cell, in a line, and without a value; values of every kind."""
    out = []
    for field, words in metadata.LABELS.items():
        amount = field in metadata.AMOUNTS
        for word in words:
            good, want = ("1.5万元", "15000") if amount else ("名 {x}", "名 {x}")
            out += [(f"序号\t1\t{word}\t{good}", field, want, "present"), (f"x {word}： {good}；另", field, want, "present"), (f"{word}：", field, "", "blank_in_source"), (f"{word}：未公示。", field, "", "explicitly_not_published")]
            out += [(f"{word}：详见采购文件", field, "", "unverified"), (f"{word}\t\n{word}：{good} 一、其他", field, want, "present"), (f"{word}：\n{word}：未公开", field, "", "explicitly_not_published"), (f"{word}\t项目名称\t{word}：\t{good}", field, want, "present"), (f"{word} {good}", field, "", "unknown")]
            if amount:
                out += [(f"{word}：约10元", field, "", "unverified"), (f"{word}（万元）：1.5 乙方：2", field, "", "unknown"), (f"{word}（万元）\t2.5", field, "25000", "present"), (f"{word}\t￥1,000.50", field, "1000.5", "present")]
            else:
                out += [(f"{word}：{'长' * 161}", field, "", "unverified"), (f"{word}：甲(1)乙 采购人：丙", field, "甲(1)乙", "present") if field != "procurement_unit" else (f"{word}：甲 项目编号：丙", field, "甲", "present")]
    return [*out, ("项目编号：A(1)的公告", "project_number", "A(1", "present"), ("项目编号：A(1)的合同", "project_number", "A(1)的合同", "present"), ("项目编号：" + "1" * 121, "project_number", "", "unverified")]


@query("f32_crossed_metadata", f"SELECT r_regionkey, c0 AS text, replace(c2, '{{x}}', lower(r_name)) AS value, c3 AS status FROM region, {values(_papers())}")
def crossed_metadata(m):
    """The field that each paper is about, for every label and kind of value."""
    rows = crossed(m.table("region").select("r_regionkey", "r_name"), _papers())
    docs = rows.select("r_regionkey", "case", F.concat_ws("/", "r_regionkey", F.md5("case.c0"), "case.c1").alias("path"), F.replace("case.c0", F.lit("{x}"), F.lower("r_name")).alias("text"))
    found = metadata.facts(docs.select("path", "text")).join(docs, "path").where(F.col("field") == F.col("case.c1"))
    return found.select("r_regionkey", F.col("case.c0").alias("text"), F.coalesce("value", F.lit("")).alias("value"), "status")
