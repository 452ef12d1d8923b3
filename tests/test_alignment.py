"""Rows that lack cells against a search of all alignments."""

from __future__ import annotations

import random
from itertools import combinations

from pyspark.sql import functions as F

from lotmark.operators import alignment, intake

CELL = "path string, table_no int, row_no int, col_no int, text string"


def best(kinds, fields):
    def price(kind, field):
        return 0 if kind == "blank" else alignment.COSTS.get((kind, field), alignment.OTHER if field == "" else alignment.WRONG)

    def total(path):
        left = sum(alignment.EMPTY.get(f, 0) for j, f in enumerate(fields) if j not in path)
        return left + sum(price(k, fields[j]) for k, j in zip(kinds, path, strict=True)), path

    return list(min(map(total, combinations(range(len(fields)), len(kinds))))[1])


def test_least_cost_is_that_of_all_alignments(spark):
    rng = random.Random(7)
    kinds = ["blank", "status", "reason", "number", "amount", "code", "name", "text"]
    fields = ["package_code", "name", "result", "amount", "reason", "", ""]
    rows = []
    for i in range(400):
        wide = rng.randint(1, 7)
        rows.append((i, [rng.choice(kinds) for _ in range(rng.randint(0, wide))], rng.sample(fields, wide)))
    df = spark.createDataFrame(rows, "i int, kinds array<string>, fields array<string>")
    got = df.select("i", alignment.least_cost(F.col("kinds"), F.col("fields")).alias("path")).collect()
    assert len(got) == 400
    for r in got:
        assert r.path == best(*rows[r.i][1:]), rows[r.i]


def test_kinds_of_cells(spark):
    said = {
        "": "blank", None: "blank", " — ": "blank", "是": "status", "未 中标": "status", "综合得分较低": "reason", "12": "number", "1,200.5": "amount", "3万元": "amount", "第2包": "code",
        "甲有限公司": "name", "张三": "text", "包装有限责任公司": "name",
    }
    df = spark.createDataFrame(list(said.items()), "text string, kind string")
    assert [r for r in df.select("*", alignment.cell_kind(F.col("text")).alias("got")).collect() if r.got != r.kind] == []


def cells(*rows):
    return [("p", 1, i, j, text) for i, row in enumerate(rows) for j, text in enumerate(row)]


def test_edges(spark):
    head = ("包号", "供应商名称", "中标结果", "中标金额（元）")
    rows = cells(head, ("包1", "甲公司", "是", "5"), (None, None), ("合计", "7"), ("乙公司", "否"), ("乙公司", "否"), ("包2", "丙公司", None, None, "x"), ("丁公司",))
    df = spark.createDataFrame(rows, CELL).withColumn("width", F.lit(1)).withColumn("shifted", F.lit("clash"))
    got = sorted((r.row_no, r.package_code, r["name"], r.outcome, r.shifted) for r in alignment.participants(df).collect())
    want = [(1, "1", "甲公司", "winner", False), (4, "1", "乙公司", "nonwinner", True), (5, "1", "乙公司", "nonwinner", True), (6, "2", "丙公司", "unknown", False), (7, "2", "丁公司", "unknown", True)]
    assert got == want
    assert alignment.participants(spark.createDataFrame([], CELL)).count() == 0
    kept = alignment.participants(spark.createDataFrame(rows, CELL), widest=3).collect()
    assert not any(r.shifted for r in kept)


def test_full_rows_are_as_before(spark):
    head = ("包号", "供应商名称", "是否中标", "中标金额（万元）")
    df = spark.createDataFrame(cells(head, ("包1", "甲公司", "是", "1.5"), ("1", "乙公司", "否", "")), CELL)
    plain = intake.participants(df)
    assert sorted(alignment.participants(df).drop("shifted").collect()) == sorted(plain.collect())
