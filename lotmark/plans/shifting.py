"""Queries of rows that lack cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotmark.operators import alignment
from lotmark.plans.base import query

HEADER = ("包号", "供应商名称", "是否中标", "中标金额（万元）", "未中标原因")
#: Rows with {n} for a part's key and {s} for its size, and what they say: name, outcome, amount in yuan, shifted. The package is that of the first row.
ROWS = (
    (("包{s}", "甲{n}公司", "是", "1.5", ""), ("甲{n}公司", "winner", 15000, False)),
    (("乙{n}公司", "是", "2.5"), ("乙{n}公司", "winner", 25000, True)),
    (("丙{n}公司", "3.25"), ("丙{n}公司", "winner", 32500, True)),
    (("丁{n}公司", "否", "报价偏高"), ("丁{n}公司", "nonwinner", None, True)),
    (("戊{n}公司", "综合得分较低"), ("戊{n}公司", "nonwinner", None, True)),
    (("包{s}", "己{n}公司", "得分较低"), ("己{n}公司", "nonwinner", None, True)),
    (("庚{n}公司",), ("庚{n}公司", "unknown", None, True)),
    (("包{s}", "辛{n}公司", "4.5"), ("辛{n}公司", "winner", 45000, True)),
    (("包{s}", "壬{n}公司", "否"), ("壬{n}公司", "nonwinner", None, False)),
    (("供应商{n}", "否"), ("供应商{n}", "nonwinner", None, True)),
)


def _filled(text: str):
    return F.replace(F.replace(F.lit(text), F.lit("{n}"), F.col("p_partkey").cast("string")), F.lit("{s}"), F.col("p_size").cast("string"))


def _cells(m):
    rows = [F.array(*map(_filled, row)) for row in (HEADER, *(row for row, _ in ROWS))]
    each = m.table("part").select(F.col("p_partkey").cast("string").alias("path"), F.posexplode(F.array(*rows)).alias("row_no", "row"))
    return each.select("path", F.lit(0).alias("table_no"), "row_no", F.posexplode("row").alias("col_no", "text"))


def _sql() -> str:
    said = [
        f"SELECT CAST(p_partkey AS VARCHAR) AS path, {i} AS row_no, CAST(p_size AS VARCHAR) AS package_code, replace('{name}', '{{n}}', CAST(p_partkey AS VARCHAR)) AS name, '{outcome}' AS outcome, CAST({'NULL' if amount is None else amount} AS DECIMAL(38,2)) AS amount, {str(shifted).lower()} AS shifted FROM part"
        for i, (_, (name, outcome, amount, shifted)) in enumerate(ROWS, 1)
    ]
    return "\nUNION ALL ".join(said)


@query("f34_shifted_rows", _sql())
def shifted_rows(m):
    found = alignment.participants(_cells(m))
    return found.select("path", "row_no", "package_code", "name", "outcome", F.col("amount").cast("decimal(38,2)").alias("amount"), "shifted")
