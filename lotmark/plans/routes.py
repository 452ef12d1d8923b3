"""Queries of chosen routes, and of numbers as sheets show them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotmark.functions import money
from lotmark.operators import evaluation
from lotmark.plans.base import query
from lotmark.plans.grammars import crossed, values

_SCORES = """SELECT o_custkey, o_orderstatus AS route, CASE WHEN count(*) > 1 THEN 'done' ELSE 'running' END AS status, CASE WHEN max(o_orderkey) % 7 > 0 THEN max(o_orderkey) % 5 / CAST(4 AS DOUBLE) END AS field_score,
  count(*) % 3 / CAST(4 AS DOUBLE) AS record_score, min(o_orderkey) % 3 / CAST(2 AS DOUBLE) AS exact_rate, min(o_orderkey) % 2 AS duplicates, nullif(count(*) % 3, 0) AS requests FROM {} WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey, o_orderstatus"""


@query(
    "a32_routes",
    f"""WITH s AS ({_SCORES.format('orders')}),
q AS (SELECT *, CASE WHEN field_score IS NOT NULL THEN least(field_score, record_score) ELSE -1 END AS a, CASE WHEN field_score IS NOT NULL THEN field_score + record_score ELSE -1 END AS b, CASE WHEN field_score IS NOT NULL THEN exact_rate ELSE -1 END AS c, coalesce(requests, 0) AS r FROM s),
o AS (SELECT *, row_number() OVER w AS place, lead(a) OVER w AS a2, lead(b) OVER w AS b2, lead(c) OVER w AS c2, lead(duplicates) OVER w AS d2, count(*) FILTER (WHERE status = 'done') OVER (PARTITION BY o_custkey) AS done
  FROM q WINDOW w AS (PARTITION BY o_custkey ORDER BY a DESC, b DESC, c DESC, duplicates, r, route DESC))
SELECT o_custkey, CASE WHEN done = 2 THEN 'determined' ELSE 'blocked' END AS status, CASE WHEN done = 2 THEN route END AS route,
  CASE WHEN done = 2 THEN CASE WHEN (a, b, c) <> (a2, b2, c2) THEN 'quality' WHEN duplicates <> d2 THEN 'duplicates' ELSE 'requests' END END AS tie_break FROM o WHERE place = 1""",
)
def routes(m):
    scores = m.spark.sql(_SCORES.format("{orders}"), orders=m.table("orders"))
    return evaluation.chosen_routes(scores, "o_custkey", ("O", "F"))


#: A text with {n} for a number, its form as a quantity, and as a score.
NUMBERS = [
    ("{n}.50", "{n}.5", "{n}.50"), ("{n}", "{n}", "{n}.00"), (" {n}.000 ", "{n}", "{n}.00"), ("{n}.005", "{n}.005", "{n}.01"), ("{n}.0049", "{n}.0049", "{n}.00"), ("{n}.995", "{n}.995", "+1"),
    ("{n} 台", "{n} 台", ""), ("一批", "一批", ""), ("", "", ""), ("  ", "", ""), ("{n}e2", "{n}00", "{n}00.00"), ("NaN", "NaN", ""), ("Infinity", "Infinity", ""),
]
_FILL = "nullif(replace({}, '{{n}}', CAST(n_nationkey + 1 AS VARCHAR)), '')"


@query(
    "f25_sheet_numbers",
    f"SELECT n_nationkey, c0 AS text, {_FILL.format('c1')} AS quantity, CAST(CASE WHEN c2 = '+1' THEN CAST(n_nationkey + 2 AS VARCHAR) ELSE {_FILL.format('c2')} END AS DECIMAL(38,2)) AS score FROM nation, {values(NUMBERS)}",
)
def sheet_numbers(m):
    rows = crossed(m.table("nation").select("n_nationkey"), NUMBERS)
    said = F.replace("case.c0", F.lit("{n}"), (F.col("n_nationkey") + 1).cast("string"))
    return rows.select("n_nationkey", F.col("case.c0").alias("text"), money.shown_quantity(said).alias("quantity"), money.score(said).alias("score"))
