"""Steps whose data outgrow one file, one pass or one call."""

from __future__ import annotations


from lotmark import registry
from lotmark.operators import dedup, evaluation, linking, snapshots
from lotmark.plans import patterns
from lotmark.plans.details import office_file
from lotmark.sources import documents


def test_a_task_that_writes_several_arrays(same_as_sql, monkeypatch):
    monkeypatch.setattr(patterns, "ELEMENTS", 20)
    assert same_as_sql(registry.QUERIES["s19_array_elements"], registry.ORACLE["s19_array_elements"]) > 20


def test_differences_store_nothing_and_shuffle_texts_only(spark, small, tmp_path, monkeypatch):
    """Leaves that are stored or shuffled outgrow a disk: some thirty times the bytes of their lines."""
    monkeypatch.setattr(snapshots, "checkpoint", None, raising=False)
    rows = [(1, '{"a": {"b": {"c": {"d": {"e": [1, {"f": 2}]}}}}, "x_json": "{\\"k\\": [[[1]]]}"}', '{"a": {"b": {"c": {"d": {"e": [1, {"f": 3}]}}}}, "x_json": "{\\"k\\": [[[1.0, 2]]]}"}'), (None, "1", "1")]
    both = spark.createDataFrame(rows, "id long, old string, new string")
    sides = (both.select("id", F.col(c).alias("j")) for c in ("old", "new"))
    found = snapshots.differences(*sides, ["id"], "j", 3)
    assert sorted(found.collect(), key=str) == [(1, "$.a.b.c.d.e[1].f", "changed", "2", "3"), (1, "$.x_json.k[0][0][1]", "added", None, "2"), (None, "$", "added", None, "1"), (None, "$", "removed", "1", None)]
    assert found.select("path").distinct()._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1


def test_scopes_of_any_size_are_aligned_alike(spark, monkeypatch):
    """Scopes that a task can hold need no rounds of joins over all rows, and those beyond give the same weights."""
    rows = [(s, n, (n * 7 + s) % 4, (n * 5 + s) % 3 if n % 5 else None) for s in range(4) for n in range(5 + 6 * s)]
    gold = spark.createDataFrame(rows, "scope long, no long, a long, b long")
    predicted = spark.createDataFrame([(s, n, (a + n % 2) % 4, b) for s, n, a, b in rows], gold.schema)
    rounds = []
    monkeypatch.setattr(evaluation, "components", lambda edges, run=evaluation.components: rounds.append(1) or run(edges))
    per = lambda df: sorted(df.groupBy("scope").agg({"weight": "sum", "*": "count"}).collect())
    whole = per(evaluation.align(gold, predicted, "scope", ["a", "b"]))
    assert not rounds
    monkeypatch.setattr(evaluation, "SCOPE_ROWS", 3)
    assert [r["sum(weight)"] for r in per(evaluation.align(gold, predicted, "scope", ["a", "b"]))] == [r["sum(weight)"] for r in whole] and rounds


def test_components_within_scopes_of_any_size(spark, monkeypatch):
    """Edges of small scopes need no rounds of joins; larger ones have the same components."""
    edges = spark.createDataFrame([(s, 100 * s + n, 100 * s + n + step) for s in range(4) for n in range(3 + 5 * s) for step in (2, 4)], "s long, a long, b long")
    rounds = []
    monkeypatch.setattr(linking, "components", lambda some, run=linking.components: rounds.append(1) or run(some))
    expected = {(100 * s + n, 100 * s + n % 2) for s in range(4) for n in range(2, 3 + 5 * s + 4) if n < 3 + 5 * s + 2 or (n - 4) < 3 + 5 * s}
    assert {tuple(r) for r in linking.components_within(edges, "s").collect()} == expected and not rounds
    monkeypatch.setattr(linking, "SCOPE_EDGES", 12)
    assert {tuple(r) for r in linking.components_within(edges, "s").collect()} == expected and rounds


def test_crossed_outcomes_are_work_for_every_core(spark, small):
    """A small file of suppliers is one task, and each row becomes thousands."""
    assert registry.QUERIES["p24_crossed_outcomes"](spark, small).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_documents_are_opened_once_for_all_formats(spark):
    """Each format's reader would make and open all files again."""
    table = [["a", "b"], ["c  d", "e"]]
    made = [("a.docx", office_file("docx", table)), ("b.xlsx", office_file("xlsx", table)), ("c.txt", b"head\na\tb\r\nc \xc2\xa0d\te\nend"), ("d.html", b"<table><tr><td>a<td>b<tr><td>c<br>d<td>e</table>"), ("e.txt", b"no table"), ("f.docx", office_file("docx", []))]
    leaves = documents.expand(spark.createDataFrame([(path, bytearray(body)) for path, body in made], "path string, content binary"))
    cells, _ = documents.dispatched(leaves)
    assert cells._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 2
    base = {"a.docx": 0, "b.xlsx": 0, "c.txt": 1, "d.html": 0}
    assert sorted(map(tuple, cells.collect())) == sorted((path, 0, r + n, c, text) for path, r in base.items() for n, row in enumerate([["a", "b"], ["c d", "e"]]) for c, text in enumerate(row))


def test_merging_files_shuffles_rows_by_numbers(spark, small, monkeypatch):
    """Edges stay in their notice, so components need no rounds of joins over all of them, and rows meet their class by two numbers."""
    monkeypatch.setattr(dedup, "components", None)
    monkeypatch.setattr(dedup, "checkpoint", None)
    plan = registry.QUERIES["j22_merged_items"](spark, small)._jdf.queryExecution().executedPlan().toString()
    keys = [part.split("), ")[0] for part in plan.split("hashpartitioning(")[1:]]
    assert not [k for k in keys if "name#" in k]
