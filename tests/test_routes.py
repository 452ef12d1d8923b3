"""Choices of routes at their edges."""

from __future__ import annotations

from lotmark.operators import evaluation

SCORES = "k int, route string, status string, field_score double, record_score double, exact_rate double, duplicates long, requests long"


def test_choices(spark):
    rows = [
        (1, "a", "done", 0.5, 0.9, 1.0, 0, 1), (1, "b", "done", 0.6, 0.6, 0.0, 9, 9),  # the lesser score first
        (2, "a", "done", 0.5, 0.7, 0.0, 0, 0), (2, "b", "done", 0.8, 0.5, 0.0, 9, 9),  # then the mean
        (3, "a", "done", 0.5, 0.7, None, 0, 0), (3, "b", "done", 0.7, 0.5, 0.1, 9, 9),  # then the rate
        (4, "a", "done", 0.5, 0.5, 0.5, 2, 0), (4, "b", "done", 0.5, 0.5, 0.5, 1, 9),
        (5, "a", "done", 0.5, 0.5, 0.5, 1, 3), (5, "b", "done", 0.5, 0.5, 0.5, 1, None),
        (6, "a", "done", 0.5, 0.5, 0.5, 1, 0), (6, "b", "done", 0.5, 0.5, 0.5, 1, None),  # the first of the routes
        (7, "a", "done", None, 1.0, 1.0, 0, 0), (7, "b", "done", 0.0, 0.0, 0.0, None, 0),
        (8, "a", "done", 1.0, 1.0, 1.0, 0, 0), (8, "b", "running", 1.0, 1.0, 1.0, 0, 0),
        (9, "a", "done", 1.0, 1.0, 1.0, 0, 0), (10, "z", "done", 1.0, 1.0, 1.0, 0, 0),
        (None, "a", "done", 0.1, 0.1, 0.1, 0, 0), (None, "b", "done", 0.2, 0.2, 0.1, 0, 0), (None, "b", "done", 0.2, 0.2, 0.1, 0, 0),
    ]
    df = spark.createDataFrame(rows, SCORES)
    got = {r.k: (r.status, r.route, r.tie_break) for r in evaluation.chosen_routes(df, "k", ("a", "b")).collect()}
    how = {1: ("b", "quality"), 2: ("b", "quality"), 3: ("b", "quality"), 4: ("b", "duplicates"), 5: ("b", "requests"), 6: ("a", "requests"), 7: ("b", "quality"), None: ("b", "quality")}
    assert got == {k: ("determined", *v) for k, v in how.items()} | {k: ("blocked", None, None) for k in (8, 9)}
    assert {r.status for r in evaluation.chosen_routes(df, "k", ("a", "b"), final=False).collect()} == {"pending"}
    assert evaluation.chosen_routes(df.limit(0), "k", ("a", "b")).count() == 0
