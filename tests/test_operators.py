"""Operators on small frames whose results are worked out by hand or by brute force."""

from __future__ import annotations

import io
import itertools
import zipfile
from datetime import date
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotmark.operators import clues, evaluation, intake, records, scenes, versions
from lotmark.sources import catalog, documents
from lotmark.streaming import jobs

BIDS = "project_id long, buyer_id long, created_at date, package_id long, package_code string, organization_id long, outcome string, award_amount decimal(38,2)"
D = date(2024, 1, 1)
BIG = Decimal("9007199254740993.01")
ROWS = [
    (1, 10, D, 11, "1", 1, "winner", Decimal("0.10")),
    (1, 10, D, 11, "1", 2, "winner", Decimal("0.10")),
    (1, 10, D, 11, "1", 3, "unknown", None),
    (1, 10, D, 12, "2", 1, "winner", BIG),
    (1, 10, D, 12, "2", 3, "nonwinner", None),
    (2, 10, D, 21, "default", 1, "winner", None),
    (2, 10, D, 21, "default", 2, "nonwinner", None),
    (3, 20, D, 31, "1", 2, "winner", Decimal("5.00")),
    (3, 20, D, 31, "1", 3, "nonwinner", None),
    (3, None, D, 32, "2", 3, "winner", None),
]


@pytest.fixture(scope="module")
def bids(spark):
    return spark.createDataFrame(ROWS, BIDS)


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (10, "buyer"), (20, "other")], "id long, name string")


def test_money_is_exact_and_summed_per_award(spark, bids, names):
    items = spark.createDataFrame([(11, " x "), (11, "y"), (12, ""), (12, None), (21, "y")], "package_id long, brand string")
    out = {(r.buyer_id, r.organization_id): r for r in scenes.buyer_awardees(bids, items, names).collect()}
    one = out[10, 1]
    assert (one.projects, one.packages, one.award_total, one.brands) == (2, 3, BIG + Decimal("0.10"), " x ,y")
    assert out[10, 2].award_total == Decimal("0.10") and out[20, 2].award_total == 5


def test_bidders_ties_and_losers(bids, names):
    got = [(r.organization_id, r.projects, r.place) for r in scenes.buyer_bidders(bids, names).where("buyer_id = 10").orderBy("place").collect()]
    assert got == [(2, 2, 1), (1, 2, 2), (3, 1, 3)]
    lost = [(r.organization_id, r.projects) for r in scenes.buyer_bidders(bids, names, include_winners=False).where("buyer_id = 10").orderBy("place").collect()]
    assert lost == [(2, 1), (3, 1)]
    with pytest.raises(ValueError):
        scenes.buyer_bidders(bids, names, k=0)


def test_pairs_need_one_package(bids):
    got = {(r.left_id, r.right_id): (r.projects, r.packages) for r in clues.common_bidding(bids).collect()}
    assert got == {(1, 2): (2, 2), (1, 3): (1, 2), (2, 3): (2, 2)}
    assert [r.clue_id for r in clues.repeat_cooperation(bids).collect()] == ["repeat-cooperation:1-2", "repeat-cooperation:2-3"]


def test_common_buyers_and_packages(bids):
    got = {(r.buyer_id, r.organization_id): (r.projects, r.packages, r.award_total) for r in scenes.common_buyers(bids, [1, 2]).collect()}
    assert got == {(10, 1): (2, 3, BIG + Decimal("0.10")), (10, 2): (1, 1, Decimal("0.10")), (10, None): (2, 4, BIG + Decimal("0.20"))}
    rows = {(r.level, r.project_id, r.package_id): (r.packages, r.awards, r.award_total) for r in scenes.common_packages(bids, [1, 3]).collect()}
    assert rows[("package", 1, 11)] == (1, 2, Decimal("0.20")) and rows[("all", None, None)] == (2, 3, BIG + Decimal("0.20"))
    assert scenes.common_packages(bids, [1, 99]).collect() == []


def test_network_skips_projects_without_buyer(bids):
    got = {(r.buyer_id, r.organization_id): r for r in clues.buyer_network(bids, include_winners=False).collect()}
    assert (20, 3) in got and all(b is not None for b, _ in got)
    assert (got[10, 1].participation_projects, got[10, 1].award_projects) == (0, 2)


def test_filter_on_the_key_reaches_the_scan(spark, small):
    from lotmark.sources.tables import Model

    m = Model(spark, small)
    plan = scenes.co_bidders(m.bids).where("supplier_id = 7")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "p_brand" not in plan and "l_comment" not in plan


@pytest.mark.parametrize("seed", range(30))
def test_assignment_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 6, size=2)
    w = rng.integers(0, 4, size=(n, m))
    pairs = evaluation.assignment(w)
    assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs) and all(w[i, j] > 0 for i, j in pairs)
    wide = w if n <= m else w.T
    best = max(sum(wide[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
    assert sum(w[i, j] for i, j in pairs) == best


def test_alignment_over_scopes(spark):
    rng = np.random.default_rng(3)
    make = lambda: [(int(s), n, *(str(x) if x < 3 else None for x in rng.integers(0, 4, size=3))) for s in range(8) for n in range(int(rng.integers(0, 6)))]
    g, p = make(), make()
    schema = "scope long, no long, a string, b string, c string"
    out = evaluation.align(spark.createDataFrame(g, schema), spark.createDataFrame(p, schema), "scope", ["a", "b", "c"]).collect()
    for s in range(8):
        x, y = [r for r in g if r[0] == s], [r for r in p if r[0] == s]
        same = lambda u, v: sum(i == j and i is not None for i, j in zip(u[2:], v[2:], strict=True))
        w = np.array([[same(u, v) for v in y] for u in x]).reshape(len(x), len(y))
        want = sum(w[i, j] for i, j in evaluation.assignment(w))
        mine = [r for r in out if r.scope == s]
        assert len({r.gold_no for r in mine}) == len({r.predicted_no for r in mine}) == len(mine)
        assert sum(w[r.gold_no, r.predicted_no] for r in mine) == want == sum(r.weight for r in mine)


def test_alignment_solves_a_large_scope_in_parts(spark, monkeypatch):
    # one scope of 4,000 differing rows a side: neighbours 2i and 2i + 1 share values, others share none
    make = lambda side: [(1, n, f"a{n // 2}", f"b{n}", f"{side}{n}") for n in range(4000)] + [(1, 9000, None, None, None)]
    g, p = (spark.createDataFrame(make(side), "scope long, no long, a string, b string, c string") for side in "gp")
    whole = evaluation.assignment

    def small(weights):
        assert max(weights.shape) <= 2
        return whole(weights)

    monkeypatch.setattr(evaluation, "assignment", small)
    out = evaluation.align(g, p, "scope", ["a", "b", "c"]).collect()
    assert sorted((r.gold_no, r.predicted_no, r.weight) for r in out) == [(n, n, 2) for n in range(4000)]


def test_metrics_without_denominators(spark):
    row = evaluation.metrics(spark.createDataFrame([(0, 0, 0, 5)], "tp long, fp long, fn long, tn long")).first()
    assert (row.precision, row.recall, row.f1, row.accuracy, row.weighted) == (None, None, None, 1.0, None)


def test_fingerprints_ignore_order(spark):
    rows = [(1, "a", 2), (1, "b", None), (1, "a", 2), (2, "a", 2)]
    f = lambda r: versions.fingerprint(spark.createDataFrame(r, "k long, x string, y int"), ["k"], ["x", "y"]).orderBy("k").collect()
    assert f(rows) == f(rows[::-1]) and f(rows) != f(rows[1:])


def test_row_matching_passes(spark):
    schema = "scope long, no long, a string, b int"
    before = spark.createDataFrame([(1, 1, "x", 1), (1, 2, "x", 1), (1, 3, "y", 2), (1, 4, "z", None), (2, 1, "q", 1)], schema)
    after = spark.createDataFrame([(1, 1, "x", 1), (1, 2, "y", 9), (1, 3, "z", None), (1, 4, "w", 0)], schema)
    got = sorted((r.before_no, r.after_no, r.pass_no) for r in versions.match_rows(before, after, "scope", ["a", "b"], [["a"]]).collect())
    assert got == [(1, 1, 0), (3, 2, 1), (4, 3, 0)]


def test_merges(spark):
    rows = spark.createDataFrame([("k", "a", 1), ("k", None, 1), ("j", "a", 1), ("j", "b", 1)], "k string, v string, w int")
    assert {r.k: (r.v, r.w, r.conflict) for r in records.merged(rows, ["k"], ["v", "w"]).collect()} == {"k": ("a", 1, False), "j": (None, 1, True)}
    people = spark.createDataFrame([("a", "winner", 5), ("a", "unknown", None), ("b", "winner", 5), ("b", "nonwinner", None), ("c", "unknown", None)], "k string, outcome string, amount int")
    assert {r.k: (r.outcome, r.amount) for r in records.dedup_participants(people, ["k"]).collect()} == {"a": ("winner", 5), "b": ("unknown", None), "c": ("unknown", None)}


def test_lookup_takes_wildcards_literally(spark):
    orgs = spark.createDataFrame([(1, "a%b"), (2, "AxB"), (3, "a_b")], "id long, name string")
    assert [r.id for r in records.lookup(orgs, "A%").collect()] == [1]
    assert [r.id for r in records.lookup(orgs, "_").collect()] == [3]


def _zip(**members) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "."), body)
    return out.getvalue()


def test_archives(spark):
    inner = _zip(a__txt="inner")
    rows = [("x.zip", bytearray(_zip(b__txt="one", in__zip=inner))), ("bad.zip", bytearray(b"nothing")), ("plain.txt", bytearray(b"text")), ("none.txt", None)]
    out = {r.path: (None if r.content is None else bytes(r.content), r.warning) for r in documents.expand(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert out["x.zip!/b.txt"] == (b"one", None) and out["x.zip!/in.zip!/a.txt"] == (b"inner", None)
    assert out["bad.zip"] == (None, "damaged archive") and out["plain.txt"] == (b"text", None) and out["none.txt"][1] == "no content"


def test_nested_tables_and_items(spark):
    html = """<table><tr><th>品目名称</th><th>数量</th><th>总价（万元）</th></tr><tr><td>a<br>b<table><tr><td>deep</td></tr></table></td><td>2 台</td><td>1.5</td></tr>
    <tr><td>合计</td><td></td><td>3</td></tr><tr><td></td><td>1</td><td></td></tr></table>"""
    cells = documents.html_cells(spark.createDataFrame([("n", html), ("e", None)], "path string, html string"))
    assert {(r.table_no, r.text) for r in cells.collect()} >= {(1, "deep"), (0, "品目名称")}
    one = intake.items(cells).collect()
    assert [(r.category, r.quantity, r.quantity_unit, r.total_price, r.package_code) for r in one] == [("a b", 2, "台", 15000, "default")]


def test_attachments_by_stems_of_whole_paths(spark):
    def attached(notices: list, files: list) -> dict:
        frames = (spark.createDataFrame([(p,) for p in paths], "path string") for paths in (notices, files))
        return dict(map(tuple, intake.attach(*frames).collect()))

    notices = ["in/n1.html", "in\\N-2 公告.html", "in/n3/x.htm", "in/n4/x.htm", "in/straße.html"]
    files = {
        "n1_附件.zip": "in/n1.html", "n1/spec.pdf": "in/n1.html", "n1.zip!/deep/a.pdf": "in/n1.html", "b.zip!/n1 - Attachments_files.zip!/a": "in/n1.html", "n2公告-annex.doc": notices[1],
        "n3/x.pdf": None, "n3/y.pdf": "in/n3/x.htm", "in/none.pdf": None, "n1/n3.pdf": None, "附件.zip": None, "STRASSE.pdf": "in/straße.html", "": None,
    }
    assert attached(notices, list(files)) == files
    assert attached(["in/n1.html"], ["other.pdf", "n1.zip"]) == {"other.pdf": "in/n1.html", "n1.zip": "in/n1.html"}
    assert attached([], ["other.pdf"]) == {"other.pdf": None}
    assert attached(["in/n1.html"] * 2 + ["in/n2.html"], ["n1.zip", "n2.zip"]) == {"n1.zip": None, "n2.zip": "in/n2.html"}


def test_catalog(spark, tmp_path):
    root, ident = str(tmp_path / "sets"), "0" * 32
    catalog.create(root, ident, {"t": spark.range(3)})
    assert catalog.listed(spark, root) == [ident]
    assert spark.read.parquet(f"{catalog.resolve(spark, root, ident)}/t.parquet").count() == 3
    with pytest.raises(catalog.UnknownDataset):
        catalog.resolve(spark, root, "f" * 32)
    with pytest.raises(ValueError):
        catalog.resolve(spark, root, "../etc")


def test_streams_continue_where_they_stopped(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "job")
    rows = spark.range(10).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"))
    rows.write.parquet(source)
    assert jobs.ingest_once(jobs.stream(spark, source), folder, "k").count() == 10
    rows.unionByName(rows.select((F.col("k") + 8).alias("k"), "g")).write.mode("append").parquet(source)
    assert jobs.ingest_once(jobs.stream(spark, source, 1), folder, "k").select("k").distinct().count() == 18
    assert jobs.ingest_once(jobs.stream(spark, source), folder, "k").count() == 18


def test_latest_state_over_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    for n in range(3):
        spark.createDataFrame([(1, n, f"v{n}"), (n + 5, n, "x")], "k long, at long, v string").coalesce(1).write.mode("append").parquet(source)
    out = jobs.latest_state(jobs.stream(spark, source, 1), str(tmp_path / "job"), ["k"], "at")
    assert {(r.k, r.at, r.v) for r in out.collect()} == {(1, 2, "v2"), (5, 0, "x"), (6, 1, "x"), (7, 2, "x")}
