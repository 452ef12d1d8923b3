"""Steps that run where the lines of a project lie, and so grow with the number of tasks."""

from __future__ import annotations

import datetime
import random
from collections import Counter
from itertools import product

from pyspark.sql import functions as F

from lotmark import registry
from lotmark.operators import bidders, clues, patterns, scenes, scoring
from lotmark.operators.patterns import Step
from lotmark.sources.tables import Model


def shuffled_by(df) -> list[str]:
    """The keys of a plan's shuffles, without numbers of columns."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [part.split(", ")[0].split("#")[0] for part in plan.split("hashpartitioning(")[1:]]


def test_pairs_meet_where_bids_lie(spark, small):
    m = Model(spark, small)
    assert set(shuffled_by(scenes.pairs(m.bids))) <= {"l_orderkey", "o_orderkey"}
    per = clues.envelope(m.bids).groupBy("kind").count()
    assert not [key for key in shuffled_by(per) if key in ("package_id", "project_id")]


def test_evidence_of_pairs_is_counted_by_ids(spark, small):
    """Names of clues in a shuffle take several times the room of their ids."""
    assert "clue_id" not in shuffled_by(clues.evidence(Model(spark, small).bids))


def test_evidence_against_a_plain_count(spark):
    day = lambda n: None if n is None else datetime.date(2020, 1, n)
    rows = [(p, 2 * p + k, None if p == 4 else 2, day({1: 5, 2: 3, 3: None, 4: 3, 5: 5}[p]), o) for p in range(1, 6) for k in (0, 1) for o in (1, 3, 5) if (p + k + o) % 4]
    bids = spark.createDataFrame(rows, "project_id long, package_id long, buyer_id long, created_at date, organization_id long").withColumn("outcome", F.lit("winner"))
    of: dict = {}
    for p, package, buyer, at, o in rows:
        of.setdefault(("supplier_distribution", f"supplier-distribution:{o}", (o,)), set()).add((at is None, at, p, package))
        if buyer:
            of.setdefault(("buyer_network", f"buyer-network:{buyer}-{o}", (o,)), set()).add((at is None, at, p, package))
        for q, other, _, _, x in rows:
            if other == package and o < x:
                of.setdefault(("common_bidding", f"common-bidding:{o}-{x}", (o, x)), set()).add((at is None, at, p, package))
    expected = set()
    for (kind, clue, entities), met in of.items():
        key = lambda r: (r[0], r[1] or day(1), r[2])
        dates = [r[1] for r in met if r[1]]
        expected.add((kind, clue, entities, len({r[2] for r in met}), len({r[3] for r in met}), min(dates, default=None), min(met, key=key)[2], max(dates, default=None), max(met, key=key)[2]))
    assert {(*r[:2], tuple(r[2]), *r[3:]) for r in clues.evidence(bids).collect()} == expected


def test_roles_are_counted_where_bids_lie(spark, small):
    assert set(shuffled_by(registry.QUERIES["a26_roles"](spark, small))) <= {"l_orderkey", "o_orderkey", "role"}


def test_roles_without_scope_or_key_match_nothing(spark):
    schema = "scope long, role string, key string"
    gold = spark.createDataFrame([(1, "r", "a"), (1, "r", "a"), (1, "r", None), (None, "r", "a"), (2, "q", "b")], schema)
    predicted = spark.createDataFrame([(1, "r", "a"), (1, "r", None), (1, "r", None), (None, "r", "a"), (2, "q", "b"), (2, "q", "b")], schema)
    assert sorted(map(tuple, scoring.roles(gold, predicted, "scope").collect())) == [("q", 1, 1, 0), ("r", 1, 3, 3)]


def test_a_sheet_of_bidders_deals_its_rows_once(spark, small):
    df = registry.QUERIES["a22_bidder_sheet"](spark, small)
    assert shuffled_by(df) == ["notice_id"]
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_sheet_of_bidders_against_a_plain_one(spark):
    r = random.Random(4)
    pick = lambda *xs: r.choice(xs)
    key = lambda: (pick(1, 2, 3, 4, 5, 6, None), pick("O", "F", "default", None), pick("A b", "ab", "C", "Ｃ", "D", None, " "))
    people = [(*key(), pick("winner", "unknown", None)) for _ in range(25)]
    awards = [(*key(), pick(1, 20000, None)) for _ in range(10)]
    records = [(*key(), pick("通过", "未通过", None), pick("5", "30000", None, None), pick(["score"], ["review"], [], None, None)) for _ in range(60)]
    frame = lambda rows, more: spark.createDataFrame(rows, f"notice_id long, package_code string, name string, {more}")
    third = frame(records, "qualification string, bid_amount string, conflicts array<string>").selectExpr("*", "null compliance", "cast(null as string) review", "'9' score", "cast(null as string) reason")
    third = third.withColumns({"compliance": F.col("qualification"), "source_file": F.lit("f"), "source_location": F.lit("1")})
    out = bidders.export(frame(people, "outcome string"), frame(awards, "award_amount long").withColumn("award_amount", F.col("award_amount").cast("decimal(38,2)")), third)
    out = out.select("notice_id", "package_code", "name_key", "category", "qualification", "review", "score", F.col("amount_wan").cast("double"))

    fold = lambda s: None if s is None else s.replace("Ｃ", "C").replace(" ", "").lower() or None
    keyed = lambda rows: [(x[0], fold(x[2]), x[1] or "default", *x[3:]) for x in rows]
    people, awards, records = keyed(people), keyed(awards), keyed(records)
    known = lambda k: k[0] is not None and k[1] is not None
    base = [(k, [x for x in people if x[:3] == k], [x for x in awards if x[:3] == k]) for k in {x[:3] for x in people + awards}]
    base = [one for k, p, a in base for one in ([(k, p, a)] if known(k) else [(k, p, []), (k, [], a)]) if one[1] or one[2]]
    lots = {k[:2]: {j[2] for j, *_ in base if j[:2] == k[:2]} for k, *_ in base}
    want, used = [], set()

    def say(k, category, some, amount):
        clash = {c for x in some for c in x[5] or []}
        value = lambda f, i: min({x[i] for x in some if x[i]} or {None}) if len({x[i] for x in some if x[i]}) <= 1 and f not in clash else None
        unsure = len({x[3] for x in some if x[3]}) > 1 or clash & {"qualification", "compliance", "review"}
        offer = amount if amount is not None else value("bid_amount", 4)
        score = "9" if some and "score" not in clash else None
        want.append((k[0], k[2], k[1], category, value("qualification", 3), None if unsure else value("qualification", 3), score, None if offer is None else round(float(offer) / 10000 + 1e-9, 2)))

    for k, p, a in base:
        named = {x[2] for x in records if x[:2] == k[:2]} - {"default"}
        some = [(i, x) for i, x in enumerate(records) if known(k) and x[:2] == k[:2] and (x[2] == k[2] or x[2] == "default" and k[2] != "default" and len(lots[k[:2]]) == 1 and named <= {k[2]})]
        used |= {i for i, _ in some}
        won = [x[3] == "winner" for x in p if x[3]]
        say(k, "中标人" if not won or any(won) else "参与人", [x for _, x in some], max((x[3] for x in a if x[3] is not None), default=None))
    rest = [x for i, x in enumerate(records) if i not in used]
    for k in {x[:3] for x in rest}:
        say(k, "其他", [x for x in rest if x[:3] == k], None)
    assert Counter(map(tuple, out.collect())) == Counter(want)


def test_steps_of_a_pattern_meet_by_project(spark, small, monkeypatch):
    monkeypatch.setattr("lotmark.sources.tables.PIECE", 20_000)
    n = Model(spark, small).pieces
    assert n > spark.sparkContext.defaultParallelism
    for name in ("n06_buyer_awardees", "n06_product_suppliers", "n06_buyer_bidders", "n06_buyer_pairs", "n06_co_bidders", "n06_common_packages"):
        df = registry.QUERIES[name](spark, small)
        plan = df._jdf.queryExecution().executedPlan().toString()
        dealt = [part.split(")")[0].split(", ") for part in plan.split("hashpartitioning(")[1:]]
        by = {key.split("#")[0] for key, *more in dealt if more == [str(n)]}
        assert by == {"project_id"} and not {d[0].split("#")[0] for d in dealt} & {"project", "package"}, name


def test_patterns_within_a_scope_against_all_assignments(spark):
    r = random.Random(8)
    edges = [(s, f"{s}-{r.randrange(4)}", f"{s}-{r.randrange(4)}", r.choice("xyz")) for s in range(5) for _ in range(25)]
    edges += [(None, "a", "b", rel) for rel in "xyz"] + [(9, "9-0", "9-1", "x")]
    frame = spark.createDataFrame(edges, "s long, source string, target string, relation string")
    some = {edge for edge in edges if edge[0] is not None}
    cases = [
        ([Step("x", "a", "b")], ["a"], {}),
        ([Step("x", "a", "b"), Step("y", "b", "c")], ["a", "c"], {}),
        ([Step("x", "a", "b"), Step("y", "c", "b"), Step("y", "d", "b"), Step("z", "b", "e")], ["c", "d", "s"], {}),
        ([Step("x", "c", "b"), Step("x", "d", "b"), Step("x", "e", "b")], ["b", "e"], {"c": ["0-1", "2-1"], "d": ["0-2", "2-2"]}),
        ([Step("x", "a", "b"), Step("y", "b", "c"), Step("y", "b", "d"), Step("z", "d", "e")], ["a", "c", "e"], {}),
    ]
    for steps, keep, where in cases:
        names = sorted({node for s in steps for node in (s.start, s.end)})
        want = set()
        for s in (*range(5), 9):
            for values in product([f"{s}-{i}" for i in range(4)], repeat=len(names)):
                at = {**dict(zip(names, values, strict=True)), "s": s}
                if all((s, at[step.start], at[step.end], step.relation) in some for step in steps) and all(at[k] in v for k, v in where.items()):
                    want.add(tuple(at[k] for k in keep))
        for n in (None, 3):
            assert Counter(map(tuple, patterns.matches(frame, steps, keep, where=where, scope="s", n=n).collect())) == Counter(want), steps
    leads = patterns.reduced_within(frame, cases[1][0], "s", 3)
    assert {x.b for x in leads[0].collect()} <= {x.b for x in leads[1].collect()}
