"""Kinds of clues by name, and purposes of quotes against a plain search."""

from __future__ import annotations

import random

import pytest

from lotmark.operators import intents, scopes


@pytest.mark.parametrize(
    ("name", "kind"),
    [(None, "all"), ("", "all"), ("all", "all"), ("common", "common_bidding"), ("common-bidding", "common_bidding"), ("co-bidding", "common_bidding"), ("repeat", "repeat_cooperation"), (" Repeat_Cooperation ", "repeat_cooperation"), ("distribution", "supplier_distribution"), ("supplier-distribution", "supplier_distribution"), ("network", "buyer_network"), ("buyer_network", "buyer_network")],
)
def test_kinds(name, kind):
    assert intents.kind(name) == kind


@pytest.mark.parametrize("name", ["commons", "co_bidding_", "x"])
def test_unknown_kinds(name):
    with pytest.raises(ValueError, match="unknown kind"):
        intents.kind(name)


TITLES = [("业绩一览表", "history"), ("采购清单", "current"), ("评审结果", "evaluation"), ("技术参数", "unknown"), ("甲 10 台", None), ("乙乙乙", None), ("aXa", None)]


def plainly(lines, quote):
    """The purposes of all places of a quote, and that of the first one's heading."""
    marks, body = [], ""
    for title, purpose in lines:
        flat = "".join(title.split()).lower()
        if purpose:
            marks.append((len(body), purpose))
        body += flat
    key, found, first = "".join(quote.split()).lower(), set(), None
    at, n = body.find(key), 0
    while key and at >= 0:
        above = [p for o, p in marks if o <= at]
        if not n:
            first = above[-1] if above else None
        found |= {above[-1] if above else "unknown"} | {p for o, p in marks if at < o < at + len(key)}
        at, n = body.find(key, at + 1), n + 1
    return first, sorted(found)


def test_places_of_quotes(spark):
    r = random.Random(3)
    docs, quotes, want = [], [], {}
    for d in range(60):
        lines = [r.choice(TITLES) for _ in range(r.randrange(1, 9))]
        docs.append((f"p{d}", "\n".join(t for t, _ in lines)))
        for n, quote in enumerate(("10 台", "乙乙", "台乙", "果", "absent", "A x", "表采", "")):
            quotes.append((f"p{d}", n, quote))
            want[f"p{d}", n] = plainly(lines, quote)
    out = scopes.placed(spark.createDataFrame(docs, "path string, text string"), spark.createDataFrame(quotes, "path string, evidence_no long, quote string")).collect()
    assert len(out) == len(quotes)
    for row in out:
        assert (row.purpose, row.purposes or []) == want[row.path, row.evidence_no], (row, dict(docs)[row.path])


def test_candidates_of_mixed_documents(spark):
    text = "采购清单\n甲\n业绩一览表\n乙\n评审结果\n丙\n技术参数\n丁\n乙"
    docs = spark.createDataFrame([("a", text), ("b", "业绩一览表\n甲"), ("c", "评审结果\n甲")], "path string, text string")
    quotes = spark.createDataFrame([(p, i, q) for p in "abc" for i, q in enumerate("甲乙丙丁戊")], "path string, evidence_no long, quote string")
    found, known = scopes.placed(docs, quotes), scopes.classified(docs)
    kept = lambda what: {(x.path, x.quote) for x in scopes.in_scope(quotes, known, found, what).collect()}
    assert kept("items") == {("a", q) for q in "甲乙丁戊"}  # 乙 stands under history, and again under a section of its own
    assert kept("participants") == {("a", q) for q in "甲乙丙丁戊"} | {("c", q) for q in "甲乙丙丁戊"}
