"""Trees of pages against a plain parser with a stack."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from lotmark import registry
from lotmark.operators import trees

HARD = [
    (1, "<div><p>a<p>b</div>c"),
    (2, "<ul><li>x<li>y</ul></b><i>z</ul>"),
    (3, "<p class='a  b' id=q>1 &lt; 2<br/>&#20013; 文</p>"),
    (4, '<P ID="q" CLASS="a b">1 &lt; 2<br>中文</P>'),
    (5, "<script>var t='</p>';</script><p>t</p><style>p{}</style>"),
    (6, "<!-- a --><p title='a > b' x>y</p><!---->"),
    (7, ""),
    (8, None),
    (9, "only text"),
    (10, "<section><nav><a href='/x'>x</a></nav><p>own 1</p></section>"),
    (11, "<section><nav><a href='/x'>x</a></nav><p>own 2</p></section>"),
    (12, "  \n "),
    (13, "<p a=1 a=2>d</p>"),
    (14, "<p a='2'>d</p>"),
    (15, "<div/><b></b>"),
    (16, "<div></div><b/>"),
]


class Plain(HTMLParser):
    """Nested lists [kind, name, label, children]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["root", None, None, []]
        self.open = [self.root]

    def add(self, node):
        self.open[-1][3].append(node)
        return node

    def handle_starttag(self, tag, attrs, void=False):
        said = {k: "" if v is None else v for k, v in attrs}
        if "class" in said:
            said["class"] = " ".join(said["class"].split())
        label = tuple(sorted(said.items()))
        node = self.add(["start", tag, label, []])
        if not void and tag not in trees.VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, void=True)

    def handle_endtag(self, tag):
        if tag in [n[1] for n in self.open[1:]]:
            while self.open.pop()[1] != tag:
                pass

    def handle_data(self, data):
        text = " ".join(data.split())
        text = re.sub("(?<=[㐀-鿿]) (?=[㐀-鿿])", "", text)
        if text:
            self.add(["text", None, text, []])

    def handle_comment(self, data):
        if data.strip():
            self.add(["comment", None, " ".join(data.split()), []])

    def handle_decl(self, decl):
        self.add(["declaration", None, " ".join(decl.split()), []])


def frozen(node):
    return (node[0], node[1], node[2], tuple(map(frozen, node[3])))


def plain(html):
    parser = Plain()
    parser.feed(html)
    parser.close()
    return frozen(parser.root)


def subtrees(tree):
    yield tree
    for child in tree[3]:
        yield from subtrees(child)


def size(tree):
    return sum(1 for _ in subtrees(tree))


def texts(tree):
    if tree[0] == "text":
        return [tree[2]]
    if tree[1] in ("script", "style"):
        return []
    return [t for child in tree[3] for t in texts(child)]


def flat(tree):
    """Scripts and styles count as one node here, with their text in it."""
    if tree[1] in ("script", "style"):
        return (tree[0], tree[1], (tree[2], tuple(c[2] for c in tree[3])), ())
    return (tree[0], tree[1], tree[2], tuple(map(flat, tree[3])))


def same_classes(df, pages):
    """Every subtree's hash stands for one plain subtree and the other way round, and the counts agree."""
    want = Counter((i, t) for i, html in pages if html and plain(html)[3] for t in subtrees(flat(plain(html))))
    rows = df.collect()
    by_page = defaultdict(list)
    for r in rows:
        by_page[r.page_id].append(r)
    assert {i for i, _ in want} == set(by_page)
    names = {}
    for i, got in by_page.items():
        kids = defaultdict(list)
        for r in sorted((r for r in got if r.parent is not None), key=lambda r: r.pos):
            kids[r.parent].append(r)

        def walk(row, tree, kids=kids):
            assert row.size == size(tree)
            assert names.setdefault(row.hash, tree) == tree
            below = kids[row.pos]
            assert len(below) == len(tree[3])
            for one, child in zip(below, tree[3], strict=True):
                walk(one, child)

        (root,) = [r for r in got if r.parent is None]
        walk(root, flat(plain(dict(pages)[i])))
    assert len(set(names.values())) == len(names) and len(rows) == sum(want.values())


def test_hard_pages(spark):
    df = spark.createDataFrame(HARD, "page_id int, html string").withColumn("hash", F.lit("clash"))
    same_classes(trees.hashed(trees.nodes(df, ["page_id"], "html"), ["page_id"]), HARD)


def test_rows_of_structures(spark):
    df = spark.createDataFrame(HARD, "page_id int, html string").withColumn("size", F.lit(1))
    got = {r.page_id: r for r in trees.structures(df, ["page_id"], "html").collect()}
    assert set(got) == {i for i, _ in HARD}
    assert got[3].structure == got[4].structure and got[15].structure == got[16].structure
    assert got[13].structure == got[14].structure != got[10].structure
    assert (got[8].structure, got[8].n_nodes, got[8].text) == (None, None, None)
    assert (got[7].structure, got[7].n_nodes, got[7].text) == (None, 0, "")
    assert (got[12].n_nodes, got[12].text) == (0, "")
    for i, html in HARD:
        if html:
            assert got[i].text == re.sub("(?<=[㐀-鿿]) (?=[㐀-鿿])", "", " ".join(texts(plain(html)))), i
    empty = spark.createDataFrame([], "page_id int, html string")
    assert trees.structures(empty, ["page_id"], "html").count() == 0 and trees.shared(empty, ["page_id"], "html").count() == 0


def test_deep_pages_stay_bounded(spark):
    df = spark.createDataFrame([(1, "<div>" * 3000 + "x")], "page_id int, html string")
    of = trees.nodes(df, ["page_id"], "html", deepest=5)
    assert of.agg(F.max("depth")).first()[0] == 5 and of.count() == 3001
    assert trees.hashed(of, ["page_id"]).where("parent is null").first().size == 3002
    with pytest.raises(ValueError):
        trees.nodes(df, ["page_id"], "html", deepest=0)


def test_long_pages(spark):
    html = "<p>" + "word " * 400_000 + "</p>" + "<a " + " ".join(f"k{i}='v'" for i in range(3000)) + ">x</a>" + "<" * 1000 + "\"'" * 5000
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert trees.structures(df, ["page_id"], "html").first().n_nodes > 3


def _given(spark, small):
    df = spark.read.parquet(f"{small}/pages.parquet")
    return df, [(r.page_id, r.html) for r in df.collect()]


def test_given_pages(spark, small):
    df, pages = _given(spark, small)
    same_classes(trees.hashed(trees.nodes(df, ["page_id"], "html"), ["page_id"]), pages)


def test_shared_subtrees(spark, small):
    _, pages = _given(spark, small)
    found = [[(t, n) for t, n in _with_parents(flat(plain(html)))] for _, html in pages if html]
    on = Counter(t for page in found for t in {t for t, _ in page if t[0] == "start" and t[1] not in ("script", "style", *trees.VOID) and size(t) >= 2})
    want = Counter()
    for page in found:
        for t, parent in page:
            if on[t] >= 2 and on[parent] < 2:
                want[(t[1], size(t), on[t])] += 1
    got = Counter((r["name"], r["size"], r.n_pages) for r in registry.QUERIES["f19_shared_subtrees"](spark, small).collect())
    assert got == want and got


def _with_parents(tree, parent=None):
    yield tree, parent
    for child in tree[3]:
        yield from _with_parents(child, tree)
