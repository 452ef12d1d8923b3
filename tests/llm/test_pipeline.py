"""The pipeline's stages, and the queries that SQL expresses."""

from __future__ import annotations

import hashlib
import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lotmark.llm import linededup, minhash, mixing, queries, toxicity
from test_minhash import brute


def words(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_run_is_its_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{small}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.grade(docs, labels).collect() if r.rejected}
    clean = docs.where(~docs.doc_id.isin(sorted(toxic) or [-1]))
    lines = linededup.dedup_lines(clean)
    lines = lines.where("n_removed = 0 or text rlike '[^ \\\\t-\\\\r]'").select(*columns)
    one = minhash.keep_one(lines, 80)
    mixed = mixing.mix(one, score=mixing.fitted_quality(one, labels), whole=True).collect()
    out = corpus_pipeline.run(spark, small)
    assert set(out.columns) == {*columns, "ids", "n_tokens", "decoded_sha256"} - {"text"}
    out = out.collect()
    assert sorted((r.doc_id, r.n_chars) for r in out) == sorted((r.doc_id, r.n_chars) for r in mixed)
    library = Tokenizer.from_file(queries.vocabulary_path())
    library.no_truncation()
    library.no_padding()
    want = {}
    for r in mixed:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (ids, len(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert all((r.ids, r.n_tokens, r.decoded_sha256) == want[r.doc_id] for r in out)


def test_stages_keep_columns_and_clean_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "minhash", "mixing", "bpe"]
    texts, kept = {r.doc_id: r.text for r in docs.collect()}, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in out.collect()}
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    gone = texts.keys() - kept["toxicity"].keys()
    assert sum(marks.get(i) == 0 for i in gone) <= 0.02 * len(texts)
    # only what had words and has none left goes
    left = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    assert kept["line dedup"].keys() == {i for i in texts if words(left[i]) or not words(texts[i])}
    # near copies from 0.8 on go, by all pairs of shingle sets
    _, component = brute(texts, 80)
    assert kept["minhash"].keys() == {i for i in texts if component[i] == i}
    # no text of the mix is cut
    assert all(t == texts[i] for i, t in kept["mixing"].items())


ROWS = [
    (1, "a b c d e f g h", "en", "s", 1, "x"), (1, "a b c d e f g h", "en", "s", 1, "x"), (2, None, None, None, None, None), (3, "", "en", None, 0, ""), (None, "one two", "en", "s", 7, "x"),
    (4, "l1\nl2\nl3\nl4", "en", "s", 11, "x"), (5, "l1\nl2\nl3", "en", "s", 8, "x"), (6, "word " * 60_000, "en", "t", 300_000, "x"), (None, None, None, None, None, None),
]


@pytest.mark.parametrize("extra", ["ids", "N_Tokens", "n_removed", "severity", "_id", "hash", "row", "bands"])
def test_odd_rows_and_clashing_columns(spark, small, extra):
    docs = spark.createDataFrame(ROWS, f"doc_id long, text string, lang string, source string, n_chars long, `{extra}` string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        rows = out.collect()
        ids = [r.doc_id for r in rows]
        if name != "bpe":
            assert out.columns == docs.columns
        if name == "minhash":
            assert sorted(ids, key=str) == [1, 2, 3, 4, 5, 6, None, None]
        elif name == "line dedup":  # all lines of 5 stand in 4
            assert sorted(ids, key=str) == [1, 1, 2, 3, 4, 6, None, None]
        elif name in ("toxicity", "bpe"):
            assert sorted(ids, key=str) == [1, 1, 2, 3, 4, 5, 6, None, None]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_gives_the_same_rows(same_as_sql, name):
    assert same_as_sql(queries.QUERIES[name], queries.ORACLE[name]) > 0


def test_empty_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0
