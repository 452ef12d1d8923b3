"""BPE against the tokenizers library, which is the reference for ids and for decoded texts."""

from __future__ import annotations

import functools
import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lotmark.llm import bpe, queries

PATH = public_tokenizers.path(queries.VOCABULARY)
TEXTS = [
    None, "", " ", "\n\t\r\x0b\x0c", "word", "Two words", "it's we'll they'd I'm you've ISN'T", "aaaa aaaaaaaaa", "a b c　d\x85e", "x\x1cy\x1dz\x1e1\x1f2",
    "<|startoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|>", "<|endoftext", "ΣΑΣ ΟΔΟΣ ς", "İstanbul ẞ ﬁ", "é é ẛ̣", "日本語 한국어 emoji 👩‍👩‍👧", "12345 ⅷ ² ½", "!?.,;:--- ***", "tab\tnew\nline",
    "\u0000 null", "x" * 5000, "ab " * 3000, "﻿bom", "​zero‍width", "Ⱥ ȺȾ ǅ", "𝒳𝒴 𐐀𐐨", "don''t 's's", "_under_score_ camelCase",
]


@functools.cache
def plain_library() -> Tokenizer:
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def library() -> Tokenizer:
    return plain_library()


def test_edge_texts_as_the_library(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(docs, PATH).withColumn("copy", F.col("ids")), PATH).collect()
    assert len(out) == len(TEXTS)
    for row in out:
        ids = library.encode(TEXTS[row.doc_id] or "", add_special_tokens=False).ids
        assert row["copy"] == ids, TEXTS[row.doc_id]
        assert row.decoded == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab'st <|>\n"))), max_size=6))
def test_any_texts_as_the_library(texts):
    library = plain_library()
    offsets, ids = bpe.Encoder(PATH).encode(texts)
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


def test_whole_table(spark, small, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = queries.op1_bpe(spark, small).collect()
    assert len(out) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for row in out:
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert (row.n_tokens, row.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert row.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_empty_table_and_odd_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(docs, PATH), PATH).collect() == []
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, -1, 10**8, 320])], "doc_id long, ids array<int>")
    decoded = {r.doc_id: r.decoded for r in bpe.decode(odd, PATH).collect()}
    assert decoded == {1: None, 2: "", 3: bpe.vocabulary(PATH).tokens[320].as_py()}


def test_cache_is_forgotten_without_effect(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    encoder = bpe.Encoder(PATH)
    for text in ("one two three four five", "two six", "five one"):
        assert encoder.encode([text])[1].tolist() == library.encode(text, add_special_tokens=False).ids


def test_decoding_in_the_same_pass(spark):
    docs = spark.createDataFrame([(1, "Some text, with 12 words — and <|endoftext|> in it."), (2, None), (3, ""), (4, "ÄÖ ß " * 2000)], "doc_id long, text string")
    path = queries.vocabulary_path()
    both = bpe.encode(docs, path, decoded="said").select("doc_id", "ids", "said")
    apart = bpe.decode(bpe.encode(docs, path), path, text="said")
    assert {(r.doc_id, r.said) for r in both.collect()} == {(r.doc_id, r.said) for r in apart.collect()}
    assert both.where("doc_id = 2").first().ids == []
