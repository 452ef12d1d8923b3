"""Every registered query against its SQL, and the entry module."""

from __future__ import annotations

import subprocess
import sys

import pytest

import __spark_entry__
from lotmark import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_sql_gives_the_same_rows(same_as_sql, name):
    assert same_as_sql(registry.QUERIES[name], registry.ORACLE[name]) > 0


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs_without_sql(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_quotes_and_conflicts_cover_all_documents(spark, small):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    quotes = registry.QUERIES["p17_quotes"](spark, small).collect()
    assert sorted(r.doc_id for r in quotes) == sorted(i for i in docs for _ in range(3))
    assert any(r.grounded for r in quotes if r.origin == "own") and not any(r.grounded for r in quotes if r.origin == "changed")
    assert any(not r.grounded for r in quotes if r.origin == "foreign")
    found = {r.doc_id for r in registry.QUERIES["u05_all_conflicts"](spark, small).collect()}
    assert found == {i for i, r in docs.items() if i % 5 == 0 and r.n_chars is not None} and any(i % 2 for i in found)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["organization_id", "buyer_id", "projects", "organization_name", "place"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


def test_entry_module_needs_no_session():
    code = "import __spark_entry__ as e; print(len(e.queries()) > len(e.oracle_sql()) > 100)"
    said = subprocess.run([sys.executable, "-c", code], cwd=__spark_entry__.ROOT, capture_output=True, text=True, timeout=120)
    assert said.stdout.strip() == "True", said.stderr
