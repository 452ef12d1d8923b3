"""One Spark session for all tests, and a comparison of queries with their SQL in DuckDB."""

from __future__ import annotations

import os
import sys
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small() -> str:
    if not Path(SMALL).is_dir():
        pytest.skip("no test tables here")
    return SMALL


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{small}/{name}.parquet')")
    return con


def plain(value):
    """A value as both engines may give it: decimals without trailing zeros, floats rounded."""
    if isinstance(value, Decimal):
        return format(value.normalize(), "f")
    if isinstance(value, float):
        return format(round(value, 6), ".6f")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def bag(columns: list[str], rows) -> Counter:
    """The rows as a multiset, with columns in order of name."""
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in by) for row in rows)


@pytest.fixture(scope="session")
def same_as_sql(spark, small, duck):
    def compare(query, sql: str) -> int:
        df = query(spark, small)
        rel = duck.execute(sql)
        names = [d[0] for d in rel.description]
        assert sorted(df.columns) == sorted(names)
        ours, theirs = bag(df.columns, df.collect()), bag(names, rel.fetchall())
        assert ours == theirs, f"only Spark: {list((ours - theirs).items())[:3]}; only SQL: {list((theirs - ours).items())[:3]}"
        return sum(ours.values())

    return compare
