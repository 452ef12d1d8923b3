"""Tables with keys as large as those of sixty-fold tables, against the same SQL over keys that can't overflow."""

from __future__ import annotations

import duckdb
import pytest

from lotmark import registry
from tests.conftest import TABLES, bag

SHIFT = 1_200_000


@pytest.fixture(scope="module")
def large(small, tmp_path_factory):
    """The small tables with part keys behind SHIFT, and DuckDB over them with part keys of 128 bits."""
    folder, con = tmp_path_factory.mktemp("large"), duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        key = {"part": "p_partkey", "lineitem": "l_partkey"}.get(name)
        shifted = f"SELECT * REPLACE ({key} + {SHIFT} AS {key})" if key else "SELECT *"
        con.execute(f"COPY ({shifted} FROM read_parquet('{small}/{name}.parquet')) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        wide = f"SELECT * REPLACE (CAST({key} AS HUGEINT) AS {key})" if key else "SELECT *"
        con.execute(f"CREATE VIEW {name} AS {wide} FROM read_parquet('{folder}/{name}.parquet')")
    return str(folder), con


@pytest.mark.parametrize("name", ["j14_candidates", "p31_all_reasons", "k07_queue_status", "k07_decisions", "t05_queue_page"])
def test_ids_beyond_a_long(spark, large, name):
    folder, con = large
    df = registry.QUERIES[name](spark, folder)
    rel = con.execute(registry.ORACLE[name])
    names = [d[0] for d in rel.description]
    same = lambda columns, rows: bag(columns, [tuple(v % 2**64 if c == "candidate_id" else v for c, v in zip(columns, row, strict=True)) for row in rows])
    ours, theirs = same(df.columns, df.collect()), same(names, rel.fetchall())
    assert ours == theirs
    if "candidate_id" in names:
        assert dict(df.dtypes)["candidate_id"] == "bigint"
