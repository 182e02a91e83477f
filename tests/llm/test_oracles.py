"""Numbered queries against their SQL."""

import os

import duckdb
import pytest

from dossier.llm.queries import oracle_sql, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = c.execute("SELECT " + ", ".join(columns) + f" FROM ({oracle_sql()[name]})").fetchall()
    assert sorted((tuple(r[k] for k in columns) for r in df.collect()), key=repr) == sorted(want, key=repr)
