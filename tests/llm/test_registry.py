"""Queries of the text operators run over the smallest tables; those with SQL give its rows."""

import os

import duckdb
import pytest
from tests.test_queries import DATA, TABLES, plain

from tidelake.llm import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = registry.queries()[name](spark, DATA), c.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in ("op7_decontamination", "op12_top_k", "op13_vector_codes")])
def test_query_keeps_every_document(spark, name):
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    got = registry.queries()[name](spark, DATA).count()
    assert got == n or name == "pipeline" and 0 < got < n
