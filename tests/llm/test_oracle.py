"""Corpus queries that SQL can express, against it."""

import duckdb
import pytest

from layerlake.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    res = c.execute(queries.ORACLES[name])
    cols = [d[0] for d in res.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(res.fetchall())
