"""Corpus queries with SQL, against DuckDB on the small tables."""

import duckdb
import pandas as pd
import pytest

from hitgraph.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = c.execute(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cell = lambda x: None if x is None or x is pd.NA or x != x else int(x) if isinstance(x, float) and x == int(x) else x
    rows = lambda d: sorted((tuple(map(cell, r)) for r in d[sorted(d.columns)].itertuples(index=False, name=None)), key=str)
    assert rows(got) == rows(want)
