"""Every query with SQL, against DuckDB on the small tables."""

import duckdb
import pandas as pd
import pytest

from hitgraph.plans import catalog


def rows(df: pd.DataFrame) -> list[str]:
    cell = lambda x: None if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x) else float(x) if not isinstance(x, (str, bool)) and hasattr(x, "__float__") else x
    return sorted(str(tuple(cell(x) for x in r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in catalog.TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_members_of_a_very_long_text(spark, tmp_path):
    spark.createDataFrame([(1, "a\nb\n" + "\n".join(map(str, range(1_000_005)))), (2, "a"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert catalog.QUERIES["gmt_explode"](spark, str(tmp_path)).count() == 1_000_005
