"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from docloom.plans import documents, shapes

SF = "/root/testdata/sf0.001"
QUERIES = {**documents.QUERIES, **shapes.QUERIES}
ORACLES = {**documents.ORACLES, **shapes.ORACLES}


def plain(value):
    if value is None or value != value:
        return ""
    if isinstance(value, bool) or type(value).__name__ == "bool":
        return str(bool(value))
    return f"{float(value):.6f}" if isinstance(value, (int, float)) or hasattr(value, "dtype") else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("orders", "events", "lineitem", "part", "embeddings"):
        path = f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ours = QUERIES[name](spark, SF).toPandas()
    assert len(ours) > 0
    if name not in ORACLES:
        return
    theirs = duck.sql(ORACLES[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    rows = lambda d: sorted(tuple(map(plain, r)) for r in d[columns].itertuples(index=False, name=None))
    assert rows(ours) == rows(theirs)
