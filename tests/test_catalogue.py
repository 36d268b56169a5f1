"""Every catalogue query with SQL gives the rows that DuckDB gives; the others give some."""

import duckdb
import pytest

from sigloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "events embeddings orders lineitem".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def rows(got):
    return sorted((tuple(float(round(v, 9)) if isinstance(v, float) else v for v in r) for r in got), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = rows(tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    sql = catalogue.oracles().get(name)
    if sql is None:
        assert got
        return
    want = con.sql(sql)
    assert sorted(want.columns) == cols
    assert got == rows(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())
