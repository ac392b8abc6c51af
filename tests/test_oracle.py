"""Every query with SQL equals DuckDB on the smoke tables (rows, columns, types, values)."""

import duckdb
import pytest

import __spark_entry__ as E
import oracle_check as OC

from conftest import SF001


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in OC.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = E.queries()[name](spark, SF001)
    srows = [tuple(r) for r in df.collect()]
    rel = duck.sql(E.oracle_sql()[name])
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    stypes = dict(df.dtypes)
    dtypes = {c: str(t) for c, t in zip(rel.columns, rel.dtypes)}
    assert all(OC.SPARK_TO_DUCK.get(stypes[c], stypes[c]) == dtypes[c] for c in df.columns), (stypes, dtypes)
    assert len(srows) == len(drows)
    assert OC.digest(df.columns, srows)[0] == OC.digest(rel.columns, drows)[0]
