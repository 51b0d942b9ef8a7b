"""Every query of the plans against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from intervalia import plans

SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def rows(records, names):
    def plain(x):
        return "null" if x is None else f"{x + 0.0:.4f}" if isinstance(x, (int, float)) and not isinstance(x, bool) and not math.isnan(x) else str(x)

    return sorted(tuple(plain(r[n]) for n in sorted(names)) for r in records)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = rows([r.asDict() for r in df.collect()], df.columns)
    assert got
    if name in ORACLES:
        found = db.sql(ORACLES[name])
        assert sorted(found.columns) == sorted(df.columns)
        assert got == rows([dict(zip(found.columns, r)) for r in found.fetchall()], found.columns)
