import os

import duckdb
import pytest

from maskline.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


def _rows(frame, columns):
    return sorted(tuple("None" if v is None or v != v else str(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    want = duck.sql(ORACLE_SQL[name]).df().astype(object)
    got = QUERIES[name](spark, DATA).toPandas().astype(object)
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got, sorted(got.columns)) == _rows(want, sorted(got.columns))
