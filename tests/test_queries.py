"""Every registered reference query against its SQL, at the smallest scale."""

import math
import os

import duckdb
import pytest

from gaugeworks.plans.reference import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(tuple(map(plain, r)) for r in cursor.fetchall())
    assert sorted(tuple(map(plain, r)) for r in got.select(*(f"`{c}`" for c in columns)).collect()) == want
