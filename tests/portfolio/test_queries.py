"""Every query that has SQL gives the rows that the SQL gives."""

from __future__ import annotations

import datetime
import math

import pytest

from portolan.plans.oracles import ORACLES
from portolan.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float)):
        return None if math.isnan(x) else round(float(x), 6)
    return x.isoformat() if isinstance(x, datetime.datetime) else str(x)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(v[k]) for k in order) for v in values), key=str)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, sf, duck, name):
    frame = QUERIES[name](spark, sf)
    got = rows(frame.columns, frame.collect())
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert got == rows(columns, cursor.fetchall())


def test_all_roles_occur(spark, sf):
    assert all(r.n > 0 for r in QUERIES["flow_role_counts"](spark, sf).collect())
