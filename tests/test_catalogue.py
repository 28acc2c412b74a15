"""Every query of the catalogue against its SQL."""

import os
from decimal import Decimal

import duckdb
import pytest

from assetlake.plans import catalogue, dataflows, roundtrips, rulebook  # noqa: F401 - they register their queries


def plain(v):
    if isinstance(v, (float, Decimal)):
        return float(f"{float(v):.9g}")
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, sf, db, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = db.execute(catalogue.ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())
