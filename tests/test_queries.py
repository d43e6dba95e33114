"""Every query of the core that has an oracle agrees with it on the smallest data."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb
import pytest

from larkspur.queries import core

FOLDER = os.environ.get("LARKSPUR_DATA", "/root/testdata/sf0.001")
REGISTRY = core()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    return c


def plain(v):
    if isinstance(v, (bool, str)) or v is None:
        return repr(v)
    if isinstance(v, (int, float, Decimal)):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(float(v))
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(REGISTRY.oracles))
def test_agrees_with_oracle(spark, duck, name):
    df = REGISTRY.queries[name](spark, FOLDER)
    got = table(df.columns, df.collect())
    cursor = duck.execute(REGISTRY.oracles[name])
    want = table([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_every_query_has_an_oracle():
    assert set(REGISTRY.queries) == set(REGISTRY.oracles)
