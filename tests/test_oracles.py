"""Every query of the engine that has SQL equals it on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from quarry.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def said(v) -> str:
    return "nan" if isinstance(v, float) and math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(said(r[c]) for c in columns) for r in df.collect())
    r = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in r.description]
    want = sorted(tuple(said(row[names.index(c)]) for c in sorted(names)) for row in r.fetchall())
    assert columns == sorted(names)
    assert got == want
