"""Every query with SQL gives the SQL's rows on the smallest tables."""

import math

import pytest

from lithos import plans

SF = "/root/testdata/sf0.001"


def norm(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return str(x)[:10] if hasattr(x, "isoformat") else x


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key)
    if name in plans.SQL:
        r = duck.execute(plans.SQL[name])
        names = [d[0] for d in r.description]
        want = sorted((tuple(norm(dict(zip(names, x))[c]) for c in cols) for x in r.fetchall()), key=key)
        assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
