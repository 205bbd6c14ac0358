"""Slices against plain Python, with one key that holds nearly all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lithos.operators import flood, joins, series, slices


@pytest.fixture(scope="module", autouse=True)
def many_slices(spark):
    """Small partitions stay apart, as large ones would."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    keys = ["hot"] * 9 + ["a", None]
    return [(rng.choice(keys), rng.randrange(400), i, rng.choice([None, *range(5)]), rng.choice([rng.randrange(20) / 4, rng.random()])) for i in range(1500)]


TYPE = "k string, t long, i long, v long, x double"


def test_a_hot_key_has_many_slices(spark, rows):
    r = slices.sliced(spark.createDataFrame(rows, TYPE), ["k"], ["t", "i"]).filter("k = 'hot'").groupBy("_slice").agg(F.min(F.struct("t", "i")).alias("a"), F.max(F.struct("t", "i")).alias("b")).orderBy("_slice").collect()
    assert len(r) >= 3 and all(tuple(p.b) < tuple(q.a) for p, q in zip(r, r[1:], strict=False))


@pytest.mark.parametrize("before", [False, True])
def test_carried(spark, rows, before):
    got = {r.i: r.last for r in slices.carried(spark.createDataFrame(rows, TYPE), "k", ["t", "i"], F.col("v"), "last", before).collect()}
    want, last = {}, {}
    for k, _, i, v, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        old = last.get(k)
        last[k] = old if v is None else v
        want[i] = old if before else last[k]
    assert got == want
    assert slices.carried(spark.createDataFrame([], TYPE), "k", ["t", "i"], F.col("v"), "last").count() == 0


def test_as_of_and_changed_payloads(spark, rows):
    left, right = rows[::2], [r for r in rows[1::2] if r[3] is not None]
    l = spark.createDataFrame([r[:3] for r in left], "k string, t long, i long")
    r = spark.createDataFrame([(k, t, i) for k, t, i, _, _ in {(r[0], r[1]): r for r in right}.values()], "k string, u long, found long")
    got = {x.i: x.found for x in joins.as_of(l, r, "k", "t", "u", "found").collect()}
    newest = {(r[0], r[1]): r[2] for r in right}
    of = lambda k, t: max(((u, f) for (q, u), f in newest.items() if q == k and u <= t), default=(0, None))[1]
    assert got == {i: of(k, t) for k, t, i, _, _ in left}
    p = spark.createDataFrame([(k, t, i, v) for k, t, i, v, _ in rows], "connector string, fetched_at long, key long, digest long")
    want, last = set(), {}
    for k, _, i, v, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in last or last[k] != v:
            if not (k not in last and v is None):  # nothing before is like a null digest
                want.add(i)
        last[k] = v
    out = series.changed_payloads(p)
    assert {x.key for x in out.collect()} == want and out.columns == p.columns


def test_quantiles_and_ranks(spark, rows):
    df = spark.createDataFrame([*rows, ("none", 1, -1, None, None)], TYPE)
    shares = [0.0, 0.1, 0.5, 0.98, 1.0]
    got = {r.k: (r.n, list(r.quantiles)) for r in slices.quantiles(df, ["k"], "x", shares).collect()}
    rank = {r.k: [r[c] for c in r.asDict() if c != "k"] for r in flood.nearest_rank(df, ["k"], "x", shares).collect()}
    plain = {r.k: list(r.q) for r in df.filter("x is not null").groupBy("k").agg(F.percentile("x", F.array(*[F.lit(q) for q in shares])).alias("q")).collect()}
    for k in ("hot", "a", None):
        v = sorted(r[4] for r in rows if r[0] == k)
        assert got[k][0] == len(v) and got[k][1] == plain[k]
        assert rank[k] == [v[max(math.ceil(q * len(v)) - 1, 0)] for q in shares]
    assert "none" not in got and rank["none"] == [None] * 5
    assert slices.quantiles(df.limit(0), ["k"], "x", shares).count() == 0
