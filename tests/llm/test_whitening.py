import math

import numpy as np

from lithos.llm import queries, whitening

TYPE = "vec_id long, embedding array<float>, x int, n string"


def brute(rows, k=16):
    """(vec_id, deviation), whitened up to sign, explained, n."""
    ok = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in ok])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    c = fit - s / n
    e, vec = np.linalg.eigh(c.T @ c / n)
    e, vec = e[::-1][:k], vec[:, ::-1][:, :k]
    return [i for i, _ in ok], dev, (x - s / n) @ vec / np.sqrt(e), e / np.trace(c.T @ c / n), n


def held(df, rows, k=16):
    ids, dev, white, explained, n = brute(rows, k)
    got = sorted(df.collect(), key=lambda r: (r.vec_id, r.component))
    assert len(got) == len(ids) * len(explained)
    order = np.argsort(ids, kind="stable")
    assert [r.deviation for r in got] == [dev[i] for i in order for _ in explained]
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8
    w = np.array([r.whitened for r in got]).reshape(len(ids), -1)
    sign = np.sign((w * white[order]).sum(axis=0))
    assert np.allclose(w, white[order] * sign, rtol=1e-6, atol=1e-8)
    assert np.allclose([r.explained for r in got[: len(explained)]], explained, rtol=1e-9)
    assert [r.component for r in got[: len(explained)]] == list(range(1, len(explained) + 1))


def test_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 11)) @ rng.normal(size=(11, 11))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(500 + i, rows[3][1]) for i in range(200)]  # copies count once
    odd = [(900, None), (901, [None] + rows[0][1][1:]), (902, [float("nan")] + rows[0][1][1:]), (903, [float("inf")] + rows[0][1][1:])]
    df = spark.createDataFrame([(i, v, 1, "z") for i, v in rows + odd], TYPE)
    for tile, block in ((4, 50), (32, 4096), (1, 7)):
        held(whitening.whiten(df, tile=tile, block_rows=block), rows)
    held(whitening.whiten(df, components=3, tile=5), rows, 3)


def test_edges(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 1, "z") for i, v in rows], TYPE)
    assert whitening.whiten(make([(1, [1.0, 2.0])]).limit(0)).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(make([(1, []), (2, None)])).count() == 0
    # another length than most goes; a dimension without variance gives no component
    rows = [(1, [1.0, 2.0, 5.0]), (1, [2.0, 1.0, 5.0]), (None, [4.0, 4.0, 5.0]), (3, [0.5, -1.0, 5.0])]
    got = whitening.whiten(make([*rows, (4, [1.0])])).collect()
    assert len(got) == 4 * 2 and {r.component for r in got} == {1, 2} and {r.vec_id for r in got} == {1, None, 3}
    assert got[0].identity_error < 1e-9


def test_deviation_beyond_a_long():
    by = whitening.Fit(10**9, np.array([10**9 * 7]), np.zeros((1, 0)), np.zeros(0), 1.0)
    assert by.deviation(np.array([[7], [8], [10]])) == [0, 10**18, 9 * 10**18]
    assert by.deviation(np.array([[11]])) == [None]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    df = queries.op13_whitening(spark, sf)
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    held(df, rows)
