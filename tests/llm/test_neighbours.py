import numpy as np
import pytest
from pyspark.sql import functions as F

from lithos.llm import neighbours

DDL = "vec_id long, embedding array<float>, label int, leaf string, v string, part string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[100:300] = x[7]  # a third of the rows are copies
    out = [(i, [float(a) for a in x[i]], 0, "z", "z", "z") for i in range(600)]
    bad = [None, [0.0] * 8, [float("nan")] * 8, [1.0, None] * 4, [float("inf")] * 8, [], [1.0, 2.0]]
    return out + [(10_000 + 100 * i, b, 0, "z", "z", "z") for i, b in enumerate(bad)] + [(None, out[5][1], 0, "z", "z", "z")]


def exact(rows, k, every):
    sound = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and i < 10_000]
    out = {}
    for i, q in sound:
        if i % every == 0:
            d = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in sound if j != i)
            out[i] = d[:k]
    return out


def test_recall_scores_and_ties(spark, rows):
    df = spark.createDataFrame(rows, DDL)
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, k=10, sample_rows=300).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = exact(rows, 10, 20)
    assert set(got) == set(want)
    hits = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    for q, found in got.items():
        assert found == sorted(found) and len(found) == 10
    assert [j for _, j in got[120]] == [j for _, j in want[120]]  # a copy: ties go to the smaller id


def test_small_and_empty(spark, rows):
    df = spark.createDataFrame(rows[:4], DDL)
    out = neighbours.search(df, F.col("vec_id") == 0, k=10).collect()
    assert [(r.rank, r.vec_id) for r in sorted(out, key=lambda r: r["rank"])] == [(i + 1, j) for i, (_, j) in enumerate(exact(rows[:4], 10, 4)[0])]
    assert neighbours.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_every_leaf_is_exact():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 4))
    tree = neighbours.Tree(x, branches=4, leaf_rows=20)
    assert sorted(tree.visit(x[0], tree.n_leaves)) == list(range(tree.n_leaves))
    assert len(set(tree.assign(x).tolist())) == tree.n_leaves


def test_every_query_has_k_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 32)).astype(np.float32)  # the default sample is the whole table
    df = spark.createDataFrame([(i, [float(a) for a in v], 0, "z", "z", "z") for i, v in enumerate(x)], DDL)
    got = {r.query_id: r.n for r in neighbours.search(df, F.col("vec_id") % 10 == 0, k=10, target=0.5).groupBy("query_id").agg(F.count("vec_id").alias("n")).collect()}
    assert got == dict.fromkeys(range(0, 2000, 10), 10)


def test_small_leaves_are_visited_until_k_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(a) for a in v], 0, "z", "z", "z") for i, v in enumerate(x)], DDL)
    for k in (250, 400):
        got = neighbours.search(df, F.col("vec_id") % 100 == 0, k=k, target=0.1).groupBy("query_id").count().collect()
        assert {r.query_id: r["count"] for r in got} == dict.fromkeys((0, 100, 200), min(k, 299))


def test_rows_that_share_an_id(spark):
    x = [[float(i), 1.0] for i in range(12)]
    rows = [(0, x[0], 0, "z", "z", "z"), (0, x[3], 0, "z", "z", "z")] + [(i, x[i], 0, "z", "z", "z") for i in range(1, 12)]
    df = spark.createDataFrame(rows, DDL)
    got = sorted((r["rank"], r.vec_id, r.score) for r in neighbours.search(df, F.col("vec_id") == 0, k=10).collect())
    want = []
    for own in (0, 1):
        near = sorted((abs(r[1][0] - rows[own][1][0]), r[0]) for j, r in enumerate(rows) if j != own)[:10]
        want += [(n + 1, i, d) for n, (d, i) in enumerate(near)]
    assert got == sorted(want)


def test_sample_is_bounded_and_leaves_grow():
    sizes = [neighbours.sample_size(n) for n in (10, 20_000, 10**6, 10**8, 10**11)]
    assert [s[0] for s in sizes] == [20_000, 20_000, 20_000, 200_000, 200_000]
    leaves = [rows / each for rows, each in sizes]
    assert leaves == sorted(leaves) and leaves[-1] == neighbours.MOST_SAMPLE_ROWS / neighbours.FEW_LEAF_ROWS


def test_recall_of_the_query(spark):
    """Against brute force, on the table that it is registered for."""
    from lithos.llm import queries

    sf = "/root/testdata/sf0.1"
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, ids = np.array([r.embedding for r in df], float), np.array([r.vec_id for r in df])
    got = {}
    for r in queries.op3_neighbours(spark, sf).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    asking = [i for i in ids.tolist() if i % 100 == 0]
    assert set(got) == set(asking)
    hits = 0
    for q in asking:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        hits += len(set(got[q]) & set(ids[np.lexsort((ids, d))[:10]].tolist()))
        assert len(got[q]) == 10 and all(d[ids == j][0] == s for j, s in got[q].items())
    assert hits >= 0.9 * 10 * len(asking)
