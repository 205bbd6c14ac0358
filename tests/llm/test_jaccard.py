import numpy as np
import pytest

from lithos.llm import jaccard


def brute(texts, percent=75, k=5):
    sets = []
    for _, t in texts:
        w = bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(texts, sets))), key=str)


@pytest.mark.parametrize("short", [2, 8])
def test_equals_brute_force(docs, texts, short):
    out = jaccard.components(docs, short=short, pivots=2, counters=1 << 10, bucket_postings=200)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str) == brute(texts)


def test_long_lists_lose_no_link(spark):
    """Many near copies in chains: lists are long, and most pairs don't link."""
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        w = list(words)
        w[i : i + 2] = [f"x{i}", f"y{i}"]
        if i > 25:
            w[50:] = [f"z{i}{j}" for j in range(10)]
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for short, pivots in ((2, 0), (4, 2)):
        out = jaccard.components(df, short=short, pivots=pivots, counters=1 << 10)
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str) == brute(rows)


def test_empty_table(no_docs):
    assert jaccard.components(no_docs).count() == 0


def test_bits_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(0)
    for n, m, both in ((10, 400, 5), (100, 120, 90), (3, 3, 3)):
        x = rng.integers(0, 1 << 60, n + m, np.uint64)
        a, b = np.unique(x[:n]), np.unique(np.concatenate([x[:both], x[n:]]))
        assert jaccard.differing(jaccard.parity_bits(a), jaccard.parity_bits(b)) <= len(np.setxor1d(a, b))


def test_skipping_loses_no_pair_and_forms_no_other():
    rng = np.random.default_rng(3)
    for percent in (75, 80, 95):
        rows = sorted({(int(rng.integers(0, 6)), n := int(rng.integers(1, 40)), int(rng.integers(0, n - (percent * n + 99) // 100 + 1))) for _ in range(300)})
        lists, sizes, places = (np.array(c, np.int64) for c in zip(*rows))
        got = set(zip(*(x.tolist() for x in jaccard.skip_pairs(lists, sizes, places, percent))))
        want = set()
        for i, (g, n, p) in enumerate(rows):
            for j in range(i + 1, len(rows)):
                h, m, q = rows[j]
                if g == h and 100 * n >= percent * m and 100 * (min(p, q) + min(n - p, m - q)) * (100 + percent) >= 100 * percent * (n + m):
                    want.add((i, j))
        assert got == want
