"""Searches of the stored trigram index against sets of trigrams in plain Python."""

import random

import pytest

from lithos.operators import names


def tri(s):
    t = "  " + " ".join(s.lower().split()) + " "
    return {t[i : i + 3] for i in range(max(len(t) - 2, 1))}


def like(a, b):
    return len(tri(a) & tri(b)) / len(tri(a) | tri(b))


@pytest.mark.parametrize("least", [0.15, 0.4, 1.0])
def test_searches(spark, tmp_path, least):
    rng = random.Random(2)
    parts = ["kota", "suka", "raja", "sari", "jaya", "ban", "dung", "a", "é"]
    rows = [(i, " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 2)))) for i in range(150)] + [(900, ""), (901, None), (902, "Kota"), (903, "kota")]
    path = str(tmp_path / "i")
    names.store(spark.createDataFrame(rows, "id long, name string"), path, "id", "name", 3)
    words = ["kota", "sukaraja", "kotajaya sari", "zzz", "é", ""]
    want = {(w, i): like(n, w) for w in words for i, n in rows if n is not None and like(n, w) >= least}
    many = names.search_many(spark, path, spark.createDataFrame([(w,) for w in [*words, "kota", None]], "word string"), least)
    assert {(r.word, r.key): r.similarity for r in many.collect()} == pytest.approx(want)
    for w in words:
        assert {(w, r.key): r.similarity for r in names.search(spark, path, w, least, 3).collect()} == pytest.approx({k: v for k, v in want.items() if k[0] == w})
