import random
import zlib

import numpy as np
import pytest

from lithos.llm import langid
from lithos.session import read_table


def test_held_out_accuracy(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.train(docs)
    said = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    rows = [(r.doc_id, r.lang) for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(said) == docs.count()
    assert sum(said[i][0] == lang for i, lang in rows) >= 0.97 * len(rows)
    assert all(0 <= s <= 1 for _, s in said.values())


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(60)).encode()
    return langid.fit([("aa", make("abcde")) for _ in range(30)] + [("bb", make("vwxyz")) for _ in range(30)], landmarks=10)


def test_edge_cases(docs, no_docs, texts, model):
    out = langid.identify(docs, model).collect()
    assert len(out) == len(texts)
    want = sorted(t is not None and any(c.isalpha() for c in t) for _, t in texts)
    assert sorted(r.lang_pred != "und" for r in out) == want
    assert langid.keep(docs, model).count() == sum(want) and langid.keep(docs, model).columns == docs.columns
    assert langid.identify(no_docs, model).count() == 0


def test_languages_are_told_apart(spark, model):
    df = spark.createDataFrame([(1, "abc dea bca"), (2, "zyx wvz xyz"), (3, "漢字")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, model).collect()}
    assert (got[1], got[2]) == ("aa", "bb") and got[3] in ("aa", "bb")


def test_nothing_to_learn_from(spark, docs):
    assert langid.train(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


def test_kernel_is_common_over_geometric_mean():
    m = langid.fit([("x", b"abc"), ("y", b"abd")], landmarks=2)
    grams = lambda s: {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}
    a, b = grams(" abc "), grams(" abd ")
    assert abs(m.kernel([b"abc"])[0][1] - len(a & b) / (len(a) * len(b)) ** 0.5) < 1e-6


@pytest.fixture(scope="module")
def many():
    """(doc_id, text, lang): more rows than any sample took before, texts of a language in sizes of their own, languages of unlike frequency."""
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
    rows = []
    for lang, letters, n in (("aa", "abcdefghij", 1500), ("bb", "fghijklmno", 500), ("cc", "ijklmnopqé", 90)):
        for size in range(20, 20 + n):
            text = " ".join(word(letters) for _ in range(size // 3 + 1)).encode()[:size].decode("utf-8", "ignore")
            rows.append((len(rows), text + "x" * (size - len(text.encode())), lang))
    rng.shuffle(rows)
    return [*rows, (9001, None, "aa"), (9002, "12 34", "aa"), (9003, "abc", None), (None, "abc", "aa")]


def learned_from(rows):
    return [(i, t, lang) for i, t, lang in rows if i is not None and lang is not None and t and any(map(str.isalpha, t)) and zlib.crc32(str(i).encode()) % 4 != 2]


def test_all_labelled_rows_are_learned_from(spark, many):
    df = spark.createDataFrame(many, "doc_id long, text string, lang string")
    model = langid.train(df.repartition(5))
    rows = [(lang, t.encode()) for _, t, lang in learned_from(many)]
    whole = langid.fit(rows)
    assert np.array_equal(model.landmarks, whole.landmarks) and np.allclose(model.weights, whole.weights, rtol=1e-9, atol=1e-9)
    # the ridge regression on all rows at once, each by its kernel's map
    value, vector = np.linalg.eigh(model.kernel([d for _, d in pick(rows, model)]).astype(float))
    to_map = vector / np.sqrt(np.maximum(value, 1e-6 * value.max()))
    phi = model.kernel([d for _, d in rows]) @ to_map
    label = np.array([lang for lang, _ in rows])
    share = np.array([len(rows) / 3 / (label == x).sum() for x in label])[:, None]
    target = np.where(label[:, None] == np.array(model.languages)[None, :], 1.0, -1.0)
    plain = phi @ np.linalg.solve(phi.T @ (share * phi) + langid.RIDGE * np.eye(phi.shape[1]), phi.T @ (share * target))
    assert np.abs(model.kernel([d for _, d in rows]) @ model.weights - plain).max() < 1e-3
    again = langid.train(df.repartition(11))
    assert np.array_equal(model.weights, again.weights)  # bit by bit, whatever the partitions


def pick(rows, model):
    """The landmarks, by brute force: the middles of equal shares by size."""
    each = langid.LANDMARKS // len(model.languages)
    own = [sorted((r for r in rows if r[0] == lang), key=lambda r: len(r[1])) for lang in model.languages]
    return [o[i] for o in own for i in sorted({(2 * k + 1) * len(o) // (2 * each) for k in range(each)})]


def test_floors_come_from_all_labelled_rows(spark, many):
    df = spark.createDataFrame(many, "doc_id long, text string, lang string")
    model = langid.train(df, calibrate=True)
    half = {r.doc_id: r.half for r in langid.labelled(df).select("doc_id", "half").collect()}
    rows = learned_from(many)
    assert sorted(half) == sorted(i for i, _, _ in rows)
    shares = []
    grams = lambda d: [d[i : i + 3] for i in range(len(d) - 2)]
    for turn in (0, 1):
        other = [(lang, t.encode()) for i, t, lang in rows if half[i] == 1 - turn]
        folded = lambda d: b" " + d.translate(langid._FOLD) + b" "
        held = {g for _, d in pick(other, model) for g in grams(folded(d))}
        for i, t, lang in rows:
            if half[i] == turn:
                own = grams(folded(t.encode()))
                shares.append((lang, sum(g in held for g in own) / len(own)))
    for lang, floor in zip(model.languages, model.floors, strict=True):
        low, middle = np.quantile([s for x, s in shares if x == lang], [langid.FLOOR_QUANTILE, 0.5])
        assert abs(floor - (low - max(langid.FLOOR_SLACK * (middle - low), langid.LEAST_SLACK))) < 1e-9


def test_many_rows_of_one_size_and_few_rows(spark):
    same = spark.createDataFrame([(i, "abc", "aa") for i in range(300)] + [(400 + i, "xyz", "bb") for i in range(3)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(same.filter("lang = 'bb'"), langid.train(same, calibrate=True)).collect()} == {"bb"}
    few = langid.train(same.filter("doc_id < 4"), calibrate=True)
    assert few.languages == ["aa"] and few.floors is None
