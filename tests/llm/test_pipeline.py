import random
from collections import Counter

import corpus_pipeline as cp
from pyspark.sql import functions as F

from lithos.session import read_table


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = read_table(spark, sf, "documents")
    at = docs
    seen = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        path = str(tmp_path / f"{k}")
        stage(spark, at, sf).write.parquet(path)
        at = spark.read.parquet(path)
        seen[name] = at
        if k < len(cp.STAGES) - 1:
            assert at.columns == docs.columns
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert ids["quality"] < {r.doc_id for r in docs.select("doc_id").collect()}
    assert ids["packing"] == ids["repeated_passages"] <= ids["near_duplicates"] < ids["language"]
    # exact copies: one of each is left
    left = Counter(r.text for r in seen["near_duplicates"].select("text").collect())
    assert max(left.values()) == 1


def test_empty_and_odd_documents(spark, docs, no_docs):
    for d in (docs, no_docs):
        at = d
        for _, stage in cp.STAGES[:-1]:
            at = stage(spark, at, "")
            assert at.columns == d.columns
        cp.STAGES[-1][1](spark, at, "").count()


FOREIGN = {
    "fi": "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ",
    "pl": "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem ",
    "ru": "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью ",
    "zh": "人人 生而自由 在尊嚴和權利上 一律平等 他們賦有理性 和良心 並應以兄弟關係的精神 相對待 ",
}


def test_language_stage_rejects_unknown_languages(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    clean = cp.quality_stage(spark, docs, "")
    rng = random.Random(5)
    junk = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(120))
    odd = [*(t * 6 for t in FOREIGN.values()), junk("abcdefghijklmnopqrstuvwxyz"), junk("qxzjkvwpbfgh"), junk("etaoinshrdlucmé")]
    rows = spark.createDataFrame([(10_000_000 + i, t, None, "odd", len(t)) for i, t in enumerate(odd)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in cp.language_stage(spark, clean.unionByName(rows.select(*(F.col(c).cast(docs.schema[c].dataType) for c in docs.columns))), "").select("doc_id").collect()}
    assert not [t[:40] for i, t in enumerate(odd) if 10_000_000 + i in kept]
    assert len(kept) == clean.count()


def test_near_duplicates_with_null_and_repeated_ids(spark):
    rng = random.Random(9)
    make = lambda: [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows, groups = [], []
    for g in range(30):
        base = make()
        copies = [base, base[:-1] + ["x"], base[:-2] + ["y", "z"]][: 1 + g % 3]
        own = []
        for c, w in enumerate(copies):
            # a third without an id, a third that share one, a third with their own
            doc_id = (None, 7, 100 + 10 * g + c)[(g + c) % 3]
            own.append((doc_id, " ".join(w), "xx", f"src{c}", len(" ".join(w))))
        rows += own
        groups.append(own)
    rows.append(rows[0])  # equal in all columns
    blank = [(None, "  ", "xx", "s", 2), (7, "\n", "xx", "s", 1), (8, "", "xx", "s", 0), (9, None, "xx", "s", 0)]
    df = spark.createDataFrame(rows + blank, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((tuple(r) for r in cp.near_duplicate_stage(spark, df, "").collect()), key=str)
    first = [min(own, key=lambda r: (r[0] is None, r[0] or 0, r[3])) for own in groups]
    assert got == sorted(first + blank, key=str)


def test_near_duplicates_leave_clashing_columns_alone(spark):
    df = spark.createDataFrame([(None, "a b c d e f", 1, 2), (5, "g h i j k l", 3, 4), (5, "m n o p q r", 5, 6), (6, "m n o p q r", 7, 8)], "doc_id long, text string, _key int, _turn int").selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source", "11L AS n_chars", "_key", "_turn")
    got = sorted((r.doc_id or 0, r.text[0], r._key, r._turn) for r in cp.near_duplicate_stage(spark, df, "").collect())
    assert got == [(0, "a", 1, 2), (5, "g", 3, 4), (5, "m", 5, 6)]
