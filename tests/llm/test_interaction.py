import re
from itertools import permutations

import pytest

from lithos.llm import interaction, queries

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(rows, labels, letters="ABCDE"):
    """rows: (doc_id, text, lang)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    judged = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i,
        }
        judged.append((i, lang or "", fails))
    out = {}
    for part in {p for _, p, _ in judged}:
        own = [(i, f) for i, p, f in judged if p == part]
        for order in map("".join, permutations(letters)):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[x]]
                left = [(i, f) for i, f in left if not f[x]]
                out[part, order, step] = [
                    len(left), len(gone), sum(f[x] for _, f in own) - len(gone), sum(f[x] and sum(f[y] for y in letters) == 1 for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
        for x in letters:
            total = sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == x)
            for (p, o, s), v in out.items():
                if p == part and o[s - 1] == x:
                    v.append(total)
    return {k: tuple(v) for k, v in out.items()}


def collected(df):
    return {(r["part"], r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in df.collect()}


def test_against_brute_force(spark, docs, no_docs, texts):
    langs = ["en", None, "", "de"]
    rows = [(i, t, langs[k % 4]) for k, (i, t) in enumerate(texts)]
    rows += [(200, "COPY " * 120, "en"), (200, "COPY " * 120, "en"), (201, "COPY " * 120, "en"), (None, "COPY " * 120, "en"), (None, "COPY " * 120, None), (300, "word # word", "de"), (299, "word # word", "en")]
    labels = [(20, 1, 0), (20, 0, 1), (21, None, 1), (None, 1, 1), (201, 1, None), (299, 1, 1), (999, 1, 1), (43, 0, 0)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, lang string, mask string, id int")
    marks = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, n string")
    got = collected(interaction.audit(df, marks))
    assert got == brute(rows, labels) and len(got) == 3 * 120 * 5
    assert collected(interaction.audit(df, marks.limit(0), letters="DAB")) == brute(rows, [], "DAB")
    assert interaction.audit(no_docs, marks).count() == 0


def test_query_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    r = c.execute(queries.ORACLE_SQL["op12_interaction"])
    names = [d[0] for d in r.description]
    want = {(x["part"], x["filter_order"], x["step"]): tuple(x[k] for k in COUNTS) for x in (dict(zip(names, row)) for row in r.fetchall())}
    df = queries.op12_interaction(spark, sf)
    assert collected(df) == want and sorted(df.columns) == sorted(names)
    assert df.columns[:3] == ["part", "filter_order", "step"]
