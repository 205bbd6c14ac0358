import numpy as np
import pytest

from lithos.llm import suffix_dedup


def brute(texts, length):
    rows = [(i, (t or "").encode()) for i, t in texts]
    where = {}
    for i, b in rows:
        if i is not None:
            for k in range(len(b) - length + 1):
                w = b[k : k + length]
                where[w] = min(i, where.get(w, i))
    out = []
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        if i is not None:
            for k in range(len(b) - length + 1):
                if where[b[k : k + length]] < i:
                    gone[k : k + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[4]))


@pytest.mark.parametrize(("length", "blocks", "part"), [(50, 50_000, 3000), (50, 1, 10_000), (30, 4, 1_000_000)])
def test_equals_brute_force(docs, texts, length, blocks, part):
    """Also with names that are sent string by string (blocks=1), and with one part or many."""
    out = suffix_dedup.dedup(docs, length, part_bytes=part, bucket_names=500, sorted_blocks=blocks)
    got = sorted(((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[4]))
    assert got == brute(texts, length)


def test_replaced_text_keeps_columns_and_characters(docs, texts):
    out = suffix_dedup.replace_text(docs)
    assert out.columns == docs.columns
    want = sorted(k.decode("utf-8", "ignore") for _, n, g, _, k in brute(texts, 50) if g == 0 or k)
    assert sorted(r.text for r in out.select("text").collect()) == want


def test_empty_table(no_docs):
    assert suffix_dedup.dedup(no_docs).count() == 0
    assert suffix_dedup.replace_text(no_docs).count() == 0


def test_induced_order_against_strings():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n, length = 40, 6
        text = rng.integers(97, 99, (n, 10)).astype(np.uint8)  # 4 bytes before the anchor, 6 after
        left, right = text[:, 3::-1].copy(), text[:, 4:]
        most = rng.integers(0, 5, n)
        least = np.array([rng.integers(0, m + 1) for m in most])
        for i in range(n):
            left[i, most[i] :] = 0
            right[i, length - least[i] :] = 0
        group, doc = rng.integers(0, 3, n), rng.integers(0, 20, n)
        said = suffix_dedup.induced(group, doc, left, right, least.astype(np.uint8), most.astype(np.uint8), length)
        for i in range(n):
            for o in range(5):
                mine = least[i] <= o <= most[i]
                s = text[i, 4 - o : 10 - o].tobytes()
                want = mine and any(group[j] == group[i] and doc[j] < doc[i] and least[j] <= o <= most[j] and text[j, 4 - o : 10 - o].tobytes() == s for j in range(n))
                assert bool(said[i] >> np.uint64(o) & np.uint64(1)) == bool(want)


def test_input_that_changes_between_readings_is_an_error(spark):
    from pyspark.sql import functions as F

    import uuid

    fresh = F.udf(lambda: uuid.uuid4().hex, "string").asNondeterministic()  # another text at each reading
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("same words again and again "), 9), fresh()).alias("text"))
    with pytest.raises(Exception, match="checkpoint it first"):
        suffix_dedup.dedup(df).collect()
