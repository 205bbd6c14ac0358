import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P

from lithos.llm import packing

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def test_pieces_and_places(docs, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(JSON)
    rows = packing.best_fit_packing(docs, JSON, RANKS, P.PATTERN, capacity=64).collect()
    want = Counter()
    for i, t in texts:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)] if len(ids) > 64 else [0, len(ids)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 64
    assert len(held) <= packing.best_fit(Counter(r.length for r in rows), 64).n_sequences


def test_added_token_goes_through_the_tokenizer(spark):
    df = spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string")
    r = packing.pieces(df, JSON, RANKS, P.PATTERN).first()
    assert r.length == 4 and r.ids_crc32 == zlib.crc32(np.array([64, 50256, 65, 0], "<u4").tobytes())


def test_search_beats_or_equals_best_fit():
    rng = random.Random(1)
    for trial in range(30):
        counts = Counter(rng.randint(1, 100) for _ in range(rng.randint(1, 200)))
        plan = packing.complete(dict(counts), 100)
        used = Counter()
        for filling, m in plan.steps:
            assert sum(filling) <= 100
            for x in filling:
                used[x] += m
        assert used == counts
        assert -(-sum(k * v for k, v in counts.items()) // 100) <= plan.n_sequences <= packing.best_fit(dict(counts), 100).n_sequences


def test_backtracking_finds_what_best_fit_misses():
    # largest-first takes 6+3 and 5+4... ; a perfect packing into three exists
    counts = {6: 1, 5: 2, 4: 1, 3: 2, 2: 2}
    assert packing.complete(counts, 10).n_sequences == 3


def test_empty_table(no_docs):
    assert packing.best_fit_packing(no_docs, JSON, RANKS, P.PATTERN).count() == 0


def exact(counts, capacity):
    """The least number of sequences, by trying every place for every piece."""
    pieces = sorted((x for x, n in counts.items() for _ in range(n)), reverse=True)
    best = len(pieces)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for r in sorted({r for r in rooms if r >= pieces[i]}):
            rest = list(rooms)
            rest.remove(r)
            put(i + 1, [*rest, r - pieces[i]])
        put(i + 1, [*rooms, capacity - pieces[i]])

    put(0, [])
    return best


def test_search_is_exact_on_small_residues():
    rng = random.Random(4)
    searched = 0
    for trial in range(120):
        counts = dict(Counter(rng.randint(12, 55) for _ in range(rng.randint(4, 10))))
        want = exact(counts, 100)
        plan = packing.complete(counts, 100)
        assert plan.bound <= want == plan.n_sequences
        searched += packing.best_fit(counts, 100).n_sequences > want
    assert searched  # best fit alone would have missed some


def test_effort_without_limits_is_exact():
    rng = random.Random(9)
    searched = fewer = 0
    for trial in range(300):
        top = rng.choice([30, 50, 80])
        counts = dict(Counter(rng.randint(top // 8, top - 3) for _ in range(rng.randint(5, 10))))
        want = exact(counts, top)
        plan = packing.complete(counts, top, packing.EXACT)
        used = Counter()
        for filling, m in plan.steps:
            assert sum(filling) <= top
            used.update({x: k * m for x, k in Counter(filling).items()})
        assert used == counts and plan.n_sequences == want
        searched += packing.best_fit(counts, top).n_sequences > want
        fewer += packing.complete(counts, top, packing.Effort(2, 1, 0)).n_sequences > want
    assert searched and fewer  # best fit and little effort would have missed some


def test_the_operator_searches_where_best_fit_misses(spark):
    # lengths 6, 5, 5, 4, 3, 3, 2, 2 in sequences of 10, each with its end token
    rows = [(i, " a" * (n - 1)) for i, n in enumerate((6, 5, 5, 4, 3, 3, 2, 2))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    run = lambda effort: packing.best_fit_packing(df, JSON, RANKS, P.PATTERN, 10, effort).collect()
    got = run(packing.EXACT)
    assert sorted(r.length for r in got) == [2, 2, 3, 3, 4, 5, 5, 6] and len({r.sequence_id for r in got}) == 3
    assert len({r.sequence_id for r in run(packing.Effort())}) == 3 == exact(Counter(r.length for r in got), 10)


def test_many_short_texts():
    for counts in ({1025: 4, 1: 1500}, {1025: 4, 700: 3, 1: 1500}, {1030: 5, 509: 9, 1: 100_000}, {2048: 3, 1: 1}):
        plan = packing.complete(dict(counts), 2048)
        used = Counter()
        for filling, m in plan.steps:
            assert sum(filling) <= 2048
            for x, k in Counter(filling).items():
                used[x] += k * m
        assert used == counts and plan.n_sequences >= plan.bound >= packing.lower_bound(counts, 2048)


def test_long_short_and_repeated_rows(spark):
    long = "word " * 1100
    rows = [(1, long, "x"), (1, long, "y"), (None, long, "x"), (None, None, "x"), (2, long * 3, "x")] + [(3, None if i % 2 else "", "x") for i in range(1500)]
    out = packing.best_fit_packing(spark.createDataFrame(rows, "doc_id long, text string, offset string"), JSON, RANKS, P.PATTERN)
    got = out.collect()
    assert sum(r.length == 1 for r in got) >= 1501 and sum(r.doc_id is None for r in got) == 2
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        ends = [0]
        for o, n in sorted(own):
            assert o == ends[-1]
            ends.append(o + n)
        assert ends[-1] <= 2048
    assert len(held) == packing.lower_bound(Counter(r.length for r in got), 2048)


def test_query_returns_every_piece_of_its_table(spark):
    from lithos.llm import queries

    sf = "/root/testdata/sf0.001"
    got = queries.op8_packing(spark, sf).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(JSON)
    tokens = Counter()
    for r in got:
        tokens[r.doc_id] += r.length
    assert tokens == {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in docs.items()}
    assert len({r.sequence_id for r in got}) - packing.lower_bound(Counter(r.length for r in got), 2048) <= 1
