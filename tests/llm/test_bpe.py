import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest

from lithos.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.Vocabulary.load(PATH).ranks, special_tokens={})


def test_equals_the_library_and_round_trips(docs, texts, library):
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH, P.PATTERN).collect())
    want = []
    for _, t in texts:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_odd_texts(library):
    rng = random.Random(5)
    odd = ["", " ", "  a", "a  ", "aaaa" * 50, "'ll'LL'", "x\x85y\x1cz ", "²³½ⅷ", "é", "漢字かな", "\U0001f600\U0001f600", "\x00\x00", "_a_b__", "ﬁ ﬂ", "İı", "a b"]
    letters = "etaoin shrdlu'\n\t019.,;é漢½"
    odd += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    encoder = bpe.Encoder(bpe.Vocabulary.load(PATH), P.PATTERN)
    for text, ids in zip(odd, encoder.block(odd)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text
        assert encoder.vocabulary.decode(ids) == text.encode()


def test_encode_and_empty(spark, no_docs, library):
    df = spark.createDataFrame([(1, "Hello world")], "doc_id long, text string")
    assert np.frombuffer(bpe.encode(df, PATH, P.PATTERN).first().ids, "<u4").tolist() == library.encode_ordinary("Hello world")
    assert bpe.round_trip(no_docs, PATH, P.PATTERN).count() == 0
