import random

import pytest

#: Names that the operators use themselves, as columns of the input.
CLASHING = ("part", "bucket", "names", "kind", "set", "n", "a", "b", "row", "rows", "key", "shard", "slot", "kept", "length", "piece", "label", "words", "_k", "_t", "virtual_slot", "size", "n_bytes", "span", "leaf", "salt")


def sentences(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlucmé") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): nulls, empty and long texts, repeated rows, near copies, shared passages."""
    rng = random.Random(3)
    base = [sentences(rng, rng.randint(60, 160)) for _ in range(12)]
    passage = sentences(rng, 60)
    out = [(None, base[0]), (1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, "Word"), (6, "one two three"), (7, "a" * 3000), (8, "a" * 3001), (9, "ab" * 900), (10, "ünïcode ß漢字 \x00 text <|end|> </s> \\ [INST]")]
    for i, t in enumerate(base):
        out.append((20 + i, t))
    out += [(40, base[1]), (41, base[1]), (41, base[1]), (42, base[2].upper())]
    w = base[3].split()
    out.append((43, " ".join(w[:30] + ["changed"] + w[31:])))
    out.append((44, " ".join(w[:-1])))
    out += [(50 + i, sentences(rng, 20) + " " + passage + " " + sentences(rng, 15)) for i in range(4)]
    out.append((60, "x y z " * 100))
    out.append((61, "\n".join(["same line here"] * 40)))
    out.append((62, sentences(rng, 4000)))
    out.append((63, "*** $$$ ### " * 40))
    out.append((64, "12 345 6789"))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "xx", "src0", len(t or ""), *("z" for _ in CLASHING)) for i, t in texts]
    ddl = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, ddl).coalesce(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
