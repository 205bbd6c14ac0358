"""Quality rules as a short-circuit cascade.

Each rule has a cost and a share of documents that it rejects, both estimated
on a sample; rules run in the order of rejection per cost and a document leaves
at the first rule that rejects it. A document is kept when no rule rejects it, so
the order changes the time taken and never the verdict.

Edge cases: a null or empty text has no words and is rejected by ``few_words``; a
text of one huge word or line is one word; repeated rows are judged alike; an empty
table gives no rows (and the rules' given order); other columns take no part.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm.arrow import batch_of, id_and_bytes, pairs

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_LETTERS = bytes(b for b in range(256) if b >= 0x80 or chr(b).isalpha())
#: Rows from which costs and selectivities are estimated.
SAMPLE_ROWS = 512


class Text:
    """A text's measures, each worked out when first asked for."""

    def __init__(self, data: bytes | None):
        self.data = data or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()  # bytes.split splits at SPACE exactly

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.data.translate(None, SPACE + _CONTINUATION))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def n_letters(self) -> int:
        return len(self.data) - len(self.data.translate(None, _LETTERS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.strip(SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))  # noqa: B905
        if len(set(windows)) == len(windows):
            return 0
        found = Counter(windows)
        covered, upto = 0, 0  # words before ``upto`` are counted
        for i, x in enumerate(windows):
            if found[x] > 1:
                covered += i + 3 - max(i, upto)
                upto = i + 3
        return covered


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: The rules that every user of the engine gets; the first two are the base.
BASE = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
RULES = (
    *BASE,
    Rule("symbols", lambda t: 2 * t.n_symbols > t.n_words),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > max(len(t.lines), 4)),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words),
    Rule("few_letters", lambda t: 2 * t.n_letters < t.word_chars),
)


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> list[tuple[str, float, float]]:
    """(rule, mean seconds, share rejected) on at most ``sample_rows`` rows.

    Each rule is timed on fresh texts, so its cost holds the measures it needs.
    """
    schema = pa.schema([("rule", pa.string()), ("seconds", pa.float64()), ("rejected", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x for _, x in pairs(batch)]
            rows = []
            for r in rules:
                began = time.perf_counter()
                hit = sum(r.rejects(Text(x)) for x in texts)
                rows.append((r.name, time.perf_counter() - began, hit, len(texts)))
            yield batch_of(rows, schema)

    n = docs.count()
    part = id_and_bytes(docs.select(F.lit(0).alias("_k"), F.col(text_col).alias("_t")), "_k", "_t")
    if n > 8 * sample_rows:
        part = part.sample(fraction=8 * sample_rows / n, seed=11)
    # by a hash, so that the rows come from all partitions
    found = part.orderBy(F.xxhash64("_t")).limit(sample_rows).mapInArrow(run, "rule string, seconds double, rejected long, n long")
    rows = found.groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r"), F.sum("n").alias("n")).collect()
    return [(x["rule"], x["s"] / max(1, x["n"]), x["r"] / max(1, x["n"])) for x in rows]


def ordered(rules: tuple[Rule, ...], estimates: list[tuple[str, float, float]]) -> tuple[Rule, ...]:
    """Rules by rejection per cost, highest first."""
    worth = {name: share / max(cost, 1e-9) for name, cost, share in estimates}
    return tuple(sorted(rules, key=lambda r: -worth.get(r.name, 0.0)))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, measures: tuple[str, ...] = (), order: tuple[Rule, ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, failed_rule, kept, measures...) for each row.

    ``measures`` are reported for every row and may need work that the verdict alone would not.
    """
    order = order or ordered(rules, estimate(docs, rules, text_col=text_col))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, failed_rule string, kept boolean" + "".join(f", {m} long" for m in measures)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.schema([batch.schema.field("doc_id"), ("failed_rule", pa.string()), ("kept", pa.bool_()), *((m, pa.int64()) for m in measures)])
            rows = []
            for doc_id, data in pairs(batch):
                t = Text(data)
                failed = next((r.name for r in order if r.rejects(t)), None)
                rows.append((doc_id, failed, failed is None, *(getattr(t, m) for m in measures)))
            yield batch_of(rows, out)

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, schema)


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    order = ordered(rules, estimate(docs, rules, text_col=text_col))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            ok = []
            for x in texts:
                s = x.as_py()
                t = Text(s.encode() if s is not None else None)
                ok.append(not any(r.rejects(t) for r in order))
            yield batch.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, schema)
