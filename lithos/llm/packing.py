"""Best-fit packing by bin completion with branch and bound.

Documents are encoded and cut into pieces of at most ``capacity`` tokens. Only the
number of pieces of each length matters to a packing, so the search runs on that
histogram, whose size is the capacity's and not the data's: around the largest
piece left it enumerates undominated fillings, takes the best fitting one as many
times as the counts allow, and goes back to another filling, or to fewer of one, when the waste so far
exceeds what the incumbent leaves. It ends when a packing meets the lower bound, when all have been tried, or with the
incumbent when its ``Effort`` is spent: then the number of sequences
may be above the least possible, never the pieces incomplete; ``Plan.bound`` tells by how much
at most. ``EXACT`` is effort without limits: it finds the least number, in a time that may grow exponentially with the lengths. Pieces are then numbered within their length and each finds its sequence and place in
the plan's intervals.

Edge cases: a null or empty text is the end token alone, and any number of them is packed; repeated
rows are packed as rows of their own, and so are rows with a null id; very long texts are cut; an
empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithos.llm.arrow import batch_of, id_and_bytes
from lithos.llm.bpe import MEMORY_WORDS, Vocabulary, blocks, splitter
from lithos.session import cut

CAPACITY = 2048
#: Pieces of a length that are numbered in one task, about.
TASK_PIECES = 2_000_000


@dataclass(frozen=True)
class Effort:
    """What a search may spend; None is without limit."""

    #: Places looked at for the fillings around a piece.
    nodes: int | None = 1_000
    #: Alternatives kept of these.
    kept: int | None = 8
    #: Steps back in all.
    backtracks: int | None = 200


EXACT = Effort(None, None, None)


class _Words(dict):
    """The ids of words, encoded when first met."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=Vocabulary.load(path).ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word: str) -> bytes:
        if len(self) > MEMORY_WORDS:
            self.clear()
        own = self[word] = np.array(self.encode(word.encode()), "<u4").tobytes()
        return own


@lru_cache(maxsize=2)
def _added_tokens(json_path: str) -> tuple[str, ...]:
    """The strings that the tokenizer takes for single tokens."""
    with open(json_path, encoding="utf-8") as f:
        return tuple(x["content"] for x in json.load(f)["added_tokens"])


@lru_cache(maxsize=2)
def _tokenizer(json_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


def pieces(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end token, cut if longer than ``capacity``.

    The tokenizer's own words and merges are used through the faster rank file of the
    same vocabulary; texts that hold one of its added tokens go through the tokenizer.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, split = _Words(ranks_path, pattern), splitter(pattern)
        added = _added_tokens(json_path)
        end = np.array([end_id], "<u4").tobytes()
        for ids, texts, id_field in blocks(batches):
            rows = []
            for doc_id, text in zip(ids, texts, strict=True):
                if any(a in text for a in added):
                    own = np.array(_tokenizer(json_path).encode(text, add_special_tokens=False).ids, "<u4").tobytes() + end
                else:
                    own = b"".join(map(words.__getitem__, split(text))) + end
                n = len(own) // 4
                at, k = 0, 0
                while at < n:  # the first piece takes what is over
                    to = at + (capacity if k else n % capacity or capacity)
                    rows.append((doc_id, k, at, to - at, zlib.crc32(own[4 * at : 4 * to])))
                    at, k = to, k + 1
            yield batch_of(rows, pa.schema([id_field, ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


@dataclass
class Plan:
    """Fillings with the number of sequences that take each."""

    capacity: int
    steps: list[tuple[tuple[int, ...], int]] = field(default_factory=list)
    #: No packing has fewer sequences.
    bound: int = 0

    @property
    def n_sequences(self) -> int:
        return sum(m for _, m in self.steps)

    def intervals(self) -> tuple[np.ndarray, ...]:
        """Sorted keys (length, first rank) and, for each, first sequence, first offset and pieces a sequence.

        A length limits a step at most capacity / length times, so there are at most
        about capacity * ln(capacity) steps, whatever the number of documents.
        """
        taken: dict[int, int] = {}
        rows = []
        base = 0
        for filling, m in self.steps:
            offset = 0
            for length in sorted(set(filling), reverse=True):
                k = filling.count(length)
                first = taken.get(length, 0)
                rows.append((length << 44 | first, base, offset, k))
                taken[length] = first + k * m
                offset += k * length
            base += m
        rows.sort()
        return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4


class _Counts:
    """Pieces left of each length."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: v for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.counts)

    def change(self, filling: tuple[int, ...], m: int) -> None:
        for x in filling:
            had = self.counts.get(x, 0)
            now = had + m
            if now:
                self.counts[x] = now
                if not had:
                    self.lengths.insert(bisect_right(self.lengths, x), x)
            else:
                del self.counts[x]
                self.lengths.remove(x)

    def times(self, filling: tuple[int, ...]) -> int:
        return min(self.counts[x] // filling.count(x) for x in set(filling))


def _covers(larger: tuple[int, ...], pieces: tuple[int, ...]) -> bool:
    """True if the pieces can be dealt into holes of the larger ones' lengths, as far as largest-first dealing finds it."""
    holes = list(larger)
    for x in pieces:
        i = min((i for i, h in enumerate(holes) if h >= x), key=lambda i: holes[i], default=None)
        if i is None:
            return False
        holes[i] -= x
    return True


def _order(option: tuple[int, tuple[int, ...]]) -> tuple:
    waste, filling = option
    return waste, len(filling), filling


def fillings(left: _Counts, capacity: int, effort: Effort = Effort(), allowed: int | None = None) -> list[tuple[int, tuple[int, ...]]]:
    """Undominated fillings around the largest piece: (waste, lengths), best first.

    A place of the search chooses how many pieces of one length go in, the most first, so its depth is that of
    different lengths and the first filling is the best-fit one. Fillings that waste more than ``allowed`` don't
    count. One filling dominates another if the other's pieces can be dealt into the places of its pieces:
    whatever packs the rest with the other does so with it.
    """
    top = left.lengths[-1]
    have = lambda x: left.counts[x] - (x == top)
    found: dict[tuple[int, ...], int] = {}
    stack: list[tuple[int, int, int, tuple[tuple[int, int], ...]]] = []

    def go_on(room: int, i: int, chosen: tuple[tuple[int, int], ...]) -> None:
        i = min(i, bisect_right(left.lengths, room) - 1)
        while i >= 0 and not have(left.lengths[i]):
            i -= 1
        if i >= 0:
            x = left.lengths[i]
            stack.append((room, i, min(room // x, have(x)), chosen))
            return
        used = dict(chosen)
        spare = next((x for x in left.lengths if x > room or have(x) > used.get(x, 0)), capacity + 1)
        if spare > room and (allowed is None or room <= allowed):  # nothing more fits
            found[(top, *(x for x, m in chosen for _ in range(m)))] = room

    go_on(capacity - top, len(left.lengths) - 1, ())
    seen = 0
    while stack and (effort.nodes is None or seen < effort.nodes):
        seen += 1
        room, i, m, chosen = stack.pop()
        if m:
            stack.append((room, i, m - 1, chosen))
        x = left.lengths[i]
        go_on(room - m * x, i - 1, (*chosen, (x, m)) if m else chosen)
    out: list[tuple[int, tuple[int, ...]]] = []
    for waste, filling in sorted(((w, f) for f, w in found.items()), key=_order):
        if not any(_covers(f[1:], filling[1:]) for _, f in out):
            out.append((waste, filling))
        if len(out) == effort.kept:
            break
    return out


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: by the total, and by pieces over half and what can't go beside them."""
    best = -(-sum(k * v for k, v in counts.items()) // capacity)
    for least in {0, *(k for k in counts if 2 * k <= capacity)}:
        alone = sum(v for k, v in counts.items() if k > capacity - least)
        half = [(k, v) for k, v in counts.items() if 2 * k > capacity and k <= capacity - least]
        small = sum(k * v for k, v in counts.items() if k >= max(least, 1) and 2 * k <= capacity)
        over = small - sum((capacity - k) * v for k, v in half)
        best = max(best, alone + sum(v for _, v in half) + max(0, -(-over // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """The first incumbent: each sequence takes the largest piece that fits, again and again."""
    left, plan = _Counts(counts), Plan(capacity)
    while left.lengths:
        filling = _largest_first(left, capacity)
        m = left.times(filling)
        plan.steps.append((filling, m))
        left.change(filling, -m)
    return plan


def _largest_first(left: _Counts, capacity: int) -> tuple[int, ...]:
    room, chosen = capacity, []
    i = len(left.lengths) - 1
    while i >= 0:
        x = left.lengths[i]
        k = min(room // x, left.counts[x])
        chosen += [x] * k
        room -= k * x
        i = min(i - 1, bisect_right(left.lengths, room) - 1)
    return tuple(chosen)


def complete(counts: dict[int, int], capacity: int = CAPACITY, effort: Effort = Effort()) -> Plan:
    """The best packing found of the pieces, given how many there are of each length.

    Fillings around one length are taken in their order, each as often as possible first, then less often: so every
    set of undominated fillings is met once.
    """
    total = sum(k * v for k, v in counts.items())
    least = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    best.bound = least
    left = _Counts(counts)
    path: list[tuple[tuple[int, ...], int, Iterator]] = []
    waste = back = 0
    allowed = (best.n_sequences - 1) * capacity - total

    def choices(options: list[tuple[int, tuple[int, ...]]]) -> Iterator[tuple[tuple[int, ...], int, int]]:
        """(filling, times, waste each): all as often as they go, then each less often."""
        most = []
        for w, f in options:
            # a filling that is taken m times wastes m times as much
            m = left.times(f) if not w else min(left.times(f), (allowed - waste) // w)
            most.append(m)
            if m > 0:
                yield f, m, w
        for (w, f), upto in zip(options, most, strict=True):
            for m in range(upto - 1, 0, -1):
                yield f, m, w

    while best.n_sequences > least:
        if left.lengths:
            options = fillings(left, capacity, effort, allowed=allowed - waste)
            if path and path[-1][0][0] == left.lengths[-1]:
                last = path[-1][0]
                options = [x for x in options if _order(x) > (capacity - sum(last), len(last), last)]
            now = choices(options)
        else:
            found = Plan(capacity, [(f, m) for f, m, _ in path], least)
            if found.n_sequences < best.n_sequences:
                best = found
                allowed = (best.n_sequences - 1) * capacity - total
            now = iter(())
        while True:
            step = next(((f, m, w) for f, m, w in now if waste + w * m <= allowed), None)
            if step is not None:
                f, m, w = step
                path.append((f, m, now))
                left.change(f, -m)
                waste += w * m
                break
            if not path or (effort.backtracks is not None and back >= effort.backtracks):
                return best
            back += 1
            f, m, now = path.pop()
            left.change(f, m)
            waste -= (capacity - sum(f)) * m
    return best


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, effort: Effort = Effort()) -> DataFrame:
    """The pieces with their sequence_id and offset.

    ``cut_pieces`` is read more than once, so it should be a table or a checkpoint.
    """
    spark = cut_pieces.sparkSession
    # a length that many documents share is dealt out over salts before it is numbered
    salts = max(16, cut_pieces.count() // TASK_PIECES)
    dealt = cut_pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = dealt.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    # at most a row for each length comes to the driver; the salts' shares stay a table
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    running = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    plan = complete(counts, capacity, effort)
    shared = spark.sparkContext.broadcast(plan.intervals())  # bounded by the capacity
    w = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_n", F.row_number().over(w)).join(first, ["length", "_salt"])
    ranked = ranked.select(*cut_pieces.columns, (F.col("_before") + F.col("_n") - 1).alias("_rank"))
    schema = cut_pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, base, offset, each = shared.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            i = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            past = rank - (keys[i] & ((1 << 44) - 1))
            cols = {n: batch.column(k) for k, n in enumerate(batch.schema.names) if n != "_rank"}
            cols["sequence_id"] = pa.array(base[i] + past // each[i])
            cols["offset"] = pa.array(offset[i] + past % each[i] * length)
            yield pa.RecordBatch.from_pydict(cols)

    return ranked.mapInArrow(run, schema)


def best_fit_packing(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, capacity: int = CAPACITY, effort: Effort = Effort()) -> DataFrame:
    """Pieces of all documents, packed."""
    return pack(cut(pieces(docs, json_path, ranks_path, pattern, capacity)), capacity, effort)
