"""Byte-level BPE by replaying merges over a block of the corpus.

A task gathers the distinct words of a block of texts and indexes every pair of
neighbouring tokens by the word positions where it stands. Merges are then
applied in rank order: each takes its positions from the index, joins the pairs
that are still there, and indexes anew only the two neighbours of each. A word met
again, in this block or a later one, costs a lookup.

Edge cases: a null or empty text has no ids; a text without spaces is one long word
and is replayed like any other; repeated rows get the same ids; an empty table gives no
rows; other columns take no part. The vocabulary must hold all 256 single bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lithos.llm.arrow import batch_of, id_and_bytes, pairs

#: Characters of the texts whose words are gathered before a replay; words remembered by a task; bytes replayed at once.
BLOCK_CHARS, MEMORY_WORDS, REPLAY_BYTES = 4_000_000, 400_000, 2_000_000
#: Texts of these characters alone split alike under the classes of ``re``, which is faster.
_PLAIN_ONLY = re.compile(r"[^\t\n\x0b\x0c\r -~À-ÖØ-öø-ſ]")


@lru_cache(maxsize=4)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of ``pattern`` in a text."""
    full = regex.compile(pattern).findall
    if r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+" not in pattern:
        return full
    plain = pattern.replace(r"[^\s\p{L}\p{N}]+", r"(?:[^\s\w]|_)+").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    fast = re.compile(plain).findall
    odd = _PLAIN_ONLY.search
    return lambda text: full(text) if odd(text) else fast(text)


class Vocabulary:
    """Ranks of byte strings; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        none = np.iinfo(np.int32).max
        self.byte_pairs = np.full((256, 256), none, np.int32)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.byte_pairs[token[0], token[1]] = rank
        self.pair_ranks: dict[int, int] = {}

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def pair_rank(self, a: int, b: int) -> int:
        """The rank of two tokens' joined bytes, or -1."""
        key = a << 32 | b
        got = self.pair_ranks.get(key)
        if got is None:
            got = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
            if len(self.pair_ranks) > 2_000_000:
                self.pair_ranks.clear()
            self.pair_ranks[key] = got
        return got

    def decode(self, ids: bytes) -> bytes:
        """Bytes of ids that are given as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def replay(words: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """The ids of each word, as little-endian unsigned 32-bit integers."""
    text = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    n = len(text)
    token = array("i", vocabulary.byte_ids[text].tobytes())
    after = array("i", np.arange(1, n + 1, dtype=np.int32).tobytes())  # n: none
    before = array("i", np.arange(-1, n - 1, dtype=np.int32).tobytes())
    starts = np.concatenate([[0], ends[:-1]])
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if e > s:
            before[s], after[e - 1] = -1, n
    # the index: places of each pair's left token, by the rank of the pair
    inside = np.ones(max(n - 1, 0), bool)
    inside[ends[(ends > 0) & (ends < n)] - 1] = False
    rank = np.where(inside, vocabulary.byte_pairs[text[:-1], text[1:]], np.iinfo(np.int32).max)
    places = np.flatnonzero(rank != np.iinfo(np.int32).max)
    places = places[np.argsort(rank[places], kind="stable")]
    ranks, first = np.unique(rank[places], return_index=True)
    index = {r: p.tolist() for r, p in zip(ranks.tolist(), np.split(places, first[1:]), strict=True)}
    queue = list(index)
    heapq.heapify(queue)
    pair_rank = vocabulary.pair_rank
    while queue:
        r = heapq.heappop(queue)
        at = index.pop(r)
        at.sort()  # in a word, the leftmost goes first
        for p in at:
            left = token[p]
            q = after[p]
            if left < 0 or q == n or pair_rank(left, token[q]) != r:
                continue
            token[p], token[q] = r, -1
            q = after[p] = after[q]
            if q != n:
                before[q] = p
                k = pair_rank(r, token[q])
                if k >= 0:
                    if k in index:
                        index[k].append(p)
                    else:
                        index[k] = [p]
                        heapq.heappush(queue, k)
            o = before[p]
            if o >= 0:
                k = pair_rank(token[o], r)
                if k >= 0:
                    if k in index:
                        index[k].append(o)
                    else:
                        index[k] = [o]
                        heapq.heappush(queue, k)
    found = np.frombuffer(token, np.int32)
    alive = found >= 0
    ids = found[alive].astype("<u4").tobytes()
    upto = np.concatenate([[0], np.cumsum(alive)])[ends] * 4 if n else np.zeros(len(words), int)
    cuts = [0, *upto.tolist()]
    return [ids[a:b] for a, b in zip(cuts, cuts[1:])]  # noqa: B905


class Encoder:
    """Ids of texts, block by block; words of earlier blocks are remembered up to a bound."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split = vocabulary, splitter(pattern)
        self.known: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        part: list[str] = []
        size = 0
        for w in words:
            part.append(w)
            size += len(w)
            if size >= REPLAY_BYTES:
                self._replay(part)
                part, size = [], 0
        self._replay(part)

    def _replay(self, words: list[str]) -> None:
        if words:
            self.known.update(zip(words, replay([w.encode() for w in words], self.vocabulary), strict=True))

    def block(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        if len(self.known) > MEMORY_WORDS:
            self.known.clear()
        self.learn({w for words in split for w in words}.difference(self.known))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], pa.Field]]:
    """(ids, texts) of rows that hold about BLOCK_CHARS characters together, and the id's field."""
    for batch in batches:
        ids: list = []
        texts: list[str] = []
        size = 0
        for doc_id, data in pairs(batch):
            ids.append(doc_id)
            texts.append((data or b"").decode())
            size += len(texts[-1])
            if size >= BLOCK_CHARS:
                yield ids, texts, batch.schema.field("doc_id")
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts, batch.schema.field("doc_id")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids: little-endian unsigned 32-bit integers) of each row."""
    return _encoded(docs, path, pattern, id_col, text_col, "ids binary", [("ids", pa.binary())], lambda ids, _: (ids,))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: encoded, then decoded from the ids."""
    def digest(ids: bytes, vocabulary: Vocabulary) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(vocabulary.decode(ids)).hexdigest()

    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return _encoded(docs, path, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", fields, digest)


def _encoded(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, ddl: str, fields: list, made: Callable[[bytes, Vocabulary], tuple]) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(path)
        encoder = Encoder(vocabulary, pattern)
        for ids, texts, field in blocks(batches):
            rows = [(doc_id, *made(own, vocabulary)) for doc_id, own in zip(ids, encoder.block(texts), strict=True)]
            yield batch_of(rows, pa.schema([field, *fields]))

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, f"doc_id {id_type}, {ddl}")
