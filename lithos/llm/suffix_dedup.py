"""Removal of repeated byte strings by externally sorted, induced suffix tuples.

A byte goes if a string of ``length`` bytes over it also starts in a document with a
smaller id. Suffixes are not all sorted: each string of ``length`` bytes picks the
smallest name of the ``NAME`` byte strings in it, and only suffixes at such places, the
anchors, become tuples. Like the places that induced sorting starts from, they are
chosen by content alone, so equal strings have equal anchors. Strings that start
between two anchors form the block of the right one, and their order is induced.

1. Names. Texts are packed into parts of some megabytes. Each part sends its distinct
   anchor names, sorted, to buckets by name; a bucket merges the sorted runs and says
   which names stand in two documents or more, and whether their blocks differ.
2. Tuples. For those names each part sends its distinct blocks with its smallest
   document. Equal blocks meet and keep the smallest document of all. Where a name has
   several blocks, its suffixes are sorted, with the common prefix of each with the one
   before; then, one byte to the left at a time, the order and common prefixes of the longer
   suffixes are induced from those of the shorter ones. Neighbours with ``length`` bytes
   in common are the same string.
3. Parts take the verdicts, mark the bytes and cut them out.

Sorted runs and tuples wait in Spark's shuffle files, merged by bucket; the number of
buckets follows the input, so that none needs more than a bounded memory. What a part
sends is distinct within the part, so a passage of a third of all documents costs a
row for each part. A name with very many blocks (a passage's first bytes after many
different words) is not sorted in one bucket: its strings are sent one by one and meet by
their own names of 96 bits and more.

Names and blocks are compared by fingerprint: names in a bucket by 32 bits (a clash
only makes a name be looked at), blocks by 96 bits and the bucket's, with 40 in step 1.

Edge cases: a null text is empty, and texts under ``length`` bytes lose nothing; rows with a
null id neither lose bytes nor cause any to go; rows that share an id don't affect each
other; an empty table gives no rows; all other columns are carried, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from lithos.session import cut

LENGTH, NAME = 50, 16
#: Bytes of text in a part, names in a bucket, blocks of a name that one bucket sorts.
PART_BYTES, BUCKET_NAMES, SORTED_BLOCKS = 2_000_000, 400_000, 50_000
CHANGED = "the input has other rows in its partitions than at the first reading: checkpoint it first"
UNIQUE, ONE_BLOCK, MANY_BLOCKS, BY_STRING = range(4)

_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_LAST = np.iinfo(np.int64).max


def _mix(a: np.ndarray, b: np.ndarray | np.uint64, by: np.uint64 = _B) -> np.ndarray:
    h = a ^ (np.atleast_1d(b) * _A)
    h = (h ^ (h >> _U(29))) * by
    return h ^ (h >> _U(32))


def _zip(data: bytes | np.ndarray) -> bytes:
    raw = data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _unzip(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


class Part:
    """Texts of a part as one byte array, and the blocks of its anchors."""

    def __init__(self, row: dict, length: int):
        text = np.frombuffer(_unzip(row["text"]), np.uint8)
        self.length = length
        self.text = np.concatenate([text, np.zeros(64 + length, np.uint8)])
        self.n = len(text)
        self.ends = np.cumsum(np.frombuffer(row["lengths"], np.int64))
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.no_id = np.frombuffer(row["no_id"], bool)
        self.words = np.ndarray((len(self.text) - 7,), "<u8", buffer=self.text.data, strides=(1,))
        self._blocks()

    def _anchors(self) -> np.ndarray:
        """For each place, the leftmost smallest name among those inside the string that starts there."""
        wide, step = self.length - NAME + 1, 1 << 17
        out = np.zeros(self.n, np.int32)
        for s in range(0, self.n, step):
            m = min(step, self.n - s)
            k = m + wide - 1
            h = _mix(self.words[s : s + k], self.words[s + 8 : s + 8 + k])
            v = (h >> _U(32) << _U(32)) | np.arange(s, s + k, dtype=np.uint64)
            w = 1
            while 2 * w <= wide:
                v = np.minimum(v[:-w], v[w:])
                w *= 2
            if w < wide:
                v = np.minimum(v[: -(wide - w)], v[wide - w :])
            out[s : s + m] = (v[:m] & _U(0xFFFFFFFF)).astype(np.int32)
        return out

    def _blocks(self) -> None:
        ok = np.ones(self.n, bool)
        for s, e, none in zip(self.starts.tolist(), self.ends.tolist(), self.no_id.tolist(), strict=True):
            ok[s if none else max(s, e - self.length + 1) : e] = False
        at = np.flatnonzero(ok)
        anchor = self._anchors()[at]
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        self.first = at[first]
        self.last = at[np.append(first[1:], len(at))[: len(first)] - 1] if len(first) else at[:0]
        self.anchor = anchor[first].astype(np.int64)
        self.doc = self.ids[np.searchsorted(self.ends, self.first, side="right")] if len(first) else np.zeros(0, np.int64)
        name = _mix(_mix(self.words[self.anchor], self.words[self.anchor + 8]), _C, _C)
        span = ((self.last - self.first) * 64 + self.anchor - self.first).astype(np.uint64)
        self.name = name
        self.block = _mix(_mix(self.string(self.first, _B), self.string(self.last, _B), _C), span, _C)

    def string(self, at: np.ndarray, by: np.uint64) -> np.ndarray:
        """A fingerprint of the string that starts at each place."""
        h = _mix(self.words[at], self.words[at + 8], by)
        for o in [*range(16, self.length - 7, 8), self.length - 8]:
            h = _mix(h, self.words[at + o], by)
        return h


def _deal(name: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32-bit name in one sortable number."""
    return ((name >> _U(40)) * _U(buckets) >> _U(24) << _U(32)) | (name & _U(0xFFFFFFFF))


def _slices(dealt: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The rows of each bucket in a sorted array."""
    b = (dealt >> _U(32)).astype(np.int64)
    starts = _firsts(b).tolist()
    for s, e in zip(starts, [*starts[1:], len(b)], strict=False):
        yield int(b[s]), slice(s, e)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a new key begins in sorted arrays."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _names(part: Part, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct dealt names, a block of each, marks (bit 0: two documents, bit 1: two blocks, above: log2 of blocks), and each anchor's name."""
    dealt = _deal(part.name, buckets)
    order = np.lexsort((part.block, dealt))
    d, b, doc = dealt[order], part.block[order], part.doc[order]
    first = _firsts(d)
    if not len(first):
        return d, b, np.zeros(0, np.uint8), np.zeros(0, np.int64)
    two_docs = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    n_blocks = np.add.reduceat(np.concatenate([[1], ((b[1:] != b[:-1]) | (d[1:] != d[:-1])).astype(int)]), first)
    marks = two_docs | (n_blocks > 1) << 1 | np.minimum(np.log2(n_blocks), 63).astype(int) << 2
    which = np.empty(len(d), np.int64)
    which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(d))))
    return d[first], b[first], marks.astype(np.uint8), which


class Classes:
    """A part's instances (blocks, or single strings) of repeated names, and their distinct classes in order."""

    def __init__(self, part: Part, buckets: int, codes: np.ndarray):
        names, _, _, which = _names(part, buckets)
        if len(codes) != len(names):
            raise RuntimeError(CHANGED)
        code = codes[which] if len(which) else np.zeros(0, np.uint8)
        whole = np.flatnonzero((code == ONE_BLOCK) | (code == MANY_BLOCKS))
        single = np.flatnonzero(code == BY_STRING)
        n = part.last[single] - part.first[single] + 1
        at = np.repeat(part.first[single], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.first = np.concatenate([part.first[whole], at])
        self.last = np.concatenate([part.last[whole], at])
        self.anchor = np.concatenate([part.anchor[whole], at])
        self.many = np.concatenate([code[whole] == MANY_BLOCKS, np.zeros(len(at), bool)])
        self.doc = np.concatenate([part.doc[whole], np.repeat(part.doc[single], n)])
        dealt = _deal(np.concatenate([part.name[whole], _mix(part.string(at, _B), _B, _C)]), buckets)
        block = np.concatenate([part.block[whole], part.string(at, _C)])
        order = np.lexsort((self.doc, block, dealt))
        first = _firsts(dealt[order], block[order])
        #: of each class: dealt name, block, smallest document, the instance that has it
        self.sample = order[first]
        self.dealt, self.block, self.least = dealt[self.sample], block[self.sample], self.doc[self.sample]
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))


def induced(group: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, least: np.ndarray, most: np.ndarray, length: int) -> np.ndarray:
    """For each suffix tuple, bit o is set if the string from o bytes before it also occurs with a smaller document in its group.

    left[:, o - 1] is the byte o places before the anchor, right the bytes from it on (0 where
    unknown); strings of a tuple begin ``least`` to ``most`` bytes before its anchor.
    """
    n = len(group)
    said = np.zeros(n, np.uint64)
    if not n:
        return said
    order = np.lexsort((*(right[:, j] for j in range(right.shape[1] - 1, -1, -1)), group))
    g = group[order]
    same = right[order][1:] == right[order][:-1]
    # common prefix of each with the one before, nothing across groups
    common = np.zeros(n + 1, np.int32)
    common[1:n] = np.where(g[1:] == g[:-1], np.where(same.all(axis=1), right.shape[1], same.argmin(axis=1)), 0)
    for o in range(int(most.max()) + 1):
        if o:
            alive = np.flatnonzero(most[order] >= o)
            if not len(alive):
                break
            byte = left[order[alive], o - 1]
            # induced: by the byte before, then in the order of the suffixes so far
            key = g[alive].astype(np.int64) << 8 | byte
            turn = np.argsort(key, kind="stable")
            was, key = alive[turn], key[turn]
            ends = np.empty(2 * len(was), np.int64)
            ends[0], ends[2::2], ends[1::2] = 0, was[:-1] + 1, was + 1
            low = np.minimum.reduceat(common, ends)[::2]
            low[0] = 0
            low[1:][key[1:] != key[:-1]] = -1
            order, g = order[was], g[was]
            common = np.append(low + 1, 0).astype(np.int32)
        first = np.flatnonzero(common[:-1] < length)
        own = np.where((least[order] <= o) & (o <= most[order]), doc[order], _LAST)
        smallest = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(own))))
        hit = order[smallest < own]
        hit = hit[(least[hit] <= o) & (o <= most[hit])]
        said[hit] |= _U(1 << o)
    return said


PART_TYPE = "part long, lengths binary, ids binary, no_id binary, rows binary, text binary"


def parts(docs: DataFrame, id_col: str, text_col: str, part_bytes: int):
    """(rows to pack, function that packs them by their order in the input's partitions)."""
    others = [c for c in docs.columns if c != text_col]
    sent = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t"), F.struct(*others).alias("r"))
    schema = pa.schema([("part", pa.int64()), *((n, pa.binary()) for n in ("lengths", "ids", "no_id", "rows", "text"))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k_of = TaskContext.get().partitionId(), 0
        for b in batches:
            lengths = np.array([len(x) if x is not None else 0 for x in (y.as_buffer() for y in b.column(1))], np.int64)
            turn = np.cumsum(lengths) // part_bytes
            for k in np.unique(turn):
                own = np.flatnonzero(turn == k)
                some = b.slice(own[0], len(own))
                sink = pa.BufferOutputStream()
                rows = pa.RecordBatch.from_arrays([some.column(2)], names=["row"])
                with pa.ipc.new_stream(sink, rows.schema) as w:
                    w.write_batch(rows)
                text = b"".join(x.as_py() or b"" for x in some.column(1))
                ids = some.column(0)
                # the name holds a digest of the part: a later reading that packs other rows gives another name, and is noticed
                made = task << 44 | k_of << 32 | zlib.crc32(text, zlib.crc32(ids.fill_null(0).to_numpy().tobytes()))
                cols = (made, lengths[own].tobytes(), ids.fill_null(0).to_numpy().tobytes(), np.asarray(ids.is_null()).tobytes(), _zip(sink.getvalue().to_pybytes()), _zip(text))
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)
                k_of += 1

    return sent, pack


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split(" ") for x in ddl.split(", "))])


RUN = "bucket int, part long, names binary, blocks binary, marks binary"
SAID = "part long, bucket int, kind int, codes binary, places binary, masks binary"
TUPLES = "bucket int, part long, names binary, blocks binary, docs binary, many binary, context binary"


def _merge_names(run: pa.Table, sorted_blocks: int) -> list[tuple]:
    """Codes for the names of each part's run in one bucket."""
    rows = run.to_pylist()
    names = np.concatenate([np.frombuffer(r["names"], np.uint32) for r in rows])
    blocks = np.zeros((len(names), 8), np.uint8)
    blocks[:, :5] = np.concatenate([np.frombuffer(r["blocks"], np.uint8) for r in rows]).reshape(-1, 5)
    blocks = blocks.view("<u8")[:, 0]
    marks = np.concatenate([np.frombuffer(r["marks"], np.uint8) for r in rows])
    order = np.argsort(names, kind="stable")  # the runs are sorted, so this merges
    n, b, m = names[order], blocks[order], marks[order]
    first = _firsts(n)
    count = np.diff(np.append(first, len(n)))
    repeated = (count > 1) | (np.bitwise_or.reduceat(m, first) & 1 > 0)
    differ = (np.minimum.reduceat(b, first) != np.maximum.reduceat(b, first)) | (np.bitwise_or.reduceat(m, first) & 2 > 0)
    n_blocks = np.add.reduceat(np.left_shift(1, (m >> 2).astype(np.int64)), first)
    code = np.where(repeated, np.where(differ, np.where(n_blocks > sorted_blocks, BY_STRING, MANY_BLOCKS), ONE_BLOCK), UNIQUE)
    codes = np.empty(len(n), np.uint8)
    codes[order] = np.repeat(code, count)
    out, at = [], 0
    for r in rows:
        to = at + len(r["names"]) // 4
        out.append((r["part"], r["bucket"], 1, _zip(codes[at:to]), None, None))
        at = to
    return out


def _merge_tuples(run: pa.Table, length: int) -> list[tuple]:
    """For each part's classes in one bucket: whether a smaller document has the class elsewhere, and strings that smaller documents have."""
    rows = run.to_pylist()
    names = np.concatenate([np.frombuffer(r["names"], np.uint32) for r in rows])
    blocks = np.concatenate([np.frombuffer(r["blocks"], np.uint64) for r in rows])
    docs = np.concatenate([np.frombuffer(r["docs"], np.int64) for r in rows])
    many = np.concatenate([np.frombuffer(r["many"], bool) for r in rows])
    wide = length - NAME  # bytes before an anchor at most
    shape = wide + length + 2
    context = np.zeros((len(names), shape), np.uint8) if many.any() else None
    if context is not None:
        context[many] = np.frombuffer(b"".join(_unzip(r["context"]) for r in rows), np.uint8).reshape(-1, shape)
    order = np.lexsort((docs, blocks, names))
    first = _firsts(names[order], blocks[order])
    sizes = np.diff(np.append(first, len(order)))
    lower = np.zeros(len(names), bool)
    lower[order] = np.repeat(docs[order[first]], sizes) < docs[order]
    masks = np.zeros(len(names), np.uint64)
    if context is not None:
        lead = order[first]
        lead = lead[many[lead]]
        c = context[lead]
        group = np.unique(names[lead], return_inverse=True)[1]
        masks[lead] = induced(group, docs[lead], c[:, 2 : 2 + wide], c[:, 2 + wide :], c[:, 0], c[:, 1], length)
        # equal classes with the same smallest document (rows that share an id) are told alike
        masks[order] = np.where(lower[order], 0, np.repeat(masks[order[first]], sizes))
    out, at = [], 0
    for r in rows:
        to = at + len(r["names"]) // 4
        places = np.flatnonzero(masks[at:to])
        out.append((r["part"], r["bucket"], 2, _zip(np.packbits(lower[at:to])), places.astype(np.uint32).tobytes(), masks[at:to][places].tobytes()))
        at = to
    return out


def _codes(said: list[dict]) -> np.ndarray:
    own = sorted((r for r in said if r["kind"] == 1), key=lambda r: r["bucket"])
    return np.frombuffer(b"".join(_unzip(r["codes"]) for r in own), np.uint8)


def _verdicts(classes: Classes, said: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(lower, mask) of each class."""
    by = {r["bucket"]: r for r in said if r["kind"] == 2}
    lower, masks = np.zeros(len(classes.dealt), bool), np.zeros(len(classes.dealt), np.uint64)
    for bucket, own in _slices(classes.dealt):
        r = by[bucket]
        n = own.stop - own.start
        lower[own] = np.unpackbits(np.frombuffer(_unzip(r["codes"]), np.uint8))[:n].astype(bool)
        masks[own.start + np.frombuffer(r["places"], np.uint32).astype(np.int64)] = np.frombuffer(r["masks"], np.uint64)
    return lower, masks


def _covered(part: Part, classes: Classes, lower: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which bytes of a part go."""
    edge = np.zeros(part.n + 1, np.int32)
    mine = classes.which
    gone = lower[mine] | (classes.doc > classes.least[mine])
    np.add.at(edge, classes.first[gone], 1)
    np.add.at(edge, classes.last[gone] + part.length, -1)
    some = np.flatnonzero(~gone & (masks[mine] != 0))
    for o in range(part.length - NAME + 1):
        hit = some[(masks[mine[some]] >> _U(o) & _U(1)) > 0]
        at = classes.anchor[hit] - o
        np.add.at(edge, at, 1)
        np.add.at(edge, at + part.length, -1)
    return np.cumsum(edge[:-1]) > 0


def _same_parts(own: pa.Table, said: pa.Table) -> None:
    """Verdicts on a part that isn't there mean that the input gave other rows than before; better no result than a wrong one."""
    if said.num_rows and not own.num_rows:
        raise RuntimeError(CHANGED)


def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, bucket_names: int = BUCKET_NAMES, sorted_blocks: int = SORTED_BLOCKS, as_text: bool = False) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept) of each document; ``row`` holds the input's other columns, ``kept`` the remaining bytes (or, ``as_text``, their whole characters).

    ``docs`` is read three times and must give the same rows in the same partitions each
    time, as files do; if it doesn't, the job fails: checkpoint it first. ``length`` is 24 to 79.
    """
    if not 24 <= length <= NAME + 63:
        raise ValueError("length must be from 24 to 79")
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    buckets = max(8, -(-total // (bucket_names * (length - NAME) // 2)))
    sent, pack = parts(docs, id_col, text_col, part_bytes)
    packed = sent.mapInArrow(pack, PART_TYPE)
    run_schema, said_schema, tuple_schema = _schema(RUN), _schema(SAID), _schema(TUPLES)

    def send_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pack(batches):  # in one worker: two of them in a row would hold twice the memory
            for row in b.to_pylist():
                dealt, block, marks, _ = _names(Part(row, length), buckets)
                five = (block >> _U(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                rows = [(k, row["part"], (dealt[s] & _U(0xFFFFFFFF)).astype(np.uint32).tobytes(), five[s].tobytes(), marks[s].tobytes()) for k, s in _slices(dealt)]
                yield from _table(rows, run_schema).to_batches()

    names = sent.mapInArrow(send_names, RUN).groupBy("bucket").applyInArrow(lambda t: _table(_merge_names(t, sorted_blocks), said_schema), SAID)
    names = cut(names)
    wide = length - NAME

    def send_tuples(own: pa.Table, said: pa.Table) -> pa.Table:
        _same_parts(own, said)
        rows = []
        for row in own.to_pylist():
            part = Part(row, length)
            c = Classes(part, buckets, _codes(said.to_pylist()))
            x = c.sample
            anchor, many = c.anchor[x], c.many[x]
            for k, s in _slices(c.dealt):
                at, some = anchor[s], many[s]
                a = at[some]
                first, last = c.first[x[s][some]], c.last[x[s][some]]
                context = np.zeros((len(a), wide + length + 2), np.uint8)
                context[:, 0], context[:, 1] = a - last, a - first
                back = np.arange(1, wide + 1)
                reach = back[None, :] <= (a - first)[:, None]
                context[:, 2 : 2 + wide] = np.where(reach, part.text[np.maximum(a[:, None] - back[None, :], 0)], 0)
                on = np.arange(length)
                reach = a[:, None] + on[None, :] < (last + length)[:, None]
                context[:, 2 + wide :] = np.where(reach, part.text[a[:, None] + on[None, :]], 0)
                rows.append((k, row["part"], (c.dealt[s] & _U(0xFFFFFFFF)).astype(np.uint32).tobytes(), c.block[s].tobytes(), c.least[s].tobytes(), some.tobytes(), _zip(context)))
        return _table(rows, tuple_schema)

    tuples = packed.groupBy("part").cogroup(names.groupBy("part")).applyInArrow(send_tuples, TUPLES)
    told = tuples.groupBy("bucket").applyInArrow(lambda t: _table(_merge_tuples(t, length), said_schema), SAID)

    row_type = StructType([f for f in docs.schema.fields if f.name != text_col])
    out_type = StructType([StructField("row", row_type), *(StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")), StructField("kept", StringType() if as_text else BinaryType())])

    def finish(own: pa.Table, said: pa.Table) -> pa.Table:
        _same_parts(own, said)
        found = []
        for row in own.to_pylist():
            part = Part(row, length)
            verdicts = said.to_pylist()
            c = Classes(part, buckets, _codes(verdicts))
            gone = _covered(part, c, *_verdicts(c, verdicts))
            rows = pa.ipc.open_stream(_unzip(row["rows"])).read_all()
            removed, spans, kept = [], [], []
            for s, e in zip(part.starts.tolist(), part.ends.tolist(), strict=True):
                g = gone[s:e]
                removed.append(int(g.sum()))
                spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if e > s else 0)
                kept.append((part.text[s:e][~g] if removed[-1] else part.text[s:e]).tobytes())
            cols = [rows.column("row"), pa.array(part.ends - part.starts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([x.decode("utf-8", "ignore") for x in kept] if as_text else kept, pa.string() if as_text else pa.binary())]
            found.append(pa.Table.from_arrays(cols, names=["row", "n_bytes", "n_removed", "n_spans", "kept"]))
        return pa.concat_tables(found) if found else _table([], pa.schema([]))

    return packed.groupBy("part").cogroup(names.unionByName(told).groupBy("part")).applyInArrow(finish, out_type)


def replace_text(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the remaining text; rows that lost all of their text go.

    Bytes of a character that was cut through are left out.
    """
    done = dedup(docs, length, id_col, text_col, as_text=True)
    cols = [F.col("kept").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return done.filter((F.col("n_removed") == 0) | (F.length("kept") > 0)).select(*cols)
