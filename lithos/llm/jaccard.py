"""Exact n-gram Jaccard join by skipping with set relations.

Documents become sets of distinct word n-grams; documents with one set are one class.
Two sets link when 100 * intersection >= ``percent`` * union.

Candidates come from a prefix index: with the n-grams in one order for all, two sets
that link share one in the first part of each. The order is by frequency, rare first,
as counted over all documents in a table of fixed size, then by fingerprint. An index
list holds (set, size, position) in blocks of one size, sorted by position. For an entry, blocks
too far in size are skipped whole, and in the others the positions that leave room for the overlap
that is needed are one range, which is found by binary search: no other pair is formed.

Answers are derived from those of similar sets. A list's sets are first compared with a
pivot of it only; sets that the pivot links are one component, and their common answers
need no comparing. What is left after some pivots, pairs of a list in different
components, is compared in full, so no link between components is lost.

A pair is first held against bit vectors of its sets (a bit for each n-gram's parity,
so differing bits bound the difference from below), then counted exactly.

Edge cases: a null text, an empty one or one without words has no n-grams and is linked
with nothing; a text with fewer words is one n-gram of all its words; repeated rows are
one class; rows with a null id take part and have the component of their class; an empty
table gives no rows; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.graph import connected_components
from lithos.llm.arrow import batch_of, id_and_bytes, pairs
from lithos.session import cut

WORDS, PERCENT = 5, 75
#: Counters of the frequency table (4 bytes each; it is broadcast), bits of the filter of ids that are fetched again.
COUNTERS, FILTER_BITS = 1 << 22, 1 << 23
#: Postings of a bucket; sets of a list that are compared at once; pivots tried on longer lists.
BUCKET_POSTINGS, SHORT_LIST, PIVOTS = 2_000_000, 8, 2
#: Sets of a cell that a task compares with others at once, on either side.
CELL_SETS = 20_000
#: Documents whose postings a task gathers before sending.
BLOCK_POSTINGS = 1_000_000
#: Rows of pairs, entries or sets that a task works on, about; small tables are kept in few partitions.
TASK_ROWS = 10_000

_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, (32, 256), np.uint64).ravel()


def _final(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _B
    h = (h ^ (h >> _U(27))) * _C
    return h ^ (h >> _U(31))


def ngrams(data: bytes | None, k: int = WORDS) -> np.ndarray:
    """Sorted 64-bit fingerprints of a text's distinct word n-grams."""
    none = np.zeros(0, np.uint64)
    if not data:
        return none
    b = np.frombuffer(data.translate(_LOWER), np.uint8)
    edge = np.ones(len(b) + 2, bool)
    edge[1:-1] = _SPACE[b]
    turn = np.flatnonzero(edge[1:] != edge[:-1])
    start, end = turn[::2], turn[1::2]
    if not len(start):
        return none
    size = end - start
    total = np.cumsum(size)
    place = np.arange(total[-1]) - np.repeat(total - size, size)  # of each byte in its word
    value = _BYTE_VALUES[(place & 31) << 8 | b[~edge[1:-1]]]
    if size.max() > 32:
        value = value * ((place >> 5) * 2 + 1).astype(np.uint64)
    word = _final(np.add.reduceat(value, total - size) + size.astype(np.uint64) * _A)
    n = min(k, len(word))
    h = np.full(len(word) - n + 1, _U(n))
    for i in range(n):
        h = (h ^ (h >> _U(29))) * _A + word[i : len(word) - n + 1 + i]
    return np.unique(_final(h))


def set_id(grams: np.ndarray) -> int:
    """A name for a set, the same wherever the set occurs; 0 for the empty one."""
    if not len(grams):
        return 0
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True) or 1


def parity_bits(grams: np.ndarray) -> bytes:
    """A bit for each n-gram's parity in a vector of about two bits an n-gram, a power of two of them."""
    m = 64
    while m < 2 * len(grams):
        m *= 2
    odd = np.bincount((grams & _U(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """At least so many n-grams are in one set only."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) > len(b):
        a, b = b, a
    if len(b) > len(a):
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def prefix(grams: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The n-grams of which a linked set must share one, in the common order."""
    n = len(grams)
    keep = n - (percent * n + 99) // 100 + 1
    count = counts[(grams & _U(len(counts) - 1)).astype(np.int64)]
    if keep < n // 2:
        most = np.partition(count, keep - 1)[keep - 1]
        some = count <= most
        grams, count = grams[some], count[some]
    return grams[np.lexsort((grams, count))[:keep]]


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection with which sets of these sizes link."""
    return -(-percent * (n + m) // (100 + percent))


STATS = "kind int, doc_id long, n long, set long, bits binary, block int, counts binary"


def _statistics(docs: DataFrame, words: int, counters: int) -> DataFrame:
    """Rows of kind 0: each document's set; of kind 1: a task's n-gram counts, in blocks."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("set", pa.int64()), ("bits", pa.binary()), ("block", pa.int32()), ("counts", pa.binary())])
    step = min(counters, 1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(counters, np.uint32)
        for batch in batches:
            rows = []
            for doc_id, data in pairs(batch):
                g = ngrams(data, words)
                np.add.at(counts, (g & _U(counters - 1)).astype(np.int64), 1)
                rows.append((0, doc_id, len(g), set_id(g), parity_bits(g) if len(g) else None, None, None))
            yield batch_of(rows, schema)
        codec = pa.Codec("zstd", compression_level=1)
        for k in range(counters // step):
            own = counts[k * step : (k + 1) * step]
            if own.any():
                yield batch_of([(1, None, None, None, None, k, codec.compress(own.tobytes(), asbytes=True))], schema)

    return id_and_bytes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, STATS)


def _counts(stats: DataFrame, counters: int) -> np.ndarray:
    """The frequency table: sums of the tasks' counts. Its size is fixed."""
    step = min(counters, 1 << 16)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(pa.decompress(data.as_py(), step * 4, codec="zstd", asbytes=True), np.uint32)
                total[k] = total[k] + own if k in total else own.copy()
        yield batch_of([(k, v.tobytes()) for k, v in total.items()], pa.schema([("block", pa.int32()), ("counts", pa.binary())]))

    out = np.zeros(counters, np.uint32)
    sums = stats.filter("kind = 1").select("block", "counts").repartition(counters // step, "block").mapInArrow(add, "block int, counts binary")
    for r in sums.toLocalIterator():
        out[r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(r["counts"], np.uint32)
    return out


POSTINGS = "bucket int, sets binary, sizes binary, each binary, grams binary, places binary"


def _postings(docs: DataFrame, counts: np.ndarray, words: int, percent: int, buckets: int) -> DataFrame:
    """Packed prefix postings by bucket: for each set its number of postings, then 32-bit names and positions."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    schema = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("sets", "sizes", "each", "grams", "places"))])

    def pack(held: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch:
        sets = np.array(list(held), np.int64)
        sizes = np.array([n for n, _ in held.values()], np.uint32)
        k = np.array([len(p) for _, p in held.values()])
        grams = np.concatenate([p for _, p in held.values()])
        who = np.repeat(np.arange(len(sets)), k)
        place = np.arange(len(grams)) - np.repeat(np.cumsum(k) - k, k)
        bucket = ((grams >> _U(40)) * _U(buckets) >> _U(24)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rows = []
        for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            mine, each = np.unique(who[own], return_counts=True)
            rows.append((int(bucket[own[0]]), sets[mine].tobytes(), sizes[mine].tobytes(), each.astype(np.uint32).tobytes(), (grams[own] & _U(0xFFFFFFFF)).astype(np.uint32).tobytes(), place[own].astype(np.uint32).tobytes()))
        return batch_of(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        total = 0
        for batch in batches:
            for _, data in pairs(batch):
                g = ngrams(data, words)
                if len(g) and (name := set_id(g)) not in held:
                    held[name] = (len(g), prefix(g, shared.value, percent))
                    total += len(held[name][1])
                if total >= BLOCK_POSTINGS:
                    yield pack(held)
                    held, total = {}, 0
        if held:
            yield pack(held)

    return id_and_bytes(docs).mapInArrow(run, POSTINGS)


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of about so many rows in as many partitions as these need, where that is few; larger tables are left as they are."""
    few = max(1, -(-rows // TASK_ROWS))
    return df.coalesce(few) if few < df.sparkSession._jsc.sc().defaultParallelism() * 4 else df


LISTS = "kind int, list long, a long, b long, n long, place long"


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all values from each row's low to below its high."""
    n = np.maximum(high - low, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.repeat(low, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def skip_pairs(lists: np.ndarray, sizes: np.ndarray, places: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i before j, of entries in one list whose sizes and positions leave room for a link.

    Entries are sorted by list, size and place. With p and q entries before them, two sets share at most
    min(p, q) + min(n - p, m - q) n-grams, so q lies from ``needed - n + p`` to ``m - needed + p``.
    """
    n_rows = len(lists)
    if n_rows < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new_list = np.concatenate([[True], lists[1:] != lists[:-1]])
    new_block = new_list | np.concatenate([[True], sizes[1:] != sizes[:-1]])
    list_of, block_of = np.cumsum(new_list) - 1, np.cumsum(new_block) - 1
    first = np.flatnonzero(new_block)
    by_size = (list_of[first] << 31) + sizes[first]
    by_place = (block_of << 31) + places
    # the blocks of the same list from an entry's own to the largest size that can link
    end = np.searchsorted(by_size, (list_of << 31) + np.minimum(100 * sizes // percent, (1 << 31) - 1), side="right")
    i, block = _ranges(block_of, end)
    n, m, p = sizes[i], sizes[first[block]], places[i]
    need = needed(n, m, percent)
    low = np.searchsorted(by_place, (block << 31) + np.clip(need - n + p, 0, (1 << 31) - 1), side="left")
    high = np.searchsorted(by_place, (block << 31) + np.clip(m - need + p, -1, (1 << 31) - 1), side="right")
    row, j = _ranges(np.maximum(low, np.where(block == block_of[i], i + 1, 0)), high)
    return i[row], j


def _walk(table: pa.Table, percent: int, short: int) -> pa.Table:
    """Kind 0: candidate pairs (a, b) of short lists; kind 1: entries (list, a, n, place) of longer ones."""
    rows = table.to_pylist()
    bucket = rows[0]["bucket"]
    sets = np.concatenate([np.frombuffer(r["sets"], np.int64) for r in rows])
    sizes = np.concatenate([np.frombuffer(r["sizes"], np.uint32) for r in rows]).astype(np.int64)
    each = np.concatenate([np.frombuffer(r["each"], np.uint32) for r in rows])
    gram = np.concatenate([np.frombuffer(r["grams"], np.uint32) for r in rows])
    place = np.concatenate([np.frombuffer(r["places"], np.uint32) for r in rows]).astype(np.int64)
    s, n = np.repeat(sets, each), np.repeat(sizes, each)
    order = np.lexsort((s, place, n, gram))
    gram, s, n, place = gram[order], s[order], n[order], place[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (s[1:] != s[:-1])  # a set that several blocks sent counts once
    gram, s, n, place = gram[new], s[new], n[new], place[new]
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    size = np.diff(np.append(first, len(gram)))
    length = np.repeat(size, size)
    few = np.flatnonzero((length > 1) & (length <= short))
    i, j = skip_pairs(gram[few], n[few], place[few], percent)
    i, j = few[i], few[j]
    other = s[i] != s[j]  # two n-grams of one set may share a name
    i, j = i[other], j[other]
    both = np.unique(np.stack([np.minimum(s[i], s[j]), np.maximum(s[i], s[j])], axis=1), axis=0)
    many = np.flatnonzero(length > short)
    k = len(both)
    none = pa.nulls(len(many), pa.int64())
    zeros = pa.nulls(k, pa.int64())
    cols = [
        pa.array(np.repeat([0, 1], [k, len(many)]), pa.int32()),
        pa.concat_arrays([zeros, pa.array((bucket << 32 | gram[many].astype(np.int64)))]),
        pa.concat_arrays([pa.array(both[:, 0]), pa.array(s[many])]),
        pa.concat_arrays([pa.array(both[:, 1]), none]),
        pa.concat_arrays([zeros, pa.array(n[many])]),
        pa.concat_arrays([zeros, pa.array(place[many])]),
    ]
    return pa.Table.from_arrays(cols, names=["kind", "list", "a", "b", "n", "place"])


def set_names(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, set) of each row of (doc_id, text); 0 is the empty set. ``doc_id`` may be of any type."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [set_id(ngrams(x.as_py(), words)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64())], names=["doc_id", "set"])

    return id_and_bytes(rows).mapInArrow(run, f"doc_id {id_type}, set long")


#: Pairs of sets, with a document of each.
NEAR = "a long, b long, a_doc long, b_doc long"


class _Verifier:
    """Compares candidate pairs of sets, exactly."""

    def __init__(self, docs: DataFrame, sets: DataFrame, words: int, percent: int):
        self.docs, self.sets, self.words, self.percent = docs, sets, words, percent

    def _near(self, candidates: DataFrame, rows: int) -> DataFrame:
        """Pairs that bit vectors don't rule out, with a document of each set. There are about so many candidates."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, m, x, y = (batch.column(c).to_pylist() for c in ("n", "m", "x", "y"))
                most = [p + q - 2 * (-(-percent * (p + q) // (100 + percent))) for p, q in zip(n, m, strict=True)]
                ok = [differing(u, v) <= d for u, v, d in zip(x, y, most, strict=True)]
                yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b", "a_doc", "b_doc"])

        s = self.sets.select("set", "n", "bits", "doc_id")
        both = packed(packed(candidates, rows).join(s.toDF("a", "n", "x", "a_doc"), "a"), rows)
        both = packed(both.join(s.toDF("b", "m", "y", "b_doc"), "b"), rows)
        both = both.filter(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
        return both.select("a", "b", "n", "m", "x", "y", "a_doc", "b_doc").mapInArrow(run, NEAR)

    def _fetch(self, near: DataFrame, rows: int) -> DataFrame:
        """(set, grams) of the sets in these pairs, made again from one document of each."""
        spark, words, bits = near.sparkSession, self.words, FILTER_BITS
        ends = F.explode(F.array(*(F.struct(F.col(c).alias("set"), F.col(f"{c}_doc").alias("doc_id")) for c in "ab")))
        asked = near.select(ends.alias("end")).select("end.*")
        slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits)).cast("int")

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(bits, bool)
            for b in batches:
                own[b.column(0).to_numpy()] = True
            yield batch_of([(np.packbits(own).tobytes(),)], pa.schema([("m", pa.binary())]))

        total = np.zeros(bits // 8, np.uint8)  # of fixed size, and so is the number of parts it comes in
        for r in asked.select(slot.alias("s")).coalesce(4).mapInArrow(mark, "m binary").toLocalIterator():
            total |= np.frombuffer(r["m"], np.uint8)
        shared = spark.sparkContext.broadcast(total)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = pa.schema([("set", pa.int64()), ("grams", pa.binary())])
            for b in batches:
                at = b.column(2).to_numpy()
                hit = np.flatnonzero(shared.value[at >> 3] >> (7 - (at & 7)) & 1)
                rows = []
                for i in hit.tolist():
                    g = ngrams(b.column(1)[i].as_py(), words)
                    rows.append((set_id(g), g.tobytes()))
                yield batch_of(rows, out)

        made = id_and_bytes(self.docs, "doc_id", "text", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits)).cast("int").alias("slot")).mapInArrow(look, "set long, grams binary")
        # ids may clash in the filter or repeat in the table
        return packed(made.join(packed(asked.select("set").distinct(), 2 * rows), "set", "left_semi").groupBy("set").agg(F.first("grams").alias("grams")), 2 * rows)

    def links(self, candidates: DataFrame, rows: int) -> DataFrame:
        """(a, b) of the candidates that link; there are about so many."""
        return self.exact(self._near(candidates, rows))

    def rest(self, left: DataFrame, rows: int) -> DataFrame:
        """Pairs of different components that bit vectors don't rule out, where both sets stand in lists with one commonest component.

        Sets outside that component are held against all sets of these lists, in blocks;
        no pair is written unless it may link.
        """
        percent, bits = self.percent, self.sets.select(F.col("set").alias("a"), "bits", "doc_id")
        own = packed(left.groupBy("main", "a").agg(F.first("n").alias("n"), F.first("label").alias("label")), rows)
        own = packed(own.join(bits, "a"), rows)
        size = own.groupBy("main").agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col("label") != F.col("main")).alias("_few"))
        blocks = lambda c: F.ceil(F.col(c) / CELL_SETS).cast("int")
        deal = lambda c, salt: F.pmod(F.xxhash64("a", F.lit(salt)), blocks(c)).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.greatest(blocks(c), F.lit(1)) - 1))
        own = cut(packed(own.join(packed(size, rows), "main"), rows))
        few = own.filter("label != main").withColumn("i", deal("_few", "few")).withColumn("j", every("_all"))
        every_one = own.filter("_few > 0").withColumn("j", deal("_all", "all")).withColumn("i", every("_few"))
        cols = "main", "i", "j", "a", "n", "label", "bits", "doc_id"

        def fold(rows: list[bytes], to: int) -> np.ndarray:
            out = np.zeros((len(rows), to), np.uint8)
            for k, r in enumerate(rows):
                out[k] = np.bitwise_xor.reduce(np.frombuffer(r, np.uint8).reshape(-1, to), axis=0)
            return out.view(np.uint64)

        def compare(x: pa.Table, y: pa.Table) -> pa.Table:
            found = [np.zeros((0, 2), np.int64)]
            if x.num_rows and y.num_rows:
                xb, yb = x.column("bits").to_pylist(), y.column("bits").to_pylist()
                xw, yw = np.array([len(v) for v in xb]), np.array([len(v) for v in yb])
                xa, ya, xn, yn, xl, yl = (t.column(c).to_numpy() for c in ("a", "n", "label") for t in (x, y))
                for u in np.unique(xw):
                    for w in {u // 2, u, 2 * u} & set(yw.tolist()):  # further apart in size, sets don't link
                        p, q = np.flatnonzero(xw == u), np.flatnonzero(yw == w)
                        xv, yv = fold([xb[k] for k in p], min(u, w)), fold([yb[k] for k in q], min(u, w))
                        for k, own in zip(p, xv, strict=True):
                            at = np.flatnonzero((xl[k] != yl[q]) & (100 * np.minimum(xn[k], yn[q]) >= percent * np.maximum(xn[k], yn[q])))
                            least = np.bitwise_count(yv[at] ^ own).sum(axis=1, dtype=np.int64)
                            at = q[at[least <= xn[k] + yn[q[at]] - 2 * needed(xn[k], yn[q[at]], percent)]]
                            found.append(np.stack([np.minimum(xa[k], ya[at]), np.maximum(xa[k], ya[at])], axis=1))
            both = np.unique(np.concatenate(found), axis=0)
            doc = {a: d for t in (x, y) for a, d in zip(t.column("a").to_pylist(), t.column("doc_id").to_pylist(), strict=True)} if len(both) else {}
            docs = [pa.array([doc[a] for a in both[:, k].tolist()], pa.int64()) for k in (0, 1)]
            return pa.Table.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), *docs], names=["a", "b", "a_doc", "b_doc"])

        cell = ("main", "i", "j")
        return few.select(*cols).toDF(*cols).groupBy(*cell).cogroup(every_one.select(*cols).groupBy(*cell)).applyInArrow(compare, NEAR).distinct()

    def exact(self, near: DataFrame) -> DataFrame:
        """(a, b) of these pairs that link."""
        percent = self.percent

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    g, h = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = len(np.intersect1d(g, h, assume_unique=True))
                    ok.append(100 * both >= percent * (len(g) + len(h) - both))
                yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

        near = cut(near)
        rows = near.count()
        if not rows:
            return near.select("a", "b")
        near = packed(near, rows)
        wide = 4 * rows  # rows with n-grams
        grams = cut(self._fetch(near, wide))
        both = packed(near.select("a", "b").join(grams.toDF("a", "x"), "a"), wide)
        both = packed(both.join(grams.toDF("b", "y"), "b"), wide)
        return cut(both.select("a", "b", "x", "y").mapInArrow(count, "a long, b long"))


def _labelled(entries: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """Entries of lists that still hold two components or more, each with its component and its list's commonest one."""
    c = connected_components(links).toDF("a", "label")
    e = packed(entries.join(c, "a", "left").withColumn("label", F.coalesce("label", "a")), rows)
    size = packed(e.groupBy("list", "label").agg(F.count(F.lit(1)).alias("k")), rows)
    main = size.groupBy("list").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).filter("labels > 1").drop("labels")
    return cut(packed(e.join(packed(main, rows), "list"), rows))


def _may_link(n: Column, p: Column, m: Column, q: Column, percent: int) -> Column:
    need = F.ceil(percent * (n + m) / (100 + percent))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least(p, q) + F.least(n - p, m - q) >= need)


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, counters: int = COUNTERS, id_col: str = "doc_id", text_col: str = "text", short: int = SHORT_LIST, pivots: int = PIVOTS, bucket_postings: int = BUCKET_POSTINGS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, links, components) of the join.

    documents: doc_id, n, set; links: pairs (a, b) of sets that were found to link, enough to
    connect every component; components: set, component_id (the smallest doc_id in it), label (the
component's own name, as ids may be null or repeat).
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stats = cut(_statistics(docs, words, counters))
    own = stats.filter("kind = 0").select("doc_id", "n", "set", "bits")
    counts = _counts(stats, counters)
    total = own.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, -(-total * (100 - percent) // 100 // bucket_postings))
    # one row for each set; the document that stands for it is its smallest
    sets = cut(own.filter("n > 0").groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits")))
    lists = _postings(docs, counts, words, percent, buckets).groupBy("bucket").applyInArrow(lambda t: _walk(t, percent, short), LISTS)
    lists = cut(lists)
    n_pairs, n_entries = lists.agg(F.count_if(F.col("kind") == 0), F.count_if(F.col("kind") == 1)).first()
    n_sets = sets.count()
    verifier = _Verifier(docs, sets, words, percent)
    entries = packed(lists.filter("kind = 1").select("list", "a", "n", "place"), n_entries)
    of_set = packed(entries.groupBy("a").agg(F.count(F.lit(1)).alias("n_lists")), n_entries)
    entries = cut(packed(entries.join(of_set, "a"), n_entries))
    links = verifier.links(packed(lists.filter("kind = 0").select("a", "b"), n_pairs).distinct(), n_pairs)
    left = _labelled(entries, links, n_entries)

    def near_pivot(e: DataFrame, turn: int) -> DataFrame:
        """Entries with a pivot of their list that is in another component.

        The first pivot is the set that stands in most lists: of copies with edits, the least
        edited. Later ones are other members of the list's commonest component.
        """
        best = F.struct(F.col("n_lists") if turn == 0 else F.lit(0), F.xxhash64("a", F.lit(turn)))
        some = e if turn == 0 else e.filter("label = main")
        pivot = packed(some.groupBy("list").agg(F.max_by(F.struct("a", "n", "place", "label"), best).alias("p")), n_left)
        both = packed(e.join(pivot, "list"), n_left).filter(F.col("label") != F.col("p.label"))
        both = both.filter(_may_link(F.col("n"), F.col("place"), F.col("p.n"), F.col("p.place"), percent))
        return both.select(F.least("a", "p.a").alias("a"), F.greatest("a", "p.a").alias("b")).distinct()

    for turn in range(pivots):
        if not (n_left := left.count()):
            break
        # a pair of different components isn't among the links before
        links = links.unionAll(verifier.links(near_pivot(left, turn), n_left))
        left = _labelled(entries, links, n_entries)
    if n_left := left.count():
        links = links.unionAll(verifier.exact(verifier.rest(left, n_left)))
    of = connected_components(links).toDF("set", "label")
    members = packed(sets.select("set", "doc_id").join(of, "set", "left").withColumn("label", F.coalesce("label", "set")), n_sets)
    least = packed(members.groupBy("label").agg(F.min("doc_id").alias("component_id")), n_sets)
    return own.select("doc_id", "n", "set"), links, packed(members.join(least, "label"), n_sets).select("set", "component_id", "label")


def components(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row."""
    own, _, of = join(docs, **options)
    out = own.join(of, "set", "left")
    alone = F.col("n") == 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
