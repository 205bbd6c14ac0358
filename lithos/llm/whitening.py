"""Whitening of embeddings from a covariance in tiles.

Entries are made whole numbers, x = floor(64 * c) + 1,000,000, and each distinct vector of them counts once (the fit
list). The dimensions are cut into column blocks and the pairs of blocks are the tiles of the covariance. Row blocks of
the fit list send each column block to every tile that it takes part in; a task multiplies two centred column blocks
of a row block, partial products are summed by entry, and the driver assembles the matrix (its size is the
square of the dimensions, whatever the rows) and takes its eigenvectors. All rows are projected with the same ones.

A column block of 4,096 rows and 32 dimensions holds at most 1 MB, as the offsets from the mean are sent in as few bytes as hold them.

Edge cases: vectors that are null or hold null or non-finite entries are dropped, as are those of another length than most
(of lengths as frequent the shortest counts); a null or repeated id is an id like others; repeated vectors each get rows, but
count once in the fit; components without variance (a share of the trace under 1e-12) can't be whitened and are left out, so
one vector alone, or an empty table, gives no rows; a deviation beyond a long is null; an entry so large that x isn't a long is an error; other
columns take no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.session import checkpoint_dir

#: Dimensions in a column block, rows in a row block, components returned.
TILE, BLOCK_ROWS, COMPONENTS = 32, 4096, 16
#: Share of the trace under which a component has no variance.
LEAST_SHARE = 1e-12
OFFSET, SCALE = 1_000_000, 64.0


def usable(vec: Column) -> Column:
    """True for vectors whose entries are all finite."""
    return F.coalesce(vec.isNotNull() & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))


def whole(vec: Column) -> Column:
    """The entries as whole numbers."""
    return F.transform(vec, lambda c: F.floor(F.lit(SCALE) * c.cast("double")) + F.lit(OFFSET).cast("long"))


def matrix(col: pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


@dataclass(frozen=True)
class Fit:
    """What all rows are projected with: as many numbers as the square of the dimensions at most."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def middle(self) -> np.ndarray:
        """Whole numbers near the mean."""
        return np.array([round(int(s) / self.n) for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, the whole part taken first, so that nothing is lost to rounding."""
        middle = self.middle
        rest = np.array([(int(s) - self.n * int(m)) / self.n for s, m in zip(self.sums, middle, strict=True)])
        return (x - middle) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.variances)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum over dimensions of (n * x - S)^2; None beyond a long."""
        middle = self.middle
        off, rest = x - middle, [int(s) - self.n * int(m) for s, m in zip(self.sums, middle, strict=True)]
        far = self.n * int(np.abs(off).max(initial=0)) + max(map(abs, rest), default=0)
        if far * far * x.shape[1] < 2**63:
            return (((self.n * off - np.array(rest, np.int64)) ** 2).sum(axis=1)).tolist()
        exact = ((off.astype(object) * self.n - np.array(rest, object)) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]


def totals(fit: DataFrame) -> tuple[int, np.ndarray]:
    """(n, S) of the fit list."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                n, sums = n + len(x), x.sum(axis=0) if sums is None else sums + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums), pa.array([n] * len(sums), pa.int64())], names=["d", "s", "n"])

    rows = fit.mapInArrow(add, "d int, s long, n long").groupBy("d").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("d").collect()
    return (rows[0]["n"], np.array([r["s"] for r in rows], np.int64)) if rows else (0, np.zeros(0, np.int64))


def covariance(fit: DataFrame, n: int, sums: np.ndarray, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> np.ndarray:
    """The covariance of the fit list, divisor n, from tiles of dimension pairs."""
    dim = len(sums)
    about = Fit(n, sums, np.zeros((0, 0)), np.zeros(0), 0.0)
    starts = range(0, dim, tile)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for b in batches:
            for at in range(0, b.num_rows, block_rows):
                off = matrix(b.column(0).slice(at, block_rows)) - about.middle
                most = int(np.abs(off).max(initial=0))
                kind = next(t for t in ("i1", "i2", "i4", "i8") if most <= np.iinfo(t).max)
                rows = []
                for k in starts:
                    data = np.ascontiguousarray(off[:, k : k + tile].astype(kind)).tobytes()
                    rows += [(number, min(k, other), max(k, other), k, len(off), kind, data) for other in starts]
                number += 1
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["row_block", "top", "left", "own", "n_rows", "kind", "data"])

    rest = np.array([(int(s) - n * int(m)) / n for s, m in zip(sums, about.middle, strict=True)])

    def multiply(pair: pa.Table) -> pa.Table:
        side = {}
        for r in pair.to_pylist():
            own = np.frombuffer(r["data"], r["kind"]).reshape(r["n_rows"], -1)
            side[r["own"]] = own - rest[r["own"] : r["own"] + tile]
        top, left = pair.column("top")[0].as_py(), pair.column("left")[0].as_py()
        product = side[top].T @ side[left]
        p, q = np.indices(product.shape)
        return pa.table({"p": pa.array(p.ravel() + top, pa.int32()), "q": pa.array(q.ravel() + left, pa.int32()), "v": product.ravel()})

    sent = fit.mapInArrow(blocks, "row_block long, top int, left int, own int, n_rows int, kind string, data binary")
    products = sent.groupBy("row_block", "top", "left").applyInArrow(multiply, "p int, q int, v double")
    out = np.zeros((dim, dim))
    for r in products.groupBy("p", "q").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r["p"], r["q"]] = out[r["q"], r["p"]] = r["v"] / n
    return out


def identity_error(fit: DataFrame, by: Fit) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(by.variances)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                w = by.whitened(matrix(b.column(0)))
                out += w.T @ w
        p, q = np.indices(out.shape)
        yield pa.RecordBatch.from_arrays([pa.array(p.ravel(), pa.int32()), pa.array(q.ravel(), pa.int32()), pa.array(out.ravel())], names=["p", "q", "v"])

    rows = fit.mapInArrow(add, "p int, q int, v double").groupBy("p", "q").agg((F.sum("v") / by.n).alias("v")).collect()
    return max((abs(r["v"] - (r["p"] == r["q"])) for r in rows), default=0.0)


def whiten(vectors: DataFrame, components: int = COMPONENTS, tile: int = TILE, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component."""
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    out_type = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v")).filter(usable(F.col("v"))).select("vec_id", whole(F.col("v")).alias("x"))
    dims = v.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).filter("d > 0").orderBy(F.desc("n"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], out_type)
    v = v.filter(F.size("x") == dims[0]["d"])
    # a written table: whole numbers take a byte or so each there
    path = f"{checkpoint_dir(spark)}/fit-{uuid.uuid4().hex}"
    v.select("x").distinct().write.parquet(path)
    fit = spark.read.parquet(path)
    n, sums = totals(fit)
    cov = covariance(fit, n, sums, tile, block_rows)
    e, vectors_of = np.linalg.eigh(cov)
    trace = float(np.trace(cov))
    order = [k for k in np.argsort(-e, kind="stable")[:components] if e[k] > LEAST_SHARE * trace]
    by = Fit(n, sums, np.ascontiguousarray(vectors_of[:, order]), e[order], trace)
    error = identity_error(fit, by)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    k = len(order)
    if not k:
        return spark.createDataFrame([], out_type)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, block_rows):
                b = whole_batch.slice(at, block_rows)
                x = matrix(b.column(1))
                row = pa.array(np.repeat(np.arange(len(x)), k))
                number = np.tile(np.arange(k), len(x))
                cols = [
                    b.column(0).take(row), pa.array(number + 1, pa.int32()), pa.array(np.full(len(number), n), pa.int64()), pa.array(by.deviation(x), pa.int64()).take(row),
                    pa.array(by.whitened(x).ravel()), pa.array((by.variances / trace)[number]), pa.array(np.full(len(number), error)),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return v.mapInArrow(project, out_type)
