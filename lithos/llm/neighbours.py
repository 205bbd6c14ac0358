"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a sample whose size is bounded (``sample_size``); every vector is assigned to a
leaf. A query goes through the tree best bin first: a priority queue holds the
branches seen by their distance, and leaves are visited in that order. How many are
visited is calibrated on sampled vectors that the tree was not fitted on, by widening until the
target recall against brute force is reached; a query then compares itself with whole leaves, in
blocks dealt out by leaf and salt, so a leaf with a third of all vectors is split over tasks.
The number of leaves grows with the table until the sample's bound.

Distances are Euclidean on the original vectors in double precision, ties go to
the smaller id. Edge cases: vectors that are null, zero, of another length than most or hold
null or non-finite components take no part, as queries or as candidates; repeated vectors
are candidates of each other; rows that share an id are told apart: each asks on its own (so a query id may
have several rows of each rank), is a candidate of the others and is left out only for itself; a row with a
null id takes no part; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.session import cut

#: Vectors in the sample at least and at most, branches of a node, vectors of the sample in a leaf at least and at most.
SAMPLE_ROWS, MOST_SAMPLE_ROWS, BRANCHES, FEW_LEAF_ROWS, LEAF_ROWS = 20_000, 200_000, 8, 10, 100
#: Vectors of the table in a leaf, as far as the sample allows; queries in the calibration, recall they must reach.
TABLE_LEAF_ROWS, CALIBRATION_QUERIES, TARGET_RECALL = 5_000, 200, 0.94
#: Vectors, and queries, compared in one task at most, about.
CELL_ROWS, CELL_QUERIES = 20_000, 5_000


def usable(vec: Column) -> Column:
    """True for vectors that can take part."""
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vec.isNotNull() & sound & F.exists(vec, lambda x: x != 0), F.lit(False))


@dataclass
class Node:
    centres: np.ndarray | None = None
    children: list[Node] | None = None
    leaf: int = -1


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    c = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = _squared(x, c).argmin(axis=1)
        c = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(k)])
    return np.unique(c, axis=0)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :]


class Tree:
    """A hierarchical k-means tree over a sample."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS, seed: int = 5):
        self.n_leaves = 0
        self.rng = np.random.default_rng(seed)
        self.root = self._grow(sample, branches, leaf_rows)

    def _grow(self, x: np.ndarray, branches: int, leaf_rows: int) -> Node:
        if len(x) > leaf_rows:
            c = _kmeans(x, branches, self.rng)
            near = _squared(x, c).argmin(axis=1)
            used = np.unique(near)
            if len(used) > 1:
                return Node(c[used], [self._grow(x[near == i], branches, leaf_rows) for i in used])
        node = Node(leaf=self.n_leaves)
        self.n_leaves += 1
        return node

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out = np.zeros(len(x), np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node.children is None:
                out[rows] = node.leaf
            elif len(rows):
                near = _squared(x[rows], node.centres).argmin(axis=1)
                todo += [(child, rows[near == i]) for i, child in enumerate(node.children)]
        return out

    def visit(self, q: np.ndarray, most: int, sizes: dict[int, int] | None = None, rows: int = 0) -> list[int]:
        """The first ``most`` leaves in best-bin-first order, and more until they hold ``rows`` vectors by ``sizes``."""
        queue: list[tuple[float, int, Node]] = [(0.0, 0, self.root)]
        seen, out, held = 1, [], 0
        while queue and (len(out) < most or held < rows):
            _, _, node = heapq.heappop(queue)
            while node.children is not None:
                d = _squared(q[None, :], node.centres)[0]
                best = int(d.argmin())
                for i, child in enumerate(node.children):
                    if i != best:
                        heapq.heappush(queue, (float(d[i]), seen, child))
                        seen += 1
                node = node.children[best]
            out.append(node.leaf)
            held += sizes.get(node.leaf, 0) if sizes else 0
        return out


def sample_size(population: int, sample_rows: int = SAMPLE_ROWS) -> tuple[int, int]:
    """(vectors to sample, vectors of the sample in a leaf) for a table of this size."""
    leaves = max(sample_rows // LEAF_ROWS, population // TABLE_LEAF_ROWS, 1)
    rows = min(max(sample_rows, MOST_SAMPLE_ROWS), max(sample_rows, FEW_LEAF_ROWS * leaves))
    return rows, min(LEAF_ROWS, max(FEW_LEAF_ROWS, rows // leaves))


def calibrate(tree: Tree, fitted: np.ndarray, held_out: np.ndarray, k: int, target: float) -> int:
    """The leaves to visit so that held-out queries find ``target`` of their k nearest fitted vectors.

    The share k / sample is coarser than k / population, so nearer neighbours than
    these are asked for in use.
    """
    leaf = tree.assign(fitted)
    found: list[np.ndarray] = []
    for q in held_out:
        d = ((fitted - q) ** 2).sum(axis=1)
        best = np.argsort(d, kind="stable")[:k]
        place = np.full(tree.n_leaves, tree.n_leaves)
        order = tree.visit(q, tree.n_leaves)
        place[order] = np.arange(len(order))
        found.append(place[leaf[best]])
    if not found:
        return tree.n_leaves
    # the place after which that share of all neighbours has been met
    places = np.sort(np.concatenate(found))
    return int(min(tree.n_leaves, places[min(len(places) - 1, int(np.ceil(target * len(places))))] + 1))


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def search(vectors: DataFrame, queries: Column, k: int = 10, target: float = TARGET_RECALL, sample_rows: int = SAMPLE_ROWS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row where ``queries`` holds."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    v = v.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    out_type = "query_id long, rank int, vec_id long, score double"
    dims = v.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], out_type)
    dim, population = dims[0]["d"], dims[0]["n"]
    v = v.filter(F.size("v") == dim)
    rows, leaf_rows = sample_size(population, sample_rows)
    key = F.pmod(F.xxhash64("v", F.lit("tree")), F.lit(1_000_000))
    share = int(1e6 * rows / population)
    # the hash is of the vector: copies come or stay away together, so the limit guards against many copies of one
    some = v.filter(key < share).limit(2 * rows) if share < 900_000 else v.limit(2 * rows)
    sample = np.array([r["v"] for r in some.select("v").toLocalIterator()], np.float64).reshape(-1, dim)
    step = max(2, len(sample) // CALIBRATION_QUERIES)
    out_of_fit = np.arange(len(sample)) % step == step - 1
    tree = Tree(sample[~out_of_fit], leaf_rows=leaf_rows)
    visits = calibrate(tree, sample[~out_of_fit], sample[out_of_fit], k, target)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = shared.value.assign(_matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], names=[*b.schema.names, "leaf"])

    elem = dict(v.dtypes)["v"]
    # a number for each row, which stays with it in the checkpoint: ids may repeat
    placed = cut(v.withColumn("row", F.monotonically_increasing_id()).mapInArrow(place, f"vec_id long, v {elem}, asks boolean, row long, leaf int"))
    sizes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    rows_of = {r["leaf"]: r["n"] for r in sizes.collect()}  # at most a row for each leaf
    salts = {leaf: -(-n // CELL_ROWS) for leaf, n in rows_of.items()}
    by_leaf = spark.sparkContext.broadcast((rows_of, salts))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = by_leaf.value
        for b in batches:
            for i, q in enumerate(_matrix(b.column(2))):
                # k candidates besides the query itself
                cells = [(leaf, s) for leaf in shared.value.visit(q, visits, held, k + 1) for s in range(parts.get(leaf, 0))]
                own = b.take(pa.array([i] * len(cells)))
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array([c[j] for c in cells], pa.int32()) for j in (0, 1))], names=["query_id", "asker", "q", "leaf", "salt"])

    asked = placed.filter("asks").select("vec_id", "row", "v").mapInArrow(route, f"query_id long, asker long, q {elem}, leaf int, salt int")
    # at most a row for each leaf
    many = F.broadcast(spark.createDataFrame([(leaf, n) for leaf, n in salts.items() if n > 1], "leaf int, n_salts int"))
    held = placed.select("vec_id", "row", "v", "leaf").join(many, "leaf", "left")
    held = held.select("vec_id", "row", "v", "leaf", F.pmod(F.xxhash64("row"), F.coalesce("n_salts", F.lit(1))).cast("int").alias("salt"))

    def compare(asking: pa.Table, there: pa.Table) -> pa.Table:
        names = ["query_id", "asker", "vec_id", "row", "score"]
        kinds = [*[pa.int64()] * 4, pa.float64()]
        if not asking.num_rows or not there.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names=names)
        asking, there = asking.combine_chunks(), there.combine_chunks()
        x, ids, rows = _matrix(there.column("v").combine_chunks()), there.column("vec_id").to_numpy(), there.column("row").to_numpy()
        found = []
        for q_id, own, q in zip(asking.column("query_id").to_numpy(), asking.column("asker").to_numpy(), _matrix(asking.column("q").combine_chunks()), strict=True):
            d = np.sqrt(((x - q) ** 2).sum(axis=1))
            near = np.flatnonzero(rows != own)
            if len(near) > k:
                # the cell's k nearest, whatever other cells hold; of those as far as the k-th the smaller ids
                far = np.partition(d[near], k - 1)[k - 1]
                at, near = near[d[near] == far], near[d[near] < far]
                near = np.concatenate([near, at[np.lexsort((rows[at], ids[at]))[: k - len(near)]]])
            found.append((np.full(len(near), q_id), np.full(len(near), own), ids[near], rows[near], d[near]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    # queries that meet in a leaf are parted too; each part gets the leaf's vectors
    n_queries = placed.filter("asks").count()
    parts_of = max(1, -(-n_queries * visits // (tree.n_leaves * CELL_QUERIES)))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("asker", "leaf"), F.lit(parts_of)).cast("int"))
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts_of - 1)))) if parts_of > 1 else held.withColumn("part", F.lit(0))
    cell = ("leaf", "salt", "part")
    near = asked.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInArrow(compare, "query_id long, asker long, vec_id long, row long, score double")
    w = Window.partitionBy("asker").orderBy("score", "vec_id", "row")
    best = near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
