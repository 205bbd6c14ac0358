"""Connected components of an undirected graph held as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.session import cut


#: Edges that a task works on at most, about; small graphs are kept in few partitions.
TASK_EDGES = 100_000
#: Nodes that a task holds at most, about: a partition of more gives the stars of its parts.
MOST_NODES = 1_000_000


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as edges from each node to the smallest one that it reaches in the partition.

    A partition with more nodes than a task may hold is taken in parts, whose stars connect what its edges do.
    """
    up: dict = {}

    def root(x):
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while x != top:  # shorten the way for the next
            up[x], x = top, up.get(x, top)
        return top

    def stars(schema: pa.Schema) -> pa.RecordBatch:
        ends = [(x, root(x)) for x in list(up)]
        up.clear()
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in ends], schema.field(i).type) for i in (0, 1)], schema=schema)

    schema = None
    for b in batches:
        schema = b.schema
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > MOST_NODES:
            yield stars(schema)
    if schema is not None:
        yield stars(schema)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """(node, component) of every node that has an edge; a component is named by its smallest node.

    Each partition first joins what its own edges connect, of which one edge a node is left. A graph of few
    edges has one partition and is done then. Otherwise large-star and small-star steps follow in turn: every edge
    is hooked to the smallest neighbour of its end, until all edges of a component point at its smallest node.
    Each step is one aggregation and one join, so no task ever needs a whole
    neighbourhood; the number of rounds grows with the logarithm of the size.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col("u") != F.col("v"))
    kind = e.schema["u"].dataType.simpleString()

    def local(df: DataFrame) -> DataFrame:
        return cut(df.mapInArrow(_local_stars, f"u {kind}, v {kind}"))

    e, before = local(e), None
    few = max(1, -(-e.count() // TASK_EDGES))

    def packed(df: DataFrame) -> DataFrame:
        return df.coalesce(few) if few < df.sparkSession._jsc.sc().defaultParallelism() * 4 else df

    def stars(df: DataFrame) -> DataFrame:
        own = df.select(F.col("u").alias("node"), F.col("v").alias("component"))
        return own.unionAll(packed(own.select(F.col("component").alias("node"), "component").distinct()))

    e = local(packed(e))
    if few == 1:
        return stars(e)
    e = packed(e)
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = packed(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = packed(packed(large.filter(F.col("u") != F.col("v"))).distinct())
        low = packed(large.groupBy("u").agg(F.min("v").alias("m")))
        hooked = large.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = packed(low.select("u", F.col("m").alias("v")).unionAll(hooked))
        e = packed(cut(packed(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return stars(e)
