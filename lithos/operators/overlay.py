"""Overlay of polygons as a sweep that Spark sorts and joins.

Edges of all geometries that meet in a group (a pair of geometries, or one alone) are rows. The heights of their ends and crossings cut the
group into slabs in which no two edges cross, so the edges of a slab have one order from west to east. Counting how often each
polygon has been entered and left along that order tells which sides are inside; where that changes is a border of
the result. Intervals between the same two edges in slabs that follow one another are one piece, a trapezoid, so
results are whole and exact up to the rounding of doubles, and no row ever carries a geometry.

A geometry is the union of its polygons, and a polygon is what lies inside an odd number of its rings; rings may cross themselves or
each other. Crossings are looked for in the cells of a grid of each group, fine enough for some edges a cell. An edge is repeated for each
slab that it spans: as often as there are heights between its ends.

Edge cases: null or empty geometries, rings of less than three places and areas of nothing have no pieces; edges that coincide
bound pieces of no width, which are left out; repeated keys are one group, so callers give each geometry its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.session import cut

#: Pieces narrower and lower than this share of a degree are rounding.
LEAST = 1e-12
PIECE = ("y0", "y1", "w0", "e0", "w1", "e1")


def edges(shapes: DataFrame, by: list[str], side: str, geom: str = "geom") -> DataFrame:
    """A row for each edge that isn't level: the keys, the side, its name and (x1, y1, x2, y2) from below upwards."""
    rings = shapes.select(*by, F.posexplode(geom).alias("poly", "_rings")).select(*by, "poly", F.posexplode("_rings").alias("ring", "_ring"))
    at = lambda i: F.element_at("_ring", i)
    n = F.size("_ring")
    # a ring that isn't closed is closed by its last edge
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("i"), at(i).alias("a"), at(i % n + 1).alias("b")))
    e = rings.filter(n >= 3).select(*by, "poly", "ring", F.explode(pairs).alias("p")).filter("p.a.lat <> p.b.lat")
    up = F.col("p.a.lat") < F.col("p.b.lat")
    low, high = F.when(up, F.col("p.a")).otherwise(F.col("p.b")), F.when(up, F.col("p.b")).otherwise(F.col("p.a"))
    return e.select(
        *by, F.lit(side).alias("side"), "poly", F.struct(F.lit(side).alias("side"), "poly", "ring", F.col("p.i").alias("i")).alias("edge"),
        low["lon"].cast("double").alias("x1"), low["lat"].cast("double").alias("y1"), high["lon"].cast("double").alias("x2"), high["lat"].cast("double").alias("y2"),
    )


def _at(y: Column) -> Column:
    """Where the edge of a row is at a height; its own ends exactly."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    return F.when(y == y1, x1).when(y == y2, x2).otherwise(x1 + (y - y1) / (y2 - y1) * (x2 - x1))


def _crossings(e: DataFrame, by: list[str]) -> DataFrame:
    """The heights (by, y) at which edges of a group cross."""
    g = e.groupBy(*by).agg(
        F.min(F.least("x1", "x2")).alias("_w"), F.min("y1").alias("_s"), F.ceil(F.sqrt(F.count(F.lit(1)))).alias("_n"), F.greatest(F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2")), F.max("y2") - F.min("y1")).alias("_size"),
    )
    cell = F.col("_size") / F.col("_n")
    c = lambda v, o: F.floor((v - F.col(o)) / cell)
    r = e.join(g, by)
    r = r.withColumn("cx", F.explode(F.sequence(c(F.least("x1", "x2"), "_w"), c(F.greatest("x1", "x2"), "_w")))).withColumn("cy", F.explode(F.sequence(c(F.col("y1"), "_s"), c(F.col("y2"), "_s"))))
    a = r.select(*by, "cx", "cy", *[F.col(k).alias(f"a_{k}") for k in ("edge", "x1", "y1", "x2", "y2")])
    b = r.select(*by, "cx", "cy", *[F.col(k).alias(f"b_{k}") for k in ("edge", "x1", "y1", "x2", "y2")])
    j = a.join(b, [*by, "cx", "cy"]).filter(F.col("a_edge") < F.col("b_edge"))
    v = {k: F.col(k) for k in j.columns}
    dx, dy, ex, ey = v["a_x2"] - v["a_x1"], v["a_y2"] - v["a_y1"], v["b_x2"] - v["b_x1"], v["b_y2"] - v["b_y1"]
    gx, gy = v["b_x1"] - v["a_x1"], v["b_y1"] - v["a_y1"]
    turn = F.nullif(dx * ey - dy * ex, F.lit(0.0))
    j = j.withColumn("_t", (gx * ey - gy * ex) / turn).withColumn("_u", (gx * dy - gy * dx) / turn)
    inside = (F.col("_t") > 0) & (F.col("_t") < 1) & (F.col("_u") >= 0) & (F.col("_u") <= 1)
    return j.filter(inside).select(*by, (v["a_y1"] + F.col("_t") * dy).alias("y"))


def sweep(e: DataFrame, by: list[str], inside: Column, within: tuple[str, str] | None = None) -> DataFrame:
    """Pieces (by, y0, y1, w0, e0, w1, e1) of the places where ``inside`` holds: between two heights, from west to east at each.

    ``inside`` is a condition on the booleans ``a`` and ``b``: in the geometry of that side. ``within`` names columns of ``e`` with the lowest and
    highest place of a group that is asked for.
    """
    if within:
        low, high = (F.col(c) for c in within)
        e = e.withColumn("_lo", low).withColumn("_hi", high).filter((F.col("y1") < F.col("_hi")) & (F.col("y2") > F.col("_lo")))
    else:
        e = e.withColumn("_lo", F.lit(-math.inf)).withColumn("_hi", F.lit(math.inf))
    e = cut(e.select(*by, "side", "poly", "edge", "x1", "y1", "x2", "y2", F.greatest("y1", "_lo").alias("_from"), F.least("y2", "_hi").alias("_to"), "_lo", "_hi"))
    span = e.groupBy(*by).agg(F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    crossed = _crossings(e, by).join(span, by).filter((F.col("y") > F.col("_lo")) & (F.col("y") < F.col("_hi"))).select(*by, "y")
    heights = e.select(*by, F.explode(F.array("_from", "_to")).alias("y")).unionByName(crossed).distinct()
    order = Window.partitionBy(*by).orderBy("y")
    slabs = cut(heights.withColumn("k", F.row_number().over(order)).withColumn("y1_", F.lead("y").over(order)))

    rank = lambda c, k: slabs.select(*by, F.col("y").alias(c), F.col("k").alias(k))
    r = e.join(rank("_from", "_k0"), [*by, "_from"]).join(rank("_to", "_k1"), [*by, "_to"])
    r = r.withColumn("k", F.explode(F.sequence(F.col("_k0"), F.col("_k1") - 1)))
    r = r.join(slabs.select(*by, "k", F.col("y").alias("y0"), F.col("y1_").alias("yt")), [*by, "k"])
    r = r.withColumn("x0", _at(F.col("y0"))).withColumn("xt", _at(F.col("yt"))).withColumn("xm", F.col("x0") + F.col("xt"))
    slab = [*by, "k"]
    own = Window.partitionBy(*slab, "side", "poly").orderBy("xm", "edge")
    enters = F.when(F.row_number().over(own) % 2 == 1, 1).otherwise(-1)
    west = Window.partitionBy(*slab).orderBy("xm", "edge")
    upto = west.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = r.withColumn("_d", enters)
    for s in ("a", "b"):
        r = r.withColumn(s, F.sum(F.when(F.col("side") == s, F.col("_d")).otherwise(0)).over(upto) > 0)
    r = r.withColumn("_in", inside)
    r = r.withColumn("_was", F.coalesce(F.lag("_in").over(west), F.lit(False))).filter("_in <> _was")
    # borders come in pairs: one into the result and one out of it
    names = ("edge", "x0", "xt")
    r = r.select(*slab, "y0", "yt", "_in", *names, *[F.lead(c).over(west).alias(f"_{c}") for c in names], "xm").filter("_in")
    r = r.filter((F.col("_x0") - F.col("x0") > LEAST) | (F.col("_xt") - F.col("xt") > LEAST))
    same = Window.partitionBy(*by, "edge", "_edge").orderBy("k")
    r = r.withColumn("_run", F.col("k") - F.row_number().over(same))
    out = r.groupBy(*by, "edge", "_edge", "_run").agg(
        F.min("y0").alias("y0"), F.max("yt").alias("y1"), F.min_by("x0", "k").alias("w0"), F.min_by("_x0", "k").alias("e0"), F.max_by("xt", "k").alias("w1"), F.max_by("_xt", "k").alias("e1"),
    )
    return out.select(*by, *PIECE)


def area() -> Column:
    """Of a piece, in square degrees."""
    return (F.col("y1") - F.col("y0")) * ((F.col("e0") - F.col("w0")) + (F.col("e1") - F.col("w1"))) / 2


def areas(pieces: DataFrame, by: list[str]) -> DataFrame:
    """(by, area) of what the pieces of a group cover."""
    return pieces.groupBy(*by).agg(F.sum(area()).alias("area"))


def as_geometry(pieces: DataFrame, by: list[str]) -> DataFrame:
    """(by, geom): a polygon for each piece; they touch but don't overlap. A geometry is a row, so it must fit into one."""
    at = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    ring = F.array(at("w0", "y0"), at("e0", "y0"), at("e1", "y1"), at("w1", "y1"), at("w0", "y0"))
    polygons = F.sort_array(F.collect_list(F.struct("y0", "w0", F.array(ring).alias("p"))))
    return pieces.groupBy(*by).agg(F.transform(polygons, lambda x: x["p"]).alias("geom"))


def both(pairs: DataFrame, by: list[str], rule: str) -> DataFrame:
    """Pieces of two geometries ``a`` and ``b`` of each row: their intersection, union, difference (a without b) or symmetric difference."""
    a, b = F.col("a"), F.col("b")
    rules = {"intersection": a & b, "union": a | b, "difference": a & ~b, "symmetric": a != b}
    e = edges(pairs, by, "a", "a").unionByName(edges(pairs, by, "b", "b"))
    return sweep(e, by, rules[rule])


def make_valid(shapes: DataFrame, by: list[str], geom: str = "geom") -> DataFrame:
    """Pieces of each geometry: rings that cross themselves, holes that lie outside and polygons that overlap are no matter in them."""
    return sweep(edges(shapes, by, "a", geom), by, F.col("a"))


def point_on_surface(pieces: DataFrame, by: list[str]) -> DataFrame:
    """(by, lon, lat) of a place inside: the middle of the piece that is widest in its middle, ties to the lowest, then westernmost."""
    wide = (F.col("e0") - F.col("w0")) + (F.col("e1") - F.col("w1"))
    lon = (F.col("w0") + F.col("e0") + F.col("w1") + F.col("e1")) / 4
    best = F.min_by(F.struct(lon.alias("lon"), ((F.col("y0") + F.col("y1")) / 2).alias("lat")), F.struct(-wide, "y0", "w0"))
    return pieces.groupBy(*by).agg(best.alias("_p")).select(*by, "_p.lon", "_p.lat")


def buffer(shapes: DataFrame, by: list[str], distance: float, corners: int = 8, geom: str = "geom") -> DataFrame:
    """Pieces of the places within a distance of each geometry; circles are polygons of four times ``corners`` sides.

    It is the union of the geometry, a circle at each place of its rings and a box along each edge.
    """
    if distance <= 0:
        raise ValueError("the distance must be positive")
    rings = shapes.select(*by, F.explode(geom).alias("_rings")).select(*by, F.explode("_rings").alias("_ring"))
    n = F.size("_ring")
    at = lambda i: F.element_at("_ring", i)
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(at(i)["lon"].alias("x"), at(i)["lat"].alias("y"), at(i % n + 1)["lon"].alias("u"), at(i % n + 1)["lat"].alias("v")))
    e = rings.filter(n >= 3).select(*by, F.explode(pairs).alias("p")).select(*by, "p.*").distinct()
    place = lambda x, y: F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))
    turns = [math.pi * k / (2 * corners) for k in range(4 * corners)]
    # the four main directions exactly
    steps = [(round(math.cos(t), 15) * distance, round(math.sin(t), 15) * distance) for t in turns]
    circle = F.array(*[place(F.col("x") + dx, F.col("y") + dy) for dx, dy in steps])
    dx, dy = F.col("u") - F.col("x"), F.col("v") - F.col("y")
    length = F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    nx, ny = -dy / length * distance, dx / length * distance
    box = F.array(place(F.col("x") + nx, F.col("y") + ny), place(F.col("x") - nx, F.col("y") - ny), place(F.col("u") - nx, F.col("v") - ny), place(F.col("u") + nx, F.col("v") + ny))
    own = shapes.select(*by, F.explode(geom).alias("rings"))
    made = e.select(*by, F.array(circle).alias("rings")).distinct().unionByName(e.filter(length.isNotNull()).select(*by, F.array(box).alias("rings")))
    kind = "array<array<struct<lon: double, lat: double>>>"
    polygons = own.select(*by, F.col("rings").cast(kind).alias("rings")).unionByName(made.select(*by, F.col("rings").cast(kind).alias("rings")))
    # each polygon counts for itself: its place in its group is its number
    number = F.row_number().over(Window.partitionBy(*by).orderBy("rings"))
    parts = cut(polygons.withColumn("_n", number))
    one = edges(parts.select(*by, "_n", F.array("rings").alias("geom")), [*by, "_n"], "a")
    one = one.withColumn("poly", F.col("_n")).withColumn("edge", F.col("edge").withField("poly", F.col("_n"))).drop("_n")
    return sweep(one, by, F.col("a"))
