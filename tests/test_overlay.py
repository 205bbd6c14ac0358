"""Overlay against a scan of each pair by itself, and against areas that are known."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lithos.operators import overlay, regions

KIND = "array<array<array<struct<lon:double,lat:double>>>>"


def ring(*points):
    return [{"lon": float(x), "lat": float(y)} for x, y in points]


def square(w, s, size):
    return ring((w, s), (w + size, s), (w + size, s + size), (w, s + size))


def spans(geom, y):
    """Where the line at y is inside any polygon, merged."""
    found = []
    for polygon in geom:
        xs = []
        for r in polygon:
            for p, q in zip(r, r[1:] + r[:1], strict=True):
                if (p["lat"] > y) != (q["lat"] > y):
                    xs.append(p["lon"] + (y - p["lat"]) / (q["lat"] - p["lat"]) * (q["lon"] - p["lon"]))
        xs.sort()
        found += zip(xs[::2], xs[1::2], strict=True)
    out = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def heights(*geoms):
    segs = [(p, q) for g in geoms for polygon in g for r in polygon for p, q in zip(r, r[1:] + r[:1], strict=True)]
    ys = {p["lat"] for p, _ in segs}
    for i, (p, q) in enumerate(segs):
        for r, s in segs[:i]:
            dx, dy, ex, ey = q["lon"] - p["lon"], q["lat"] - p["lat"], s["lon"] - r["lon"], s["lat"] - r["lat"]
            turn = dx * ey - dy * ex
            if turn:
                t, u = ((r["lon"] - p["lon"]) * ey - (r["lat"] - p["lat"]) * ex) / turn, ((r["lon"] - p["lon"]) * dy - (r["lat"] - p["lat"]) * dx) / turn
                if 0 < t < 1 and 0 <= u <= 1:
                    ys.add(p["lat"] + t * dy)
    return sorted(ys)


def scanned(rule, *geoms):
    """The area where a rule on being inside each geometry holds."""
    total, ys = 0.0, heights(*geoms)
    for lo, hi in zip(ys, ys[1:], strict=False):
        of = [spans(g, (lo + hi) / 2) for g in geoms]
        xs = sorted({x for s in of for ab in s for x in ab})
        for a, b in zip(xs, xs[1:], strict=False):
            total += (hi - lo) * (b - a) * rule(*(any(p <= (a + b) / 2 <= q for p, q in s) for s in of))
    return total


def wild(rng):
    """Polygons that cross themselves, with holes that may lie outside, and overlap."""
    return [[ring(*((round(rng.uniform(0, 4), 2), round(rng.uniform(0, 4), 2)) for _ in range(rng.randint(3, 7)))) for _ in range(rng.choice([1, 1, 2]))] for _ in range(rng.choice([1, 2]))]


RULES = {"intersection": lambda a, b: a and b, "union": lambda a, b: a or b, "difference": lambda a, b: a and not b, "symmetric": lambda a, b: a != b}


def test_rules_of_wild_polygons(spark):
    rng = random.Random(3)
    rows = [(i, wild(rng), wild(rng)) for i in range(25)]
    df = spark.createDataFrame(rows, f"id int, a {KIND}, b {KIND}")
    for name in ("union", "difference"):
        rule = RULES[name]
        got = {r.id: r.area for r in overlay.areas(overlay.both(df, ["id"], name), ["id"]).collect()}
        assert {i: got.get(i, 0.0) for i, _, _ in rows} == pytest.approx({i: scanned(rule, a, b) for i, a, b in rows}, abs=1e-9)


def test_make_valid_and_point_on_surface(spark):
    rng = random.Random(5)
    shapes = {"bow": [[ring((0, 0), (2, 2), (2, 0), (0, 2))]], "holed": [[square(0, 0, 4), square(1, 1, 2)]], "outside": [[square(0, 0, 1), square(5, 5, 1)]], "twice": [[square(0, 0, 2)], [square(1, 1, 2)]]}
    shapes |= {f"w{i}": wild(rng) for i in range(12)}
    df = spark.createDataFrame(list(shapes.items()), f"id string, geom {KIND}")
    pieces = overlay.make_valid(df, ["id"])
    area = {r.id: r.area for r in overlay.areas(pieces, ["id"]).collect()}
    assert area == pytest.approx({i: scanned(lambda a: a, g) for i, g in shapes.items()}, abs=1e-9)
    assert (area["bow"], area["holed"], area["outside"], area["twice"]) == pytest.approx((2, 12, 2, 7))
    # the pieces as a geometry hold the same and don't overlap
    again = {r.id: r.geom for r in overlay.as_geometry(pieces, ["id"]).collect()}
    flat = {i: sum(abs(sum(p["lon"] * q["lat"] - q["lon"] * p["lat"] for p, q in zip(r, r[1:], strict=False))) / 2 for poly in g for r in poly) for i, g in again.items()}
    assert flat == pytest.approx(area, abs=1e-9)
    assert len(again["holed"]) == 4 and len(again["bow"]) == 4
    for r in overlay.point_on_surface(pieces, ["id"]).collect():
        assert any(a < r.lon < b for a, b in spans(shapes[r.id], r.lat))


def test_buffer(spark):
    far = [[square(0, 0, 2)], [square(20, 0, 2)]]
    near = [[square(0, 0, 2)], [square(2.5, 0, 2)]]
    df = spark.createDataFrame([("far", far), ("near", near), ("holed", [[square(0, 0, 9), square(3, 3, 3)]])], f"id string, geom {KIND}")
    got = {r.id: r.area for r in overlay.areas(overlay.buffer(df, ["id"], 0.5), ["id"]).collect()}
    disc = 32 / 2 * math.sin(2 * math.pi / 32) * 0.25
    one = 4 + 4 * 2 * 0.5 + disc
    assert got["far"] == pytest.approx(2 * one)
    # the two overlap by half a degree at most, and round off towards their corners
    assert 2 * one - 0.5 * 3 < got["near"] < 2 * one - 0.5 * 2
    # the hole shrinks by the distance on all sides
    assert got["holed"] == pytest.approx(81 + 4 * 9 * 0.5 + disc - 4)
    with pytest.raises(ValueError):
        overlay.buffer(df, ["id"], 0)


def test_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [[]]), (4, [[ring((0, 0), (1, 1))]]), (5, [[ring((0, 0), (1, 0), (2, 0))]])], f"id int, geom {KIND}")
    assert overlay.make_valid(df, ["id"]).count() == 0 and overlay.make_valid(df.limit(0), ["id"]).count() == 0
    assert overlay.areas(overlay.buffer(df, ["id"], 1.0), ["id"]).filter(F.col("id") < 4).count() == 0


def test_coverage_equals_the_scan(spark):
    rng = random.Random(8)
    a = [(f"s{i}", [[ring(*((x + rng.uniform(-1, 1), y + rng.uniform(-1, 1)) for _ in range(5)))]]) for i, (x, y) in enumerate((rng.uniform(0, 4), rng.uniform(0, 4)) for _ in range(12))]
    b = [(f"r{i}", [[square(i % 4, i // 4, 1.0)]]) for i in range(16)]
    got = {(r.id, r.code): r.share for r in regions.coverage(spark.createDataFrame(a, f"id string, geom {KIND}"), spark.createDataFrame(b, f"code string, geom {KIND}")).collect()}
    want = {(i, c): scanned(lambda p, q: p and q, g, h) for i, g in a for c, h in b}
    assert got == pytest.approx({k: v for k, v in want.items() if v > 1e-11}, abs=1e-9)
