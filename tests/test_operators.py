import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lithos.functions import geo, ids, levels, text
from lithos.graph import connected_components
from lithos.operators import fire, flood, joins, latest, quake, regions, weather
from lithos.policies import CROSS_SOURCE, MatchRule
from lithos.plans import tables


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_felt_radius_and_levels(spark):
    lit = F.lit
    for m, h, want in ((5.0, 0.0, 31.6228), (6.0, 0.0, 100.0), (5.0, 10.0, 30.0), (4.0, 20.0, 0.0)):
        assert abs(one(spark, geo.felt_radius_km(lit(m), lit(h))) - want) < 1e-3
    assert one(spark, geo.felt_radius_km(lit(5.0), lit(-3.0))) == one(spark, geo.felt_radius_km(lit(5.0), lit(0.0)))
    cases = [(3, 10, 200, 1), (4, 1, 5, 2), (4, 1, 20, 1), (5, 10, 25, 3), (4.5, 10, 50, 3), (4.4, 10, 3, 2), (6, 10, 100, 4), (6, 10, 101, 1), (6.5, 10, 150, 3), (5.9, 10, 50, 3), (5.5, 300, 10, 3), (4, 300, 10, 1)]
    df = spark.createDataFrame([(float(m), float(h), float(d), w) for m, h, d, w in cases], "m double, h double, d double, want int")
    assert df.filter(geo.quake_level(F.col("m"), F.col("h"), F.col("d")) != F.col("want")).count() == 0


def test_percentiles_of_one_to_ten(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 11)] + [("a", float("nan")), ("a", None)], "k string, v double")
    r = flood.thresholds(df, ["k"], "v", min_samples=10).first()
    assert [round(r[c], 6) for c in ("p50", "p80", "p90", "p98", "p99_5")] == [5.5, 8.2, 9.1, 9.82, 9.955]
    assert r.samples == 10 and r.ok


def test_haversine_and_rounding(spark):
    assert abs(one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) - 111.195) < 0.001
    assert one(spark, geo.round_half_up(F.lit(-0.001), 2)) == 0.0 and str(one(spark, geo.round_half_up(F.lit(-0.001), 2))) == "0.0"


def test_event_ids_are_version_eight(spark):
    import hashlib
    import uuid

    h = bytearray(hashlib.sha256(b"fire\x0042").digest()[:16])
    h[6], h[8] = h[6] & 0x0F | 0x80, h[8] & 0x3F | 0x80
    assert one(spark, ids.fire_event_id(F.lit("42"))) == str(uuid.UUID(bytes=bytes(h)))


def test_tsunami_words(spark):
    said = {"Gempa ini  TIDAK berpotensi tsunami": "none", "berpotensi  tsunami": "potential", "Peringatan dini tsunami": "potential", "tsunami?": "unknown", None: "unknown"}
    df = spark.createDataFrame(list(said.items()), "s string, want string")
    assert df.filter(text.tsunami_status(F.col("s")) != F.col("want")).count() == 0


def test_text_helpers(spark):
    assert one(spark, text.squash(F.lit(" a \n b "))) == "a b"
    assert one(spark, text.clip_bytes(F.lit("é" * 60), 101)) == "é" * 50
    assert one(spark, text.decimal_comma(F.lit(5.25))) in ("5,3", "5,2")
    assert one(spark, text.similarity(F.lit("bandung"), F.lit("bandong"))) > 0.3


def test_discharge_and_rain_levels(spark):
    t = [F.lit(float(x)) for x in (10, 20, 30, 40)]
    df = spark.createDataFrame([(15.0, None, 25.0), (None, 15.0, 25.0), (15.0, None, 15.0), (45.0, None, 50.0)], "med double, one double, p75 double")
    level, possible = levels.discharge_level(F.col("med"), F.col("one"), F.col("p75"), t)
    assert [(r.l, r.p) for r in df.select(level.alias("l"), possible.alias("p")).collect()] == [(2, True), (1, False), (1, False), (4, False)]


@pytest.mark.parametrize("seed", range(3))
def test_newest_and_components_ignore_order(spark, seed):
    rng = random.Random(seed)
    rows = [(i % 5, rng.randint(0, 9), i, rng.choice([None, "x", "y"])) for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, t int, id int, s string")
    got = {r.k: (r.t, r.id, r.first_seen) for r in latest.newest(df, ["k"], ["t", "id"], "t").collect()}
    for k in range(5):
        own = [r for r in rows if r[0] == k]
        t, i = max((r[1], r[2]) for r in own)
        assert got[k] == (t, i, min(r[1] for r in own))
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(50)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    touched = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for x in touched}


def test_band_join_has_no_nested_loop(spark):
    df = spark.createDataFrame([(i, float(i * 7 % 100), 0.0, 0.0, 1.0) for i in range(50)], "id int, t double, lat double, lon double, mag double")
    m = joins.matches(df, df, CROSS_SOURCE)
    assert "NestedLoop" not in m._jdf.queryExecution().executedPlan().toString()
    want = sum(abs(a * 7 % 100 - b * 7 % 100) <= 30 for a in range(50) for b in range(50))
    assert m.count() == want
    semi, anti = joins.matches(df, df.limit(3), CROSS_SOURCE, "left_semi").count(), joins.matches(df, df.limit(3), CROSS_SOURCE, "left_anti").count()
    assert semi + anti == 50


def test_fire_chain_limits(spark):
    day = 86_400
    rows = [(1, 0, -6.5, 107.0), (2, day, -6.5, 107.0), (3, 2 * day + 60, -6.5, 107.0), (4, 0, -6.5, 107.015), (5, 0, -6.5, 107.03), (6, 0, -6.9, 107.5)]
    got = {r.id: r.event for r in fire.chain(spark.createDataFrame(rows, "id long, t long, lat double, lon double")).collect()}
    # linked at exactly a day, not a minute later; 4 links 1 and 5
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 1, 6: 6}


def test_rolling_needs_whole_windows(spark):
    rows = [("a", h, 1.0) for h in range(49) if h != 30]
    out = flood.rolling_day_maxima(spark.createDataFrame(rows, "k string, hour long, v double"), ["k"], "hour", "v", 24).collect()
    assert {(r.epoch_day, r.day_max) for r in out} == {(0, 24.0), (1, 24.0)}


def test_episode_boundaries(spark):
    rows = [("s", t) for t in (0, 10, 86_409, 86_410 + 86_400)]
    out = flood.episodes(spark.createDataFrame(rows, "site string, at long"), "site", "at", F.lit(True), 86_400).collect()
    assert [r.episode for r in sorted(out, key=lambda r: r["at"])] == [1, 1, 1, 2]


REPORTS = "id string, source string, t double, lat double, lon double, mag double, seen double, alternates array<string>, deleted boolean, arrived double"


def reports_of(rng, n, seconds):
    rows = []
    for i in range(n):
        t, source = rng.random() * seconds, rng.choice(["bmkg", "usgs"])
        lat, lon, mag = -7 + rng.random(), 107 + rng.random(), 4 + rng.random() * 1.5
        for k in range(rng.choice([1, 1, 1, 2, 3])):  # revisions move a little; some are withdrawn and may come back
            rows.append((str(i), source, t + rng.random() * 8, lat, lon + rng.random() * 0.2, mag, t + 20 * k, [str(i - 1)] if rng.random() < 0.1 else [], rng.random() < 0.1, rng.random() * 1e4))
    return rows


@pytest.mark.parametrize("seed,seconds", [(7, 3000), (8, 300), (9, 20_000)])
def test_placement_holds_its_invariant(spark, seed, seconds):
    rows = reports_of(random.Random(seed), 150, seconds)
    df = spark.createDataFrame(rows, REPORTS)
    placed = quake.place(df)
    got = {(r.source, r.id): r.event for r in placed.collect()}
    last = {}
    for r in sorted(rows, key=lambda r: (r[9], r[1], r[0])):
        last[r[1], r[0]] = r
    assert set(got) == set(last)
    assert {k for k, e in got.items() if e is None} == {k for k, r in last.items() if r[8]}
    assert quake.broken_pairs(df, placed).count() == 0
    # the groups make no difference: all in one placer gives the same sets
    one = quake.Placer()
    everyone = list(last)
    for r in sorted(rows, key=lambda r: (r[9], r[1], r[0])):
        one.arrive(dict(zip(("id", "source", "t", "lat", "lon", "mag", "seen", "alternates", "deleted"), r)), [k for k in everyone if k in one.home])
    for e in set(one.home.values()):
        counted = [one.newest[k] for k in one.in_force(one.members[e]).values()]
        assert len(counted) < 2 or quake._score(*counted, CROSS_SOURCE) is not None


def test_placement_is_sticky_and_names_are_fresh(spark):
    at = lambda i, s, t, arrived, lat=-7.0, deleted=False: (i, s, t, lat, 107.0, 5.0, arrived, [], deleted, arrived)
    rows = [
        at("a", "bmkg", 0.0, 1.0), at("b", "usgs", 10.0, 2.0),  # one event
        at("a", "bmkg", 1.0, 3.0),  # a revision stays at home
        at("c", "bmkg", 5000.0, 1.0), at("c", "bmkg", 5000.0, 2.0, deleted=True), at("c", "bmkg", 5000.0, 3.0),  # withdrawn and back
        at("d", "usgs", 9000.0, 1.0), at("e", "bmkg", 9000.0, 2.0), at("d", "usgs", 9000.0, 3.0, lat=7.0),  # the founder moves away
    ]
    got = {r.id: r for r in quake.place(spark.createDataFrame(rows, REPORTS)).collect()}
    assert got["a"].event == got["b"].event and got["a"].founder_id == "a"
    assert (got["c"].founder_id, got["c"].generation) == ("c", 1)
    assert got["d"].event != got["e"].event and (got["d"].founder_id, got["d"].generation) == ("d", 1) and (got["e"].founder_id, got["e"].generation) == ("d", 0)


def test_placement_of_one_report_an_earthquake_ignores_order(spark):
    rng = random.Random(3)
    rows = []
    for q in range(40):  # far apart in time: one event for each, whatever comes first
        for k, source in enumerate(["bmkg", "usgs", "usgs"]):
            rows.append([f"{q}-{k}", source, 1000.0 * q + k, -7.0, 107.0 + 0.1 * k, 5.0, 1000.0 * q + 60 * k, [], False])
    want = None
    for _ in range(3):
        rng.shuffle(rows)
        df = spark.createDataFrame([(*r, float(i)) for i, r in enumerate(rows)], REPORTS)
        own = {}
        for r in quake.place(df).collect():
            own.setdefault(r.event, set()).add(r.id)
        sets = sorted(sorted(x) for x in own.values())
        assert want in (None, sets) and len(sets) == 40
        want = sets


def test_arrivals_come_late(spark):
    df = spark.createDataFrame([("a", "bmkg", 10.0, -7.0, 107.0, 5.0), ("b", "usgs", 12.0, -7.0, 107.0, 5.0)], "id string, source string, t double, lat double, lon double, mag double")
    got = {r.id: r.arrived for r in quake.arrivals(df, {"bmkg": 180, "usgs": 1200}).collect()}
    assert got == {"a": 190.0, "b": 1212.0}


def test_matches_near_the_date_line_and_the_pole(spark):
    rows = [(1, 0.0, 10.0, 179.9, 5.0), (2, 10.0, 10.0, -179.9, 5.0), (3, 0.0, 89.5, 0.0, 5.0), (4, 0.0, 89.5, 180.0, 5.0), (5, 0.0, -6.0, 107.0, 5.0), (6, 30.0, -6.0, 107.9, 6.0), (7, 31.0, -6.0, 107.0, 5.0)]
    df = spark.createDataFrame(rows, "id int, t double, lat double, lon double, mag double")
    got = {(r.a_id, r.b_id) for r in joins.matches(df, df, CROSS_SOURCE).filter("a_id < b_id").collect()}
    assert got == {(1, 2), (5, 6), (6, 7)}
    assert {(r.a_id, r.b_id) for r in joins.matches(df, df, MatchRule(30, 150, 1.0)).filter("a_id < b_id").collect()} == {(1, 2), (3, 4), (5, 6), (6, 7)}


def test_warning_chains_and_lifecycle(spark):
    t = lambda h: dt.datetime(2026, 9, 24, h)
    ref = lambda i, h: [(i, "x", t(h))]
    rows = [("a", t(1), "Alert", [], [[(1.0, 2.0)]]), ("b", t(2), "Update", ref("a", 1), []), ("c", t(3), "Cancel", ref("b", 2), []), ("e", t(5), "Update", ref("d", 4), [[(1.0, 2.0)]])]
    m = spark.createDataFrame([(i, s, k, r, p, s, s, s, "d" + i) for i, s, k, r, p in rows], "identifier string, sent timestamp, msg_type string, references array<struct<identifier:string,sender:string,sent:timestamp>>, polygons array<array<struct<lat:double,lon:double>>>, effective timestamp, onset timestamp, first_seen_at timestamp, digest string")
    of = weather.chains(m)
    assert {r.identifier: r.chain for r in of.collect()} == {"a": "a", "b": "a", "c": "a", "e": "d"}
    got = {r.chain: r for r in weather.derive(weather.in_force(m), of).collect()}
    assert (got["a"].root, got["a"].current, got["a"].content, got["a"].cancelled) == ("a", "c", "a", True)
    assert (got["d"].root, got["d"].current, got["d"].content, got["d"].cancelled) == ("d", "e", "e", False)


def test_polygons(spark):
    path = '[[[0,0],[0,4],[4,4],[4,0]],[[1,1],[1,2],[2,2],[2,1],[1,1]],[[0,0],[1,1]]]'
    g = spark.createDataFrame([("11.01", path)], "code string, path string").select("code", regions.from_path(F.col("path")).alias("geom"))
    r = g.select(regions.planar_area(F.col("geom")).alias("a"), regions.bbox(F.col("geom")).alias("b"), F.size(F.col("geom")[0]).alias("n"), regions.geojson(F.col("geom")).alias("j")).first()
    assert (r.a, list(r.b), r.n) == (15.0, [0.0, 0.0, 4.0, 4.0], 2) and r.j.startswith('{"type":"MultiPolygon"')
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 4.0, 2.0), (4, 9.0, 9.0)], "id int, lon double, lat double")
    assert {x.id: x.code for x in regions.region_of(pts, g).collect()} == {1: "11.01", 2: None, 3: "11.01", 4: None}
    near = {x.id: x.km for x in regions.regions_within(pts, g, 200.0).collect()}
    assert near[1] == 0 and near[3] == 0 and 50 < near[2] < 60 and 4 not in near
    whole = spark.createDataFrame([("s", "[[[0,0],[0,2],[4,2],[4,0]]]")], "id string, path string").select("id", regions.from_path(F.col("path")).alias("geom"))
    assert abs(regions.coverage(whole, g).first().share - 7.5 / 15) < 0.1


def test_region_kinds(spark):
    df = spark.createDataFrame([(c,) for c in ("32", "32.04", "32.73", "32.73.01", "32.73.01.1001", "32.04.05.2001", "3", "32.1", "32.73.01.3001")], "code string")
    got = {r.code: (r.l, r.k) for r in df.select("code", regions.level(F.col("code")).alias("l"), regions.kind(F.col("code")).alias("k")).collect()}
    assert got["32.73"] == (2, "city") and got["32.04"] == (2, "regency") and got["32.73.01.1001"] == (4, "urban_village") and got["32.04.05.2001"] == (4, "village")
    assert got["3"] == (None, None) and got["32.1"] == (None, None) and got["32.73.01.3001"] == (4, None)


def test_coverage_is_exact(spark):
    paths = {"thin": "[[[0,3.99],[0,9],[4,9],[4,3.99]]]", "half": "[[[0,0],[0,2],[4,2],[4,0]]]", "tri": "[[[0,0],[4,0],[0,4]]]", "touch": "[[[4,0],[4,4],[5,4],[5,0]]]"}
    of = lambda rows, k: spark.createDataFrame(rows, f"{k} string, path string").select(k, regions.from_path(F.col("path")).alias("geom"))
    g = of([("holed", "[[[0,0],[0,4],[4,4],[4,0]],[[1,1],[1,2],[2,2],[2,1]]]")], "code")
    got = {r.id: r.share for r in regions.coverage(of(list(paths.items()), "id"), g).collect()}
    assert got == pytest.approx({"thin": 0.04 / 15, "half": 7 / 15, "tri": 7 / 15})


def test_region_coverage_takes_all_shapes(spark):
    sf = "/root/testdata/sf0.001"
    keys = [r[0] for r in spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey").collect()]
    box = {f"{k:05d}": (106.3 + (k * 41 % 40) / 16, -7.9 + (k * 23 % 32) / 16, (1 + k % 5) / 8) for k in keys}
    want = {}
    for i, (w, s, z) in box.items():
        for j, (x, t, y) in box.items():
            own = max(0, min(w + z, x + y) - max(w, x)) * max(0, min(s + z, t + y) - max(s, t)) / y**2
            if own > 1e-9:
                want[i, j] = own
    got = {(r.id, r.code): r.share for r in tables.region_coverage(spark, sf).collect()}
    assert got == pytest.approx(want)


def test_components_of_partitions_that_a_task_cannot_hold(spark, monkeypatch):
    import pyarrow as pa

    from lithos import graph

    rng = random.Random(12)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)]
    edges = [(max(e), min(e)) for e in edges if e[0] != e[1]]
    monkeypatch.setattr(graph, "MOST_NODES", 7)
    batches = [pa.RecordBatch.from_pylist([{"u": u, "v": v} for u, v in edges[i : i + 10]]) for i in range(0, len(edges), 10)]
    out = list(graph._local_stars(iter(batches)))
    assert len(out) > 10

    def components(pairs):
        up = {}

        def root(x):
            while up.get(x, x) != x:
                x = up[x]
            return x

        for u, v in pairs:
            u, v = root(u), root(v)
            up[max(u, v)] = min(u, v)
        return {x: root(x) for p in edges for x in p}

    assert components([(r["u"], r["v"]) for b in out for r in b.to_pylist()]) == components(edges)
