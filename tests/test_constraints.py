"""Each table's promises: a sound row breaks none, and each change to it breaks what it should."""

import datetime as dt

import pytest

from lithos.operators import constraints as c

T = dt.datetime(2031, 5, 6)
H, D = dt.timedelta(hours=1), dt.timedelta(days=1)
SHA = "ab" * 32
VILLAGE = "21.03.04.1005"
WEB = {"shakemap_url": "", "source_url": "https://x.example/1"}

#: A sound row of each table.
SOUND = {
    "region": {"code": VILLAGE, "kind": "x", "name": "Y", "source": "s", "source_version": "1", "parent_code": None},
    "event": {"id": "e1", "kind": "quake", "status": "active", "level": 2, "primary_source": "bmkg", "source_event_id": "s1", "occurred_at": T, "detected_at": T + H, "expires_at": T + 6 * H, "title": "t", "summary": "", "revision": 1, "content_sha256": SHA, "merged_into": None, "ended_at": None},
    "quake": {"event_id": "e1", "kind": "quake", "magnitude": 5.0, "depth_km": 10.0, "felt_radius_km": 0.0, "tsunami": "none", **WEB},
    "event_source": {"source": "bmkg", "source_event_id": "s1", "feed": "bmkg-felt", "kind": "quake", "event_id": "e1", "occurred_at": T, "magnitude": 5.0, "depth_km": 10.0, "tsunami": "none", "fetched_at": T + H, "first_seen_at": T, "content_sha256": SHA, "alternate_ids": ["a"], "review_status": "", **WEB},
    "impact_region": {"event_id": "e1", "region_code": VILLAGE, "distance_km": 1.0, "level": 2, "within_felt": True, "coverage": None},
    "outbox": {"id": 1, "subject": "hazard.quake.created", "msg_id": "e1:r1", "payload": b"x", "traceparent": "00-" + "1" * 32 + "-" + "2" * 16 + "-01"},
    "cap_message": {"source": "bmkg", "identifier": "m1", "kind": "weather", "event_id": None, "sender": "s", "sent": T, "msg_type": "alert", "severity": "severe", "effective": T, "onset": T + H, "expires": T + D, "polygon_count": 1, "fetched_at": T + H, "first_seen_at": T, "content_sha256": SHA, "texts": [("id", "h")], "web": "", "source_url": ""},
    "cap_reference": {"source": "bmkg", "identifier": "m1", "ref_identifier": "m0", "ref_sender": "s", "ref_sent": T},
    "site": {"id": "river:x-1", "kind": "river", "name": "n", "river": "r", "lat": -6.0, "lon": 107.0, "region_code": None, "first_seen_at": T},
    "river_discharge": {"site_id": "river:x-1", "model": "m", "issued_at": T, "valid_date": T + D, "discharge_m3s": 1.0, **{f"ensemble_{k}_m3s": v for k, v in (("min", 1.0), ("p25", 2.0), ("median", 3.0), ("mean", 3.0), ("p75", 4.0), ("max", None))}},
    "hotspot": {"id": "MODIS_NRT:20310506T0000:-6.00000:107.00000", "detected_at": T, "product": "MODIS_NRT", "satellite": "A", "instrument": "MODIS", "lat": -6.0, "lon": 107.0, "confidence": "high", "confidence_pct": 80, "brightness_k": 300.0, "background_k": None, "frp_mw": None, "scan_km": 1.0, "track_km": 1.0, "daytime": True, "version": "6", "region_code": None, "first_fetched_at": T},
}
TYPES = {str: "string", int: "long", float: "double", bool: "boolean", bytes: "binary", dt.datetime: "timestamp"}
OWN = {"alternate_ids": "array<string>", "texts": "array<struct<language:string,headline:string>>", "ended_at": "timestamp", "coverage": "double", "ensemble_max_m3s": "double", "background_k": "double", "frp_mw": "double"}

#: What changes break, beside the sound row of the table.
BROKEN = [
    ("region", {"code": "21.3"}, "check:code"), ("region", {"name": " Y"}, "check:name"), ("region", {"code": "22.01", "parent_code": "22"}, "reference:parent_code>region"),
    ("event", {"id": "e2", "status": "merged", "ended_at": T}, "check:merged"), ("event", {"id": "e2", "ended_at": T}, "check:ended"), ("event", {"id": "e2", "level": 5}, "check:level"), ("event", {"id": "e2", "expires_at": T}, "check:expires"),
    ("event", {"id": "e2", "detected_at": T - 2 * H}, "check:detected"), ("event", {"id": "e2", "status": "merged", "ended_at": T, "merged_into": "e2"}, "check:not_into_itself"), ("event", {"id": "e2", "title": None}, "null:title"),
    ("event", {"id": "e2", "status": "merged", "ended_at": T, "merged_into": "e9"}, "reference:merged_into>event"), ("event", {}, "key:id"),
    ("quake", {"event_id": "e9"}, "reference:event_id,kind>event"), ("quake", {"magnitude": 11.0}, "check:magnitude"), ("quake", {"source_url": "http://x"}, "check:source_url"),
    ("event_source", {"feed": "usgs-summary"}, "check:feed_of_source"), ("event_source", {"review_status": "deleted"}, "check:deleted"), ("event_source", {"alternate_ids": ["a"] * 33}, "check:alternates"),
    ("impact_region", {"coverage": 0.0}, "check:coverage"), ("impact_region", {"region_code": "21.03.04.1006"}, "reference:region_code>region"),
    ("outbox", {"id": 2, "msg_id": "e1:r2", "traceparent": "00-" + "0" * 32 + "-" + "2" * 16 + "-01"}, "check:trace"), ("outbox", {"id": 2}, "key:msg_id"), ("outbox", {"id": 2, "msg_id": "x", "subject": "hazard.quake.gone"}, "check:subject"),
    ("cap_message", {"identifier": "m2", "expires": T + 8 * D}, "check:valid_for"), ("cap_message", {"identifier": "m2", "polygon_count": 0}, "check:area"), ("cap_message", {"identifier": "m2", "texts": [("en", "h")]}, "check:texts"),
    ("cap_reference", {"identifier": "m7"}, "reference:source,identifier>cap_message"), ("cap_reference", {"ref_identifier": "m1"}, "check:not_itself"),
    ("site", {"id": "grid:-6.00:107.00"}, "check:kind_of_id"), ("site", {"id": "river:y", "river": ""}, "check:named"), ("site", {"id": "river:y", "lon": 90.0}, "check:place"),
    ("river_discharge", {"ensemble_p25_m3s": 0.5}, "check:order"), ("river_discharge", {"valid_date": T + D + H}, "check:midnight"), ("river_discharge", {"site_id": "river:z"}, "reference:site_id>site"),
    ("hotspot", {"confidence": "low"}, "check:confidence_of_percent"), ("hotspot", {"confidence_pct": None}, "check:percent_of_modis"), ("hotspot", {"lat": -6.1}, "check:id"), ("hotspot", {"scan_km": 20.0}, "check:scan_km"),
]


def frame(spark, table, rows):
    ddl = ", ".join(f"{k} {OWN.get(k) or TYPES[type(v) if v is not None else str]}" for k, v in SOUND[table].items())
    return spark.createDataFrame([tuple(r.values()) for r in rows], ddl)


def test_sound_rows_break_nothing(spark):
    tables = {t: frame(spark, t, [r]) for t, r in SOUND.items()}
    rows = c.check(tables).collect()
    assert not [r for r in rows if r.violations] and len(rows) > 150
    assert not any(c.broken(df, c.CATALOGUE[t]).count() for t, df in tables.items())


def test_each_promise(spark):
    """All changed rows of all tables at once, each under keys of its own, against the rules that they should break."""
    want, rows = {}, {t: [r] for t, r in SOUND.items()}
    for table, change, rule in BROKEN:
        row = SOUND[table] | change
        rows[table].append(row)
        want.setdefault((table, rule), 0)
        want[table, rule] += 1
    got = {(r["table"], r.rule): r.violations for r in c.check({t: frame(spark, t, rs) for t, rs in rows.items()}).collect()}
    assert all(got[k] >= n for k, n in want.items()), {k: got.get(k) for k in want if got.get(k, 0) < want[k]}
    checks = {k: n for k, n in got.items() if k[1].startswith(("check", "null")) and n}
    assert set(checks) - set(want) <= {("event_source", "check:feed"), ("site", "check:kind"), ("hotspot", "check:instrument"), ("site", "check:id")}


def test_keys_and_references_pass_over_nulls(spark):
    two = {"a": c.Table((("k",), ("u",)), (), {}, ((("r",), "a", ("k",)),))}
    df = spark.createDataFrame([(1, None, None), (2, None, 1), (3, 7, 9), (None, 7, None)], "k int, u int, r int")
    got = {r.rule: r.violations for r in c.check({"a": df}, two).collect()}
    assert got == {"null:k": 1, "key:k": 0, "key:u": 1, "reference:r>a": 1}


@pytest.mark.parametrize("table", sorted(c.CATALOGUE))
def test_conditions_parse(spark, table):
    for k, e in c.CATALOGUE[table].holds.items():
        assert k and spark._jsparkSession.sessionState().sqlParser().parseExpression(e) is not None
