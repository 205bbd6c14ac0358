import datetime as dt
import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lithos.sources import json_feeds, sinks, tabular, xml_feeds

NOW = dt.datetime(2033, 5, 14, 12)


def raw(spark, *bodies):
    return spark.createDataFrame([(f"p{i}", b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "path string, body string")


def quake(**kw):
    return {"Tanggal": "05 Mar 2025", "Jam": "03:04:05 WIB", "DateTime": "2025-03-04T20:04:05+00:00", "Coordinates": "-2.25,118.40", "Lintang": "2.25 LS", "Bujur": "118.40 BT", "Magnitude": "5.4", "Kedalaman": "33 km", "Wilayah": "Pusat gempa berada di darat", "Potensi": "Tidak berpotensi tsunami"} | kw


def test_agency_quakes(spark):
    one = {"Infogempa": {"gempa": quake()}}
    many = {"Infogempa": {"gempa": [quake(DateTime=None, Coordinates=None, Magnitude="4,9"), quake(DateTime="2025-03-04T21:00:00+00:00"), quake(DateTime="2025-03-04T21:00:00+00:00")]}}
    good, bad = json_feeds.agency_quakes(raw(spark, one, many), "auto", F.lit(NOW))
    got = sorted((r.path, r.event_id, r.latitude, r.longitude, r.magnitude, r.depth_km, r.tsunami) for r in good.collect())
    assert got == [("p0", "20250304200405", -2.25, 118.4, 5.4, 33.0, "none"), ("p1", "20250304200405", -2.25, 118.4, 4.9, 33.0, "none")]
    assert [r.errors for r in bad.collect()] == [["repeated"], ["repeated"]]


def test_geojson_quakes(spark):
    f = lambda i, kind, lon, **p: {"id": i, "properties": {"mag": 5.256, "place": "x", "time": 1790000000000, "updated": 1790000100000, "url": "https://x", "status": "reviewed", "type": kind, "magType": "mb", "ids": f",{i},other,", **p}, "geometry": {"coordinates": [lon, -7.0, 10.0]}}
    good, bad = json_feeds.geojson_quakes(raw(spark, {"features": [f("a", "earthquake", 107.0), f("b", "explosion", 107.0), f("c", "earthquake", 10.0), f("d", "earthquake", 107.0, mag=None)]}), F.lit(dt.datetime(2027, 1, 1)))
    r = good.collect()
    assert [(x.event_id, x.magnitude, x.alternate_ids) for x in r] == [("a", 5.26, ["other"])]
    assert [(x.event_id, x.errors) for x in bad.collect()] == [("d", ["magnitude"])]


def test_model_columns_and_rain(spark):
    loc = lambda v: {"latitude": 1.0, "longitude": 2.0, "elevation": 3.0, "hourly": {"time": [0, 3600, 7200], "precipitation": v}, "hourly_units": {"precipitation": "mm"}}
    sites = spark.createDataFrame([(0, "s0"), (1, "s1")], "pos int, site_id string")
    good, bad = json_feeds.model_columns(raw(spark, [loc([1.0, None, 3.0]), loc([2.0, 2.0, 4.0])], loc([1.0])), {"precipitation": "mm"}, sites)
    assert bad.select("errors").collect()[0].errors == ["length"]
    rows = good.filter("path = 'p0'")
    assert rows.count() == 5
    w = spark.createDataFrame([("b", "s0", 0.25), ("b", "s1", 0.75)], "basin string, site_id string, weight double")
    assert sorted(r["mean"] for r in json_feeds.catchment_rain(rows, w).collect()) == [1.75, 3.75]


def test_stations_and_values(spark):
    body = {"results": [{"id": 1, "name": "a", "isMobile": False, "coordinates": {"latitude": 1, "longitude": 2}, "sensors": [{"id": 11, "parameter": {"name": "pm25", "units": "μg/m³"}}, {"id": 12, "parameter": {"name": "um010", "units": "x"}}]}, {"id": 2, "isMobile": True, "sensors": []}]}
    s = json_feeds.stations(raw(spark, body))
    assert [(r.site_id, r.sensor_id, r.unit) for r in s.collect()] == [("openaq:1", 11, "µg/m³")]
    v = json_feeds.latest_values(raw(spark, {"results": [{"datetime": {"utc": "2033-05-14T11:00:00Z"}, "value": 5.5, "sensorsId": 11, "locationsId": 1}, {"value": 1, "sensorsId": 12, "locationsId": 1}]}), s, F.lit(NOW))
    assert [(r.site_id, r.parameter, r.value) for r in v.collect()] == [("openaq:1", "pm25", 5.5)]


def test_village_forecast(spark):
    step = {"datetime": "2033-05-14T13:00:00Z", "t": 25, "tcc": 50, "tp": 0, "weather": 1, "wd_deg": 90, "ws": 5, "hu": 80, "vs": 9000, "analysis_date": "2033-05-14T00:00:00"}
    body = {"lokasi": {"adm4": "21.86.05.1003"}, "data": [{"cuaca": [[step, step | {"t": None}]]}]}
    good, bad = json_feeds.village_forecasts(raw(spark, body), F.lit("21.86.05.1003"))
    assert good.count() == 1 and bad.first().errors == ["missing"]
    assert json_feeds.village_forecasts(raw(spark, body), F.lit("21.86.05.1004"))[0].count() == 0


CAP = """<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><identifier>2.49.0.0.360.0.1</identifier><sender>a@b</sender><sent>2033-05-14T10:00:00+07:00</sent><status>Actual</status><msgType>Update</msgType>
<references>a@b,old.1,2033-05-14T09:00:00+07:00</references>
<info><language>en</language><event>Storm</event><severity>Moderate</severity><expires>2033-05-14T12:00:00+07:00</expires><headline>h</headline><area><areaDesc>X</areaDesc><polygon>-6,107 -6,108 -7,108 -6,107</polygon></area></info>
<info><language>id</language><event>Hujan</event><severity>Severe</severity><expires>2033-05-14T12:00:00+07:00</expires><area><areaDesc>X</areaDesc><polygon>-6,107 -6,108 -7,108 -6,107</polygon></area><area><areaDesc>Y</areaDesc></area></info></alert>"""


def test_cap_documents(spark):
    r = xml_feeds.warnings(raw(spark, CAP), F.lit(NOW)).first()
    assert (r.msg_type, r.severity, r.area_desc, len(r.texts)) == ("Update", "Severe", "X, Y", 2)
    assert r.effective == r.sent == dt.datetime(2033, 5, 14, 3) and r.onset is None
    assert [x.identifier for x in r.references] == ["old.1"]
    assert [(p.lat, p.lon) for p in r.polygons[0]] == [(-6.0, 107.0), (-6.0, 108.0), (-7.0, 108.0), (-6.0, 107.0)]


def test_rss_and_bulletin(spark):
    item = "<item><title>t</title><link>l</link><guid>{}</guid></item>"
    good, again = xml_feeds.warning_list(raw(spark, "<rss><channel>" + item.format("a") * 2 + item.format("b") + "</channel></rss>"))
    assert (good.count(), again.count()) == (2, 1)
    q = '<q:quakeml xmlns:q="x"><eventParameters><event publicID="e1"><origin publicID="o1"><time><value>2026-01-01T00:00:00Z</value></time><latitude><value>-7</value></latitude><longitude><value>107</value></longitude><depth><value>12000</value></depth><creationInfo><author>ISC</author></creationInfo></origin><magnitude publicID="m1"><mag><value>5.1</value></mag><type>mb</type><originID>o1</originID><creationInfo><agencyID>ISC</agencyID></creationInfo></magnitude></event></eventParameters></q:quakeml>'
    r = xml_feeds.bulletins(raw(spark, q)).first()
    assert (r.event, r.agency, r.author, r.depth_km, r.magnitude, r.magnitude_type) == ("e1", "ISC", "ISC", 12.0, 5.1, "mb")


def test_hotspots(spark, tmp_path):
    v = tmp_path / "v.csv"
    v.write_text("latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,bright_ti5,frp,daynight\n-6.123456,107.1,330.1,0.4,0.4,2033-05-14,35,N,VIIRS,h,2.0NRT,290,3.4,N\n")
    r = tabular.hotspots(spark, str(v), "VIIRS_NOAA20_NRT", F.lit(NOW)).first()
    assert (r.id, r.confidence, r.daytime, r.confidence_pct) == ("VIIRS_NOAA20_NRT:20330514T0035:-6.12346:107.10000", "high", False, None)
    m = tmp_path / "m.csv"
    m.write_text("latitude,longitude,brightness,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,bright_t31,frp,daynight,type\n-6.1,107.1,330.1,1,1,2020-09-24,0735,Terra,MODIS,45,6.1,290,3.4,D,\n")
    r = tabular.hotspots(spark, str(m), "MODIS_SP", F.lit(NOW), archive=True).first()
    assert (r.confidence, r.confidence_pct, r.type, r.daytime) == ("nominal", 45, -1, True)


def test_archive_chunks(spark):
    out = tabular.archive_chunks(spark, [("MODIS_SP", "2020-01-01", "2020-01-12"), ("MODIS_NRT", "2020-01-01", "2020-01-20")], "2020-01-03", "2020-01-18", "2020-01-22").orderBy("product", "from_day").collect()
    sp = [r for r in out if r.product == "MODIS_SP"]
    nrt = [r for r in out if r.product == "MODIS_NRT"]
    assert str(sp[0].from_day) == "2020-01-03" and str(sp[-1].to_day) == "2020-01-12" and all(r.final for r in sp)
    assert str(nrt[0].from_day) == "2020-01-13" and str(nrt[-1].to_day) == "2020-01-18" and not nrt[-1].final


def test_calibration_and_dump(spark, tmp_path):
    c = tmp_path / "c.csv"
    c.write_text("# rows: 2\n# period: 1997-2024\nid,p80\na,1.5\nb,2.5\n")
    df, comments, digest = tabular.calibration(spark, str(c), "id string, p80 double", 2)
    assert comments == {"rows": "2", "period": "1997-2024"} and df.count() == 2 and len(digest) == 64
    with pytest.raises(ValueError):
        tabular.calibration(spark, str(c), "id string, p90 double")
    d = tmp_path / "d.sql"
    d.write_text("-- note (1)\nINSERT INTO t (kode, nama) VALUES ('11.01', 'O''Neil (a,b)'), (NULL, 'x\\'y');\n/* c */ INSERT INTO t VALUES ('12', 'z');")
    rows, bad = tabular.sql_dump(spark, str(d), ["kode", "nama"])
    assert sorted((r.kode or "", r.nama) for r in rows.collect()) == [("", "x'y"), ("11.01", "O'Neil (a,b)"), ("12", "z")] and bad.count() == 0
    # nothing is lost: lists of another width are rejected, and other line ends are pieces too
    d.write_bytes(b"INSERT INTO t VALUES ('a','b'),('c'),('d','e');\r\nINSERT INTO t VALUES ('f', NULL, 'g'), (NULL, NULL);\r\n")
    rows, bad = tabular.sql_dump(spark, str(d), ["kode", "nama"], line_end="\r\n")
    assert sorted(((r.kode, r.nama) for r in rows.collect()), key=str) == [("a", "b"), ("d", "e"), (None, None)]
    assert sorted((r["values"], r.errors) for r in bad.collect()) == [(["c"], ["width"]), (["f", None, "g"], ["width"])]


def test_archive_ranges_list_only_their_days(spark, tmp_path):
    for c in ("alpha", "beta"):
        for day in ("2031/01/31", "2031/02/01", "2031/02/02", "2032/02/02"):
            k = tmp_path / c / day
            k.mkdir(parents=True)
            for h in ("03", "15"):
                (k / f"{h}0000Z-0123456789ab.json.gz").write_bytes(gzip.compress(b"{}"))
    every = sorted(r.key for r in tabular.archive_index(spark, str(tmp_path)).collect())
    assert len(every) == 16
    for lo, hi, days in ((every[3], every[6], 3), (every[1], None, 8), (None, every[2], 2), (every[5], every[12], 5), ("zeta", None, 0)):
        assert sorted(r.key for r in tabular.archive_index(spark, str(tmp_path), lo, hi).collect()) == [k for k in every if (lo is None or k > lo) and (hi is None or k < hi)]
        assert len(tabular.archive_days(spark, str(tmp_path), lo, hi)) == days
    assert {r.key for r in tabular.archive_index(spark, str(tmp_path), every[3], every[6], content=True).filter("length(content) > 0").collect()} == set(every[4:6])


def test_archive_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, sink = tmp_path / "a", str(tmp_path / "out")
    for i, day in enumerate(("01", "02", "03")):
        k = src / "alpha" / "2031" / "01" / day
        k.mkdir(parents=True)
        body = f'{{"n": {i}}}'.encode()
        (k / f"120000Z-{hashlib.sha256(body).hexdigest()[:12]}.json.gz").write_bytes(gzip.compress(body))
        good, _ = tabular.archive_payloads(tabular.archive_stream(spark, str(src), "alpha/2031/01/01/99", 1))
        q = good.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(60) and q.exception() is None
    assert sorted(r.body for r in spark.read.parquet(sink).collect()) == ['{"n": 1}', '{"n": 2}']


def test_archive_index_and_sinks(spark, tmp_path):
    k = tmp_path / "bmkg" / "2033" / "05" / "14"
    k.mkdir(parents=True)
    (k / "101112Z-0123456789ab.json.gz").write_bytes(gzip.compress(b"{}"))
    r = tabular.archive_index(spark, str(tmp_path)).first()
    assert (r.connector, r.fetched_at, r.sha_prefix) == ("bmkg", dt.datetime(2033, 5, 14, 10, 11, 12), "0123456789ab")
    events = spark.createDataFrame([("e", 2)], "event string, revision int")
    impacts = spark.createDataFrame([("e", float(i), f"c{i:03d}", 2) for i in range(150)], "event string, km double, code string, level int")
    m = sinks.published(events, impacts).first()
    assert (m.msg_id, m.n_impacts, len(m.impacts), m.impacts[0].code) == ("e:r2", 150, 100, "c000")
    g = sinks.geojson_lines(spark.createDataFrame([("a", 1.0, 2.0)], "id string, lat double, lon double"), "lat", "lon", ["id"]).first().value
    assert json.loads(g) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [2.0, 1.0]}, "properties": {"id": "a"}}
    s = spark.createDataFrame([("x", dt.datetime(2026, 1, 1, 3), 1.0), ("x", dt.datetime(2026, 1, 2, 3), 2.0)], "site string, at timestamp, v double")
    for _ in range(2):
        sinks.write_series(s, str(tmp_path / "series"), "at", ["site"])
    assert spark.read.parquet(str(tmp_path / "series")).count() == 2


def test_measurements_fail_by_page(spark):
    row = lambda v, unit="µg/m³", at="2033-05-14T11:00:00Z": {"value": v, "parameter": {"name": "pm25", "units": unit}, "period": {"datetimeTo": {"utc": at}}}
    df = raw(spark, {"results": [row(1.5), row(2.5, at="2033-05-01T00:00:00Z")]}, {"results": [row(3.0), row(None)]}, {"results": [row(4.0, "ppm")]})
    good, bad = json_feeds.measurements(df, F.lit(7), F.lit("µg/m³"), F.lit(dt.datetime(2033, 5, 10)), F.lit(NOW))
    assert [(r.path, r.sensor_id, r.value) for r in good.collect()] == [("p0", 7, 1.5)]
    assert sorted((r.path, r.errors) for r in bad.collect()) == [("p1", ["value"]), ("p2", ["unit"])]


def test_catalogues_and_lookups(spark, tmp_path):
    c = tmp_path / "c.tsv"
    c.write_text("id\ttime\tmag\na\t2026-01-01\t5.5\nb\t2026-01-02\tx\n")
    rows, bad = tabular.catalogue(spark, str(c), "id string, time date, mag double", sep="\t")
    assert [r.id for r in rows.collect()] == ["a"] and bad.count() == 1
    f = tmp_path / "fires.csv"
    f.write_text("# source: x\nid,day,lat,lon,radius_km\na,2026-01-01,-7,107,2\nb,2026-01-01,-97,107,2\nc,2026-01-01,-7,107,0\nd,2026-01-01,-7,107,2\nd,2026-01-01,-7,107,2\n")
    good, wrong = tabular.lookup(spark, str(f), "fires")
    assert [r.id for r in good.collect()] == ["a"]
    assert sorted((r.id, tuple(r.errors)) for r in wrong.collect()) == [("b", ("place",)), ("c", ("radius",)), ("d", ("repeated",)), ("d", ("repeated",))]
    w = tmp_path / "w.csv"
    w.write_text("subdas,lat,lon,bobot\na,-7,107,0.5\na,-7,108,0.5\nb,-7,107,0.9\n")
    assert [r.subdas for r in tabular.catchments(tabular.lookup(spark, str(w), "catchments")[0]).collect()] == ["b"]
    (tmp_path / "two").mkdir()
    for n in "ab":
        (tmp_path / "two" / f"{n}.csv").write_text("id,p80\na,1\n")
    with pytest.raises(ValueError):
        tabular.calibration(spark, str(tmp_path / "two"), "id string, p80 double")


def test_archive_range_and_digests(spark, tmp_path):
    import hashlib

    d = tmp_path / "feed" / "2033" / "05" / "14"
    d.mkdir(parents=True)
    names = {}
    for t, body in (("101112", b"{}"), ("111112", b"[1]"), ("121112", b"[2]")):
        names[t] = f"{t}Z-{hashlib.sha256(body).hexdigest()[:12]}.json.gz"
        (d / names[t]).write_bytes(gzip.compress(body))
    (d / "131112Z-0123456789ab.json.gz").write_bytes(gzip.compress(b"other"))
    (d / "141112Z-0123456789ab.json.gz").write_bytes(b"no archive")
    first = "feed/2033/05/14/" + names["101112"]
    index = tabular.archive_index(spark, str(tmp_path), start_after=first, before="feed/2033/05/15", content=True)
    good, bad = tabular.archive_payloads(index)
    assert sorted(r.body for r in good.collect()) == ["[1]", "[2]"]
    assert sorted(r.errors[0] for r in bad.collect()) == ["damaged", "digest"]
    assert tabular.archive_index(spark, str(tmp_path), before=first).count() == 0


def test_published_batches_can_be_written_again(spark, tmp_path):
    out = spark.createDataFrame([("e1", 1, "fire", "{}"), ("e2", 1, "flood", "{}")], "event string, revision int, kind string, payload string")
    for _ in range(2):
        sinks.write_published(out, str(tmp_path / "out"), 4)
    sinks.write_published(out.filter("kind = 'fire'"), str(tmp_path / "out"), 5)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.event, r.batch) for r in got.select("event", "batch").collect()) == [("e1", 4), ("e1", 5), ("e2", 4)]


def test_warning_message_and_titles_of_levels(spark):
    chains = spark.createDataFrame([("r", "c", "c", NOW, NOW)], "root string, current string, content string, occurred_at timestamp, detected_at timestamp")
    contents = spark.createDataFrame([("c", "t", "X, Y")], "identifier string, texts string, area_desc string")
    m = sinks.warning_message(chains, contents).first()
    assert (m.kind, m.source_id, m.detail.current, m.detail.area_desc) == ("weather", "r", "c", "X, Y")
