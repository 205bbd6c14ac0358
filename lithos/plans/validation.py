"""Validation queries: reports, messages, runs and readings made of the driver's rows, some of them broken on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.functions.ids import detection_id
from lithos.operators import constraints, quality, regions
from lithos.plans.registry import EVENTS_SQL, detections, query
from lithos.policies import PROVINCE
from lithos.session import read_table


def errors_sql(rules: dict[str, str]) -> str:
    """The names of the conditions that hold, joined by commas."""
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in rules.items()) + "], lambda x: x IS NOT NULL), ',')"


def said(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.array_join("errors", ",").alias("errors"))


def every(n: int, then, other):
    """``then`` in every n-th row."""
    return F.when(F.col("id") % n == 0, then).otherwise(other)


_QUAKE_ERRORS = errors_sql({
    "feed": "feed = 'x'", "id": "event_id = ''", "alternate_ids": "id % 23 = 0", "latitude": "NOT latitude BETWEEN -90 AND 90", "longitude": "false", "magnitude": "NOT magnitude BETWEEN -2 AND 10",
    "depth": "NOT depth_km BETWEEN -10 AND 800", "time": "occurred_at IS NULL", "future": "occurred_at > fetched_at + INTERVAL 10 MINUTE", "tsunami": "id % 37 = 0", "text": "2 * (id % 600) > 1024", "url": "id % 41 = 0",
})


@query(f"""WITH {EVENTS_SQL}, q AS (SELECT id, CASE WHEN id % 17 = 0 THEN '' ELSE CAST(id AS VARCHAR) END AS event_id, CASE WHEN id % 19 = 0 THEN 'x' ELSE 'auto' END AS feed, CASE WHEN id % 29 = 0 THEN 20 ELSE 1 END * lat AS latitude,
  value / 48 AS magnitude, id % 900 - 20.0 AS depth_km, CASE WHEN id % 43 = 0 THEN NULL WHEN id % 31 = 0 THEN ts + INTERVAL 1 HOUR ELSE ts END AS occurred_at, ts + INTERVAL 5 MINUTE AS fetched_at FROM h)
SELECT id, {_QUAKE_ERRORS} AS errors FROM q""")
def valid_quake_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that a report breaks."""
    ts = F.col("ts")
    r = detections(spark, sf_dir).select(
        "id", every(17, F.lit(""), F.col("id").cast("string")).alias("event_id"), F.when(F.col("event_type") == "click", "bmkg").otherwise("usgs").alias("source"),
        every(19, F.lit("x"), F.when(F.col("event_type") == "click", "auto").otherwise("geojson")).alias("feed"), every(23, F.array(F.lit("a b")), F.array().cast("array<string>")).alias("alternate_ids"),
        (every(29, F.lit(20), F.lit(1)) * F.col("lat")).alias("latitude"), F.col("lon").alias("longitude"), (F.col("value") / 48).alias("magnitude"), (F.col("id") % 900 - F.lit(20.0)).alias("depth_km"),
        F.when(F.col("id") % 43 != 0, every(31, ts + F.expr("INTERVAL 1 HOUR"), ts)).alias("occurred_at"), (ts + F.expr("INTERVAL 5 MINUTES")).alias("fetched_at"), every(37, F.lit("maybe"), F.lit("none")).alias("tsunami"),
        F.repeat(F.lit("é"), (F.col("id") % 600).cast("int")).alias("place"), every(41, F.lit("http://x"), F.lit("")).alias("source_url"),
    )
    return said(quality.with_errors(r, quality.quake_rules()), "id")


_WARNING_RULES = {
    "expires": "expires <= ts", "too_long": "expires > ts + INTERVAL 7 DAY", "onset": "{onset}", "references": "id % 3 <> 0 AND id % 4 = 0", "self_reference": "id % 4 <> 0 AND id % 7 = 0", "later_reference": "id % 4 <> 0 AND id % 11 = 0",
    "reference_order": "id % 4 <> 0 AND (a1 > a2 OR (a1 = a2 AND s1 > s2))", "repeated_reference": "id % 4 <> 0 AND a1 = a2", "ring": "id % 5 = 0",
}


@query(f"""WITH {EVENTS_SQL}, m AS (SELECT id, ts, ts + (id % 200) * INTERVAL 1 HOUR AS expires, ts + (id % 5) * INTERVAL 1 HOUR AS onset, CAST(id - 1 AS VARCHAR) AS a1, ts - INTERVAL 1 HOUR AS s1,
  CAST(CASE WHEN id % 7 = 0 THEN id WHEN id % 13 = 0 THEN id - 1 ELSE id - 2 END AS VARCHAR) AS a2, CASE WHEN id % 11 = 0 THEN ts + INTERVAL 1 HOUR ELSE ts - INTERVAL 2 HOUR END AS s2 FROM h)
SELECT id, {errors_sql(_WARNING_RULES | {"onset": "onset >= expires"})} AS errors, {errors_sql(_WARNING_RULES | {"onset": "onset > expires"})} AS at_ingest FROM m""")
def valid_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that a message breaks, here and with the door's own rule for the onset."""
    ts, hour = F.col("ts"), F.expr("INTERVAL 1 HOUR")
    ref = lambda i, at: F.struct(i.cast("string").alias("identifier"), F.lit("x").alias("sender"), at.alias("sent"))
    refs = F.array(ref(F.col("id") - 1, ts - hour), ref(F.when(F.col("id") % 7 == 0, F.col("id")).when(F.col("id") % 13 == 0, F.col("id") - 1).otherwise(F.col("id") - 2), every(11, ts + hour, ts - 2 * hour)))
    at = lambda x, y: F.struct(F.lit(float(x)).alias("lat"), F.lit(float(y)).alias("lon"))
    open_ring, ring = F.array(at(0, 0), at(0, 1), at(1, 1), at(1, 0)), F.array(at(0, 0), at(0, 1), at(1, 1), at(0, 0))
    m = detections(spark, sf_dir).select(
        "id", F.col("id").cast("string").alias("identifier"), ts.alias("sent"), ts.alias("effective"), (ts + (F.col("id") % 5) * hour).alias("onset"), (ts + (F.col("id") % 200) * hour).alias("expires"),
        F.element_at(F.array(F.lit("Alert"), F.lit("Update"), F.lit("Cancel")), (1 + F.col("id") % 3).cast("int")).alias("msg_type"), F.when(F.col("id") % 4 != 0, refs).alias("references"), F.array(every(5, open_ring, ring)).alias("polygons"),
    )
    both = quality.with_errors(quality.with_errors(m, quality.warning_rules(onset_may_equal=True), "_ingest"), quality.warning_rules())
    return both.select("id", F.array_join("errors", ",").alias("errors"), F.array_join("_ingest", ",").alias("at_ingest"))


_RUN_SQL = """s AS (SELECT user_id, event_type, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS issued, time_bucket(INTERVAL 2 HOUR, ts) + CASE user_id % 10 WHEN 0 THEN -11 WHEN 1 THEN 21 ELSE 0 END * INTERVAL 1 DAY AS vt, ts FROM h)"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_trunc("DAY", "ts").cast("timestamp_ntz")
    shift = F.when(F.col("user_id") % 10 == 0, -11).when(F.col("user_id") % 10 == 1, 21).otherwise(0)
    bucket = day + F.floor(F.hour("ts") / 2).cast("int") * F.expr("INTERVAL 2 HOURS")
    return detections(spark, sf_dir).select("user_id", "event_type", day.alias("issued"), (bucket + shift * F.expr("INTERVAL 1 DAY")).alias("at"), "ts")


@query(f"""WITH {EVENTS_SQL}, {_RUN_SQL}, g AS (SELECT user_id, issued, count(*) AS n, count(DISTINCT vt) AS d, min(vt - issued) AS lo, max(vt - issued) AS hi FROM s GROUP BY ALL)
SELECT user_id, epoch_us(issued) AS issued_us, {errors_sql({"steps": "n < 1 OR n > 4", "order": "d < n", "early": "lo < -10 * INTERVAL 1 DAY", "late": "hi > 20 * INTERVAL 1 DAY"})} AS errors FROM g""")
def valid_model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's day as a run, of four steps at most."""
    out = quality.run_errors(_steps(spark, sf_dir), ["user_id", "issued"], "at", "issued", most=4)
    return out.select("user_id", (F.unix_date(F.to_date("issued")).cast("long") * 86_400_000_000).alias("issued_us"), F.array_join("errors", ",").alias("errors"))


@query(f"""WITH {EVENTS_SQL}, {_RUN_SQL}, g AS (SELECT user_id, event_type, count(*) AS n, count(DISTINCT vt) AS d, min(vt - TIMESTAMP '2024-01-20') AS lo, max(vt - TIMESTAMP '2024-01-20') AS hi, max(TIMESTAMP '2024-01-20' - issued) AS age FROM s GROUP BY ALL)
SELECT user_id, event_type, {errors_sql({"steps": "NOT n BETWEEN 1 AND 200", "order": "d < n", "analysis": "age > 7 * INTERVAL 1 DAY", "early": "lo < -1 * INTERVAL 1 DAY", "late": "hi > 10 * INTERVAL 1 DAY"})} AS errors FROM g""")
def valid_village_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _steps(spark, sf_dir).withColumn("fetched", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return said(quality.forecast_errors(s, ["user_id", "event_type"], "at", "issued", "fetched"), "user_id", "event_type")


@query(f"""WITH {EVENTS_SQL}, v AS (SELECT id, CASE WHEN id % 9 <> 0 THEN value - 60 END AS temperature, CASE WHEN id % 6 <> 0 THEN value / 4 END AS humidity FROM h)
SELECT id, {errors_sql({"temperature": "temperature IS NOT NULL AND NOT temperature BETWEEN -60 AND 400", "humidity": "humidity IS NOT NULL AND NOT humidity BETWEEN 0 AND 100", "empty_step": "temperature IS NULL AND humidity IS NULL"})} AS errors FROM v""")
def valid_model_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = detections(spark, sf_dir).select("id", F.when(F.col("id") % 9 != 0, F.col("value") - 60).alias("temperature"), F.when(F.col("id") % 6 != 0, F.col("value") / 4).alias("humidity"))
    return said(quality.with_errors(v, quality.model_rules({"temperature": (-60, 400), "humidity": (0, 100)})), "id")


_SPEC = [("click", 0.0, 450.0, False, 3600, 0.2), ("view", 0.0, 480.0, True, 60, 0.1), ("error", 5.0, 1000.0, False, 1, 1.0)]
_SPEC_SQL = "sp(variable, low, high, whole, step_seconds, max_offset) AS (VALUES " + ", ".join(f"('{v}', {a}, {b}, {str(w).lower()}, {s}, {o})" for v, a, b, w, s, o in _SPEC) + ")"


@query(f"""WITH {EVENTS_SQL}, {_SPEC_SQL}, v AS (SELECT id, event_type AS variable, CASE WHEN id % 2 = 0 THEN floor(value) ELSE value END AS value, CASE WHEN id % 3 = 0 THEN time_bucket(INTERVAL 1 HOUR, ts) ELSE time_bucket(INTERVAL 1 MINUTE, ts) END AS vt, greatest(abs(id % 7 / 20.0), abs(id % 5 / 40.0)) AS off FROM h)
SELECT id, {errors_sql({"variable": "step_seconds IS NULL", "step": "(epoch_us(vt) // 1000000) % step_seconds <> 0", "window": "vt < TIMESTAMP '2024-01-03' OR vt > TIMESTAMP '2024-01-25'", "cell": "off > max_offset", "range": "value < low OR value > high", "whole": "whole AND value <> floor(value)"})} AS errors
FROM v LEFT JOIN sp USING (variable)""")
def valid_against_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.date_trunc("MINUTE", "ts").cast("timestamp_ntz")
    v = detections(spark, sf_dir).select(
        "id", F.col("event_type").alias("variable"), every(2, F.floor("value").cast("double"), F.col("value")).alias("value"), every(3, F.date_trunc("HOUR", "ts").cast("timestamp_ntz"), at).alias("valid_time"),
        F.lit("2024-01-03 00:00:00").cast("timestamp_ntz").alias("window_start"), F.lit("2024-01-25 00:00:00").cast("timestamp_ntz").alias("window_end"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), (F.col("id") % 7 / 20.0).alias("cell_lat"), (F.col("id") % 5 / 40.0).alias("cell_lon"),
    )
    spec = spark.createDataFrame(_SPEC, "variable string, low double, high double, whole boolean, step_seconds int, max_offset_deg double")
    return said(quality.spec_errors(v, spec), "id")


@query(f"""WITH {EVENTS_SQL}, p AS (SELECT id, time_bucket(INTERVAL 1 MINUTE, ts) + CASE WHEN id % 17 = 0 THEN 1 ELSE 0 END * INTERVAL 1 SECOND AS vt, lat + CASE WHEN id % 19 = 0 THEN 5 ELSE 0 END AS lat, id % 4 < 2 AS modis, value + 180 AS k FROM h)
SELECT id, {errors_sql({"id": "id % 11 = 0", "product": "id % 13 = 0", "minute": "id % 17 = 0", "box": "NOT lat BETWEEN -7.9 AND -5.7", "confidence": "modis <> (id % 3 > 0)", "brightness": "NOT k BETWEEN 200 AND 600 + 100", "age": "vt < TIMESTAMP '2024-01-20' - INTERVAL 10 DAY"})} AS errors FROM p""")
def valid_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.date_trunc("MINUTE", "ts").cast("timestamp_ntz") + every(17, F.lit(1), F.lit(0)) * F.expr("INTERVAL 1 SECOND")
    modis = F.col("id") % 4 < 2
    p = detections(spark, sf_dir).select(
        "id", F.when(modis, "MODIS_NRT").otherwise("VIIRS_NOAA20_NRT").alias("product"), every(13, F.lit("other"), F.when(modis, "MODIS").otherwise("VIIRS")).alias("instrument"), at.alias("detected_at"),
        (F.col("lat") + every(19, F.lit(5), F.lit(0))).alias("lat"), "lon", F.when(F.col("id") % 3 > 0, 50).alias("confidence_pct"), (F.col("value") + 180).alias("brightness_k"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz").alias("fetched_at"),
    )
    derived = detection_id(F.col("product"), F.col("detected_at"), F.col("lat"), F.col("lon"))
    p = p.withColumn("_n", F.col("id")).withColumn("id", every(11, F.lit("x"), derived))
    return said(quality.with_errors(p, quality.hotspot_rules()), "_n").withColumnRenamed("_n", "id")


@query(f"""WITH {EVENTS_SQL}, r AS (SELECT id, user_id, id % 40 AS sensor, ['pm25', 'no2', 'co'][1 + id % 3] AS parameter, ['µg/m³', 'ppm'][1 + id % 2] AS unit, value, ts, CAST(ts AS DATE) AS d FROM h)
SELECT id, CASE WHEN count(*) OVER (PARTITION BY user_id, d, sensor) > 1 THEN 'repeated' WHEN NOT coalesce(value >= 0 AND value <= CASE parameter || '|' || unit WHEN 'pm25|µg/m³' THEN 5000 WHEN 'no2|µg/m³' THEN 5000 WHEN 'no2|ppm' THEN 2.7 WHEN 'co|µg/m³' THEN 200000 WHEN 'co|ppm' THEN 175 END, false) THEN 'invalid'
  WHEN ts < d + INTERVAL 24 HOUR - INTERVAL 6 HOUR THEN 'stale' ELSE 'ok' END AS verdict FROM r""")
def clean_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of a payload (a user's day): repeated sensors, values beyond their limit and stale ones apart."""
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (1 + F.col("id") % n).cast("int"))
    day = F.date_trunc("DAY", "ts").cast("timestamp_ntz")
    r = detections(spark, sf_dir).select("id", F.struct("user_id", day.alias("d")).alias("payload"), (F.col("id") % 40).alias("sensor_id"), pick(["pm25", "no2", "co"], 3).alias("parameter"), pick(["µg/m³", "ppm"], 2).alias("unit"), "value", F.col("ts").alias("observed_at"), (day + F.expr("INTERVAL 24 HOURS")).alias("fetched_at"))
    return quality.clean_readings(r, "payload", 6).select("id", "verdict")


@query(f"""WITH {EVENTS_SQL}, r AS (SELECT user_id, event_type, id, id % 100 AS sensor, ts, lag(id % 100) OVER (PARTITION BY user_id, event_type ORDER BY id) AS before FROM h),
g AS (SELECT user_id, event_type, count(*) AS n, bool_or(coalesce(sensor <= before, false)) AS back, max(TIMESTAMP '2024-01-31' - ts) AS age FROM r GROUP BY ALL)
SELECT user_id, event_type, {errors_sql({"readings": "n > 10", "order": "back", "age": "age > 7 * INTERVAL 1 DAY", "issued": "user_id % 6 = 0"})} AS errors FROM g""")
def valid_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = detections(spark, sf_dir)
    newest = h.groupBy("user_id", "event_type").agg(F.max("ts").alias("_m"))
    issued = F.when(F.col("user_id") % 6 == 0, F.col("_m") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("_m"))
    r = h.join(newest, ["user_id", "event_type"]).select("user_id", "event_type", F.col("id").alias("position"), (F.col("id") % 100).alias("sensor_id"), F.col("ts").alias("observed_at"), issued.alias("issued_at"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz").alias("fetched_at"))
    return said(quality.observation_errors(r, ["user_id", "event_type"], most=10), "user_id", "event_type")


@query(f"""WITH {EVENTS_SQL}, c AS (SELECT id, t // 600 AS vt, floor(lat) AS lat, floor(lon) AS lon, floor(value / 250) AS mag FROM h WHERE lat BETWEEN -12 AND 7 AND lon BETWEEN 94 AND 142 AND t // 600 >= 2840200 AND t // 600 < 2843000),
o AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(mag) OVER w AS pmag, row_number() OVER w AS k FROM c WINDOW w AS (PARTITION BY vt ORDER BY id)) SELECT id FROM o WHERE k = 1 OR lat <> plat OR lon <> plon OR mag <> pmag""")
def catalogue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins of a period on a coarse grid, without adjacent repeats."""
    c = detections(spark, sf_dir).select("id", F.floor(F.col("t") / 600).alias("at"), F.floor("lat").cast("double").alias("lat"), F.floor("lon").cast("double").alias("lon"), F.floor(F.col("value") / 250).alias("mag"))
    return quality.catalogue_filter(c, "at", F.lit(2_840_200), F.lit(2_843_000)).select("id")


@query(f"""WITH {EVENTS_SQL} SELECT id FROM h WHERE id % 5 <> 0 AND id % 4 <> 3 AND id % 3 = 1""")
def relevant_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual messages of one province, named by the fifth part of the identifier."""
    m = detections(spark, sf_dir)
    name = F.concat(F.lit("2.49.0.0."), (F.col("id") % 3 + 359).cast("string"), F.lit("."), F.col("id").cast("string"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Alert", "Update", "Cancel", "Ack")]), (1 + F.col("id") % 4).cast("int"))
    return m.filter(quality.warning_relevance(name, every(5, F.lit("Test"), F.lit("Actual")), kind, "360")).select("id")


@query("""WITH s AS (SELECT user_id, max(ts) AS r FROM events GROUP BY 1), l AS (SELECT user_id, min(ts) AS seen FROM events WHERE event_type = 'click' AND user_id % 2 = 0 GROUP BY 1)
SELECT user_id FROM s LEFT JOIN l USING (user_id) WHERE r >= TIMESTAMP '2024-01-30' - INTERVAL 48 HOUR AND (seen IS NULL OR r > seen)""")
def active_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = detections(spark, sf_dir).withColumnRenamed("user_id", "site_id")
    now = h.groupBy("site_id").agg(F.max("ts").alias("last_report"))
    state = h.filter("event_type = 'click' AND site_id % 2 = 0").groupBy("site_id").agg(F.min("ts").alias("last_seen"))
    return quality.active_stations(now, state, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).select(F.col("site_id").alias("user_id"))


@query("SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'village' WHEN 1 THEN 'grid' WHEN 2 THEN 'river' WHEN 3 THEN 'station' WHEN 4 THEN 'catchment' END AS kind FROM events")
def site_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("adm4:", "grid:", "river:", "openaq:", "catchment:", "adm", "x:grid:")])
    e = read_table(spark, sf_dir, "events")
    site = F.concat(F.element_at(names, (1 + F.col("event_id") % 7).cast("int")), F.col("event_id").cast("string"))
    return e.select("event_id", quality.site_kind(site).alias("kind"))


_FOCUS = ["12.65", "11", "13.7"]


@query("""WITH c AS (SELECT DISTINCT lpad(CAST(11 + n_regionkey AS VARCHAR), 2, '0') || '.' || lpad(CAST(60 + n_nationkey AS VARCHAR), 2, '0') AS code FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT code, CASE WHEN code LIKE '12.65%' THEN 0 WHEN code LIKE '11%' THEN 1 WHEN code LIKE '13.7%' THEN 2 ELSE 3 END AS focus FROM c""")
def focus_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").join(F.broadcast(read_table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # a fixed 25 rows
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return quality.in_focus(c.select(F.concat_ws(".", two(11 + F.col("n_regionkey")), two(60 + F.col("n_nationkey"))).alias("code")), _FOCUS)


_EVENT_RULES = {"kind": "kind NOT IN ('quake', 'weather', 'flood', 'fire')", "status": "status = 'open'", "level": "level NOT BETWEEN 1 AND 4", "revision": "revision < 1", "times": "expires_at <= occurred_at", "detected": "detected_at < occurred_at", "merged": "(status = 'merged') <> (merged_into IS NOT NULL)", "digest": "id % 31 = 0"}


@query(f"""WITH {EVENTS_SQL}, e AS (SELECT id, ['quake', 'weather', 'flood', 'fire', 'wind'][1 + id % 5] AS kind, ['active', 'expired', 'merged', 'retracted', 'open'][1 + id % 11 // 2 % 5] AS status, id % 6 AS level, id % 13 AS revision, ts AS occurred_at, ts + (id % 17) * INTERVAL 1 HOUR AS expires_at,
  ts + (id % 19 - 1) * INTERVAL 1 HOUR AS detected_at, CASE WHEN id % 3 = 0 THEN id END AS merged_into FROM h), v AS (SELECT id, {errors_sql(_EVENT_RULES)} AS errors FROM e) SELECT * FROM v WHERE errors <> ''""")
def event_table_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (1 + i).cast("int"))
    ts, hour = F.col("ts"), F.expr("INTERVAL 1 HOUR")
    e = detections(spark, sf_dir).select(
        "id", pick(("quake", "weather", "flood", "fire", "wind"), F.col("id") % 5).alias("kind"), pick(("active", "expired", "merged", "retracted", "open"), F.floor(F.col("id") % 11 / 2) % 5).alias("status"), (F.col("id") % 6).alias("level"), (F.col("id") % 13).alias("revision"), ts.alias("occurred_at"),
        (ts + (F.col("id") % 17) * hour).alias("expires_at"), (ts + (F.col("id") % 19 - 1) * hour).alias("detected_at"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("merged_into"), every(31, F.lit("x"), F.sha2(F.col("id").cast("string"), 256)).alias("digest"),
    )
    return said(quality.table_violations(e, "event"), "id")


@query(f"""WITH {EVENTS_SQL}, i AS (SELECT id, CASE WHEN id % 4 < 3 THEN value - 5 END AS distance_km, id % 6 AS level, CASE WHEN id % 3 = 0 THEN value / 400 END AS coverage FROM h),
v AS (SELECT id, {errors_sql({"distance": "distance_km < 0", "level": "level NOT BETWEEN 2 AND 4", "coverage": "coverage <= 0 OR coverage > 1", "measure": "(distance_km IS NULL) = (coverage IS NULL)"})} AS errors FROM i) SELECT * FROM v WHERE errors <> ''""")
def impact_table_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = detections(spark, sf_dir).select("id", F.when(F.col("id") % 4 < 3, F.col("value") - 5).alias("distance_km"), (F.col("id") % 6).alias("level"), F.when(F.col("id") % 3 == 0, F.col("value") / 400).alias("coverage"))
    return said(quality.table_violations(i, "impact"), "id")


@query(f"""WITH t AS (SELECT p_partkey AS id, p_size - 1.0 AS p80, p_size * 1.5 AS p90, p_retailprice / 40.0 AS p98, p_retailprice / 30.0 AS p99_5, p_partkey % 9 / 8.0 AS correction, 3000 + p_size * 40 AS samples FROM part),
v AS (SELECT id, {errors_sql({"rising": "NOT (p80 < p90 AND p90 < p98 AND p98 < p99_5)", "positive": "p80 <= 0", "correction": "correction <= 0 OR correction > 1", "samples": "samples < 3650"})} AS errors FROM t) SELECT * FROM v WHERE errors <> ''""")
def threshold_table_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice").cast("double")
    t = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (size - 1.0).alias("p80"), (size * 1.5).alias("p90"), (price / 40.0).alias("p98"), (price / 30.0).alias("p99_5"), (F.col("p_partkey") % 9 / 8.0).alias("correction"), (3000 + size * 40).alias("samples"))
    return said(quality.table_violations(t, "threshold"), "id")


_CODE_SQL = """lpad(CAST(11 + n_regionkey AS VARCHAR), 2, '0') || CASE c_custkey % 7 WHEN 0 THEN '-' ELSE '.' END || lpad(CAST(60 + n_nationkey AS VARCHAR), 2, '0') || '.0' || CAST(1 + c_custkey % 9 AS VARCHAR)"""


@query(f"""WITH c AS (SELECT c_custkey, {_CODE_SQL} AS code, CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE c_name END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey), d AS (SELECT *, count(*) OVER (PARTITION BY code) AS k FROM c),
v AS (SELECT c_custkey AS id, unnest(list_filter([CASE WHEN code LIKE '%-%' THEN 'code' END, CASE WHEN code LIKE '13.%' THEN 'province' END, CASE WHEN k > 20 THEN 'repeated' END, CASE WHEN trim(name) = '' THEN 'name' END], lambda x: x IS NOT NULL)) AS reason FROM d)
SELECT reason, count(*) AS n FROM v GROUP BY 1""")
def region_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected regions by reason: codes of the wrong form, of another province, met too often, without a name."""
    c = read_table(spark, sf_dir, "customer").join(F.broadcast(read_table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # a fixed 25 rows
    k = F.col("c_custkey")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    code = F.concat(two(11 + F.col("n_regionkey")), F.when(k % 7 == 0, "-").otherwise("."), two(60 + F.col("n_nationkey")), F.lit(".0"), (1 + k % 9).cast("string"))
    c = c.select("c_custkey", code.alias("code"), F.when(k % 11 == 0, " ").otherwise(F.col("c_name")).alias("name"))
    c = c.join(c.groupBy("code").agg(F.count(F.lit(1)).alias("_k")), "code")
    rules = {"code": regions.level(F.col("code")).isNull(), "province": F.col("code").startswith("13."), "repeated": F.col("_k") > 20, "name": F.trim("name") == ""}
    return quality.report(quality.split(quality.with_errors(c, rules))[1], "c_custkey").select("reason", "n")


@query(f"""WITH {EVENTS_SQL} SELECT id, lat BETWEEN -12 AND 7 AND lon BETWEEN 94 AND 142 AS nation, lat + id % 3 BETWEEN {PROVINCE[1]} AND {PROVINCE[3]} AND lon BETWEEN {PROVINCE[0]} AND {PROVINCE[2]} AS province FROM h""")
def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lithos.functions.geo import in_box

    return detections(spark, sf_dir).select("id", quality.in_nation(F.col("lat"), F.col("lon")).alias("nation"), in_box(F.col("lat") + F.col("id") % 3, F.col("lon"), PROVINCE).alias("province"))


@query(f"""WITH {EVENTS_SQL}, e AS (SELECT id AS i, 'e' || id AS id, CASE WHEN id % 50 = 0 THEN 'storm' WHEN id % 5 = 1 THEN 'quake' ELSE 'fire' END AS kind, id % 4 = 0 AS merged, CASE WHEN id % 4 = 0 AND id % 12 <> 0 THEN 'e' || (id - 1) END AS merged_into FROM h),
q AS (SELECT id AS i, 'e' || id AS event_id, value / 45 AS magnitude, id % 900 AS depth FROM h WHERE id % 5 = 1 OR id % 35 = 0), o AS (SELECT 'm' || (o_orderkey // 3) AS msg_id, o_orderkey % 10 = 0 AS wrong FROM orders),
r AS (SELECT 'event' AS "table", 'null:summary' AS rule, count_if(i % 17 = 0) AS violations FROM e UNION ALL SELECT 'event', 'check:kind', count_if(i % 50 = 0) FROM e UNION ALL SELECT 'event', 'check:merged', count_if(i % 12 = 0) FROM e
  UNION ALL SELECT 'event', 'check:level', count_if(i % 5 = 0) FROM e UNION ALL SELECT 'event', 'check:expires', count_if(i % 9 = 0) FROM e UNION ALL SELECT 'event', 'check:title', count_if(i % 13 = 0) FROM e
  UNION ALL SELECT 'event', 'reference:merged_into>event', count(*) FROM e WHERE merged_into IS NOT NULL AND merged_into NOT IN (SELECT id FROM e)
  UNION ALL SELECT 'quake', 'check:magnitude', count_if(magnitude > 10) FROM q UNION ALL SELECT 'quake', 'check:depth_km', count_if(depth > 800) FROM q
  UNION ALL SELECT 'quake', 'reference:event_id,kind>event', count(*) FROM q WHERE event_id NOT IN (SELECT id FROM e WHERE kind = 'quake')
  UNION ALL SELECT 'outbox', 'check:subject', count_if(wrong) FROM o UNION ALL SELECT 'outbox', 'key:msg_id', count(*) - count(DISTINCT msg_id) FROM o)
SELECT * FROM r WHERE violations > 0""")
def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promises of stored tables that are broken, and how often."""
    h = detections(spark, sf_dir)
    i, text = F.col("id"), lambda c: F.concat(F.lit("e"), c.cast("string"))
    merged = i % 4 == 0
    event = h.select(
        text(i).alias("id"), F.when(i % 50 == 0, "storm").when(i % 5 == 1, "quake").otherwise("fire").alias("kind"), F.when(merged, "merged").otherwise("active").alias("status"),
        F.when(merged & (i % 12 != 0), text(i - 1)).alias("merged_into"), F.when(merged, F.col("ts")).alias("ended_at"), (i % 5).alias("level"), F.lit("bmkg").alias("primary_source"), text(i).alias("source_event_id"),
        F.col("ts").alias("occurred_at"), F.col("ts").alias("detected_at"), F.when(i % 9 == 0, F.col("ts")).otherwise(F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("expires_at"), F.when(i % 13 == 0, "").otherwise("t").alias("title"),
        F.when(i % 17 != 0, "s").alias("summary"), F.lit(1).alias("revision"), F.sha2(text(i), 256).alias("content_sha256"),
    )
    quake = h.filter((i % 5 == 1) | (i % 35 == 0)).select(
        text(i).alias("event_id"), F.lit("quake").alias("kind"), (F.col("value") / 45).alias("magnitude"), (i % 900).alias("depth_km"), F.lit(0.0).alias("felt_radius_km"), F.lit("none").alias("tsunami"), F.lit("").alias("shakemap_url"), F.lit("").alias("source_url"),
    )
    k = F.col("o_orderkey")
    outbox = read_table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 10 == 0, "hazard.quake.gone").otherwise("hazard.quake.created").alias("subject"), F.concat(F.lit("m"), F.floor(k / 3).cast("string")).alias("msg_id"), F.lit(b"x").alias("payload"), F.lit(None).cast("string").alias("traceparent"),
    )
    return constraints.check({"event": event, "quake": quake, "outbox": outbox}).filter("violations > 0")
