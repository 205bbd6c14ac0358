"""Series, wording, identity and message queries over the driver's rows, each through its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.functions import geo, ids, text
from lithos.functions.geo import round_half_up
from lithos.operators import fire, flood, joins, quake, quality, series, weather
from lithos.plans.fires import _CIRCLES_SQL, _INSIDE_SQL, KM_SQL, _circles
from lithos.plans.registry import EVENTS_SQL, detections, query
from lithos.plans.validation import errors_sql
from lithos.policies import SNAP_EARTH_KM, MatchRule
from lithos.session import read_table
from lithos.sources import sinks, tabular
from lithos.streaming import processors


def ntz(at: str):
    return F.lit(at).cast("timestamp_ntz")


def hours(n):
    return n * F.expr("INTERVAL 1 HOUR")


def pick(names, i):
    return F.element_at(F.array(*[F.lit(x) for x in names]), (1 + i).cast("int"))


_MONTHS_SQL = "['Jan', 'Feb', 'Mar', 'Apr', 'Mei', 'Jun', 'Jul', 'Agu', 'Sep', 'Okt', 'Nov', 'Des']"
_DAY_SQL = f"day({{0}} + INTERVAL 7 HOUR) || ' ' || {_MONTHS_SQL}[month({{0}} + INTERVAL 7 HOUR)] || ' ' || year({{0}} + INTERVAL 7 HOUR)"
_WIB_SQL = _DAY_SQL + " || ' ' || strftime({0} + INTERVAL 7 HOUR, '%H.%M')"


@query(f"""WITH {EVENTS_SQL}, e AS (SELECT id, ts AS a, ts + (id % 30) * INTERVAL 1 HOUR AS b FROM h)
SELECT id, {_WIB_SQL.format("a")} || CASE WHEN CAST(a + INTERVAL 7 HOUR AS DATE) = CAST(b + INTERVAL 7 HOUR AS DATE) THEN '–' || strftime(b + INTERVAL 7 HOUR, '%H.%M') ELSE ' – ' || {_WIB_SQL.format("b")} END || ' WIB' AS said FROM e""")
def local_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("id", text.local_range_text(F.col("ts"), F.col("ts") + hours(F.col("id") % 30)).alias("said"))


@query(f"""WITH {EVENTS_SQL}, q AS (SELECT id, id % 97 / 10.0 + 0.01 AS m, CASE id % 3 WHEN 0 THEN 'Pusat gempa berada di laut ' || id WHEN 1 THEN 'pusat gempa berada  darat' ELSE '' END AS place, id % 90 - 5.0 AS z, CASE WHEN id % 4 = 0 THEN 'II-III Kota' ELSE '' END AS felt, CASE WHEN id % 2 = 0 THEN id % 80 / 1.0 ELSE 0 END AS r FROM h)
SELECT id, 'Gempa M' || replace(printf('%.1f', m), '.', ',') || CASE id % 3 WHEN 0 THEN ' — laut ' || id WHEN 1 THEN ' — darat' ELSE '' END AS title,
  'Kedalaman ' || CAST(floor(greatest(z, 0) + 0.5) AS BIGINT) || ' km.' || CASE WHEN felt <> '' THEN ' Dirasakan (skala MMI): ' || felt || '.' ELSE '' END
  || CASE WHEN r > 0 THEN ' Estimasi radius dirasakan ' || CAST(floor(r + 0.5) AS BIGINT) || ' km.' ELSE ' Estimasi: tidak dirasakan di permukaan.' END
  || CASE id % 3 WHEN 0 THEN ' BMKG: berpotensi tsunami.' WHEN 1 THEN ' Tidak berpotensi tsunami.' ELSE '' END || CASE WHEN id % 2 = 0 THEN ' Sumber: BMKG.' ELSE ' Sumber: USGS.' END AS summary FROM q""")
def quake_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Pusat gempa berada di laut "), F.col("id").cast("string"))).when(F.col("id") % 3 == 1, "pusat gempa berada  darat").otherwise("")
    felt_km = F.when(F.col("id") % 2 == 0, F.col("id") % 80 / 1.0).otherwise(0.0)
    return detections(spark, sf_dir).select(
        "id", text.quake_title(F.col("id") % 97 / 10.0 + F.lit(0.01), place).alias("title"),
        text.quake_summary(F.col("id") % 90 - F.lit(5.0), F.when(F.col("id") % 4 == 0, "II-III Kota").otherwise(""), felt_km, pick(("potential", "none", "unknown"), F.col("id") % 3), pick(("bmkg", "usgs"), F.col("id") % 2)).alias("summary"),
    )


@query(f"""WITH {EVENTS_SQL}, w AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'Hujan lebat ' || id ELSE ' ' END AS headline, CASE WHEN id % 2 = 0 THEN 'Badai' END AS event, ['Minor', 'Moderate', 'Severe', 'Extreme', 'Unknown'][1 + id % 5] AS severity, ts, ts + (id % 30) * INTERVAL 1 HOUR AS b, id % 4 AS n FROM h)
SELECT id, CASE WHEN trim(headline) <> '' THEN trim(headline) WHEN event IS NOT NULL THEN 'Peringatan dini cuaca: ' || event ELSE 'Peringatan dini cuaca' END AS title,
  coalesce(event, 'Peringatan dini cuaca') || ', tingkat ' || CASE severity WHEN 'Moderate' THEN 'Waspada' WHEN 'Severe' THEN 'Awas' WHEN 'Extreme' THEN 'Bahaya' ELSE 'Info' END || ' (CAP ' || severity || '). '
  || CASE WHEN id % 7 = 0 THEN 'Dibatalkan BMKG pada ' || {_WIB_SQL.format("ts")} || ' WIB.' ELSE 'Berlaku ' || {_WIB_SQL.format("ts")} || CASE WHEN CAST(ts + INTERVAL 7 HOUR AS DATE) = CAST(b + INTERVAL 7 HOUR AS DATE) THEN '–' || strftime(b + INTERVAL 7 HOUR, '%H.%M') ELSE ' – ' || {_WIB_SQL.format("b")} END || ' WIB.' END
  || CASE WHEN n > 1 THEN ' Diperbarui ' || (n - 1) || ' kali.' ELSE '' END || ' Sumber: BMKG.' AS summary FROM w""")
def warning_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.when(F.col("id") % 2 == 0, "Badai")
    head = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Hujan lebat "), F.col("id").cast("string"))).otherwise(" ")
    said = text.warning_summary(event, pick(("Minor", "Moderate", "Severe", "Extreme", "Unknown"), F.col("id") % 5), F.col("id") % 7 == 0, F.col("ts"), F.col("ts"), F.col("ts") + hours(F.col("id") % 30), F.col("id") % 4)
    return detections(spark, sf_dir).select("id", text.warning_title(head, event).alias("title"), said.alias("summary"))


@query(f"""WITH {EVENTS_SQL}, f AS (SELECT id, ts, 'P' || user_id AS site, id % 1000 / 7.0 AS v, id % 4 + 1 AS level, CASE WHEN id % 3 = 0 THEN id % 500 / 3.0 END AS top, id % 2 + 3 AS most FROM h), g AS (SELECT *, replace(printf('%.1f', v), '.', ',') AS n, ['Info', 'Waspada', 'Awas', 'Bahaya'][level] AS l,
  day(ts) || ' ' || {_MONTHS_SQL}[month(ts)] || ' ' || year(ts) AS d FROM f)
SELECT id, CASE WHEN id % 2 = 0 THEN 'Indikasi potensi banjir sub-DAS ' || site ELSE 'Potensi banjir Citarum di ' || site END AS title,
  'Hujan rata-rata wilayah sub-DAS ' || site || ' diprakirakan ' || n || ' mm dalam 6 jam pada ' || d || ', tingkat ' || l || ' (ambang 12,5 mm). Indikasi potensi banjir dari hujan model ECMWF IFS, bukan pengukuran debit. Sumber: Open-Meteo.' AS rain,
  'Debit model di titik pantau ' || site || ' diprakirakan ' || n || ' m³/s pada ' || d || ', tingkat ' || l || ' (ambang 12,5 m³/s).' || CASE WHEN top IS NOT NULL THEN ' Skenario terburuk ensemble ' || replace(printf('%.1f', top), '.', ',') || ' m³/s.' ELSE '' END
  || CASE WHEN most = 3 THEN ' Debit di titik ini diatur waduk; tingkat dibatasi Awas.' ELSE '' END || ' Debit model GloFAS, bukan pengukuran lapangan. Sumber: Open-Meteo.' AS discharge FROM g""")
def flood_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    site, v, day, level = F.concat(F.lit("P"), F.col("user_id").cast("string")), F.col("id") % 1000 / 7.0, F.to_date(F.col("ts")), F.col("id") % 4 + 1
    return detections(spark, sf_dir).select(
        "id", text.flood_title(F.col("id") % 2 == 0, site, F.lit("Citarum")).alias("title"), text.rain_summary(site, v, F.lit(6), day, level, F.lit(12.5)).alias("rain"),
        text.discharge_summary(site, v, day, level, F.lit(12.5), F.when(F.col("id") % 3 == 0, F.col("id") % 500 / 3.0), F.col("id") % 2 + 3).alias("discharge"),
    )


@query(f"""WITH {EVENTS_SQL}, f AS (SELECT user_id, count(*) AS n, min(ts) AS a, max(ts) AS b, user_id % 3 + 1 AS level, user_id % 2 AS high, count(DISTINCT event_type) AS p FROM h GROUP BY user_id)
SELECT user_id, CASE WHEN n = 1 THEN 'Titik api terdeteksi satelit' ELSE 'Titik api: ' || n || ' deteksi satelit' END AS title, n || ' deteksi dari ' || p || ' lintasan satelit (NOAA-20), ' || {_WIB_SQL.format("a")} || ' WIB' || CASE WHEN a <> b THEN ' s.d. ' || {_WIB_SQL.format("b")} || ' WIB' ELSE '' END || '.'
  || CASE WHEN level = 3 THEN ' Awas: ' || n || ' deteksi dalam 24 jam (ambang 5).' WHEN level = 2 AND high > 0 THEN ' Waspada: ada deteksi keyakinan tinggi.' WHEN level = 2 THEN ' Waspada: api terlihat di ' || p || ' lintasan dalam 24 jam.' ELSE '' END
  || ' Deteksi satelit bisa juga pembakaran lahan, bukan laporan lapangan. Sumber: NASA FIRMS.' AS summary FROM f""")
def fire_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = detections(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"), F.countDistinct("event_type").alias("p"))
    u, n, p = F.col("user_id"), F.col("n"), F.col("p")
    return f.select("user_id", text.fire_title(n).alias("title"), text.fire_summary(n, p, F.lit("NOAA-20"), F.col("a"), F.col("b"), u % 3 + 1, n, u % 2, p).alias("summary"))


_UUID_SQL = "substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-8' || substr({h}, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


@query(f"""WITH e AS (SELECT event_id, CAST(event_id AS VARCHAR) AS i FROM events), s AS (SELECT event_id, sha256('quake' || chr(0) || 'bmkg' || chr(0) || i || chr(0) || '2') AS q, sha256('weather' || chr(0) || 'bmkg' || chr(0) || i) AS w, sha256('flood' || chr(0) || i || chr(0) || '2024-01-01T00:00:00Z') AS f FROM e)
SELECT event_id, {_UUID_SQL.format(h="q")} AS quake, {_UUID_SQL.format(h="w")} AS weather, {_UUID_SQL.format(h="f")} AS flood FROM s""")
def namespaced_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return read_table(spark, sf_dir, "events").select("event_id", ids.quake_event_id(F.lit("bmkg"), i, F.lit(2)).alias("quake"), ids.warning_event_id(F.lit("bmkg"), i).alias("weather"), ids.flood_event_id(i, F.lit("2024-01-01T00:00:00Z")).alias("flood"))


@query("""SELECT event_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || ',"note":' || CASE WHEN event_id % 2 = 0 THEN 'null' ELSE '""' END || '}') AS digest FROM events""")
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").withColumn("note", F.when(F.col("event_id") % 2 == 1, ""))
    return e.select("event_id", ids.content_digest("event_type", "user_id", "note").alias("digest"))


@query(f"""WITH {EVENTS_SQL} SELECT id, 'grid:' || printf('%.2f', floor(lat * 20) / 20) || ':' || printf('%.2f', floor(lon * 20) / 20) AS grid, greatest(abs(lat + 6.5), abs(lon - 107.5)) AS apart,
  floor({KM_SQL.format(a="h.", b="b.").replace("6371.0088", "6371.0")} * 1e6 + 0.5) / 1e6 AS km FROM h, (SELECT -6.5 AS lat, 107.5 AS lon) b""".replace("SELECT id, 'grid", "SELECT id, 'grid").replace("floor(lat", "floor(h.lat").replace("floor(lon", "floor(h.lon").replace("abs(lat", "abs(h.lat").replace("abs(lon", "abs(h.lon"))
def grid_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid names, and the two distances that stations are snapped to cells by."""
    lat, lon, a, b = F.col("lat"), F.col("lon"), F.lit(-6.5), F.lit(107.5)
    return detections(spark, sf_dir).select("id", ids.grid_id(F.floor(lat * 20) / 20, F.floor(lon * 20) / 20).alias("grid"), geo.chebyshev(lat, lon, a, b).alias("apart"), round_half_up(geo.haversine_km(lat, lon, a, b, SNAP_EARTH_KM), 6).alias("km"))


@query("""SELECT o_orderkey, unnest(range(0, 4)) AS pos, unnest([o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END, NULL, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 END]) AS v FROM orders""".join(["SELECT o_orderkey, pos AS valid_time, CAST(v AS DOUBLE) AS v FROM (", ") WHERE v IS NOT NULL"]))
def compacted_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column arrays as steps; those without any value drop out."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    wide = read_table(spark, sf_dir, "orders").select("o_orderkey", F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")).alias("times"), F.array(p, F.when(k % 2 == 0, p), F.lit(None).cast("double"), F.when(k % 3 == 0, F.lit(1.0))).alias("vs"))
    return series.long_form(wide, ["o_orderkey"], "times", {"v": "vs"})


@query(f"""WITH {EVENTS_SQL} SELECT id, epoch_us(CASE id % 3 WHEN 0 THEN ts WHEN 1 THEN ts + INTERVAL 2 HOUR ELSE ts + INTERVAL 1 HOUR END) AS issued_us FROM h""")
def issue_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = series.issued_at(pick(("bmkg", "openaq", "open-meteo"), F.col("id") % 3), F.col("ts"), F.col("ts") + hours(1), F.col("ts") + hours(2))
    from lithos.plans.registry import micros

    return detections(spark, sf_dir).withColumn("i", at).select("id", micros("i").alias("issued_us"))


@query(f"""WITH {EVENTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us DESC, id DESC) AS k FROM h), s AS (SELECT DISTINCT user_id, user_id % 5 AS zone FROM h WHERE user_id % 4 <> 0)
SELECT n.user_id AS site_id, event_type AS sensor_id, value, zone FROM n JOIN s USING (user_id) WHERE k = 1 AND user_id % 3 <> 0""")
def observations_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest value of each sensor of known sites and stations."""
    h = detections(spark, sf_dir).select(F.col("user_id").alias("site_id"), F.col("event_type").alias("sensor_id"), F.col("us").alias("observed_at"), F.col("id").alias("fetched_at"), "value")
    sites = h.filter("site_id % 4 <> 0").select("site_id", (F.col("site_id") % 5).alias("zone")).distinct()
    stations = h.filter("site_id % 3 <> 0").select("site_id").distinct()
    return series.observation_current(h, sites, stations).select("site_id", "sensor_id", "value", "zone")


@query("""WITH s AS (SELECT o_custkey AS site_id, o_orderstatus AS dataset, o_orderkey AS a, o_custkey + o_orderkey % 10 AS b FROM orders) SELECT site_id, dataset, max(a) AS last_issued_at, max(b) AS last_fetched_at FROM s GROUP BY ALL""")
def series_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A late, older run never sets a series back."""
    k = F.col("o_orderkey")
    s = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site_id"), F.col("o_orderstatus").alias("dataset"), F.lit("m").alias("model"), k.alias("issued_at"), (F.col("o_custkey") + k % 10).alias("fetched_at"))
    stored = s.filter("issued_at % 2 = 0").withColumnsRenamed({"issued_at": "last_issued_at", "fetched_at": "last_fetched_at"})
    return series.freshness(stored, s.filter("issued_at % 2 = 1")).drop("model")


@query(f"""WITH {EVENTS_SQL} SELECT user_id AS site_id, arg_max(lat, t * 10000000 + id) AS cell, max(us) AS last_us FROM h GROUP BY 1""")
def site_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites by their last fetch, whatever order they come in."""
    h = detections(spark, sf_dir).select(F.col("user_id").alias("site_id"), F.col("lat").alias("cell"), (F.col("t") * 10_000_000 + F.col("id")).alias("last_fetched_at"), "us", "id")
    return series.site_upsert(h.filter("id % 2 = 0"), h.filter("id % 2 = 1")).select("site_id", "cell", F.col("us").alias("last_us"))


@query(f"""WITH {EVENTS_SQL} SELECT id, ts > TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-20' AS recent, CAST(ts AS DATE) < DATE '2024-01-30' - 14 AS expired FROM h WHERE (ts > TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-20') OR CAST(ts AS DATE) < DATE '2024-01-30' - 14""")
def recent_and_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last day before a time, and rows that a retention of 14 days drops."""
    h = detections(spark, sf_dir)
    now = series.recent(h, "ts", ntz("2024-01-20 00:00:00"), 24).select("id", F.lit(True).alias("recent"), F.lit(False).alias("expired"))
    return now.unionByName(series.expired_by_ttl(h, "ts", ntz("2024-01-30 00:00:00"), 14).select("id", F.lit(False).alias("recent"), F.lit(True).alias("expired")))


@query("""WITH s AS (SELECT user_id, CASE WHEN user_id % 5 <> 0 THEN max(ts) END AS l FROM events WHERE event_id % 7 < 2 GROUP BY 1), w AS (SELECT user_id, greatest(coalesce(l, TIMESTAMP '2024-01-24'), TIMESTAMP '2024-01-24') AS a FROM s)
SELECT user_id AS sensor_id, epoch_us(a) AS from_us FROM w WHERE a < TIMESTAMP '2024-01-31'""")
def backfill_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lithos.plans.registry import micros

    s = detections(spark, sf_dir).filter("id % 7 < 2").groupBy(F.col("user_id").alias("sensor_id")).agg(F.max("ts").alias("m"))
    s = s.select("sensor_id", F.when(F.col("sensor_id") % 5 != 0, F.col("m")).alias("last_observed_at"))
    return series.backfill_window(s, ntz("2024-01-31 00:00:00")).select("sensor_id", micros("from_time").alias("from_us"))


@query(f"""WITH {EVENTS_SQL}, f AS (SELECT user_id, CAST(ts AS DATE) AS d, list(DISTINCT event_type) AS p FROM h GROUP BY ALL) SELECT user_id, d AS day FROM f WHERE NOT list_has_any(p, (SELECT list(DISTINCT event_type) FROM h WHERE event_type NOT IN ('click', 'view')))""")
def events_of_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of users all of whose products are allowed."""
    f = detections(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("products"))
    return series.only_products(f, ["click", "view"]).select("user_id", "day")


@query(f"""WITH {EVENTS_SQL}, f AS (SELECT user_id, max(value) AS peak, count(*) AS detections, min(t) AS first_t FROM h GROUP BY 1) SELECT user_id, detections FROM f ORDER BY floor(peak / 10) DESC, detections DESC, first_t LIMIT 25""")
def largest_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 largest; the number is the feature."""
    f = detections(spark, sf_dir).groupBy("user_id").agg(F.floor(F.max("value") / 10).alias("peak"), F.count(F.lit(1)).alias("detections"), F.min("t").alias("first_t"))
    return series.largest(f, 25).select("user_id", "detections")


@query("SELECT CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'retried' ELSE 'ok' END AS outcome, count(*) AS n FROM events GROUP BY 1")
def sweep_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.when(F.col("event_id") % 5 == 0, "failed").when(F.col("event_id") % 5 == 1, "retried").otherwise("ok")
    return series.poll_outcomes(read_table(spark, sf_dir, "events").select(o.alias("outcome")))


_LABEL_SQL = f"""s AS (SELECT *, value / 60 AS mag, t // 600 AS label FROM h), a AS (SELECT * FROM s WHERE event_type = 'view' AND mag >= 4.0), b AS (SELECT * FROM s WHERE event_type = 'click')
SELECT a.id AS a_id, b.id AS b_id, a.label = b.label AS positive FROM a JOIN b ON abs(a.t - b.t) <= 300 AND {KM_SQL.format(a="a.", b="b.")} <= 300 + 1e-9"""


@query(f"WITH {EVENTS_SQL}, {_LABEL_SQL}")
def quake_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = detections(spark, sf_dir).withColumn("mag", F.col("value") / 60).withColumn("label", F.floor(F.col("t") / 600))
    side = lambda kind: s.filter(F.col("event_type") == kind).select("id", "t", "lat", "lon", "mag", "label")
    return quake.label_rows(side("view"), side("click"), MatchRule(300, 300, 0))


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT *, value / 100 AS mag FROM h), j AS (SELECT abs(a.t - b.t) AS dt, {KM_SQL.format(a="a.", b="b.")} AS km, abs(a.mag - b.mag) AS dm, (a.id + b.id) % 3 <> 0 AS same, CAST(a.id % 2 AS VARCHAR) AS subset, ['Mw', 'mb', 'ML'][1 + a.id % 3] AS kind
  FROM s a JOIN s b ON a.event_type = 'click' AND b.event_type = 'view' AND abs(a.t - b.t) <= 3600 WHERE abs(a.mag - b.mag) <= 3.0 + 1e-9 AND {KM_SQL.format(a="a.", b="b.")} <= 150 + 1e-9),
r(rule, s, k, m) AS (VALUES ('narrow', 600, 30, 0.5), ('wide', 3600, 150, 2.0)), x AS (SELECT *, dt <= s AND km <= k + 1e-9 AND dm <= m + 1e-9 AS hit FROM j, r)
SELECT rule, subset, kind, count_if(hit AND same)::BIGINT AS tp, count_if(hit AND NOT same)::BIGINT AS fp, count_if(NOT hit AND same)::BIGINT AS fn FROM x GROUP BY ALL""")
def quake_subset_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of rules by subset and magnitude type."""
    s = detections(spark, sf_dir).withColumn("mag", F.col("value") / 100)
    side = lambda kind: s.filter(F.col("event_type") == kind).select("id", "t", "lat", "lon", "mag")
    m = joins.matches(side("click"), side("view"), MatchRule(3600, 150, 3.0))
    c = F.col
    pairs = m.select(F.abs(c("a_t") - c("b_t")).alias("dt"), geo.haversine_km(c("a_lat"), c("a_lon"), c("b_lat"), c("b_lon")).alias("km"), F.abs(c("a_mag") - c("b_mag")).alias("dm"), ((c("a_id") + c("b_id")) % 3 != 0).alias("same"), (c("a_id") % 2).cast("string").alias("subset"), pick(("Mw", "mb", "ML"), c("a_id") % 3).alias("kind"))
    rules = spark.createDataFrame([("narrow", 600.0, 30.0, 0.5), ("wide", 3600.0, 150.0, 2.0)], "rule string, max_s double, max_km double, max_mag double")
    return quake.scores(pairs, rules, ("subset", "kind")).select("rule", "subset", "kind", "tp", "fp", "fn")


@query(f"""WITH {EVENTS_SQL}, r AS (SELECT id, t, CASE WHEN id % 3 = 0 THEN user_id END AS home FROM h WHERE event_type = 'error'), m AS (SELECT user_id AS event, t FROM h WHERE event_type = 'click')
SELECT r.id, m.event FROM r JOIN m ON m.t BETWEEN r.t - 600 AND r.t + 600 UNION SELECT id, home FROM r WHERE home IS NOT NULL""")
def quake_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a member near a report in time, and the report's own."""
    h = detections(spark, sf_dir)
    reports = h.filter("event_type = 'error'").select("id", "t", F.when(F.col("id") % 3 == 0, F.col("user_id")).alias("home"))
    return joins.candidates(reports, h.filter("event_type = 'click'").select(F.col("user_id").alias("event"), F.col("t").alias("m_t")), 600)


@query("""WITH a AS (SELECT c_custkey, unnest([c_custkey % 25, (c_custkey + 7) % 25, 99]) AS x, unnest([c_custkey % 5, (c_custkey + 7) % 5, 1]) AS y FROM customer) SELECT c_custkey, n_name FROM a JOIN nation ON n_nationkey = x AND n_regionkey = y""")
def rows_for_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that parallel arrays of a request name."""
    k = F.col("c_custkey")
    asked = read_table(spark, sf_dir, "customer").select("c_custkey", F.array(k % 25, (k + 7) % 25, F.lit(99).cast("long")).alias("x"), F.array(k % 5, (k + 7) % 5, F.lit(1).cast("long")).alias("y"))
    return joins.for_pairs(read_table(spark, sf_dir, "nation"), asked, {"x": "n_nationkey", "y": "n_regionkey"}).select("c_custkey", "n_name")


@query(f"""WITH {EVENTS_SQL}, e AS (SELECT CAST(ts AS DATE) AS d, lat, lon, id % 3 + 1 AS level FROM h WHERE event_type = 'click'), r AS (SELECT s_suppkey AS fire, DATE '2024-01-01' + CAST(s_suppkey % 30 AS INTEGER) AS d, -7.9 + (s_suppkey * 613 % 2200) / 1000.0 AS lat, 106.3 + (s_suppkey * 3571 % 2600) / 1000.0 AS lon, 5.0 + s_suppkey % 20 AS km FROM supplier)
SELECT fire, count(e.level) AS events, max(e.level) AS level FROM r LEFT JOIN e ON e.d BETWEEN r.d - 1 AND r.d + 2 AND {KM_SQL.format(a="r.", b="e.")} <= r.km GROUP BY fire""")
def recorded_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded fires with the events near them, from a day before to two days after."""
    s = F.col("s_suppkey")
    r = read_table(spark, sf_dir, "supplier").select(s.alias("fire"), F.date_add(F.lit("2024-01-01").cast("date"), (s % 30).cast("int")).alias("day"), (F.lit(-7.9) + (s * 613 % 2200) / 1000.0).alias("lat"), (F.lit(106.3) + (s * 3571 % 2600) / 1000.0).alias("lon"), (F.lit(5.0) + s % 20).alias("radius_km"))
    e = detections(spark, sf_dir).filter("event_type = 'click'").select(F.to_date("ts").alias("first_day"), "lat", "lon", (F.col("id") % 3 + 1).alias("level"))
    return joins.recorded_checks(r, e)


@query("""SELECT event_id AS key, event_type AS connector FROM events ORDER BY ts, connector, key""")
def merged_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all connectors in one order."""
    h = detections(spark, sf_dir).select(F.col("id").alias("key"), F.col("event_type").alias("connector"), F.col("ts").alias("fetched_at"))
    return tabular.merged_order(h).select("key", "connector")


@query("""SELECT event_type AS connector, max(event_id) AS key FROM events GROUP BY 1""")
def newest_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("connector"), F.col("event_id").alias("key"))
    return tabular.newest_of_each(e).select("connector", "key")


@query("""SELECT event_id AS key FROM events WHERE event_id % 3 = 0""")
def objects_not_backed_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("key"))
    return tabular.not_backed_up(e, e.filter("key % 3 <> 0"))


@query("""SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def responses_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The i-th response with the i-th request."""
    li = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pos"), "l_linenumber")
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), "o_custkey")
    return joins.positional(li, o).select(F.col("pos").alias("l_orderkey"), "l_linenumber", "o_custkey")


@query(f"""WITH {EVENTS_SQL}, {_CIRCLES_SQL} SELECT month(ts + INTERVAL 7 HOUR) AS month, count(*) AS n FROM h WHERE NOT EXISTS (SELECT 1 FROM c WHERE {_INSIDE_SQL}) GROUP BY 1""")
def fire_monthly_unmasked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections by local month, without those at lasting sources."""
    return fire.monthly(joins.mask(detections(spark, sf_dir).select("id", "ts", "lat", "lon"), _circles(spark, sf_dir)), "ts")


@query("""WITH h AS (SELECT user_id, epoch_us(ts) // 3600000000 AS hour, floor(sum(value) * 100 + 0.5) / 100 AS v FROM events GROUP BY ALL), w AS (SELECT user_id, hour, sum(v) OVER k AS s, count(*) OVER k AS c FROM h WINDOW k AS (PARTITION BY user_id ORDER BY hour RANGE BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT user_id, count(*) AS windows, 0::BIGINT AS unequal FROM w WHERE c = 3 GROUP BY user_id""")
def rain_running_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole windows of each user, and those whose running and fresh sums differ: none."""
    h = detections(spark, sf_dir).groupBy("user_id", F.floor(F.col("us") / 3_600_000_000).alias("hour")).agg(round_half_up(F.sum("value"), 2).alias("v"))
    return flood.running_sums(h, ["user_id"], "hour", "v", 3).groupBy("user_id").agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.abs(F.col("fresh") - F.col("running")) > 1.5e-9).alias("unequal"))


@query(f"""WITH {EVENTS_SQL}, b AS (SELECT id AS chain, CASE id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'expired' WHEN 2 THEN 'active' ELSE 'retracted' END AS s, id % 3 AS d FROM h WHERE id % 5 <> 0),
a AS (SELECT id AS chain, id % 2 AS d, id % 7 = 0 AS cancelled, ts, CASE WHEN id % 11 = 0 THEN id - 1 END AS m FROM h), j AS (SELECT *, CASE WHEN s IS NULL AND NOT cancelled AND m IS NULL THEN 'created' WHEN m IS NOT NULL AND s = 'active' THEN 'merged' WHEN cancelled AND s = 'active' THEN 'retracted'
  WHEN s = 'active' AND ts <= TIMESTAMP '2024-01-10' THEN 'expired' WHEN s <> 'active' AND NOT cancelled AND ts > TIMESTAMP '2024-01-10' AND b.d <> a.d THEN 'reactivated' WHEN s = 'active' AND b.d <> a.d THEN 'updated' END AS transition FROM a LEFT JOIN b USING (chain)) SELECT chain, transition FROM j WHERE transition IS NOT NULL""")
def warning_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = detections(spark, sf_dir).withColumnRenamed("id", "chain")
    k = F.col("chain")
    before = h.filter(k % 5 != 0).select("chain", pick(("active", "expired", "active", "retracted"), k % 4).alias("status"), (k % 3).alias("digest"))
    after = h.select("chain", (k % 2).alias("digest"), (k % 7 == 0).alias("cancelled"), F.col("ts").alias("expires_at"), F.when(k % 11 == 0, k - 1).alias("merged_into"))
    return weather.lifecycle(before, after, ntz("2024-01-10 00:00:00"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'id' WHEN 1 THEN 'id,en' WHEN 2 THEN 'id' ELSE 'en,id' END AS languages, event_id % 4 <> 9 AS has_id FROM events""")
def warning_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a message and of its translation, one of each language, and whether the main language is among them."""
    k = F.col("event_id")
    t = lambda lang: F.struct(F.lit(lang).alias("language"), F.lit("h").alias("headline"))
    first = F.when(k % 4 == 3, F.array(t("en"))).otherwise(F.array(t("id")))
    second = F.when(k % 4 == 1, F.array(t("en"), t("id"))).when(k % 4 == 2, F.array(t("id"))).when(k % 4 == 3, F.array(t("id")))
    e = read_table(spark, sf_dir, "events").select("event_id", first.alias("texts_a"), second.alias("texts_b")).withColumn("texts", weather.merge_texts())
    return e.select("event_id", F.array_join(F.transform("texts", lambda x: x["language"]), ",").alias("languages"), F.exists("texts", lambda x: x["language"] == "id").alias("has_id"))


@query(f"""WITH {EVENTS_SQL}, m AS (SELECT id, id % 7 AS attempt, id % 5 = 0 AS bad, id % 2 = 0 AS tr FROM h)
SELECT id, CASE WHEN NOT bad THEN 'ack' WHEN tr AND attempt <= 4 THEN 'retry' ELSE 'dead' END AS outcome, CASE WHEN bad AND tr AND attempt <= 4 THEN [1, 5, 15, 30][attempt] END AS delay_seconds FROM m WHERE attempt > 0""")
def message_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = detections(spark, sf_dir).select("id", (F.col("id") % 7).alias("attempt"), F.when(F.col("id") % 5 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("errors"), (F.col("id") % 2 == 0).alias("transient"))
    return sinks.outcomes(m.filter("attempt > 0")).select("id", "outcome", "delay_seconds")


@query(f"""WITH {EVENTS_SQL}, v AS (SELECT id, event_type, {errors_sql({"low": "value < 5", "high": "value > 480"})} AS reason FROM h) SELECT 'raw.quake' AS subject, reason, '{{"id":' || id || ',"event_type":"' || event_type || '","errors":["' || replace(reason, ',', '","') || '"]}}' AS body FROM v WHERE reason <> ''""")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = quality.with_errors(detections(spark, sf_dir), {"low": F.col("value") < 5, "high": F.col("value") > 480}).select("id", "event_type", "errors")
    return sinks.dead_letters(h.filter(F.size("errors") > 0), "raw.quake")


@query("SELECT o_orderkey AS id, o_custkey AS event FROM orders WHERE o_orderstatus = 'O' ORDER BY id LIMIT 100")
def outbox_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next hundred messages; the batch size is the feature."""
    o = read_table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("event"))
    return sinks.drain(o, 100)


@query(f"""WITH {EVENTS_SQL}, e AS (SELECT user_id AS event, min(t) AS a, min(t) + user_id % 60 AS b, arg_min(lat, t * 10000000 + id) AS lat, max(value) AS f, count(*) AS n FROM h GROUP BY user_id) SELECT event, 'fire' AS kind, a AS occurred, b AS detected, event AS source_id, lat, f AS max_frp, n AS detections FROM e""")
def fire_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = detections(spark, sf_dir).groupBy(F.col("user_id").alias("event")).agg(F.min("t").alias("first_t"), F.min_by("lat", F.struct("t", "id")).alias("lat"), F.lit(0.0).alias("lon"), F.max("value").alias("max_frp"), F.count(F.lit(1)).alias("detections"), F.array_sort(F.collect_set("event_type")).alias("products"))
    m = sinks.fire_message(e.withColumn("fetched_first", F.col("first_t") + F.col("event") % 60))
    return m.select("event", "kind", "occurred", "detected", "source_id", "detail.lat", "detail.max_frp", "detail.detections")


@query("""SELECT o_custkey AS site, min(o_orderkey) AS occurred, count(*) AS n_days, max(o_orderkey % 4) AS top FROM orders GROUP BY 1""")
def flood_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site"), F.lit(1).alias("episode"), F.col("o_orderkey").alias("date"), (F.col("o_orderkey") % 4).alias("level"), F.lit(False).alias("possible"))
    episodes = o.groupBy("site", "episode").agg(F.min("date").alias("opened"), F.max("level").alias("level"))
    m = sinks.flood_message(episodes, o)
    return m.select(F.col("source_id").alias("site"), "occurred", F.size("detail.days").cast("long").alias("n_days"), F.array_max(F.transform("detail.days", lambda d: d["level"])).alias("top"))


@query("""SELECT event_id, '| ' || event_id || ' | ' || event_type || ' | ' || CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END || ' |' AS value FROM events""")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("u"))
    return sinks.markdown_rows(e).select(F.regexp_extract("value", r"^\| (\d+)", 1).cast("long").alias("event_id"), "value")


@query(f"""WITH {EVENTS_SQL}, f AS (SELECT 'w' || CAST(id // 10 AS VARCHAR) AS identifier, id % 10 AS poll, CASE WHEN event_type IN ('click', 'view') THEN 'id' ELSE 'en' END AS language,
  CASE WHEN value >= 250 THEN 'ok' WHEN value < 25 THEN 'broken' ELSE 'failed' END AS outcome FROM h),
n AS (SELECT *, count_if(outcome = 'failed') OVER (PARTITION BY identifier, language ORDER BY poll) AS tries FROM f),
s AS (SELECT identifier, language, min(poll) AS poll, arg_min(outcome, poll) AS outcome FROM n WHERE outcome <> 'failed' OR tries >= 5 GROUP BY ALL),
b AS (SELECT m.identifier, m.poll, m.outcome, e.poll AS later FROM s m LEFT JOIN s e ON e.identifier = m.identifier AND e.language = 'en' AND e.outcome = 'ok' WHERE m.language = 'id')
SELECT identifier, poll, CASE outcome WHEN 'ok' THEN 'published' WHEN 'broken' THEN 'rejected' ELSE 'gave up' END AS outcome, CASE outcome WHEN 'ok' THEN 1 ELSE 0 END::BIGINT AS published,
  CASE WHEN outcome = 'ok' THEN 'id' || poll || CASE WHEN later < poll THEN ',en' || later ELSE '' END ELSE '' END AS headlines FROM b
UNION ALL SELECT identifier, later, 'published', 2::BIGINT, 'id' || poll || ',en' || later FROM b WHERE outcome = 'ok' AND later > poll""")
def warning_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ten events as the polls for one warning's two documents: published early, again with its translation, or given up."""
    h = detections(processors.with_state_store(spark), sf_dir)
    language = F.when(F.col("event_type").isin("click", "view"), "id").otherwise("en")
    outcome = F.when(F.col("value") >= 250, "ok").when(F.col("value") < 25, "broken").otherwise("failed")
    poll = F.col("id") % 10
    tries = h.select(F.concat(F.lit("w"), F.floor(F.col("id") / 10).cast("string")).alias("identifier"), F.lit("1").alias("item"), language.alias("language"), poll.alias("poll"), outcome.alias("outcome"), F.concat(language, poll.cast("string")).alias("headline"))
    out = processors.two_stages(tries)
    return out.select("identifier", "poll", "outcome", "published", F.coalesce(F.array_join(F.transform("texts", lambda x: x["headline"]), ","), F.lit("")).alias("headlines"))


@query(f"""WITH RECURSIVE {EVENTS_SQL}, a AS (SELECT CAST(user_id AS VARCHAR) AS event, us AS tm, CAST(CAST(floor(value / 100) AS INTEGER) AS VARCHAR) AS dg, CASE WHEN id % 7 = 0 THEN us ELSE us + (1 + id % 5) * 43200000000 END AS ex, id % 11 = 0 AS gone FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY tm, dg) AS k FROM a),
r(event, k, s, d, v, x, e, u, g) AS (SELECT DISTINCT event, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 0, NULL::BIGINT, 0, 0, 0 FROM a UNION ALL
  SELECT event, k, CASE WHEN gone THEN CASE WHEN s1 = 'active' THEN 'retracted' ELSE s1 END WHEN s1 IS NULL THEN CASE WHEN ex > tm THEN 'active' ELSE 'expired' END WHEN up THEN 'active' ELSE s1 END,
    CASE WHEN NOT gone AND (s1 IS NULL OR up) THEN dg ELSE d END,
    v + l + CASE WHEN gone THEN CASE WHEN s1 = 'active' THEN 1 ELSE 0 END WHEN s1 IS NULL THEN CASE WHEN ex > tm THEN 1 ELSE 2 END WHEN up THEN 1 ELSE 0 END,
    CASE WHEN NOT gone AND (s1 IS NULL OR up) THEN ex ELSE x END, e + l + CASE WHEN NOT gone AND s1 IS NULL AND ex <= tm THEN 1 ELSE 0 END,
    u + CASE WHEN NOT gone AND s1 IS NOT NULL AND up THEN 1 ELSE 0 END, g + CASE WHEN gone AND s1 = 'active' THEN 1 ELSE 0 END
  FROM (SELECT *, coalesce(s1 IS NOT NULL AND dg <> d AND (s1 = 'active' OR ex > tm), false) AS up FROM (
    SELECT r.event, o.k, o.tm, o.dg, o.ex, o.gone, r.d, r.v, r.x, r.e, r.u, r.g, CASE WHEN r.s = 'active' AND r.x <= o.tm THEN 'expired' ELSE r.s END AS s1, CASE WHEN r.s = 'active' AND r.x <= o.tm THEN 1 ELSE 0 END AS l
    FROM r JOIN o ON o.event = r.event AND o.k = r.k + 1)))
SELECT event, max(v)::BIGINT AS revision, max(e)::BIGINT AS expired, max(u)::BIGINT AS updated, max(g)::BIGINT AS retracted FROM r GROUP BY event HAVING max(v) > 0""")
def event_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as assessments of one event that is updated, lapses, is retracted and comes back."""
    h = detections(processors.with_state_store(spark), sf_dir)
    i, at = F.col("id"), F.col("us")
    expires = F.when(i % 7 == 0, at).otherwise(at + (1 + i % 5) * 43_200_000_000)
    rows = h.select(F.col("user_id").cast("string").alias("event"), F.floor(F.col("value") / 100).cast("int").cast("string").alias("digest"), (1 + i % 4).alias("level"), at.alias("at"), expires.alias("expires"), (i % 11 == 0).alias("retracted"))
    said = lambda t: F.count_if(F.col("transition") == t).alias(t)
    return processors.lifecycle(rows).groupBy("event").agg(F.max("revision").alias("revision"), said("expired"), said("updated"), said("retracted"))
