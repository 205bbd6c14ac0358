"""Fire queries over the driver's events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.functions.geo import in_box, round_half_up
from lithos.operators import fire, joins, latest, quality
from lithos.plans.registry import EVENTS_SQL, detections, query
from lithos.policies import PROVINCE, FirePolicy, StaticSourcePolicy
from lithos.session import checkpoint_dir, read_table
from lithos.streaming import fires as fire_state

KM_SQL = "2 * 6371.0088 * asin(sqrt(least(1.0, sin(radians({b}lat - {a}lat) / 2) ** 2 + cos(radians({a}lat)) * cos(radians({b}lat)) * sin(radians({b}lon - {a}lon) / 2) ** 2)))"


@query(f"""WITH {EVENTS_SQL}, w AS (
  SELECT *, count(*) OVER win AS n, (min(us) OVER win < max(us) OVER win) OR (min(event_type) OVER win < max(event_type) OVER win) AS sp, bool_or(value >= 480) OVER win AS hi
  FROM h WHERE event_type <> 'error' WINDOW win AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)
), l AS (SELECT *, CASE WHEN n >= 5 THEN 3 WHEN hi OR sp THEN 2 ELSE 1 END AS lv FROM w),
m AS (SELECT *, max(lv) OVER (PARTITION BY user_id) AS ml FROM l)
SELECT user_id, max(ml) AS level, min(us) FILTER (lv = ml) AS reached_us, max(n) AS peak, count(*) AS detections FROM m GROUP BY user_id""")
def fire_window_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: excluded products go, each site's trailing day gives a level, each site keeps its highest."""
    h = detections(spark, sf_dir).filter(F.col("event_type") != "error").filter(in_box(F.col("lat"), F.col("lon"), PROVINCE))
    return fire.event_levels(fire.window_levels(h, "user_id", F.col("us"), "event_type", F.col("value") >= 480), "user_id")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("id", "t", "lat", "lon", F.col("event_type").alias("product"), F.col("value").alias("frp"), F.col("t").alias("fetched_t"))


#: Wider than the default, so that a month of events has chains.
WIDE = FirePolicy(km=5.0)
_EDGES_SQL = f"""e AS (SELECT a.id AS a, b.id AS b FROM h a JOIN h b ON a.id < b.id AND b.t BETWEEN a.t - 86400 AND a.t + 86400
  AND abs(a.lat - b.lat) < 0.06 AND {KM_SQL.format(a="a.", b="b.")} <= 5)"""


@query(f"WITH {EVENTS_SQL}, {_EDGES_SQL} SELECT a, b FROM e")
def fire_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.near_pairs(_points(spark, sf_dir), WIDE.km, WIDE.gap_seconds)


_COMPONENTS_SQL = """, s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(id, node) AS (
  SELECT DISTINCT a, a FROM s UNION SELECT r.id, s.b FROM r JOIN s ON r.node = s.a
), c AS (SELECT id, min(node) AS event FROM r GROUP BY id), f AS (SELECT h.*, coalesce(c.event, h.id) AS event FROM h LEFT JOIN c USING (id))"""


@query(f"WITH RECURSIVE {EVENTS_SQL}, {_EDGES_SQL}{_COMPONENTS_SQL} SELECT id, event FROM f")
def fire_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fire.chain(_points(spark, sf_dir), WIDE).select("id", "event")


@query(f"""WITH RECURSIVE {EVENTS_SQL}, {_EDGES_SQL}{_COMPONENTS_SQL}
SELECT event, floor(avg(lat) * 1e5 + 0.5) / 1e5 AS lat, floor(avg(lon) * 1e5 + 0.5) / 1e5 AS lon, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS products,
  max(value) AS max_frp, min(t) AS first_t, max(t) AS last_t, max(t) + 86400 AS expires_t, count(*) AS detections FROM f GROUP BY event""")
def fire_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fire.event_summary(fire.chain(_points(spark, sf_dir), WIDE))
    return out.withColumn("products", F.array_join("products", ","))


#: Events linger so long that a month is a replay of few slices; nothing lapses, as what is received at once lies within the gap.
LINGERING = FirePolicy(km=5.0, linger_seconds=10 * 86_400)


@query(f"""WITH RECURSIVE {EVENTS_SQL}, {_EDGES_SQL}{_COMPONENTS_SQL}, n AS (SELECT event, CAST(arg_min(id, t * 1000000000 + rank) AS VARCHAR) AS name
  FROM (SELECT *, row_number() OVER (ORDER BY t, CAST(id AS VARCHAR)) AS rank FROM f) GROUP BY event),
w AS (SELECT *, count(*) OVER win AS k, (min(t) OVER win < max(t) OVER win) OR (min(event_type) OVER win < max(event_type) OVER win) AS sp, bool_or(value >= 480) OVER win AS hi
  FROM f WINDOW win AS (PARTITION BY event ORDER BY t RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW))
SELECT name AS event, count(*) AS detections, min(t) AS first_t, max(t) AS last_t, max(CASE WHEN k >= 5 THEN 3 WHEN hi OR sp THEN 2 ELSE 1 END) AS level FROM w JOIN n USING (event) GROUP BY name""")
def fire_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after all detections have been joined in slice by slice, each received when it was detected."""
    table = fire_state.fire_table(spark, f"{checkpoint_dir(spark)}/fires-{uuid.uuid4().hex}")
    batch = _points(spark, sf_dir).withColumn("high", F.col("frp") >= 480).withColumnRenamed("fetched_t", "fetched")
    fire_state.absorb(table, batch, 0, LINGERING)
    live = table.read(fire_state.MOST_SLICES).filter("live")
    return live.groupBy("event").agg(F.count(F.lit(1)).alias("detections"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.max("level").alias("level"))


_INVENTORY_SQL = f"""WITH {EVENTS_SQL}, p AS (SELECT event_type AS satellite, year(ts) AS year, CASE WHEN value >= 392 THEN 'high' WHEN value >= 147 THEN 'nominal' ELSE 'low' END AS confidence,
  hour(ts) BETWEEN 6 AND 17 AS daytime, CASE WHEN id % 5 < 4 THEN id % 5 END AS type FROM h)
SELECT satellite, year, count(*) AS n, count_if(confidence = 'low') AS low, count_if(confidence = 'nominal') AS nominal, count_if(confidence = 'high') AS high, count_if(NOT daytime) AS night,
  count_if(type = 0) AS type_0, count_if(type = 1) AS type_1, count_if(type = 2) AS type_2, count_if(type = 3) AS type_3, count_if(type IS NULL) AS untyped FROM p GROUP BY ALL"""


@query(_INVENTORY_SQL)
def fire_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lithos.functions.levels import confidence_class

    h = detections(spark, sf_dir)
    kind = F.when(F.col("id") % 5 < 4, F.col("id") % 5)
    return fire.inventory(h.select(F.col("event_type").alias("satellite"), F.year("ts").alias("year"), confidence_class(F.col("value") * 10 / 49).alias("confidence"), F.hour("ts").between(6, 17).alias("daytime"), kind.alias("type")))


@query(f"WITH {EVENTS_SQL} SELECT month(ts + INTERVAL 7 HOUR) AS month, count(*) AS n FROM h GROUP BY 1")
def fire_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fire.monthly(detections(spark, sf_dir), "ts")


@query(f"""WITH {EVENTS_SQL} SELECT year(ts + INTERVAL 7 HOUR) AS year, count_if(least(3, 1 + floor(value / 200)) = 1) AS level_1, count_if(least(3, 1 + floor(value / 200)) = 2) AS level_2,
  count_if(least(3, 1 + floor(value / 200)) = 3) AS level_3 FROM h GROUP BY 1""")
def fire_events_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = detections(spark, sf_dir).select(F.year(F.col("ts") + F.expr("INTERVAL 7 HOURS")).alias("year"), F.least(F.lit(3), 1 + F.floor(F.col("value") / 200)).cast("int").alias("level"))
    return fire.events_by_year(h)


#: Cells of a twentieth of a degree and thresholds that fit a month of events.
CELLS = StaticSourcePolicy(cell=0.05, days=4, years=1, months=1, night=0.4, season=0.9)
_CELL_SQL = f"""{EVENTS_SQL}, p AS (SELECT floor(lat / 0.05) AS cy, floor(lon / 0.05) AS cx, CAST(ts AS DATE) AS day, year(ts) AS year, month(ts) AS month, NOT hour(ts) BETWEEN 6 AND 17 AS night, id % 5 - 1 AS type FROM h)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = detections(spark, sf_dir)
    return h.select("lat", "lon", F.to_date("ts").alias("day"), F.year("ts").alias("year"), F.month("ts").alias("month"), (~F.hour("ts").between(6, 17)).alias("night"), (F.col("id") % 5 - 1).alias("type"))


@query(f"""WITH {_CELL_SQL} SELECT CAST(cy AS BIGINT) AS cy, CAST(cx AS BIGINT) AS cx, count(*) AS n, count(DISTINCT day) AS days, count(DISTINCT year) AS years, count(DISTINCT month) AS months,
  count_if(night) AS n_night, count_if(month IN (7, 8, 9, 10)) AS n_season, count_if(type >= 0) AS n_typed, count_if(type IN (2, 3)) AS n_special FROM p GROUP BY cy, cx""")
def fire_cell_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fire.cell_statistics(_cells(spark, sf_dir), CELLS)


_BLOCK_SQL = f"""{_CELL_SQL}, d AS (SELECT unnest([-1, 0, 1]) AS k), b AS (
  SELECT p.cy + y.k AS cy, p.cx + x.k AS cx, p.* EXCLUDE (cy, cx) FROM p, d y, d x
), g AS (SELECT cy, cx, count(*) AS n, count(DISTINCT day) AS days, count(DISTINCT year) AS years, count(DISTINCT month) AS months, count_if(night) AS n_night, count_if(month IN (7, 8, 9, 10)) AS n_season,
  count_if(type >= 0) AS n_typed, count_if(type IN (2, 3)) AS n_special FROM b GROUP BY cy, cx),
q AS (SELECT *, days >= 4 AND years >= 1 AND months >= 1 AND ((n_night / n >= 0.4 AND (n_season / n <= 0.9 OR n_night / n >= 0.9)) OR coalesce(n_typed >= 3 AND n_special / n_typed >= 0.5, false)) AS flagged
  FROM g WHERE (cy, cx) IN (SELECT (cy, cx) FROM p))"""


@query(f"WITH {_BLOCK_SQL} SELECT CAST(cy AS BIGINT) AS cy, CAST(cx AS BIGINT) AS cx, n, days, years, months, n_night, n_season, n_typed, n_special, flagged FROM q")
def fire_block_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fire.block_flags(_cells(spark, sf_dir), CELLS)


def _busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that at least as many detections as the rule asks days for fell into."""
    c = fire.cell_statistics(_cells(spark, sf_dir), CELLS)
    return c.filter(F.col("days") >= CELLS.days).select("cy", "cx")


@query(f"""WITH RECURSIVE {_CELL_SQL}, c AS (SELECT CAST(cy AS BIGINT) AS cy, CAST(cx AS BIGINT) AS cx FROM p GROUP BY cy, cx HAVING count(DISTINCT day) >= 4),
k AS (SELECT cy, cx, lpad(CAST(cy + 10000000 AS VARCHAR), 9, '0') || ',' || lpad(CAST(cx + 10000000 AS VARCHAR), 9, '0') AS k FROM c),
e AS (SELECT a.k AS a, b.k AS b FROM k a JOIN k b ON abs(a.cy - b.cy) <= 1 AND abs(a.cx - b.cx) <= 1),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT k.cy, k.cx, (SELECT min(b) FROM r WHERE r.a = k.k) AS component FROM k""")
def fire_cell_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fire.flood_fill(_busy(spark, sf_dir))


@query(f"""WITH RECURSIVE {_BLOCK_SQL}, pp AS (SELECT CAST(floor(lat / 0.05) AS BIGINT) AS cy, CAST(floor(lon / 0.05) AS BIGINT) AS cx, lat, lon FROM h), c AS (SELECT CAST(cy AS BIGINT) AS cy, CAST(cx AS BIGINT) AS cx FROM q WHERE flagged),
k AS (SELECT cy, cx, lpad(CAST(cy + 10000000 AS VARCHAR), 9, '0') || ',' || lpad(CAST(cx + 10000000 AS VARCHAR), 9, '0') AS k FROM c), e AS (SELECT a.k AS a, b.k AS b FROM k a JOIN k b ON abs(a.cy - b.cy) <= 1 AND abs(a.cx - b.cx) <= 1),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), o AS (SELECT a, min(b) AS component FROM r GROUP BY a), x AS (SELECT pp.*, component FROM pp JOIN k USING (cy, cx) JOIN o ON o.a = k.k),
m AS (SELECT component, avg(lat) AS lat, avg(lon) AS lon, count(*) AS detections FROM x GROUP BY 1), f AS (SELECT component, max({KM_SQL.format(a="x.", b="m.")}) AS far FROM x JOIN m USING (component) GROUP BY 1)
SELECT component, floor(floor(lat * 1e5 + 0.5) / 1e5 * 1e3 + 0.5) / 1e3 AS c_lat, floor(floor(lon * 1e5 + 0.5) / 1e5 * 1e3 + 0.5) / 1e3 AS c_lon, greatest(0.75, ceil((far + 0.5) * 100) / 100) AS radius_km, detections FROM m JOIN f USING (component)""")
def fire_static_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks from blocks that look like lasting sources; means are compared to three digits, as sums of doubles depend on their order."""
    out = fire.static_sources(_cells(spark, sf_dir), CELLS)
    return out.withColumn("c_lat", round_half_up(F.col("c_lat"), 3)).withColumn("c_lon", round_half_up(F.col("c_lon"), 3))


_CIRCLES_SQL = "c AS (SELECT s_suppkey AS pos, -7.9 + (s_suppkey * 613 % 2200) / 1000.0 AS c_lat, 106.3 + (s_suppkey * 3571 % 2600) / 1000.0 AS c_lon, 1 + s_suppkey % 7 AS radius_km FROM supplier)"
_INSIDE_SQL = "2 * 6371.0088 * asin(sqrt(least(1.0, sin(radians(c.c_lat - h.lat) / 2) ** 2 + cos(radians(h.lat)) * cos(radians(c.c_lat)) * sin(radians(c.c_lon - h.lon) / 2) ** 2))) <= c.radius_km"


def _circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return read_table(spark, sf_dir, "supplier").select(s.alias("pos"), (F.lit(-7.9) + (s * 613 % 2200) / 1000.0).alias("c_lat"), (F.lit(106.3) + (s * 3571 % 2600) / 1000.0).alias("c_lon"), (1 + s % 7).cast("double").alias("radius_km"))


@query(f"WITH {EVENTS_SQL}, {_CIRCLES_SQL} SELECT id FROM h WHERE NOT EXISTS (SELECT 1 FROM c WHERE {_INSIDE_SQL})")
def fire_unmasked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.mask(detections(spark, sf_dir).select("id", "lat", "lon"), _circles(spark, sf_dir)).select("id")


@query(f"WITH {EVENTS_SQL}, {_CIRCLES_SQL} SELECT h.id, min(c.pos) AS circle FROM h JOIN c ON {_INSIDE_SQL} GROUP BY h.id")
def fire_first_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.mask(detections(spark, sf_dir).select("id", "lat", "lon"), _circles(spark, sf_dir), keep=False).select("id", "circle")


@query(f"""WITH {EVENTS_SQL} SELECT id FROM h WHERE t + 86400 <= 1706000000 ORDER BY t + 86400, id LIMIT 100""")
def fire_due_for_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred events that are due first; the limit is the feature."""
    h = detections(spark, sf_dir).withColumn("expires", F.col("t") + FirePolicy().linger_seconds)
    return h.filter("expires <= 1706000000").orderBy("expires", "id").limit(100).select("id")


@query(f"""WITH {EVENTS_SQL}, w AS (SELECT event_type || ':' || strftime(ts, '%Y%m%dT%H%M') || ':' || printf('%.5f', lat) || ':' || printf('%.5f', lon) AS id, us, value FROM h)
SELECT id, min(us) AS first_us, arg_max(value, us) AS frp, count(*) AS seen FROM w GROUP BY id""")
def hotspot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections by derived id: the first time stays, the last value wins."""
    from lithos.functions.ids import detection_id

    h = detections(spark, sf_dir).withColumn("hid", detection_id(F.col("event_type"), F.col("ts"), F.col("lat"), F.col("lon")))
    return h.groupBy(F.col("hid").alias("id")).agg(F.min("us").alias("first_us"), F.max_by("value", "us").alias("frp"), F.count(F.lit(1)).alias("seen"))


@query(f"""WITH {EVENTS_SQL} SELECT event_type, CAST(floor(lat / 0.1) AS BIGINT) AS cy, CAST(floor(lon / 0.1) AS BIGINT) AS cx, count(*) AS n, floor(max(value) * 100 + 0.5) / 100 AS top FROM h
WHERE lat BETWEEN -7.9 AND -5.7 AND lon BETWEEN 106.3 AND 108.9 GROUP BY ALL HAVING count(*) > 1""")
def hotspot_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = detections(spark, sf_dir).filter(in_box(F.col("lat"), F.col("lon"), PROVINCE))
    g = h.groupBy("event_type", F.floor(F.col("lat") / 0.1).alias("cy"), F.floor(F.col("lon") / 0.1).alias("cx")).agg(F.count(F.lit(1)).alias("n"), round_half_up(F.max("value"), 2).alias("top"))
    return g.filter("n > 1")


@query(f"""WITH {EVENTS_SQL}, q AS (SELECT *, count(*) OVER (PARTITION BY user_id, event_type || CAST(t // 86400 AS VARCHAR)) AS k FROM h) SELECT id FROM q WHERE k = 1""")
def single_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = detections(spark, sf_dir).withColumn("sensor", F.concat("event_type", F.floor(F.col("t") / 86400).cast("string")))
    return quality.drop_repeated_sensors(h, "user_id", "sensor").select("id")


@query(f"""WITH {EVENTS_SQL}, o AS (SELECT *, lag(value) OVER w AS pv, lag(event_type) OVER w AS pt, row_number() OVER w AS k FROM h WINDOW w AS (PARTITION BY user_id ORDER BY us, id))
SELECT id FROM o WHERE k = 1 OR pv IS DISTINCT FROM value OR pt IS DISTINCT FROM event_type""")
def drop_adjacent_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.drop_adjacent(detections(spark, sf_dir), ["user_id", "us", "id"], ["value", "event_type"]).select("id")


@query(f"""WITH {EVENTS_SQL} SELECT user_id, event_type, arg_max(id, t * 10000000 + id) AS id, arg_max(value, t * 10000000 + id) AS value, min(us) AS first_seen FROM h GROUP BY ALL""")
def latest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = detections(spark, sf_dir).select("user_id", "event_type", "id", "value", "t", "us")
    return latest.newest(h, ["user_id", "event_type"], ["t", "id"], "us").select("user_id", "event_type", "id", "value", "first_seen")
