"""Threshold, rain and flood queries over orders, line items and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.functions.geo import round_half_up
from lithos.functions.levels import discharge_level, rain_level, threshold_level
from lithos.operators import flood, joins
from lithos.plans.registry import EVENTS_SQL, detections, query
from lithos.session import read_table


def r4(c: str) -> str:
    return f"floor(({c}) * 1e4 + 0.5) / 1e4"


_Q = {"p50": 0.5, "p80": 0.8, "p90": 0.9, "p98": 0.98, "p99_5": 0.995}
_Q_SQL = ", ".join(f"floor(quantile_cont(l_extendedprice, {q}) * 1e6 + 0.5) / 1e6 AS {n}" for n, q in _Q.items())


@query(f"SELECT l_suppkey, count(*) AS samples, {_Q_SQL} FROM lineitem GROUP BY l_suppkey")
def flood_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = flood.thresholds(read_table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", min_samples=100)
    return out.select("l_suppkey", "samples", *[round_half_up(F.col(n), 6).alias(n) for n in _Q])


@query("SELECT l_suppkey, quantile_disc(l_quantity, 0.5) AS r50, quantile_disc(l_quantity, 0.95) AS r95, quantile_disc(l_quantity, 0.99) AS r99 FROM lineitem GROUP BY l_suppkey")
def flood_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flood.nearest_rank(read_table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", [0.5, 0.95, 0.99])


_DAILY_SQL = "d AS (SELECT o_orderpriority AS site, CAST(o_orderdate AS DATE) AS day, floor(sum(o_totalprice) * 100 + 0.5) / 100 AS v, count(*) AS n FROM orders GROUP BY ALL)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("site"), F.to_date("o_orderdate").alias("day")).agg(round_half_up(F.sum("o_totalprice"), 2).alias("v"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_DAILY_SQL} SELECT site, year(day) AS year, count(*) AS days, max(v) AS maximum, arg_min(day, (-v, day)) AS on_day FROM d GROUP BY site, year(day) HAVING count(*) >= 30".replace("arg_min(day, (-v, day))", "min(day) FILTER (v = m)").replace("FROM d GROUP BY", "FROM (SELECT *, max(v) OVER (PARTITION BY site, year(day)) AS m FROM d) GROUP BY"))
def flood_annual_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flood.annual_maxima(_daily(spark, sf_dir), ["site"], "day", "v", 30)


@query(f"WITH {_DAILY_SQL}, y AS (SELECT site, year(day) AS y, max(v) AS m FROM d GROUP BY ALL HAVING count(*) >= 30) SELECT site, {r4('quantile_cont(m, 0.5)')} AS median_maximum FROM y GROUP BY site")
def flood_median_of_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = flood.median_of_maxima(flood.annual_maxima(_daily(spark, sf_dir), ["site"], "day", "v", 30), ["site"])
    return out.select("site", round_half_up(F.col("median_maximum"), 4).alias("median_maximum"))


@query(f"""WITH b AS (SELECT l_suppkey, l_extendedprice AS m, l_quantity * 2000 AS r FROM lineitem), g AS (SELECT l_suppkey, quantile_cont(m, 0.98) / nullif(quantile_cont(r, 0.98), 0) AS ratio FROM b GROUP BY 1)
SELECT l_suppkey, {r4('ratio')} AS ratio, {r4('CASE WHEN ratio < 0.9 THEN ratio ELSE 1.0 END')} AS correction FROM g""")
def flood_bias_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read_table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("m"), (F.col("l_quantity") * 2000).alias("r"))
    out = flood.bias_ratio(b, ["l_suppkey"], "m", "r")
    return out.select("l_suppkey", round_half_up(F.col("ratio"), 4).alias("ratio"), round_half_up(F.col("correction"), 4).alias("correction"))


@query(f"WITH {_DAILY_SQL} SELECT site, day, v, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY v DESC, day) AS k FROM d) WHERE k <= 5")
def flood_top_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flood.top_days(_daily(spark, sf_dir), ["site"], "day", "v").select("site", "day", "v", "place")


_HOURLY_SQL = f"{EVENTS_SQL}, hr AS (SELECT event_type AS basin, t // 3600 AS hour, floor(sum(value) * 1000 + 0.5) / 1000 AS v FROM h GROUP BY ALL)"


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).groupBy(F.col("event_type").alias("basin"), F.floor(F.col("t") / 3600).alias("hour")).agg(round_half_up(F.sum("value"), 3).alias("v"))


def _rolling_sql(hours: int) -> str:
    return f"""SELECT basin, hour // 24 AS epoch_day, {hours} AS hours, max(floor(s * 1e3 + 0.5) / 1e3) AS day_max FROM (SELECT *, sum(v) OVER w AS s, count(*) OVER w AS c FROM hr
  WINDOW w AS (PARTITION BY basin ORDER BY hour RANGE BETWEEN {hours - 1} PRECEDING AND CURRENT ROW)) WHERE c = {hours} GROUP BY ALL"""


@query(f"WITH {_HOURLY_SQL} " + " UNION ALL ".join(_rolling_sql(n) for n in (3, 6, 24)))
def rain_rolling_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    hr, out = _hourly(spark, sf_dir), None
    for n in (3, 6, 24):
        one = flood.rolling_day_maxima(hr, ["basin"], "hour", "v", n).select("basin", "epoch_day", F.lit(n).alias("hours"), round_half_up(F.col("day_max"), 3).alias("day_max"))
        out = one if out is None else out.unionByName(one)
    return out


_LEVEL_SQL = "CASE WHEN {v} IS NULL THEN NULL ELSE ({v} >= 100)::INT + ({v} >= 250)::INT + ({v} >= 400)::INT + ({v} >= 470)::INT END"
def _thresholds() -> list[Column]:
    return [F.lit(x) for x in (100.0, 250.0, 400.0, 470.0)]



@query(f"WITH {EVENTS_SQL} SELECT id, {_LEVEL_SQL.format(v='value')} AS level FROM h")
def flood_level_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("id", threshold_level(F.col("value"), _thresholds()).alias("level"))


_DISCHARGE_SQL = f"""{EVENTS_SQL}, x AS (SELECT id, user_id, t // 86400 AS d, CASE WHEN id % 3 = 0 THEN NULL ELSE value END AS med, value * 0.9 AS one, CASE WHEN id % 5 = 0 THEN NULL ELSE value * 1.2 END AS p75 FROM h),
y AS (SELECT *, least({_LEVEL_SQL.format(v='coalesce(med, one)')}, 3) AS base, {_LEVEL_SQL.format(v='p75')} AS up FROM x),
z AS (SELECT *, coalesce(med IS NOT NULL AND p75 IS NOT NULL AND up > base AND base < 3, false) AS possible FROM y), l AS (SELECT *, base + possible::INT AS level FROM z)"""


def _discharge(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = detections(spark, sf_dir)
    v = F.col("value")
    x = h.select("id", "user_id", F.floor(F.col("t") / 86400).alias("d"), F.when(F.col("id") % 3 != 0, v).alias("med"), (v * 0.9).alias("one"), F.when(F.col("id") % 5 != 0, v * 1.2).alias("p75"))
    level, possible = discharge_level(F.col("med"), F.col("one"), F.col("p75"), _thresholds(), 3)
    return x.withColumn("level", level).withColumn("possible", possible)


@query(f"WITH {_DISCHARGE_SQL} SELECT id, level, possible FROM l")
def flood_discharge_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discharge(spark, sf_dir).select("id", "level", "possible")


@query(f"""WITH {_DISCHARGE_SQL}, m AS (SELECT *, max(level) OVER (PARTITION BY user_id) AS top FROM l)
SELECT user_id, max(top) AS level, min(d) FILTER (level = top) AS peak_day, bool_and(possible) FILTER (level = top) AS possible FROM m GROUP BY user_id""")
def flood_outlook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flood.outlook(_discharge(spark, sf_dir), ["user_id"], "d").select("user_id", "level", F.col("peak_date").alias("peak_day"), "possible")


@query(f"""WITH {EVENTS_SQL}, x AS (SELECT id, least({_LEVEL_SQL.format(v='value')}, 3) AS a, least({_LEVEL_SQL.format(v='(value * 0.8)')}, 3) AS b, least({_LEVEL_SQL.format(v='(value * (0.5 + id % 3 * 0.4))')}, 3) AS c FROM h)
SELECT id, greatest(a, b, c) AS level, CASE WHEN c = greatest(a, b, c) THEN 2 WHEN b = greatest(a, b, c) THEN 1 ELSE 0 END AS window_place FROM x""")
def rain_day_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = detections(spark, sf_dir)
    v = F.col("value")
    best, which = rain_level([threshold_level(x, _thresholds()) for x in (v, v * 0.8, v * (F.lit(0.5) + F.col("id") % 3 * 0.4))])
    return h.select("id", best.alias("level"), which.alias("window_place"))


_EPISODE_SQL = f"""{EVENTS_SQL}, x AS (SELECT user_id, id, us, value FROM h WHERE value >= 250), n AS (SELECT *, coalesce(us - lag(us) OVER w >= 86400000000, true)::INT AS fresh FROM x WINDOW w AS (PARTITION BY user_id ORDER BY us)),
e AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS episode FROM n)"""


@query(f"WITH {_EPISODE_SQL} SELECT user_id, CAST(episode AS BIGINT) AS episode, min(us) AS opened, max(us) AS last_exceeded, max(us) + 86400000000 AS expires, max({_LEVEL_SQL.format(v='value')}) AS level, count(*) AS runs FROM e GROUP BY ALL")
def flood_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = detections(spark, sf_dir).select("user_id", "us", "value", threshold_level(F.col("value"), _thresholds()).alias("level"))
    linger = 86_400_000_000
    return flood.episode_summary(flood.episodes(h, "user_id", "us", F.col("value") >= 250, linger), "user_id", "us", "level", linger)


@query(f"SELECT l_partkey, count(*) AS cells, floor(sum(l_extendedprice * l_quantity) / sum(l_quantity) * 1000 + 0.5) / 1000 AS mean FROM lineitem GROUP BY l_partkey")
def rain_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flood.weighted_mean(read_table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_extendedprice", "l_quantity").select("l_partkey", "cells", "mean")


@query(f"""WITH m AS (SELECT l_suppkey, {r4('avg(l_quantity)')} AS mean, count(*) AS days FROM lineitem GROUP BY 1)
SELECT l_suppkey, mean, days, coalesce(lag(mean) OVER (PARTITION BY l_suppkey % 5 ORDER BY l_suppkey) > mean, false) AS smaller_than_upstream FROM m""")
def river_smaller_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = flood.river_cells(read_table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", 1).withColumn("river", F.col("l_suppkey") % 5)
    return flood.smaller_downstream(m, "river", "l_suppkey", "mean").select("l_suppkey", "mean", "days", "smaller_than_upstream")


@query(f"""WITH m AS (SELECT l_partkey AS cell, l_partkey % 50 AS station, {r4('avg(l_extendedprice)')} AS mean, l_partkey * 7 % 11 AS distance FROM lineitem GROUP BY 1),
k AS (SELECT *, max(mean) OVER (PARTITION BY station) AS top FROM m), s AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY distance, mean DESC, cell) AS n FROM k WHERE mean >= 0.3 * top)
SELECT station, cell, mean FROM s WHERE n = 1""")
def river_main_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = flood.river_cells(read_table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_extendedprice", 1)
    p = F.col("l_partkey")
    m = m.select(p.alias("cell"), (p % 50).alias("station"), "mean", (p * 7 % 11).alias("distance"), p.alias("lat"), p.alias("lon"))
    return flood.main_stem(m, "station").select("station", "cell", "mean")


@query("""WITH s AS (SELECT s_suppkey, s_suppkey / 8.0 AS lat, s_suppkey / 16.0 AS lon FROM supplier), k AS (SELECT unnest([-1, 0, 1]) AS k)
SELECT s_suppkey, floor((lat + y.k * 0.05) * 1e4 + 0.5) / 1e4 AS cell_lat, floor((lon + x.k * 0.05) * 1e4 + 0.5) / 1e4 AS cell_lon FROM s, k y, k x""")
def river_candidate_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") / 8.0).alias("lat"), (F.col("s_suppkey") / 16.0).alias("lon"))
    return flood.candidate_offsets(s, 1, 0.05).select("s_suppkey", "cell_lat", "cell_lon")


@query(f"""WITH {_DAILY_SQL}, s AS (SELECT DISTINCT site, DATE '1998-01-01' AS d0 FROM d), x AS (SELECT site, CAST(d0 + k * INTERVAL 1 DAY AS DATE) AS day FROM s, (SELECT unnest(range(0, 4)) AS k))
SELECT x.site, x.day, d.v FROM x LEFT JOIN d ON d.site = x.site AND d.day = x.day""")
def flood_day_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _daily(spark, sf_dir).withColumn("d0", F.lit("1998-01-01").cast("date"))
    return joins.day_spine(d, "d0", 3, ["site"], "day").select("site", "day", "v")


@query("""WITH t AS (SELECT p_partkey, p_retailprice FROM part WHERE p_partkey % 10 <> 3)
SELECT l_orderkey, l_linenumber, p_retailprice IS NULL AS rejected FROM lineitem LEFT JOIN t ON p_partkey = l_partkey""")
def flood_threshold_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "part").filter("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    found, missing = joins.lookup_or_reject(read_table(spark, sf_dir, "lineitem"), t, ["l_partkey"])
    cols = "l_orderkey", "l_linenumber"
    return found.select(*cols, F.lit(False).alias("rejected")).unionByName(missing.select(*cols, F.lit(True).alias("rejected")))


@query("""WITH f AS (SELECT s_suppkey AS fire, DATE '1995-01-01' + CAST(s_suppkey * 13 % 1500 AS INTEGER) AS start FROM supplier),
d AS (SELECT l_suppkey AS s, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)
SELECT fire, count(d.s) AS days, coalesce(max(v), 0) AS peak FROM f LEFT JOIN d ON d.s = f.fire AND d.day BETWEEN f.start - 1 AND f.start + 30 GROUP BY fire""")
def recorded_event_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded events against the series of their place, from a day before to a month after."""
    s = F.col("s_suppkey")
    f = read_table(spark, sf_dir, "supplier").select(s.alias("fire"), F.date_add(F.lit("1995-01-01").cast("date"), (s * 13 % 1500).cast("int")).alias("start"))
    d = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("v"))
    j = f.join(d, (F.col("s") == F.col("fire")) & F.col("day").between(F.date_sub("start", 1), F.date_add("start", 30)), "left")
    return j.groupBy("fire").agg(F.count("s").alias("days"), F.coalesce(F.max("v"), F.lit(0.0)).alias("peak"))
