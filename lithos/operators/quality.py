"""Validation: every rule that a row breaks is listed, and rows split into valid and rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions.geo import in_box
from lithos.functions.ids import detection_id
from lithos.policies import FEEDS, NATION, PROVINCE, UNIT_LIMITS, WarningPolicy


def with_errors(df: DataFrame, rules: dict[str, Column], name: str = "errors") -> DataFrame:
    """``rules``: what is wrong, by code; a null condition is no error."""
    return df.withColumn(name, F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])))


def split(df: DataFrame, name: str = "errors") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.size(name) == 0).drop(name), df.filter(F.size(name) > 0)


def report(rejected: DataFrame, example: str, name: str = "errors", n: int = 10) -> DataFrame:
    """Rejected rows by reason with the first examples."""
    r = rejected.select(F.explode(name).alias("reason"), F.col(example).cast("string").alias("_e"))
    w = Window.partitionBy("reason").orderBy("_e")
    few = r.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).groupBy("reason").agg(F.array_sort(F.collect_list("_e")).alias("examples"))
    return r.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).join(few, "reason")


def _outside(c: str, low: float, high: float) -> Column:
    return ~F.coalesce(F.col(c).between(low, high), F.lit(False)) | F.isnan(F.col(c).cast("double"))


def quake_rules(skew_minutes: int = 10, texts: tuple[str, ...] = ("place",), urls: tuple[str, ...] = ("source_url",)) -> dict[str, Column]:
    """``texts`` and ``urls`` are the columns that the feed has of these; lengths count bytes."""
    name = r"^[\x21-\x7E]{1,128}$"
    others = F.coalesce("alternate_ids", F.array().cast("array<string>"))
    owner = F.create_map(*[F.lit(x) for kv in FEEDS.items() for x in kv])
    any_of = lambda cs, f: F.coalesce(F.greatest(*[F.coalesce(f(c), F.lit(False)) for c in (*cs, cs[0])]), F.lit(False))
    return {
        "feed": ~owner[F.col("feed")].eqNullSafe(F.col("source")),
        "id": ~F.coalesce(F.col("event_id").rlike(name), F.lit(False)),
        "alternate_ids": (F.size(others) > 32) | F.exists(others, lambda x: ~F.coalesce(x.rlike(name), F.lit(False))),
        "latitude": _outside("latitude", -90, 90),
        "longitude": _outside("longitude", -180, 180),
        "magnitude": _outside("magnitude", -2, 10),
        "depth": _outside("depth_km", -10, 800),
        "time": F.col("occurred_at").isNull() | F.col("fetched_at").isNull(),
        "future": F.col("occurred_at") > F.col("fetched_at") + F.expr(f"INTERVAL {skew_minutes} MINUTES"),
        "tsunami": ~F.coalesce(F.col("tsunami").isin("unknown", "none", "potential"), F.lit(False)),
        "text": any_of(texts, lambda c: F.octet_length(c) > 1024),
        "url": any_of(urls, lambda c: (F.col(c) != "") & ~F.col(c).rlike("^https://")),
    }


def warning_rules(policy: WarningPolicy = WarningPolicy(), onset_may_equal: bool = False) -> dict[str, Column]:
    """Polygons are array<array<struct<lat, lon>>>; a ring is closed and has four points or more."""
    refs = F.coalesce(F.col("references"), F.array().cast("array<struct<identifier:string,sender:string,sent:timestamp>>"))
    late = F.col("onset") > F.col("expires") if onset_may_equal else F.col("onset") >= F.col("expires")
    closed = lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1))
    return {
        "expires": F.col("expires") <= F.col("effective"),
        "too_long": F.col("expires") > F.col("effective") + F.expr(f"INTERVAL {policy.max_days} DAYS"),
        "onset": late,
        "references": F.col("msg_type").isin("Update", "Cancel") & (F.size(refs) == 0),
        "self_reference": F.exists(refs, lambda r: r["identifier"] == F.col("identifier")),
        "later_reference": F.exists(refs, lambda r: r["sent"] > F.col("sent")),
        "reference_order": ~refs.eqNullSafe(F.array_sort(refs)),
        "repeated_reference": F.size(F.array_distinct(F.transform(refs, lambda r: r["identifier"]))) < F.size(refs),
        "ring": ~F.forall(F.coalesce("polygons", F.array().cast("array<array<struct<lat:double,lon:double>>>")), closed),
        "polygons": F.size("polygons") > policy.max_polygons,
        "points": F.aggregate("polygons", F.lit(0), lambda a, r: a + F.size(r)) > policy.max_points,
    }


def warning_relevance(identifier: Column, status: Column, msg_type: Column, province: str, segment: int = 5) -> Column:
    """Actual alerts, updates and cancels of the province that the identifier's OID names."""
    return (status == "Actual") & msg_type.isin("Alert", "Update", "Cancel") & (F.split_part(identifier, F.lit("."), F.lit(segment)) == province)


def hotspot_rules(max_age_days: int = 10) -> dict[str, Column]:
    modis = F.col("product").startswith("MODIS")
    west, south, east, north = PROVINCE
    return {
        "id": ~F.col("id").eqNullSafe(detection_id(F.col("product"), F.col("detected_at"), F.col("lat"), F.col("lon"))),
        "product": ~((modis & (F.col("instrument") == "MODIS")) | (F.col("product").startswith("VIIRS") & (F.col("instrument") == "VIIRS"))),
        "minute": F.second("detected_at") != 0,
        "box": ~(F.col("lat").between(south, north) & F.col("lon").between(west, east)),
        "confidence": modis != F.col("confidence_pct").isNotNull(),
        "brightness": _outside("brightness_k", 200, 700),
        "age": F.col("detected_at") < F.col("fetched_at") - F.expr(f"INTERVAL {max_age_days} DAYS"),
    }


def spec_errors(steps: DataFrame, spec: DataFrame, at: str = "valid_time", start: str = "window_start", end: str = "window_end") -> DataFrame:
    """Long-form values (variable, value, ``at``, ``start``, ``end``, lat, lon, cell_lat, cell_lon) with the rules of their variable's spec that they break.

    ``spec``: variable, low, high, whole, step_seconds, max_offset_deg; a handful of rows, one a variable.
    """
    j = steps.join(F.broadcast(spec), "variable", "left")
    t = F.unix_timestamp(at)
    value = F.col("value")
    return with_errors(
        j,
        {
            "variable": F.col("step_seconds").isNull(),
            "step": t % F.col("step_seconds") != 0,
            "window": (F.col(at) < F.col(start)) | (F.col(at) > F.col(end)),
            "cell": F.greatest(F.abs(F.col("lat") - F.col("cell_lat")), F.abs(F.col("lon") - F.col("cell_lon"))) > F.col("max_offset_deg"),
            "range": (value < F.col("low")) | (value > F.col("high")) | F.isnan("value"),
            "whole": F.col("whole") & (value != F.floor("value")),
        },
    ).drop("low", "high", "whole", "step_seconds", "max_offset_deg")


def forecast_errors(steps: DataFrame, run: list[str], at: str, issued: str, fetched: str) -> DataFrame:
    """Errors of each village forecast: 1 to 200 steps in order, an analysis of at most 7 days ago, steps from a day before to ten after."""
    day = F.expr("INTERVAL 1 DAY")
    g = steps.groupBy(*run).agg(
        F.count(at).alias("n"), F.countDistinct(at).alias("d"), F.min(F.col(at) - F.col(fetched)).alias("lo"), F.max(F.col(at) - F.col(fetched)).alias("hi"), F.max(F.col(fetched) - F.col(issued)).alias("age")
    )
    return with_errors(g, {"steps": ~F.col("n").between(1, 200), "order": F.col("d") < F.col("n"), "analysis": F.col("age") > 7 * day, "early": F.col("lo") < -1 * day, "late": F.col("hi") > 10 * day}).select(*run, "errors")


def observation_errors(readings: DataFrame, message: list[str], most: int = 64, max_age_days: int = 7) -> DataFrame:
    """Errors of each observation message: its readings (position, sensor_id, observed_at, issued_at, fetched_at) as they were sent."""
    w = Window.partitionBy(*message).orderBy("position")
    r = readings.withColumn("_back", F.col("sensor_id") <= F.lag("sensor_id").over(w))
    g = r.groupBy(*message).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.coalesce("_back", F.lit(False))).alias("_back"), F.max("observed_at").alias("_new"), F.max("issued_at").alias("_issued"),
        F.max(F.col("fetched_at") - F.col("observed_at")).alias("_age"),
    )
    return with_errors(g, {"readings": F.col("n") > most, "order": F.col("_back"), "age": F.col("_age") > F.expr(f"INTERVAL {max_age_days} DAYS"), "issued": ~F.col("_issued").eqNullSafe(F.col("_new"))}).select(*message, "errors")


def clean_readings(readings: DataFrame, payload: str, max_age_hours: int) -> DataFrame:
    """Readings (sensor_id, parameter, unit, value, observed_at, fetched_at) with their verdict: ok, repeated, invalid or stale, tested in this order."""
    w = Window.partitionBy(payload, "sensor_id")
    again = F.count(F.lit(1)).over(w) > 1
    bad = ~within_unit_limit(F.col("parameter"), F.col("unit"), F.col("value")) | F.isnan("value") | (F.col("observed_at") > F.col("fetched_at"))
    stale = F.col("observed_at") < F.col("fetched_at") - F.expr(f"INTERVAL {max_age_hours} HOURS")
    return readings.withColumn("verdict", F.when(again, "repeated").when(F.coalesce(bad, F.lit(True)), "invalid").when(stale, "stale").otherwise("ok"))


def catalogue_filter(df: DataFrame, at: str, start: Column, end: Column, box: tuple[float, float, float, float] = NATION) -> DataFrame:
    """Origins in the box from ``start`` to before ``end``, without those equal to the one before in (time, id) order."""
    kept = df.filter(in_box(F.col("lat"), F.col("lon"), box) & (F.col(at) >= start) & (F.col(at) < end))
    return drop_adjacent(kept, [at, "id"], [at, "lat", "lon", "mag"])


def accept(df: DataFrame, most: int | None, name: str = "errors") -> DataFrame:
    """The valid rows; an error if more than ``most`` were rejected."""
    good, bad = split(df, name)
    if most is not None and (n := bad.count()) > most:
        raise ValueError(f"{n} rows rejected, more than {most}")
    return good


#: The conditions on the columns of stored tables, by table; a null condition holds.
TABLE_RULES: dict[str, dict[str, str]] = {
    "event": {
        "kind": "kind NOT IN ('quake', 'weather', 'flood', 'fire')", "status": "status NOT IN ('active', 'expired', 'merged', 'retracted')", "level": "level NOT BETWEEN 1 AND 4",
        "revision": "revision < 1", "times": "expires_at <= occurred_at", "detected": "detected_at < occurred_at", "merged": "(status = 'merged') <> (merged_into IS NOT NULL)", "digest": "NOT digest RLIKE '^[0-9a-f]{64}$'",
    },
    "impact": {"distance": "distance_km < 0", "level": "level NOT BETWEEN 2 AND 4", "coverage": "coverage <= 0 OR coverage > 1", "measure": "(distance_km IS NULL) = (coverage IS NULL)"},
    "threshold": {"rising": "NOT (p80 < p90 AND p90 < p98 AND p98 < p99_5)", "positive": "p80 <= 0", "correction": "correction <= 0 OR correction > 1", "samples": "samples < 3650"},
    "fire": {"detections": "detections < 1", "peak": "peak > detections OR peak < 1", "times": "last_t < first_t", "power": "max_frp < 0"},
}


def table_violations(df: DataFrame, table: str) -> DataFrame:
    """Rows of a stored table with the conditions that they break."""
    return split(with_errors(df, {k: F.expr(c) for k, c in TABLE_RULES[table].items()}))[1]


def model_rules(low: dict[str, tuple[float, float]]) -> dict[str, Column]:
    """Ranges of a long-form model run's variables, and a value at least in each step."""
    rules = {v: F.col(v).isNotNull() & _outside(v, a, b) for v, (a, b) in low.items()}
    some = F.lit(False)
    for v in low:
        some = some | F.col(v).isNotNull()
    return rules | {"empty_step": ~some}


def run_errors(steps: DataFrame, run: list[str], at: str, issued: str, back_days: int = 10, ahead_days: int = 20, most: int = 400) -> DataFrame:
    """Errors of each run: too many steps, repeated steps, steps outside the horizon."""
    day = F.expr("INTERVAL 1 DAY")
    g = steps.groupBy(*run).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(at).alias("d"), F.min(F.col(at) - F.col(issued)).alias("lo"), F.max(F.col(at) - F.col(issued)).alias("hi"))
    return with_errors(g, {"steps": (F.col("n") < 1) | (F.col("n") > most), "order": F.col("d") < F.col("n"), "early": F.col("lo") < -back_days * day, "late": F.col("hi") > ahead_days * day}).select(*run, "errors")


def ensemble_disordered(low: str, p25: str, median: str, p75: str, high: str, mean: str) -> Column:
    """True if min <= p25 <= median <= p75 <= max or min <= mean <= max fails after rounding to 32 bits; nulls pass."""
    ok = F.lit(True)
    for a, b in ((low, p25), (p25, median), (median, p75), (p75, high), (low, p75), (p25, high), (low, high), (low, mean), (mean, high), (low, median), (median, high), (p25, p75)):
        ok = ok & F.coalesce(F.col(a).cast("float") <= F.col(b).cast("float"), F.lit(True))
    return ~ok


def drop_repeated_sensors(df: DataFrame, payload: str, sensor: str) -> DataFrame:
    """All rows of a sensor that a payload holds more than once go."""
    w = Window.partitionBy(payload, sensor)
    return df.withColumn("_n", F.count(F.lit(1)).over(w)).filter("_n = 1").drop("_n")


def within_unit_limit(parameter: Column, unit: Column, value: Column) -> Column:
    """False for unknown combinations too."""
    limits = F.create_map(*[F.lit(x) for (p, u), v in UNIT_LIMITS.items() for x in (f"{p}|{u}", v)])
    return F.coalesce((value >= 0) & (value <= limits[F.concat_ws("|", parameter, unit)]), F.lit(False))


def in_nation(lat: Column, lon: Column) -> Column:
    west, south, east, north = NATION
    return lat.between(south, north) & lon.between(west, east)


def drop_adjacent(df: DataFrame, order: list[str], same: list[str]) -> DataFrame:
    """In (time, id) order, rows equal to the one before go; ordered within blocks of equal first column."""
    w = Window.partitionBy(order[0]).orderBy(*order)
    keep = F.lit(False)
    for c in same:
        keep = keep | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    return df.withColumn("_k", keep | (F.row_number().over(w) == 1)).filter("_k").drop("_k")


def active_stations(stations: DataFrame, state: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """Stations that reported of late and since the last poll."""
    j = stations.join(state.select("site_id", F.col("last_seen").alias("_seen")), "site_id", "left")
    return j.filter((F.col("last_report") >= now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("_seen").isNull() | (F.col("last_report") > F.col("_seen")))).drop("_seen")


def site_kind(site_id: Column) -> Column:
    return F.when(site_id.rlike("^adm4:"), "village").when(site_id.rlike("^grid:"), "grid").when(site_id.rlike("^river:"), "river").when(site_id.rlike("^openaq:"), "station").when(site_id.rlike("^catchment:"), "catchment")


def in_focus(codes: DataFrame, prefixes: list[str], code: str = "code") -> DataFrame:
    """Each code once with its place: by the first prefix that fits, then by code."""
    return codes.select(code).distinct().withColumn("focus", focus_order(F.col(code), prefixes)).orderBy("focus", code)


def focus_order(code: Column, prefixes: list[str]) -> Column:
    """Rank by the first prefix that fits; the rest last."""
    out = F.lit(len(prefixes))
    for i, p in reversed(list(enumerate(prefixes))):
        out = F.when(code.startswith(p), i).otherwise(out)
    return out
