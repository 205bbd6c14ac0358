"""JSON feeds: agency quakes, GeoJSON quakes, village forecasts, model columns, stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithos.functions.geo import in_box, round_half_up
from lithos.functions.ids import quake_source_id
from lithos.functions.text import tsunami_status
from lithos.operators.quality import quake_rules, split, with_errors
from lithos.policies import NATION

QUAKE_FIELDS = ("Tanggal", "Jam", "DateTime", "Coordinates", "Lintang", "Bujur", "Magnitude", "Kedalaman", "Wilayah", "Potensi", "Dirasakan", "Shakemap")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of whole files; gzip is read by name."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))


def number(c: Column) -> Column:
    """The first number in a text, with point or comma; null if there is none."""
    return F.regexp_extract(F.replace(F.coalesce(c, F.lit("")), F.lit(","), F.lit(".")), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def hemisphere(c: Column, negative: str) -> Column:
    """'8.51 LS' to -8.51: the sign is in the letters."""
    return F.when(F.upper(c).contains(negative), -number(c)).otherwise(number(c))


def _indonesian_time(date: Column, time: Column) -> Column:
    """'23 Sep 2026' and '19:16:56 WIB' to UTC."""
    d = date
    for own, english in (("Mei", "May"), ("Agu", "Aug"), ("Agt", "Aug"), ("Okt", "Oct"), ("Des", "Dec")):
        d = F.replace(d, F.lit(own), F.lit(english))
    local = F.try_to_timestamp(F.concat_ws(" ", d, F.regexp_extract(time, r"(\d{2}:\d{2}:\d{2})", 1)), F.lit("dd MMM yyyy HH:mm:ss"))
    hours = F.when(time.contains("WITA"), 8).when(time.contains("WIT"), 9).otherwise(7)
    return local - F.make_dt_interval(hours=hours)


def agency_quakes(raw: DataFrame, feed: str, fetched_at: Column) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) from bodies whose ``gempa`` is one object or a list of them."""
    one = "struct<" + ",".join(f"{c}:string" for c in QUAKE_FIELDS) + ">"
    many = F.from_json("body", f"struct<Infogempa:struct<gempa:array<{one}>>>")["Infogempa"]["gempa"]
    single = F.from_json("body", f"struct<Infogempa:struct<gempa:{one}>>")["Infogempa"]["gempa"]
    is_list = F.get_json_object("body", "$.Infogempa.gempa").startswith("[")
    g = raw.withColumn("g", F.explode(F.when(is_list, many).otherwise(F.array(single))))
    at = F.coalesce(F.try_to_timestamp("g.DateTime"), _indonesian_time(F.col("g.Tanggal"), F.col("g.Jam")))
    pair = F.split("g.Coordinates", ",")
    rows = g.select(
        "path", F.lit("bmkg").alias("source"), F.lit(feed).alias("feed"), quake_source_id(at).alias("event_id"), at.alias("occurred_at"),
        F.coalesce(F.try_element_at(pair, F.lit(1)).try_cast("double"), hemisphere(F.col("g.Lintang"), "LS")).alias("latitude"),
        F.coalesce(F.try_element_at(pair, F.lit(2)).try_cast("double"), hemisphere(F.col("g.Bujur"), "BB")).alias("longitude"),
        number(F.col("g.Magnitude")).alias("magnitude"), F.lit("").alias("magnitude_type"), number(F.col("g.Kedalaman")).alias("depth_km"), F.col("g.Wilayah").alias("place"), F.col("g.Dirasakan").alias("felt"),
        tsunami_status(F.col("g.Potensi")).alias("tsunami"), F.col("g.Potensi").alias("potential_text"), F.col("g.Shakemap").alias("shakemap"), F.array().cast("array<string>").alias("alternate_ids"),
        F.lit("").alias("source_url"), fetched_at.alias("fetched_at"),
    )
    w = Window.partitionBy("path", "event_id")
    rules = quake_rules(texts=("place", "felt", "potential_text")) | {"repeated": F.col("_n") > 1}
    return split(with_errors(rows.withColumn("_n", F.count(F.lit(1)).over(w)), rules).drop("_n"))


def geojson_quakes(raw: DataFrame, fetched_at: Column) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of a feature collection's earthquakes inside the national box."""
    feature = "struct<id:string,properties:struct<mag:double,place:string,time:bigint,updated:bigint,url:string,status:string,type:string,magType:string,ids:string>,geometry:struct<coordinates:array<double>>>"
    f = raw.withColumn("f", F.explode(F.from_json("body", f"struct<features:array<{feature}>>")["features"]))
    p, c = "f.properties", F.col("f.geometry.coordinates")
    others = F.array_remove(F.filter(F.split(F.coalesce(F.col(f"{p}.ids"), F.lit("")), ","), lambda x: x != ""), F.col("f.id"))
    rows = f.filter(F.col(f"{p}.type") == "earthquake").select(
        "path", F.lit("usgs").alias("source"), F.lit("geojson").alias("feed"), F.col("f.id").alias("event_id"), F.timestamp_millis(f"{p}.time").alias("occurred_at"),
        c[1].alias("latitude"), c[0].alias("longitude"), round_half_up(F.col(f"{p}.mag"), 2).alias("magnitude"), F.col(f"{p}.magType").alias("magnitude_type"), c[2].alias("depth_km"), F.col(f"{p}.place").alias("place"),
        F.lit("unknown").alias("tsunami"), F.timestamp_millis(f"{p}.updated").alias("source_updated_at"), F.col(f"{p}.status").alias("review_status"), others.alias("alternate_ids"), F.col(f"{p}.url").alias("source_url"), fetched_at.alias("fetched_at"),
    )
    return split(with_errors(rows.filter(in_box(F.col("latitude"), F.col("longitude"), NATION)), quake_rules(texts=("place", "magnitude_type", "review_status"))))


STEP = "struct<datetime:string,t:double,tcc:double,tp:double,weather:int,wd_deg:double,ws:double,hu:double,vs:double,analysis_date:string>"


def village_forecasts(raw: DataFrame, requested: Column) -> tuple[DataFrame, DataFrame]:
    """Steps of nested day lists; issued at the newest analysis; the region must be the one that was asked for."""
    j = F.from_json("body", f"struct<lokasi:struct<adm4:string,lat:double,lon:double>,data:array<struct<cuaca:array<array<{STEP}>>>>>")
    f = raw.withColumn("j", j).withColumn("requested", requested)
    steps = F.flatten(F.col("j.data")[0]["cuaca"])
    issued = F.array_max(F.transform(steps, lambda s: F.try_to_timestamp(s["analysis_date"])))
    rows = f.withColumn("issued_at", issued).withColumn("s", F.explode_outer(steps)).select(
        "path", "requested", F.col("j.lokasi.adm4").alias("code"), "issued_at", F.try_to_timestamp("s.datetime").alias("valid_time"), F.col("s.t").cast("float").alias("temperature_c"), F.col("s.hu").cast("float").alias("humidity_pct"),
        F.col("s.tp").cast("float").alias("precipitation_mm"), F.col("s.weather").cast("short").alias("weather_code"), F.col("s.tcc").cast("float").alias("cloud_cover_pct"), F.col("s.ws").cast("float").alias("wind_speed_kmh"),
        F.col("s.wd_deg").cast("float").alias("wind_from_deg"), F.col("s.vs").cast("float").alias("visibility_m"),
    )
    need = ("temperature_c", "humidity_pct", "precipitation_mm", "weather_code", "cloud_cover_pct", "wind_speed_kmh", "wind_from_deg")
    missing = F.lit(False)
    for c in need:
        missing = missing | F.col(c).isNull()
    return split(with_errors(rows, {"region": ~F.col("code").eqNullSafe(F.col("requested")), "time": F.col("valid_time").isNull() | F.col("issued_at").isNull(), "missing": missing}))


def model_columns(raw: DataFrame, variables: dict[str, str], sites: DataFrame, block: str = "hourly") -> tuple[DataFrame, DataFrame]:
    """Long rows of column arrays, one location or a list, matched to ``sites`` (pos, site_id) by place.

    ``variables`` gives each variable's unit, which must be the payload's; a location with
    arrays of unequal lengths is rejected; steps with no value at all drop out.
    """
    cols = ",".join(f"{v}:array<double>" for v in variables)
    units = ",".join(f"{v}:string" for v in variables)
    loc = f"struct<latitude:double,longitude:double,elevation:double,{block}:struct<time:array<bigint>,{cols}>,{block}_units:struct<{units}>>"
    body = F.when(F.trim("body").startswith("["), F.col("body")).otherwise(F.concat(F.lit("["), F.col("body"), F.lit("]")))
    l = raw.select("path", F.posexplode(F.from_json(body, f"array<{loc}>")).alias("pos", "l")).join(sites, "pos", "left")
    b = f"l.{block}"
    lengths, unit = F.lit(False), F.lit(False)
    for v, u in variables.items():
        lengths = lengths | ~F.size(f"{b}.{v}").eqNullSafe(F.size(f"{b}.time"))
        unit = unit | ~F.col(f"l.{block}_units.{v}").eqNullSafe(F.lit(u))
    good, bad = split(with_errors(l, {"site": F.col("site_id").isNull(), "length": lengths, "unit": unit}))
    z = F.arrays_zip(*[F.col(f"{b}.{v}").alias(v) for v in ("time", *variables)])
    rows = good.select("path", "site_id", F.explode(z).alias("z"))
    rows = rows.select("path", "site_id", F.timestamp_seconds("z.time").alias("valid_time"), *[F.when(~F.isnan(f"z.{v}"), F.col(f"z.{v}")).cast("float").alias(v) for v in variables])
    some = F.lit(False)
    for v in variables:
        some = some | F.col(v).isNotNull()
    return rows.filter(some), bad


def catchment_rain(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """Area-weighted rain of each catchment and hour; hours that lack a cell drop out. weights: basin, site_id, weight."""
    from lithos.operators.flood import weighted_mean

    n = weights.groupBy("basin").agg(F.count(F.lit(1)).alias("_need"))
    out = weighted_mean(cells.join(weights, "site_id"), ["basin", "valid_time"], "precipitation", "weight")
    return out.join(n, "basin").filter("cells = _need").drop("_need", "cells")


PARAMETERS = ("pm25", "pm10", "no2", "o3", "so2", "co")


def _unit(c: Column) -> Column:
    """Both micro signs to one."""
    return F.translate(c, "μ", "µ")


def stations(raw: DataFrame) -> DataFrame:
    """Sensors of fixed stations that measure a known parameter."""
    r = "struct<id:bigint,name:string,isMobile:boolean,coordinates:struct<latitude:double,longitude:double>,sensors:array<struct<id:bigint,parameter:struct<name:string,units:string>>>>"
    s = raw.withColumn("r", F.explode(F.from_json("body", f"struct<results:array<{r}>>")["results"])).filter(~F.coalesce("r.isMobile", F.lit(False)))
    s = s.withColumn("s", F.explode("r.sensors")).filter(F.col("s.parameter.name").isin(*PARAMETERS))
    return s.select("path", F.concat(F.lit("openaq:"), F.col("r.id").cast("string")).alias("site_id"), F.col("r.id").alias("location_id"), F.col("r.name").alias("name"), F.col("r.coordinates.latitude").alias("lat"), F.col("r.coordinates.longitude").alias("lon"), F.col("s.id").alias("sensor_id"), F.col("s.parameter.name").alias("parameter"), _unit(F.col("s.parameter.units")).alias("unit"))


def latest_values(raw: DataFrame, sensors: DataFrame, fetched_at: Column) -> DataFrame:
    """Latest values with their sensor's parameter and unit, by (sensor, location)."""
    r = "struct<datetime:struct<utc:string>,value:double,sensorsId:bigint,locationsId:bigint>"
    v = raw.withColumn("r", F.explode(F.from_json("body", f"struct<results:array<{r}>>")["results"]))
    v = v.select("path", F.col("r.sensorsId").alias("sensor_id"), F.col("r.locationsId").alias("location_id"), F.try_to_timestamp("r.datetime.utc").alias("observed_at"), F.col("r.value").cast("float").alias("value"), fetched_at.alias("fetched_at"))
    return v.join(sensors.select("sensor_id", "location_id", "site_id", "parameter", "unit"), ["sensor_id", "location_id"])


def measurements(raw: DataFrame, sensor_id: Column, unit: Column, since: Column, until: Column) -> tuple[DataFrame, DataFrame]:
    """(values, rejected pages) of backfilled values, timed at the end of their period.

    A page (path) with a value that can't be read or whose unit is not the sensor's fails as a whole;
    values outside (since, until] are left out.
    """
    r = "struct<value:double,parameter:struct<name:string,units:string>,period:struct<datetimeTo:struct<utc:string>>>"
    v = raw.withColumn("r", F.explode(F.from_json("body", f"struct<results:array<{r}>>")["results"]))
    v = v.select("path", sensor_id.alias("sensor_id"), F.col("r.parameter.name").alias("parameter"), _unit(F.col("r.parameter.units")).alias("unit"), F.try_to_timestamp("r.period.datetimeTo.utc").alias("observed_at"), F.col("r.value").cast("float").alias("value"))
    wrong = {"value": F.col("value").isNull(), "time": F.col("observed_at").isNull(), "parameter": ~F.coalesce(F.col("parameter").isin(*PARAMETERS), F.lit(False)), "unit": ~F.col("unit").eqNullSafe(unit)}
    v = with_errors(v, wrong)
    pages = v.groupBy("path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("errors")))).alias("errors"))
    bad = pages.filter(F.size("errors") > 0)
    kept = v.join(bad.select("path"), "path", "left_anti").drop("errors")
    return kept.filter((F.col("observed_at") > since) & (F.col("observed_at") <= until)), bad
