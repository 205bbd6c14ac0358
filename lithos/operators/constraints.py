"""What stored tables promise, as data: required columns, conditions, keys and references, checked over whole tables.

A table's columns and conditions are counted in one scan; a key costs one aggregation and a reference one anti join. A condition that is null holds, as
in a database; a key whose columns are null isn't compared, and neither is a reference.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Table:
    """The first key is the primary one, whose columns are required too."""

    keys: tuple[tuple[str, ...], ...]
    required: tuple[str, ...]
    holds: dict[str, str]
    #: (columns, table, its columns)
    refers: tuple[tuple[tuple[str, ...], str, tuple[str, ...]], ...] = ()

    @property
    def never_null(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.keys[0], *self.required)))


# Forms, names and limits of the stored tables.
_NAME, _DIGEST, _MODEL = "^[!-~]{1,128}$", "^[0-9a-f]{64}$", "^[a-z0-9_]{1,40}$"
_VILLAGE = r"^[0-9]{2}\\.[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}$"
_TSUNAMI, _SEVERITY, _MESSAGES = "('unknown', 'none', 'potential')", "('minor', 'moderate', 'severe', 'extreme', 'unknown')", "('alert', 'update', 'cancel')"


def _web(*columns: str) -> dict[str, str]:
    return {c: f"{c} = '' OR {c} LIKE 'https://%'" for c in columns}


def _ranges(**limits: tuple[float, float]) -> dict[str, str]:
    return {c: f"{c} BETWEEN {a} AND {b}" for c, (a, b) in limits.items()}


def _inland(lat: str = "lat", lon: str = "lon") -> str:
    return f"{lon} BETWEEN 94 AND 142 AND {lat} BETWEEN -12 AND 7"


_SITE = (("site_id",), "site", ("id",))
_EVENT = (("event_id", "kind"), "event", ("id", "kind"))
_RUN = ("site_id", "model", "issued_at")

CATALOGUE: dict[str, Table] = {
    "region": Table(
        (("code",),), ("kind", "name", "source", "source_version"),
        {"code": r"code RLIKE '^[0-9]{2}(\\.[0-9]{2}(\\.[0-9]{2}(\\.[0-9]{4})?)?)?$'", "name": "name <> '' AND name = trim(name)"},
        ((("parent_code",), "region", ("code",)),),
    ),
    "event": Table(
        (("id",),), ("kind", "status", "level", "primary_source", "source_event_id", "occurred_at", "detected_at", "expires_at", "title", "summary", "revision", "content_sha256"),
        {
            "kind": "kind IN ('quake', 'weather', 'flood', 'fire', 'aq')", "status": "status IN ('active', 'expired', 'merged', 'retracted')",
            "source": "primary_source IN ('bmkg', 'usgs', 'openmeteo', 'openaq', 'firms', 'drill')", "source_event_id": f"source_event_id RLIKE '{_NAME}'", "title": "title <> ''", "revision": "revision >= 1",
            "digest": f"content_sha256 RLIKE '{_DIGEST}'", "merged": "(status = 'merged') = (merged_into IS NOT NULL)", "not_into_itself": "merged_into <> id", "ended": "(status = 'active') = (ended_at IS NULL)",
            "expires": "expires_at > occurred_at", "detected": "kind <> 'quake' OR detected_at >= occurred_at - INTERVAL 1 HOUR",
        } | _ranges(level=(1, 4)),
        ((("merged_into",), "event", ("id",)),),
    ),
    "quake": Table(
        (("event_id",),), ("kind", "magnitude", "depth_km", "felt_radius_km", "tsunami"),
        {"kind": "kind = 'quake'", "felt_radius": "felt_radius_km >= 0", "tsunami": f"tsunami IN {_TSUNAMI}"} | _ranges(magnitude=(-2, 10), depth_km=(-10, 800)) | _web("shakemap_url", "source_url"),
        (_EVENT,),
    ),
    "event_source": Table(
        (("source", "source_event_id", "feed"),), ("kind", "occurred_at", "magnitude", "depth_km", "tsunami", "fetched_at", "first_seen_at", "content_sha256"),
        {
            "source_event_id": f"source_event_id RLIKE '{_NAME}'", "kind": "kind = 'quake'", "tsunami": f"tsunami IN {_TSUNAMI}", "alternates": "size(alternate_ids) <= 32", "digest": f"content_sha256 RLIKE '{_DIGEST}'",
            "feed": "feed IN ('bmkg-latest', 'bmkg-recent', 'bmkg-felt', 'usgs-summary')", "feed_of_source": "split_part(feed, '-', 1) = source", "first_seen": "first_seen_at <= fetched_at",
            "not_future": "occurred_at <= fetched_at + INTERVAL 10 MINUTES", "deleted": "review_status <> 'deleted' OR event_id IS NULL",
        } | _ranges(magnitude=(-2, 10), depth_km=(-10, 800)) | _web("shakemap_url", "source_url"),
        (_EVENT,),
    ),
    "impact_region": Table(
        (("event_id", "region_code"),), ("level", "within_felt"),
        {"region_code": f"region_code RLIKE '{_VILLAGE}'", "distance": "distance_km >= 0", "coverage": "coverage > 0 AND coverage <= 1"} | _ranges(level=(2, 4)),
        ((("event_id",), "event", ("id",)), (("region_code",), "region", ("code",))),
    ),
    "outbox": Table(
        (("id",), ("msg_id",)), ("subject", "msg_id", "payload"),
        {"subject": r"subject RLIKE '^hazard\\.[a-z]+\\.(created|updated|expired)$'", "trace": "traceparent RLIKE '^00-[0-9a-f]{32}-[0-9a-f]{16}-0[0-3]$' AND substr(traceparent, 4, 32) <> repeat('0', 32) AND substr(traceparent, 37, 16) <> repeat('0', 16)"},
    ),
    "cap_message": Table(
        (("source", "identifier"),), ("kind", "sender", "sent", "msg_type", "severity", "effective", "expires", "polygon_count", "fetched_at", "first_seen_at", "content_sha256"),
        {
            "source": "source = 'bmkg'", "identifier": f"identifier RLIKE '{_NAME}'", "kind": "kind = 'weather'", "sender": "sender <> ''", "msg_type": f"msg_type IN {_MESSAGES}", "severity": f"severity IN {_SEVERITY}",
            "digest": f"content_sha256 RLIKE '{_DIGEST}'", "expires": "expires > effective", "valid_for": "expires <= effective + INTERVAL 7 DAYS", "onset": "onset < expires", "first_seen": "first_seen_at <= fetched_at",
            "not_future": "sent <= fetched_at + INTERVAL 10 MINUTES", "area": "msg_type = 'cancel' OR polygon_count > 0", "texts": "exists(texts, t -> t.language = 'id')",
        } | _ranges(polygon_count=(0, 5000)) | _web("web", "source_url"),
        (_EVENT,),
    ),
    "cap_reference": Table(
        (("source", "identifier", "ref_identifier"),), ("ref_sender", "ref_sent"),
        {"ref_identifier": f"ref_identifier RLIKE '{_NAME}'", "not_itself": "ref_identifier <> identifier"},
        ((("source", "identifier"), "cap_message", ("source", "identifier")),),
    ),
    "weather": Table(
        (("event_id",),), ("kind", "cap_identifier", "cap_msg_type", "severity", "sent_at", "effective_at", "area_km2", "message_count"),
        {"kind": "kind = 'weather'", "cap_identifier": f"cap_identifier RLIKE '{_NAME}'", "msg_type": f"cap_msg_type IN {_MESSAGES}", "severity": f"severity IN {_SEVERITY}", "area": "area_km2 > 0", "messages": "message_count >= 1"} | _web("web_url", "source_url"),
        (_EVENT,),
    ),
    "site": Table(
        (("id",),), ("kind", "lat", "lon", "first_seen_at"),
        {
            "id": r"id RLIKE '^(adm4:[0-9]{2}\\.[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}|grid:-?[0-9]{1,2}\\.[0-9]{2}:-?[0-9]{1,3}\\.[0-9]{2}|(river|catchment):[a-z0-9]+(-[a-z0-9]+)*|openaq:[1-9][0-9]{0,11})$'",
            "kind": "kind IN ('region', 'grid', 'river', 'station', 'catchment')", "kind_of_id": "split_part(id, ':', 1) = CASE kind WHEN 'region' THEN 'adm4' WHEN 'station' THEN 'openaq' ELSE kind END",
            "name": "name = trim(name) AND length(name) <= 100", "river": "river = trim(river) AND length(river) <= 100", "place": _inland(), "region_code": f"region_code RLIKE '{_VILLAGE}'",
            "region_of_id": "kind <> 'region' OR region_code = substr(id, 6)", "named": "(kind = 'river') = (river <> '') AND (kind NOT IN ('river', 'catchment') OR name <> '')",
        },
    ),
    "series": Table(
        (("site_id", "dataset", "model"),), ("source", "last_issued_at", "last_fetched_at"),
        {
            "model": f"model RLIKE '{_MODEL}'", "place": _inland("cell_lat", "cell_lon"), "issued": "last_issued_at <= last_fetched_at + INTERVAL 1 HOUR",
            "source": "(source = 'bmkg' AND dataset = 'weather' AND model = 'bmkg') OR (source = 'openmeteo' AND dataset IN ('weather', 'air_quality', 'discharge')) OR (source = 'openaq' AND dataset = 'aq_observation' AND model = 'sensor')",
        } | _ranges(elevation_m=(-500, 6000)),
        (_SITE,),
    ),
    "weather_forecast": Table(
        ((*_RUN, "valid_time"),), (),
        {"model": f"model RLIKE '{_MODEL}'", "horizon": "valid_time BETWEEN issued_at - INTERVAL 10 DAYS AND issued_at + INTERVAL 20 DAYS"}
        | _ranges(
            temperature_c=(-30, 50), humidity_pct=(0, 100), precipitation_mm=(0, 500), weather_code=(0, 999), cloud_cover_pct=(0, 100), wind_speed_kmh=(0, 400), wind_from_deg=(0, 360), wind_gust_kmh=(0, 500),
            pressure_hpa=(500, 1100), boundary_layer_m=(0, 10_000), visibility_m=(0, 1_000_000),
        ),
        (_SITE,),
    ),
    "aq_forecast": Table(
        ((*_RUN, "valid_time"),), (),
        {"model": f"model RLIKE '{_MODEL}'", "horizon": "valid_time BETWEEN issued_at - INTERVAL 10 DAYS AND issued_at + INTERVAL 20 DAYS"}
        | _ranges(pm2_5_ugm3=(0, 5000), pm10_ugm3=(0, 10_000), co_ugm3=(0, 200_000), no2_ugm3=(0, 5000), so2_ugm3=(0, 10_000), o3_ugm3=(0, 5000), aerosol_optical_depth=(0, 20), dust_ugm3=(0, 50_000)),
        (_SITE,),
    ),
    "river_discharge": Table(
        ((*_RUN, "valid_date"),), (),
        {
            "model": f"model RLIKE '{_MODEL}'", "midnight": "unix_timestamp(valid_date) % 86400 = 0", "horizon": "valid_date BETWEEN issued_at - INTERVAL 31 DAYS AND issued_at + INTERVAL 31 DAYS",
            "order": " AND ".join(f"coalesce(ensemble_{a}_m3s <= ensemble_{b}_m3s, true)" for a, b in (("min", "max"), ("min", "p25"), ("p25", "median"), ("median", "p75"), ("p75", "max"), ("min", "mean"), ("mean", "max"))),
        } | _ranges(discharge_m3s=(0, 200_000), **{f"ensemble_{x}_m3s": (0, 200_000) for x in ("mean", "median", "max", "min", "p25", "p75")}),
        (_SITE,),
    ),
    "station": Table(
        (("site_id",),), ("source", "provider", "is_monitor"),
        {
            "site": "site_id LIKE 'openaq:%'", "source": "source = 'openaq'", "provider": "provider = trim(provider) AND length(provider) BETWEEN 1 AND 100", "owner": "owner = trim(owner) AND length(owner) <= 100",
            "locality": "locality = trim(locality) AND length(locality) <= 100", "timezone": "timezone RLIKE '^([A-Za-z]+(/[A-Za-z0-9_+-]+){0,2})?$' AND length(timezone) <= 64",
        },
        (_SITE,),
    ),
    "aq_observation": Table(
        (("sensor_id", "observed_at"),), ("site_id", "parameter", "unit", "value", "fetched_at"),
        {
            "sensor": "sensor_id > 0", "parameter": "parameter IN ('pm25', 'pm10', 'no2', 'o3', 'so2', 'co')", "unit": "unit IN ('µg/m³', 'ppm', 'ppb')", "site": "site_id LIKE 'openaq:%'", "fetched": "observed_at <= fetched_at + INTERVAL 1 HOUR", "value": "value >= 0",
        },
        (_SITE,),
    ),
    "hotspot": Table(
        (("id", "detected_at"),), ("product", "satellite", "instrument", "lat", "lon", "confidence", "brightness_k", "scan_km", "track_km", "daytime", "version", "first_fetched_at"),
        {
            "minute": "unix_timestamp(detected_at) % 60 = 0", "product": "product IN ('VIIRS_SNPP_NRT', 'VIIRS_NOAA20_NRT', 'VIIRS_NOAA21_NRT', 'MODIS_NRT')", "satellite": "satellite RLIKE '^[A-Za-z0-9]{1,10}$'", "place": _inland(),
            "instrument": "instrument = CASE WHEN product LIKE 'VIIRS%' THEN 'VIIRS' ELSE 'MODIS' END", "confidence": "confidence IN ('low', 'nominal', 'high')", "percent_of_modis": "(instrument = 'MODIS') = (confidence_pct IS NOT NULL)",
            "confidence_of_percent": "confidence_pct IS NULL OR confidence = CASE WHEN confidence_pct >= 80 THEN 'high' WHEN confidence_pct >= 30 THEN 'nominal' ELSE 'low' END", "version": "version RLIKE '^[A-Za-z0-9._-]{1,16}$'",
            "region_code": f"region_code RLIKE '{_VILLAGE}'", "fetched": "detected_at <= first_fetched_at + INTERVAL 1 HOUR",
            "id": "id = concat_ws(':', product, date_format(detected_at, \"yyyyMMdd'T'HHmm\"), format_string('%.5f', lat), format_string('%.5f', lon))",
        } | _ranges(confidence_pct=(0, 100), brightness_k=(200, 700), background_k=(150, 450), frp_mw=(0, 50_000), scan_km=(0.1, 10), track_km=(0.1, 10)),
    ),
}


def _scan(name: str, df: DataFrame, table: Table) -> DataFrame:
    """(rule, violations) of the required columns and the conditions, in one scan."""
    counts = {f"null:{c}": F.count_if(F.col(c).isNull()) for c in table.never_null}
    counts |= {f"check:{k}": F.count_if(~F.coalesce(F.expr(c), F.lit(True))) for k, c in table.holds.items()}
    row = df.agg(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("violations")) for k, v in counts.items()]).alias("_r"))
    return row.select(F.lit(name).alias("table"), F.explode("_r").alias("r")).select("table", "r.*")


def _key(name: str, df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows too many of a key."""
    n = df.select(*columns).dropna().groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    return n.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("violations")).select(F.lit(name).alias("table"), F.lit("key:" + ",".join(columns)).alias("rule"), "violations")


def _reference(name: str, df: DataFrame, columns: tuple[str, ...], to: str, other: DataFrame, there: tuple[str, ...]) -> DataFrame:
    """Rows that refer to nothing."""
    a = df.select(*[F.col(c).alias(f"_a{i}") for i, c in enumerate(columns)]).dropna()
    b = other.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(there)])
    on = reduce(lambda x, y: x & y, [F.col(f"_a{i}") == F.col(f"_b{i}") for i in range(len(columns))])
    lost = a.join(b, on, "left_anti").agg(F.count(F.lit(1)).alias("violations"))
    return lost.select(F.lit(name).alias("table"), F.lit(f"reference:{','.join(columns)}>{to}").alias("rule"), "violations")


def check(tables: dict[str, DataFrame], catalogue: dict[str, Table] = CATALOGUE) -> DataFrame:
    """(table, rule, violations) of every promise of the tables given; references to tables that aren't given are left out."""
    out = []
    for name, df in tables.items():
        table = catalogue[name]
        out.append(_scan(name, df, table))
        out += [_key(name, df, k) for k in table.keys]
        out += [_reference(name, df, columns, to, tables[to], there) for columns, to, there in table.refers if to in tables]
    return reduce(DataFrame.unionByName, out)


def broken(df: DataFrame, table: Table) -> DataFrame:
    """The rows that break a condition or lack a required column, with the names of these."""
    rules = {f"null:{c}": F.col(c).isNull() for c in table.never_null} | {f"check:{k}": ~F.coalesce(F.expr(c), F.lit(True)) for k, c in table.holds.items()}
    names = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]))
    return df.withColumn("errors", names).filter(F.size("errors") > 0)
