"""Parameters of the rules, with their default numbers."""

from __future__ import annotations

from dataclasses import dataclass

# Results depend on exactly these.
EARTH_KM, SNAP_EARTH_KM = 6371.0088, 6371.0
EPSILON = 1e-9


@dataclass(frozen=True)
class MatchRule:
    """Two records are the same quake within these; all ends included, distance and magnitude with EPSILON."""

    seconds: float
    km: float
    magnitude: float


CROSS_SOURCE = MatchRule(30, 100, 1.0)
REVISION = MatchRule(10, 50, 1.0)
LABEL_WINDOW = MatchRule(300, 300, 3.0)


@dataclass(frozen=True)
class QuakePolicy:
    rank: tuple[str, ...] = ("bmkg", "usgs")
    expires_hours: int = 6
    max_query_km: float = 1000.0
    max_impacts: int = 100


@dataclass(frozen=True)
class FirePolicy:
    km: float = 2.0
    gap_seconds: int = 86_400
    window_seconds: int = 86_400
    many_detections: int = 5
    many_passes: int = 2
    linger_seconds: int = 86_400
    excluded: tuple[str, ...] = ("VIIRS_SNPP",)


@dataclass(frozen=True)
class FloodPolicy:
    horizon_days: int = 3
    linger_seconds: int = 86_400
    bias_cutoff: float = 0.9
    rain_max_level: int = 3
    windows_hours: tuple[int, ...] = (3, 6, 24)
    quantiles: tuple[float, ...] = (0.5, 0.8, 0.9, 0.98, 0.995)
    min_samples: int = 3650
    min_rain_samples: int = 2555
    min_year_days: int = 330


@dataclass(frozen=True)
class StaticSourcePolicy:
    cell: float = 0.005
    days: int = 12
    years: int = 3
    months: int = 6
    night: float = 0.5
    season_months: tuple[int, ...] = (7, 8, 9, 10)
    season: float = 0.8
    night_only: float = 0.9
    typed: int = 3
    typed_share: float = 0.5
    margin_km: float = 0.5
    min_radius_km: float = 0.75


@dataclass(frozen=True)
class WarningPolicy:
    coverage: float = 0.1
    impact_level: int = 2
    max_days: int = 7
    max_polygons: int = 5000
    max_points: int = 200_000


#: The source that each quake feed belongs to.
FEEDS = {"auto": "bmkg", "latest": "bmkg", "felt": "bmkg", "geojson": "usgs"}

#: Province and national boxes as (west, south, east, north).
PROVINCE, NATION = (106.3, -7.9, 108.9, -5.7), (94.0, -12.0, 142.0, 7.0)

#: Upper limits of air quality values by parameter and unit.
UNIT_LIMITS = {
    ("pm25", "µg/m³"): 5000.0,
    ("pm10", "µg/m³"): 10000.0,
    ("no2", "µg/m³"): 5000.0,
    ("no2", "ppm"): 2.7,
    ("no2", "ppb"): 2700.0,
    ("o3", "µg/m³"): 5000.0,
    ("o3", "ppm"): 2.6,
    ("o3", "ppb"): 2600.0,
    ("so2", "µg/m³"): 10000.0,
    ("so2", "ppm"): 3.9,
    ("so2", "ppb"): 3900.0,
    ("co", "µg/m³"): 200000.0,
    ("co", "ppm"): 175.0,
    ("co", "ppb"): 175000.0,
}
