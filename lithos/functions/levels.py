"""Threshold levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITY_LEVELS = {"Moderate": 2, "Severe": 3, "Extreme": 4}


def threshold_level(value: Column, thresholds: list[Column]) -> Column:
    """The number of thresholds that the value reaches; null for a null value."""
    n = F.lit(0)
    for t in thresholds:
        n = n + F.when(value >= t, 1).otherwise(0)
    return F.when(value.isNotNull(), n)


def discharge_level(median: Column, single: Column, p75: Column, thresholds: list[Column], most: Column | int = 4) -> tuple[Column, Column]:
    """(level, possible): the median's level, or one more and only possible if the ensemble's upper quartile is higher."""
    top = F.lit(most) if isinstance(most, int) else most
    base = F.least(threshold_level(F.coalesce(median, single), thresholds), top)
    raised = median.isNotNull() & p75.isNotNull() & (threshold_level(p75, thresholds) > base) & (base < top)
    raised = F.coalesce(raised, F.lit(False))
    return F.when(raised, base + 1).otherwise(base), raised


def rain_level(by_window: list[Column], most: int = 3) -> tuple[Column, Column]:
    """(level, place of the window): the longest window with the highest level decides."""
    levels = [F.least(x, F.lit(most)) for x in by_window]
    best = F.greatest(*levels) if len(levels) > 1 else levels[0]
    which = F.lit(None).cast("int")
    for i, x in enumerate(levels):
        which = F.when(x == best, F.lit(i)).otherwise(which)
    return best, which


def severity_level(severity: Column) -> Column:
    out = F.lit(1)
    for name, level in SEVERITY_LEVELS.items():
        out = F.when(severity == name, level).otherwise(out)
    return out


def confidence_class(pct: Column) -> Column:
    """Percent to high, nominal or low."""
    return F.when(pct >= 80, "high").when(pct >= 30, "nominal").otherwise("low")
