"""Text clean-up and wording."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MONTHS = ("Jan", "Feb", "Mar", "Apr", "Mei", "Jun", "Jul", "Agu", "Sep", "Okt", "Nov", "Des")


def squash(c: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def squash_paragraphs(c: Column) -> Column:
    """As squash, line by line; blank lines between paragraphs stay as one."""
    lines = F.transform(F.split(c, "\n"), squash)
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


@F.pandas_udf(StringType())
def _clip(s: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else x.encode()[:k].decode("utf-8", "ignore") for x, k in zip(s, n, strict=True)])


def clip_bytes(c: Column, n: int = 100) -> Column:
    """At most n bytes, cut between characters; short texts never leave the JVM's expression."""
    return F.when(F.octet_length(c) <= n, c).otherwise(_clip(c, F.lit(n)))


# Fixed value: what places of quakes begin with.
PLACE_PREFIX = r"(?i)^Pusat gempa berada (di )?"


def strip_place(c: Column) -> Column:
    return F.regexp_replace(c, PLACE_PREFIX, "")


def decimal_comma(x: Column, digits: int = 1) -> Column:
    return F.replace(F.format_string(f"%.{digits}f", x), F.lit("."), F.lit(","))


def local_time_text(at: Column) -> Column:
    """Day, month and time at UTC+7."""
    t = at + F.expr("INTERVAL 7 HOURS")
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(t))
    return F.concat(F.dayofmonth(t).cast("string"), F.lit(" "), month, F.lit(" "), F.year(t).cast("string"), F.lit(" "), F.date_format(t, "HH.mm"), F.lit(" WIB"))


def local_range_text(start: Column, end: Column) -> Column:
    """From and to; the day is given once if both are on it."""
    a, b = start + F.expr("INTERVAL 7 HOURS"), end + F.expr("INTERVAL 7 HOURS")
    first = F.regexp_replace(local_time_text(start), " WIB$", "")
    return F.when(F.to_date(a) == F.to_date(b), F.concat(first, F.lit("–"), F.date_format(b, "HH.mm"), F.lit(" WIB"))).otherwise(F.concat(first, F.lit(" – "), local_time_text(end)))


#: Phrases that deny and that assert a tsunami, tested in this order.
TSUNAMI_NONE = ("tidak berpotensi tsunami", "tidak berpotensi menimbulkan tsunami")
TSUNAMI_POTENTIAL = ("berpotensi tsunami", "berpotensi menimbulkan tsunami", "peringatan dini tsunami")


def tsunami_status(c: Column) -> Column:
    """unknown, none or potential."""
    t = F.coalesce(F.lower(squash(c)), F.lit(""))

    def any_of(phrases: tuple[str, ...]) -> Column:
        return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(t, p))

    return F.when(any_of(TSUNAMI_NONE), "none").when(any_of(TSUNAMI_POTENTIAL), "potential").otherwise("unknown")


def trigrams(c: Column) -> Column:
    """Distinct three-letter pieces of a name, for search that forgives typing errors."""
    s = F.concat(F.lit("  "), F.lower(squash(c)), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))), lambda i: F.substr(s, i, F.lit(3))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all."""
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def whole_km(x: Column) -> Column:
    return F.concat(F.floor(x + 0.5).cast("string"), F.lit(" km"))


def date_text(day: Column) -> Column:
    """Day, month and year."""
    return F.concat_ws(" ", F.dayofmonth(day).cast("string"), F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(day)), F.year(day).cast("string"))


def sentences(*parts: Column) -> Column:
    """Parts that aren't null, a space between."""
    return F.concat_ws(" ", *parts)


# The wording of titles and summaries.
LEVEL_NAMES = ("", "Info", "Waspada", "Awas", "Bahaya")
SEVERITY_NAMES = {"Moderate": "Waspada", "Severe": "Awas", "Extreme": "Bahaya"}
SOURCE_NAMES = {"bmkg": "BMKG", "usgs": "USGS"}


def _of(mapping: dict[str, str], c: Column, other: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[c], other)


def level_name(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVEL_NAMES]), level.cast("int") + 1)


def quake_title(magnitude: Column, place: Column) -> Column:
    p = strip_place(squash(place))
    return F.concat(F.lit("Gempa M"), decimal_comma(magnitude), F.when(p != "", F.concat(F.lit(" — "), p)).otherwise(""))


def quake_summary(depth: Column, felt: Column, felt_km: Column, tsunami: Column, source: Column) -> Column:
    return sentences(
        F.concat(F.lit("Kedalaman "), whole_km(F.greatest(depth, F.lit(0.0))), F.lit(".")),
        F.when(felt != "", F.concat(F.lit("Dirasakan (skala MMI): "), F.trim(felt), F.lit("."))),
        F.when(felt_km > 0, F.concat(F.lit("Estimasi radius dirasakan "), whole_km(felt_km), F.lit("."))).otherwise("Estimasi: tidak dirasakan di permukaan."),
        F.when(tsunami == "potential", "BMKG: berpotensi tsunami.").when(tsunami == "none", "Tidak berpotensi tsunami."),
        F.concat(F.lit("Sumber: "), _of(SOURCE_NAMES, source, F.lit(None).cast("string")), F.lit(".")),
    )


def warning_title(headline: Column, event: Column) -> Column:
    h, e = F.trim(F.coalesce(headline, F.lit(""))), F.trim(F.coalesce(event, F.lit("")))
    return F.when(h != "", h).when(e != "", F.concat(F.lit("Peringatan dini cuaca: "), e)).otherwise("Peringatan dini cuaca")


def warning_summary(event: Column, severity: Column, cancelled: Column, sent: Column, start: Column, end: Column, n_messages: Column) -> Column:
    e = F.trim(F.coalesce(event, F.lit("")))
    return sentences(
        F.concat(F.when(e == "", "Peringatan dini cuaca").otherwise(e), F.lit(", tingkat "), _of(SEVERITY_NAMES, severity, F.lit("Info")), F.lit(" (CAP "), severity, F.lit(").")),
        F.when(cancelled, F.concat(F.lit("Dibatalkan BMKG pada "), local_time_text(sent), F.lit("."))).otherwise(F.concat(F.lit("Berlaku "), local_range_text(start, end), F.lit("."))),
        F.when(n_messages > 1, F.concat(F.lit("Diperbarui "), (n_messages - 1).cast("string"), F.lit(" kali."))),
        F.lit("Sumber: BMKG."),
    )


def flood_title(rain: Column, site: Column, river: Column) -> Column:
    return F.when(rain, F.concat(F.lit("Indikasi potensi banjir sub-DAS "), site)).otherwise(F.concat(F.lit("Potensi banjir "), river, F.lit(" di "), site))


def rain_summary(site: Column, mm: Column, hours: Column, day: Column, level: Column, threshold: Column) -> Column:
    return sentences(
        F.concat(F.lit("Hujan rata-rata wilayah sub-DAS "), site, F.lit(" diprakirakan "), decimal_comma(mm), F.lit(" mm dalam "), hours.cast("string"), F.lit(" jam pada "), date_text(day), F.lit(", tingkat "), level_name(level), F.lit(" (ambang "), decimal_comma(threshold), F.lit(" mm).")),
        F.lit("Indikasi potensi banjir dari hujan model ECMWF IFS, bukan pengukuran debit. Sumber: Open-Meteo."),
    )


def discharge_summary(site: Column, value: Column, day: Column, level: Column, threshold: Column, highest: Column, most: Column) -> Column:
    """Of a day whose level isn't merely possible."""
    return sentences(
        F.concat(F.lit("Debit model di titik pantau "), site, F.lit(" diprakirakan "), decimal_comma(value), F.lit(" m³/s pada "), date_text(day), F.lit(", tingkat "), level_name(level), F.lit(" (ambang "), decimal_comma(threshold), F.lit(" m³/s).")),
        F.when(highest.isNotNull(), F.concat(F.lit("Skenario terburuk ensemble "), decimal_comma(highest), F.lit(" m³/s."))),
        F.when(most < 4, F.concat(F.lit("Debit di titik ini diatur waduk; tingkat dibatasi "), level_name(most), F.lit("."))),
        F.lit("Debit model GloFAS, bukan pengukuran lapangan. Sumber: Open-Meteo."),
    )


def fire_title(detections: Column) -> Column:
    return F.when(detections == 1, "Titik api terdeteksi satelit").otherwise(F.concat(F.lit("Titik api: "), detections.cast("string"), F.lit(" deteksi satelit")))


def fire_summary(detections: Column, passes: Column, satellites: Column, first: Column, last: Column, level: Column, peak: Column, high: Column, peak_passes: Column, many: int = 5) -> Column:
    n = lambda c: c.cast("string")
    when = F.concat(local_time_text(first), F.when(last != first, F.concat(F.lit(" s.d. "), local_time_text(last))).otherwise(""))
    return sentences(
        F.concat(n(detections), F.lit(" deteksi dari "), n(passes), F.lit(" lintasan satelit ("), satellites, F.lit("), "), when, F.lit(".")),
        F.when(level == 3, F.concat(F.lit("Awas: "), n(peak), F.lit(f" deteksi dalam 24 jam (ambang {many}).")))
        .when((level == 2) & (high > 0), "Waspada: ada deteksi keyakinan tinggi.")
        .when(level == 2, F.concat(F.lit("Waspada: api terlihat di "), n(peak_passes), F.lit(" lintasan dalam 24 jam."))),
        F.lit("Deteksi satelit bisa juga pembakaran lahan, bukan laporan lapangan. Sumber: NASA FIRMS."),
    )
