"""CSV, SQL dump and archive readers."""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithos.functions.geo import round_half_up
from lithos.functions.ids import detection_id
from lithos.functions.levels import confidence_class
from lithos.operators.quality import split, with_errors

HOTSPOTS = {
    "VIIRS": "latitude double, longitude double, bright_ti4 double, scan double, track double, acq_date string, acq_time string, satellite string, instrument string, confidence string, version string, bright_ti5 double, frp double, daynight string",
    "MODIS": "latitude double, longitude double, brightness double, scan double, track double, acq_date string, acq_time string, satellite string, instrument string, confidence int, version string, bright_t31 double, frp double, daynight string",
}


def hotspots(spark: SparkSession, path: str, product: str, fetched_at: Column, archive: bool = False) -> DataFrame:
    """Satellite detections; the set of columns follows from the product. Archives also have a type, -1 where empty."""
    family = product.split("_")[0]
    names = [x.split(" ")[0] for x in HOTSPOTS[family].split(", ")] + (["type"] if archive else [])
    kinds = dict(x.split(" ") for x in HOTSPOTS[family].split(", "))
    raw = spark.read.csv(path, header=True)  # by header name: archives and live files order columns differently
    raw = raw.select(*[F.col(n).try_cast(kinds.get(n, "int")).alias(n) for n in names])
    at = F.try_to_timestamp(F.concat_ws(" ", "acq_date", F.lpad("acq_time", 4, "0")), F.lit("yyyy-MM-dd HHmm"))
    lat, lon = round_half_up(F.col("latitude"), 5), round_half_up(F.col("longitude"), 5)
    if family == "MODIS":
        conf, pct, bright, back = confidence_class(F.col("confidence")), F.col("confidence").cast("short"), "brightness", "bright_t31"
    else:
        conf, pct, bright, back = F.when(F.col("confidence") == "h", "high").when(F.col("confidence") == "n", "nominal").when(F.col("confidence") == "l", "low"), F.lit(None).cast("short"), "bright_ti4", "bright_ti5"
    out = raw.select(
        at.alias("detected_at"), F.lit(product).alias("product"), "satellite", "instrument", lat.alias("lat"), lon.alias("lon"), conf.alias("confidence"), pct.alias("confidence_pct"), F.col(bright).cast("float").alias("brightness_k"), F.col(back).cast("float").alias("background_k"),
        F.col("frp").cast("float").alias("frp_mw"), F.col("scan").cast("float").alias("scan_km"), F.col("track").cast("float").alias("track_km"), (F.col("daynight") == "D").alias("daytime"), "version", fetched_at.alias("fetched_at"), *([F.coalesce("type", F.lit(-1)).alias("type")] if archive else []),
    )
    return out.withColumn("id", detection_id(F.col("product"), F.col("detected_at"), F.col("lat"), F.col("lon")))


def archive_chunks(spark: SparkSession, availability: list[tuple[str, str, str]], start: str, end: str, today: str, epoch: str = "2000-11-01", days: int = 5) -> DataFrame:
    """Chunks of a fixed grid of days, cut to the range: standard products first, near-real-time ones from the day after.

    ``availability``: (product, first day, last day), SP and NRT names sharing their stem. Final: standard, or older than a week.
    """
    rows = []
    last_sp = {p.rsplit("_", 1)[0]: b for p, _, b in availability if p.endswith("_SP")}
    for p, a, b in availability:
        stem = p.rsplit("_", 1)[0]
        if not p.endswith("_SP") and stem in last_sp:
            a = max(a, str(pd.Timestamp(last_sp[stem]) + pd.Timedelta(days=1))[:10])
        rows.append((p, max(a, start), min(b, end)))
    df = spark.createDataFrame(rows, "product string, a string, b string").select("product", F.to_date("a").alias("a"), F.to_date("b").alias("b")).filter("a <= b")
    k = lambda c: F.floor(F.datediff(c, F.lit(epoch).cast("date")) / days)
    df = df.withColumn("k", F.explode(F.sequence(k("a"), k("b"))))
    first = F.date_add(F.lit(epoch).cast("date"), (F.col("k") * days).cast("int"))
    out = df.select("product", F.greatest(first, "a").alias("from_day"), F.least(F.date_add(first, days - 1), "b").alias("to_day"))
    return out.withColumn("final", F.col("product").endswith("_SP") | (F.datediff(F.lit(today).cast("date"), F.col("to_day")) > 7))


def catalogue(spark: SparkSession, path: str, schema: str, sep: str = ",", optional: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, bad rows) of a historical catalogue; bad rows are skipped and kept apart, as texts, to be counted.

    Columns are found by their header; a row is bad if a column that isn't optional is empty or not of its type.
    """
    kinds = dict(x.strip().split(" ") for x in schema.split(","))
    raw = spark.read.csv(path, header=True, sep=sep)
    wrong = {c: F.col(f"_{c}").isNull() & (F.lit(c not in optional) | F.col(c).isNotNull()) for c in kinds}
    both = with_errors(raw.select(*kinds, *[F.trim(F.col(c)).try_cast(t).alias(f"_{c}") for c, t in kinds.items()]), wrong)
    good, bad = split(both)
    return good.select(*[F.col(f"_{c}").alias(c) for c in kinds]), bad.select(*kinds, "errors")


def calibration(spark: SparkSession, path: str, schema: str, n_rows: int | None = None) -> tuple[DataFrame, dict[str, str], str]:
    """(rows, comments as key: value, SHA-256) of a small lookup file with ``#`` comments; the header must be the schema's."""
    files = [r["value"] for r in spark.read.text(path, wholetext=True).limit(2).collect()]
    if len(files) > 1:
        raise ValueError(f"{path}: more than one file")
    body = files[0] if files else ""
    comments, header = {}, None
    for line in body.splitlines():
        if line.startswith("#"):
            k, _, v = line[1:].partition(":")
            comments[k.strip()] = v.strip()
        elif header is None:
            header = line.strip()
    names = ",".join(x.strip().split(" ")[0] for x in schema.split(","))
    if header != names:
        raise ValueError(f"{path}: the header is {header!r}, not {names!r}")
    df = spark.read.csv(path, header=True, comment="#", schema=schema)
    if n_rows is not None and df.count() != n_rows:
        raise ValueError(f"{path}: not {n_rows} rows")
    return df, comments, hashlib.sha256(body.encode()).hexdigest()


def catchments(df: DataFrame, tolerance: float = 0.002) -> DataFrame:
    """Catchments whose cell weights don't add up to 1."""
    return df.groupBy("subdas").agg(F.sum("bobot").alias("total")).filter(F.abs(F.col("total") - 1) > tolerance)


#: The columns of other lookup files.
LOOKUPS = {
    "catchments": "subdas string, lat double, lon double, bobot double",
    "grid": "id string, lat double, lon double",
    "rivers": "id string, name string, river string, lat double, lon double",
    "floods": "id string, day date, place string, stations string",
    "fires": "id string, day date, lat double, lon double, radius_km double",
    "static_sources": "id string, lat double, lon double, radius_km double, detections int, reason string",
}


def lookup(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(rows, wrong rows) of a lookup file: wrong are rows without an id, with one that repeats, or off the map."""
    df, _, _ = calibration(spark, path, LOOKUPS[kind])
    key = df.columns[0]
    many = F.lit(False) if kind == "catchments" else F.count(F.lit(1)).over(Window.partitionBy(key)) > 1
    rules = {"id": F.coalesce(F.trim(key) == "", F.lit(True)), "repeated": many}
    if "lat" in df.columns:
        rules["place"] = ~F.coalesce(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180), F.lit(False))
    if "radius_km" in df.columns:
        rules["radius"] = ~F.coalesce(F.col("radius_km") > 0, F.lit(False))
    return split(with_errors(df, rules))


def _tuples(text: str) -> Iterator[list[str | None]]:
    """Value lists of INSERT statements: a small lexer for quotes, escapes and comments."""
    i, n = 0, len(text)
    row: list[str | None] | None = None
    cell, quoted, seen_values = [], False, False
    while i < n:
        c = text[i]
        if quoted:
            if c == "\\" and i + 1 < n:
                cell.append(text[i + 1])
                i += 1
            elif c == "'" and text[i + 1 : i + 2] == "'":
                cell.append("'")
                i += 1
            elif c == "'":
                quoted = False
            else:
                cell.append(c)
        elif text.startswith("--", i) or text.startswith("#", i):
            i = text.find("\n", i)
            if i < 0:
                return
        elif text.startswith("/*", i):
            i = text.find("*/", i) + 1
            if i < 1:
                return
        elif c == "'":
            quoted, cell = True, ["\0"]
        elif row is None:
            if text[i : i + 6].upper() == "VALUES":
                seen_values = True
                i += 5
            elif c == "(" and seen_values:
                row, cell = [], []
            elif c == ";":
                seen_values = False
        elif c in ",)":
            v = "".join(cell)
            row.append(v[1:] if v.startswith("\0") else None if v.strip().upper() == "NULL" else v.strip())
            cell = []
            if c == ")":
                yield row
                row = None
        elif not (cell and cell[0] == "\0"):
            cell.append(c)
        i += 1


def sql_dump(spark: SparkSession, path: str, columns: list[str], line_end: str = "\n") -> tuple[DataFrame, DataFrame]:
    """(rows of a dump's INSERT statements as strings, the value lists that have more or fewer values than ``columns``).

    Files are read in pieces that end where a statement does (a semicolon at the end of a line), which a dump writes
    for each statement and escapes in texts, so a large dump is many tasks and a piece is all that one holds. ``line_end`` is
    that of the dump. Rejected lists have the file, the values and the reason.
    """
    raw = spark.read.option("lineSep", f";{line_end}").text(path).select("value", F.col("_metadata.file_path").alias("path"))
    names = [*columns, "_path", "_values"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, body in zip(b["path"], b["value"], strict=True):
                rows = [(*r, at, None) if len(r) == len(columns) else (*[None] * len(columns), at, r) for r in _tuples(body + ";\n")]
                for k in range(0, len(rows), 1000):
                    yield pd.DataFrame(rows[k : k + 1000], columns=names, dtype=object)

    out = raw.mapInPandas(run, ", ".join(f"{c} string" for c in columns) + ", _path string, _values array<string>")
    return out.filter("_values IS NULL").select(columns), out.filter("_values IS NOT NULL").select(F.col("_path").alias("path"), F.col("_values").alias("values"), F.array(F.lit("width")).alias("errors"))


KEY = r"^(.+)/(\d{4})/(\d{2})/(\d{2})/(\d{6})Z-([0-9a-f]{12})\.(\w+)\.gz$"


def archive_index(spark: SparkSession, path: str, start_after: str | None = None, before: str | None = None, content: bool = False) -> DataFrame:
    """Objects of the payload archive by their keys: connector, time, digest prefix; order of keys is order of time.

    ``start_after`` and ``before`` cut out a range of keys; only the days that it reaches into are listed. With ``content`` the
    bytes come along.
    """
    if start_after is None and before is None:
        f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    elif days := archive_days(spark, path, start_after, before):
        f = spark.read.format("binaryFile").load(days)
    else:
        f = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    return _archived(f, start_after, before, content)


def archive_days(spark: SparkSession, path: str, start_after: str | None, before: str | None) -> list[str]:
    """The folders of the days (connector/year/month/day) that keys in a range can be in: at most one for each connector and day of it."""
    found = [""]
    for _ in range(4):
        under = []
        for prefix in found:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{prefix}" if prefix else path)
            names = sorted(x.getPath().getName() for x in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder) if x.isDirectory())
            under += [f"{prefix}{name}/" for name in names]
        # a prefix comes before all keys that it starts, and they come before it with a last character that none has
        found = [p for p in under if (before is None or p < before) and (start_after is None or p + "\U0010ffff" > start_after)]
    return [f"{path}/{p}" for p in found]


def archive_stream(spark: SparkSession, path: str, start_after: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """The archive as a stream of objects with their content: those there are after a key, then new ones as they come.

    The checkpoint of a query knows the objects that it has read, so a replay goes on where it stopped.
    """
    f = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").option("maxFilesPerTrigger", files_per_batch)
    return _archived(f.load(path), start_after, None, True)


def _archived(f: DataFrame, start_after: str | None, before: str | None, content: bool) -> DataFrame:
    """The objects' keys and what they tell."""
    rel = F.regexp_extract("path", r"([^/]+/\d{4}/\d{2}/\d{2}/\d{6}Z-[0-9a-f]{12}\.\w+\.gz)$", 1)
    p = lambda i: F.regexp_extract(F.col("key"), KEY, i)
    f = f.withColumn("key", rel).filter("key != ''")
    if start_after is not None:
        f = f.filter(F.col("key") > start_after)
    if before is not None:
        f = f.filter(F.col("key") < before)
    return f.select("path", "key", "length", p(1).alias("connector"), F.to_timestamp(F.concat(p(2), p(3), p(4), p(5)), "yyyyMMddHHmmss").alias("fetched_at"), p(6).alias("sha_prefix"), *(["content"] if content else []))


def archive_payloads(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, body) of objects with content, unpacked, and those that are damaged or whose digest is not their name's."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bodies: list[bytes | None] = []
            for x in b["content"]:
                try:
                    bodies.append(gzip.decompress(x))
                except (OSError, EOFError, zlib.error):
                    bodies.append(None)
            yield pd.DataFrame({"key": b["key"], "sha_prefix": b["sha_prefix"], "body": pd.Series(bodies, dtype=object)})

    out = index.select("key", "sha_prefix", "content").mapInPandas(unpack, "key string, sha_prefix string, body binary")
    rules = {"damaged": F.col("body").isNull(), "digest": F.substring(F.sha2("body", 256), 1, 12) != F.col("sha_prefix")}
    good, bad = split(with_errors(out, rules))
    return good.select("key", F.col("body").cast("string").alias("body")), bad.select("key", "errors")


def merged_order(index: DataFrame) -> DataFrame:
    """Archives of several connectors in one order: time, connector, key."""
    return index.orderBy("fetched_at", "connector", "key")


def not_backed_up(hot: DataFrame, index: DataFrame) -> DataFrame:
    return hot.join(index.select("key"), "key", "left_anti")


def prunable(hot: DataFrame, index: DataFrame, keep_days: DataFrame, today: Column) -> DataFrame:
    """Objects past their connector's days (no row: kept for ever), only if they are backed up. ``keep_days`` has a row for each connector."""
    old = hot.join(F.broadcast(keep_days), "connector").filter(F.datediff(today, F.to_date("fetched_at")) > F.greatest("days", F.lit(8)))
    return old.join(index.select("key"), "key", "left_semi")


def newest_of_each(index: DataFrame) -> DataFrame:
    rest = [c for c in index.columns if c != "connector"]
    return index.groupBy("connector").agg(F.max_by(F.struct(*rest), "key").alias("_r")).select("connector", "_r.*")
