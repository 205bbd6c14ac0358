"""Time series with an issue time and a valid time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.operators import slices
from lithos.operators.latest import newest


def issued_at(source: Column, analysis: Column, fetched: Column, observed: Column) -> Column:
    """Agency forecasts are issued at their analysis, model runs when fetched, observations at their newest value."""
    return F.when(source == "bmkg", analysis).when(source == "openaq", observed).otherwise(fetched)


def long_form(wide: DataFrame, keys: list[str], times: str, values: dict[str, str]) -> DataFrame:
    """Column arrays to a row for each step; steps with no value drop out."""
    z = F.arrays_zip(F.col(times).alias("valid_time"), *[F.col(a).alias(v) for v, a in values.items()])
    rows = wide.select(*keys, F.explode(z).alias("z")).select(*keys, "z.*")
    return rows.filter(F.coalesce(*[F.col(v).cast("double") for v in values]).isNotNull())


def observation_current(observations: DataFrame, sites: DataFrame, stations: DataFrame) -> DataFrame:
    """The newest value of each sensor with its site and station."""
    now = newest(observations, ["site_id", "sensor_id"], ["observed_at", "fetched_at"])
    return now.join(sites, "site_id").join(stations, "site_id")


def freshness(stored: DataFrame, runs: DataFrame) -> DataFrame:
    """Series with their last issue and fetch: a late, older run never sets them back."""
    both = stored.select("site_id", "dataset", "model", "last_issued_at", "last_fetched_at").unionByName(runs.select("site_id", "dataset", "model", F.col("issued_at").alias("last_issued_at"), F.col("fetched_at").alias("last_fetched_at")))
    return both.groupBy("site_id", "dataset", "model").agg(F.max("last_issued_at").alias("last_issued_at"), F.max("last_fetched_at").alias("last_fetched_at"))


def site_upsert(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Sites by their last fetch; a fetch that is older never overwrites the cell or the elevation."""
    return newest(stored.unionByName(seen), ["site_id"], ["last_fetched_at"])


def recent(df: DataFrame, at: str, now: Column, hours: int) -> DataFrame:
    return df.filter((F.col(at) > now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col(at) <= now))


def expired_by_ttl(df: DataFrame, at: str, now: Column, days: int = 365) -> DataFrame:
    """What a retention policy drops; on a table partitioned by day this prunes to whole partitions."""
    return df.filter(F.to_date(at) < F.date_sub(F.to_date(now), days))


def backfill_window(sensors: DataFrame, now: Column, most_days: int = 7) -> DataFrame:
    """From each sensor's last value (at most ``most_days`` back) to now."""
    start = F.greatest(F.coalesce("last_observed_at", now - F.expr(f"INTERVAL {most_days} DAYS")), now - F.expr(f"INTERVAL {most_days} DAYS"))
    return sensors.withColumn("from_time", start).withColumn("to_time", now).filter(F.col("from_time") < F.col("to_time"))


def only_products(events: DataFrame, allowed: list[str], products: str = "products") -> DataFrame:
    """Events all of whose products are among the allowed ones."""
    return events.filter(F.size(F.array_except(products, F.array(*[F.lit(p) for p in allowed]))) == 0)


def largest(events: DataFrame, n: int) -> DataFrame:
    """The largest events by peak, detections, then start; the number is the feature."""
    return events.orderBy(F.desc("peak"), F.desc("detections"), "first_t").limit(n)


def poll_outcomes(results: DataFrame) -> DataFrame:
    """How a sweep over region codes went: codes by outcome."""
    return results.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def changed_payloads(payloads: DataFrame) -> DataFrame:
    """Payloads whose digest differs from the connector's payload before; a connector's archive is many tasks."""
    own = F.struct("digest")
    before = slices.carried(payloads, "connector", ["fetched_at", "key"], own, "_before", before=True)
    return before.filter(~F.col("_before.digest").eqNullSafe(F.col("digest"))).drop("_before")


def changed_records(records: DataFrame, partial: bool) -> DataFrame:
    """Records (connector, poll, key, digest) that are new or changed, as polls of a connector follow on one another.

    A whole feed forgets a key that a poll lacks, so the key is new when it comes back: each record is held against the
    poll just before. A partial feed remembers every key: each record is held against the key's last one.
    """
    if partial:
        w = Window.partitionBy("connector", "key").orderBy("poll")
        old = F.lag("digest").over(w)
        return records.withColumn("_d", old).filter(~F.col("_d").eqNullSafe(F.col("digest"))).drop("_d")
    polls = records.select("connector", "poll").distinct()
    polls = polls.withColumn("_before", F.lag("poll").over(Window.partitionBy("connector").orderBy("poll")))
    old = records.select("connector", F.col("poll").alias("_before"), "key", F.col("digest").alias("_d"))
    return records.join(polls, ["connector", "poll"]).join(old, ["connector", "_before", "key"], "left").filter(~F.col("_d").eqNullSafe(F.col("digest"))).select(*records.columns)
