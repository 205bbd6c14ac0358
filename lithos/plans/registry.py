"""Queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The driver's events as detections: places are derived from the ids.
EVENTS_SQL = """h AS (SELECT event_id AS id, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS t, ts, user_id, event_type, value, props,
  -7.9 + (event_id * 7919 % 2200) / 1000.0 AS lat, 106.3 + (event_id * 104729 % 2600) / 1000.0 AS lon FROM events)"""


def query(sql: str | None = None):
    """Register a function under its name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def micros(ts: str) -> Column:
    """Microseconds since the epoch of a timestamp without zone, whatever the session's zone."""
    day = F.unix_date(F.to_date(ts)).cast("long") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return day * 1_000_000 + (F.expr(f"extract(SECOND FROM {ts})") * 1_000_000).cast("long")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    us = micros("ts")
    return e.select(
        F.col("event_id").alias("id"), us.alias("us"), F.floor(us / 1_000_000).cast("long").alias("t"), "ts", "user_id", "event_type", "value", "props",
        (F.lit(-7.9) + (F.col("event_id") * 7919 % 2200) / 1000.0).alias("lat"), (F.lit(106.3) + (F.col("event_id") * 104729 % 2600) / 1000.0).alias("lon"),
    )
