"""Published events, reports and idempotent tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions.ids import outbox_message_id


def published(events: DataFrame, impacts: DataFrame, most: int = 100) -> DataFrame:
    """Event messages with at most ``most`` impacts, their full number, and a message id of event and revision."""
    w = Window.partitionBy("event").orderBy("km", "code")
    near = impacts.withColumn("_n", F.row_number().over(w))
    g = near.groupBy("event").agg(F.count(F.lit(1)).alias("n_impacts"), F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.struct("_n", "code", "km", "level")))).alias("impacts"))
    out = events.join(g, "event", "left").withColumn("n_impacts", F.coalesce("n_impacts", F.lit(0)))
    return out.withColumn("msg_id", outbox_message_id(F.col("event"), F.col("revision"))).withColumn("payload", F.to_json(F.struct(*[c for c in out.columns])))


def fire_message(events: DataFrame) -> DataFrame:
    """A fire event as published: occurred at the first detection, detected at the first fetch, named by its opening detection."""
    return events.select("event", F.lit("fire").alias("kind"), F.col("first_t").alias("occurred"), F.col("fetched_first").alias("detected"), F.col("event").alias("source_id"), F.struct("lat", "lon", "products", "max_frp", "detections").alias("detail"))


def flood_message(episodes: DataFrame, days: DataFrame) -> DataFrame:
    """A flood event as published: occurred and detected when opened, days nested in order."""
    d = days.groupBy("site", "episode").agg(F.array_sort(F.collect_list(F.struct("date", "level", "possible"))).alias("days"))
    return episodes.join(d, ["site", "episode"], "left").select(F.lit("flood").alias("kind"), F.col("opened").alias("occurred"), F.col("opened").alias("detected"), F.col("site").alias("source_id"), F.struct("level", "days").alias("detail"))


def warning_message(chains: DataFrame, contents: DataFrame) -> DataFrame:
    """A warning event as published: named by its root, detailed by its current message, worded by the newest with an area."""
    c = contents.select(F.col("identifier").alias("content"), "texts", "area_desc")
    return chains.join(c, "content", "left").select(F.lit("weather").alias("kind"), F.col("occurred_at").alias("occurred"), F.col("detected_at").alias("detected"), F.col("root").alias("source_id"), F.struct("current", "texts", "area_desc").alias("detail"))


def drain(outbox: DataFrame, limit: int) -> DataFrame:
    """The next messages in order of their id; the batch size is the feature."""
    return outbox.orderBy("id").limit(limit)


def write_published(outbox: DataFrame, path: str, batch: int) -> None:
    """A batch of messages in a folder of its own, by kind, in order of (event, revision): writing it again replaces it."""
    outbox.repartition("kind").sortWithinPartitions("event", "revision").write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={batch}")


def write_series(df: DataFrame, path: str, day: str, keys: list[str]) -> None:
    """A time series partitioned by day and sorted by key in each file, for pruning by date and by statistics."""
    spark = df.sparkSession
    out = df.withColumn("day", F.to_date(day)).repartition("day").sortWithinPartitions(*keys, day)
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        out.write.mode("overwrite").partitionBy("day").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def geojson_lines(df: DataFrame, lat: str, lon: str, properties: list[str]) -> DataFrame:
    """A point feature a row."""
    f = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"))
    return df.select(F.to_json(f).alias("value"))


def markdown_rows(df: DataFrame) -> DataFrame:
    """A table row of each row, for reports."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


#: Seconds to wait before the second to the fifth attempt; after that a message is given up.
RETRY_SECONDS = (1, 5, 15, 30)


def outcomes(handled: DataFrame) -> DataFrame:
    """Handled messages (attempt from 1, errors, transient) with what becomes of them: ack, retry (with its delay) or dead."""
    ok = F.size("errors") == 0
    again = F.coalesce("transient", F.lit(False)) & (F.col("attempt") <= len(RETRY_SECONDS))
    delay = F.element_at(F.array(*[F.lit(x) for x in RETRY_SECONDS]), F.least("attempt", F.lit(len(RETRY_SECONDS))).cast("int"))
    return handled.withColumn("outcome", F.when(ok, "ack").when(again, "retry").otherwise("dead")).withColumn("delay_seconds", F.when(~ok & again, delay))


def dead_letters(rejected: DataFrame, subject: str) -> DataFrame:
    """Rejected rows with the reasons as headers."""
    return rejected.select(F.lit(subject).alias("subject"), F.array_join("errors", ",").alias("reason"), F.to_json(F.struct("*")).alias("body"))
