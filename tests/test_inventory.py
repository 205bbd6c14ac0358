"""Confidence of detections at the bounds of its classes."""

from pyspark.sql import functions as F

from lithos.plans import fires


def test_bounds_belong_to_the_higher_class(spark, tmp_path):
    rows = [(1, 147.0), (2, 146.99), (3, 392.0), (4, 391.99)]
    df = spark.createDataFrame(rows, "event_id long, value double").withColumn("ts", F.lit("2024-01-01 08:00:00").cast("timestamp_ntz")).withColumn("user_id", F.lit(1))
    df.withColumn("event_type", F.lit("click")).withColumn("props", F.lit("{}")).write.parquet(f"{tmp_path}/events.parquet")
    r = fires.fire_inventory(spark, str(tmp_path)).first()
    assert (r.low, r.nominal, r.high) == (1, 2, 1)
