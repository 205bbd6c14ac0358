"""Search of names by their trigrams, over posting lists that are stored once."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.functions.text import trigrams

#: Parts that the posting lists of trigrams are stored in.
BUCKETS = 32


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("trigram"), F.lit(buckets)).cast("int").alias("bucket")


def store(names: DataFrame, path: str, key: str, name: str, buckets: int = BUCKETS) -> None:
    """Writes the index of ``names``: for each trigram the keys of names that have it, with the number of their trigrams.

    Lists are stored by bucket of the trigram and sorted in it, so that a search reads the buckets and row groups of its own trigrams.
    """
    t = names.select(F.col(key).alias("key"), trigrams(F.col(name)).alias("all")).select("key", F.size("all").alias("n"), F.explode("all").alias("trigram"))
    # a frequent trigram's list may go to several files
    out = t.select("*", _bucket(buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "trigram", "n")
    out.write.mode("overwrite").partitionBy("bucket").parquet(path)


def search(spark: SparkSession, path: str, wanted: str, least: float, buckets: int = BUCKETS) -> DataFrame:
    """(key, similarity) of names that share at least ``least`` of all trigrams of theirs and the word's, repeated keys as one name each.

    Lists are read for the word's trigrams only, and of these the names whose number of trigrams allows the similarity.
    """
    asked = spark.range(1).select(F.explode(trigrams(F.lit(wanted))).alias("trigram")).select("trigram", _bucket(buckets)).collect()  # of one word
    return _counted(spark.read.parquet(path).filter(F.col("bucket").isin(sorted({r["bucket"] for r in asked})) & F.col("trigram").isin([r["trigram"] for r in asked])), len(asked), least)


def _counted(postings: DataFrame, m: int, least: float) -> DataFrame:
    # shared <= min(n, m) and similarity = shared / (n + m - shared)
    low, high = math.ceil(least * m - 1e-9), math.floor(m / least + 1e-9) if least > 0 else 2**31 - 1
    fits = postings.filter((F.col("n") >= low) & (F.col("n") <= high))
    shared = fits.groupBy("key", "n").agg(F.count(F.lit(1)).alias("_s"))
    return shared.select("key", (F.col("_s") / (F.col("n") + m - F.col("_s"))).alias("similarity")).filter(F.col("similarity") >= least)


def search_many(spark: SparkSession, path: str, words: DataFrame, least: float, word: str = "word") -> DataFrame:
    """(word, key, similarity) for each distinct word of a table.

    A name counts for a word only in as many of the word's trigrams as it must miss plus one: those whose lists are the shortest. Names
    found there are held against all of the word's trigrams by a second join, so frequent trigrams never make candidates.
    """
    index = spark.read.parquet(path).select("trigram", "key", "n")
    w = words.select(F.col(word).alias("word")).filter("word IS NOT NULL").distinct()
    w = w.select("word", trigrams(F.col("word")).alias("all")).withColumn("m", F.size("all"))
    long = w.select("word", "m", F.explode("all").alias("trigram"))
    size = index.groupBy("trigram").agg(F.count(F.lit(1)).alias("size"))
    rare = long.join(size, "trigram").groupBy("word", "m").agg(F.sort_array(F.collect_list(F.struct("size", "trigram"))).alias("by"))
    # a similar name shares at least ceil(least * m) trigrams, so it has one of any m - that + 1
    some = F.greatest(F.col("m") - F.ceil(F.lit(least) * F.col("m") - 1e-9) + 1, F.lit(1)).cast("int")
    rare = rare.select("word", "m", F.explode(F.slice("by", F.lit(1), F.least(some, F.size("by")))).alias("t")).select("word", "m", F.col("t.trigram").alias("trigram"))
    fits = (F.col("n") >= F.ceil(F.lit(least) * F.col("m") - 1e-9)) & (F.col("n") * least <= F.col("m") + 1e-9)
    candidates = rare.join(index, "trigram").filter(fits).select("word", "m", "key", "n").distinct()
    shared = candidates.join(index.select("key", "trigram"), "key").join(long.select("word", "trigram"), ["word", "trigram"], "left_semi")
    counted = shared.groupBy("word", "m", "key", "n").agg(F.count(F.lit(1)).alias("_s"))
    return counted.select("word", "key", (F.col("_s") / (F.col("n") + F.col("m") - F.col("_s"))).alias("similarity")).filter(F.col("similarity") >= least)
