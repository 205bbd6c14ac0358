"""Stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but
the last return the columns of ``documents``; ``run`` writes each stage as Parquet in
the shared folder and reads it again, and removes what the stage before it wrote.

Edge cases: documents with a null or empty text, or with too few words, go in the
first stage; an empty table passes through all stages; repeated rows of one text are one
group, of which the first in order of (doc_id with nulls last, source) stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithos.llm import jaccard, langid, packing, quality, suffix_dedup
from lithos.session import checkpoint_dir, read_table


def free_name(docs: DataFrame, name: str) -> str:
    """A name for a helper column that ``docs`` doesn't have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.keep(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go; the classifier learns from this stage's own labelled rows."""
    return langid.keep(docs, langid.train(docs, calibrate=True))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates stays: the first by (doc_id with nulls last, source, text).

    Rows are told apart by all of their columns, not by id, as ids may be null or repeat. Of rows that are
    equal in all columns one stays; rows without a word have an empty set each and all stay.
    """
    key, turn = (free_name(docs, n) for n in ("_key", "_turn"))
    keyed = docs.withColumn(key, F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns)))
    words = F.coalesce(F.col("text").rlike(r"[^\x09-\x0D ]"), F.lit(False))
    named = keyed.filter(words)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.col(key).alias("key"))
    own, _, of = jaccard.join(named.select(F.col(key).alias("doc_id"), "text"))
    label = own.select("doc_id", "set").distinct().join(of.select("set", "label"), "set").select(F.col("doc_id").alias("row_key"), "label")
    first = named.select(F.col(key).alias("row_key"), rank.alias("rank")).join(label, "row_key").groupBy("label").agg(F.min("rank").alias("first"))
    kept = named.join(first.select(F.col("first.key").alias(key)), key, "left_semi")
    kept = kept.withColumn(turn, F.row_number().over(Window.partitionBy(key).orderBy(key))).filter(F.col(turn) == 1)
    return kept.select(*docs.columns).unionAll(keyed.filter(~words).select(*docs.columns))


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes and more that an earlier document has are cut out; documents without any text left go."""
    out = suffix_dedup.replace_text(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place."""
    path = public_tokenizers.path
    return packing.best_fit_packing(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("packing", packing_stage),
]

#: Kernel scores, components and suffix matching are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:  # what a stage has read is no longer needed
            folder = spark._jvm.org.apache.hadoop.fs.Path(before)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        before = path
    return docs
