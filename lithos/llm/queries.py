"""The numbered queries: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.llm import bpe, chat, interaction, jaccard, langid, licenses, neighbours, packing, pii, quality, sharding, suffix_dedup, whitening
from lithos.session import checkpoint_dir, read_table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = f"{checkpoint_dir(spark)}/slot-maps-{uuid.uuid4().hex}"
    out = sharding.shard(read_table(spark, sf_dir, "documents"), n_shards=40, store=store)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(read_table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string"))
    out = chat.format_conversations(rows.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    turns, loss = chat.read_back(F.col("formatted")), chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    path = public_tokenizers.path
    return packing.best_fit_packing(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.cascade(read_table(spark, sf_dir, "documents"), measures=quality.MEASURES)
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    return out.select("doc_id", *quality.MEASURES, ((n < 50) | (100 * repeated > 50 * n)).alias("base_failed"), "kept")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    # carried beside the id through the same rows, not joined: ids may repeat
    keyed = docs.select(F.struct("doc_id", langid.held_out().alias("held_out")).alias("key"), "text")
    out = langid.identify(keyed, langid.train(docs), id_col="key")
    return out.select("doc_id.doc_id", "doc_id.held_out", "lang_pred", "score")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.scan(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(kinds) - F.size(F.array_remove(kinds, k)) for k in pii.BASE_KINDS]
    counts = [n.cast("long").alias(f"n_{k}") for n, k in zip(counts, pii.BASE_KINDS, strict=True)]
    return out.select("doc_id", *counts, F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op12_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_neighbours": op3_neighbours,
    "op4_licenses": op4_licenses,
    "op5_bpe": op5_bpe,
    "op6_jaccard": op6_jaccard,
    "op7_chat": op7_chat,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_langid": op10_langid,
    "op11_pii": op11_pii,
    "op12_interaction": op12_interaction,
    "op13_whitening": op13_whitening,
}

#: The template adds 8 + role + 8 + 7 characters to a turn, and one for each backslash and control string.
_OP7_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(23 + length(role) + length(text) + length(text) - length(replace(text, '\', ''))
      + (length(text) - length(replace(text, '<|', ''))) // 2 + (length(text) - length(replace(text, '</s>', ''))) // 4
      + (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '[INST]', ''))) // 6
      + (length(text) - length(replace(text, '[/INST]', ''))) // 7) AS formatted_chars
  FROM m GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""

_OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), tri AS (
  SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)
), rep AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (
    SELECT doc_id, i + unnest([0, 1, 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM tri) WHERE k > 1
  ) GROUP BY doc_id
), li AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
    coalesce(rep.n, 0) AS n_repeat_words, strlen(regexp_replace(t, '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) AS n_letters
  FROM d LEFT JOIN li USING (doc_id) LEFT JOIN rep USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 2 * n_symbols > n_words OR 2 * n_dup_lines > greatest(n_lines, 4)
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_letters < word_chars) AS kept
FROM m
"""

_OP12_SQL = r"""
WITH RECURSIVE o(filter_order) AS (
  SELECT '' UNION ALL SELECT filter_order || l FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS x(l) WHERE NOT contains(filter_order, l)
), st AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(filter_order) = 5)
), d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS ws,
    min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS first FROM documents
), l AS (
  SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), c AS (
  SELECT part, CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails,
    count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM d LEFT JOIN l USING (doc_id) GROUP BY ALL
), x AS (
  SELECT part, filter_order, step, letter, n, good, toxic, contains(fails, letter) AS f, fails = letter AS alone,
    before <> '' AND regexp_matches(fails, '[' || before || '_]') AS earlier
  FROM c, st
), y AS (
  SELECT part, filter_order, step, letter,
    CAST(sum(CASE WHEN NOT f AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN f AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN f AND earlier THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN alone THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN f AND NOT earlier THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN f AND NOT earlier THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM x GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM y
"""

ORACLE_SQL: dict[str, str] = {"op7_chat": _OP7_SQL, "op9_quality": _OP9_SQL, "op12_interaction": _OP12_SQL}
