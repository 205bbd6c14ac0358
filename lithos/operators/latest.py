"""Latest-wins families: every result is a function of the set of records, not of their order of arrival."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], first_seen: str | None = None) -> DataFrame:
    """The newest record of each key by a total order (nulls lowest), with its key's earliest ``first_seen``.

    One aggregation with map-side combining: a hot key never meets in one task row by row.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rank = F.struct(*[x for i, c in enumerate(order) for x in (c.isNotNull().alias(f"h{i}"), c.alias(f"v{i}"))])
    rest = [c for c in df.columns if c not in keys]
    aggs = [F.max_by(F.struct(*rest), rank).alias("_r")]
    if first_seen:
        aggs.append(F.min(first_seen).alias("first_seen"))
    out = df.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest], *(["first_seen"] if first_seen else []))


def latest_issue(series: DataFrame, keys: Sequence[str], issued: str, since: Column | None = None) -> DataFrame:
    """Rows of the newest issue of each key; ``since`` drops old ones first. Callers pass the time, never the clock."""
    kept = series if since is None else series.filter(F.col(issued) >= since)
    w = Window.partitionBy(*keys).orderBy(F.col(issued).desc())
    return kept.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merge_feeds(df: DataFrame, keys: Sequence[str], order: Sequence[str], whole: Sequence[str], texts: Sequence[str], known: dict[str, str], first_seen: str) -> DataFrame:
    """One row of each key from its feeds: ``whole`` columns from the newest record together,
    each text from the newest record where it isn't empty, each ``known`` column from the newest where it isn't the given value."""
    rank = F.struct(*order)
    aggs = [F.max_by(F.struct(*whole), rank).alias("_w")]
    for c in texts:
        has = F.col(c).isNotNull() & (F.col(c) != "")
        aggs.append(F.max_by(F.when(has, F.col(c)), F.when(has, rank)).alias(c))
    for c, unknown in known.items():
        has = F.col(c).isNotNull() & (F.col(c) != unknown)
        aggs.append(F.coalesce(F.max_by(F.when(has, F.col(c)), F.when(has, rank)), F.lit(unknown)).alias(c))
    out = df.groupBy(*keys).agg(*aggs, F.min(first_seen).alias("first_seen"))
    return out.select(*keys, *[F.col(f"_w.{c}").alias(c) for c in whole], *texts, *known, "first_seen")


def current_per_source(solutions: DataFrame, event: str, source: str, ranks: dict[str, int]) -> DataFrame:
    """The solution in force of each source in an event: last first seen, ties to the larger key; withdrawn ones never."""
    live = newest(solutions.filter(~F.col("deleted")), [event, source], ["first_seen", "key"])
    place = F.lit(len(ranks))
    for name, r in ranks.items():
        place = F.when(F.col(source) == name, r).otherwise(place)
    return live.withColumn("source_rank", place)


def event_view(solutions: DataFrame, event: str, source: str, ranks: dict[str, int], expires_hours: int = 6) -> DataFrame:
    """One row an event: content of the best-ranked source in force, detection time over all members."""
    cur = current_per_source(solutions, event, source, ranks)
    best = cur.groupBy(event).agg(F.min_by(F.struct(*[c for c in cur.columns if c != event]), F.struct("source_rank", "key")).alias("_p"))
    seen = solutions.groupBy(event).agg(F.min("first_seen").alias("detected_at"), F.count(F.lit(1)).alias("n_members"))
    out = best.join(seen, event).select(event, "_p.*", "detected_at", "n_members")
    return out.withColumn("expires_at", F.col("occurred_at") + F.expr(f"INTERVAL {expires_hours} HOURS"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys with what became of them: inserted, updated, unchanged or deleted."""
    o = old.select(*keys, F.struct(*values).alias("_o"), F.lit(True).alias("_in_old"))
    n = new.select(*keys, F.struct(*values).alias("_n"), F.lit(True).alias("_in_new"))
    change = F.when(F.col("_in_old").isNull(), "inserted").when(F.col("_in_new").isNull(), "deleted").when(F.col("_o").eqNullSafe(F.col("_n")), "unchanged").otherwise("updated")
    return o.join(n, list(keys), "full_outer").select(*keys, change.alias("change"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str], first: Sequence[str] = ()) -> DataFrame:
    """The table after an idempotent, late-safe upsert; ``first`` columns keep their earliest value."""
    both = stored.unionByName(incoming)
    out = newest(both, keys, order)
    if first:
        early = both.groupBy(*keys).agg(*[F.min(c).alias(c) for c in first])
        out = out.drop(*first).join(early, list(keys)).select(*both.columns)
    return out


def change_log(before: DataFrame, after: DataFrame, key: str, digest: str, revision: str = "revision") -> DataFrame:
    """Transitions between two states of the event table, with the next revision."""
    b = before.select(key, F.col(digest).alias("_d"), F.col(revision).alias("_r"), F.col("status").alias("_s"))
    a = after.select(key, digest, "status")
    j = b.join(a, key, "full_outer")
    kind = F.when(F.col("_d").isNull(), "created").when(F.col(digest).isNull(), "expired").when((F.col("status") != F.col("_s")) & (F.col("status") != "active"), F.col("status")).when(F.col("_d") != F.col(digest), "updated")
    return j.withColumn("transition", kind).filter("transition IS NOT NULL").select(key, "transition", (F.coalesce("_r", F.lit(0)) + 1).alias(revision))
