"""Structured Streaming: deduplication, change detection, episodes with state, recomputed neighbourhoods."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lithos.operators.latest import newest


def dedup(stream: DataFrame, key: str = "msg_id", at: str = "published_at", within: str = "24 hours") -> DataFrame:
    """The first message of each id within a day; state older than that is dropped."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def changed_records(stream: DataFrame, connector: str = "connector", key: str = "key", content: str = "content", forget_days: int = 30) -> DataFrame:
    """Records whose content differs from their key's last one. Columns: connector, key, content, fetched_at."""

    def run(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for b in batches:
            for r in b.sort_values("fetched_at").itertuples(index=False):
                digest = r.digest
                if digest != last:
                    out.append((who[0], who[1], r.content, r.fetched_at))
                last = digest
        state.update((last,))
        state.setTimeoutDuration(forget_days * 86_400_000)
        yield pd.DataFrame(out, columns=["connector", "key", "content", "fetched_at"])

    s = stream.select(F.col(connector).alias("connector"), F.col(key).alias("key"), F.col(content).alias("content"), "fetched_at").withColumn("digest", F.sha2("content", 256))
    return s.groupBy("connector", "key").applyInPandasWithState(run, "connector string, key string, content string, fetched_at timestamp", "digest string", "append", GroupStateTimeout.ProcessingTimeTimeout)


EPISODE = "site string, episode long, transition string, opened long, last_exceeded long, expires long, level int"


def flood_episodes(runs: DataFrame, linger: int = 86_400, threshold: int = 2) -> DataFrame:
    """Episodes of each site from runs (site, fetched, level): created, updated, expired.

    A run not newer than the last one of its site is ignored. A run at the threshold opens or
    extends an episode; one below keeps it until it lapses. What has lapsed when the next run
    comes, or when the timer of processing time fires, is expired.
    """

    def run(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        site = who[0]
        last, number, opened, exceeded, level, is_open = state.get if state.exists else (-1, 0, 0, 0, 0, False)
        out: list[tuple] = []

        def expire() -> None:
            out.append((site, number, "expired", opened, exceeded, exceeded + linger, level))

        if state.hasTimedOut:
            if is_open:
                expire()
            state.update((last, number, opened, exceeded, level, False))
        else:
            rows = pd.concat(list(batches)).sort_values("fetched")
            for r in rows.itertuples(index=False):
                t, now = int(r.fetched), int(r.level)
                if t <= last:
                    continue
                last = t
                if is_open and t >= exceeded + linger:
                    expire()
                    is_open = False
                if now >= threshold:
                    exceeded = t
                    if not is_open:
                        number, opened, level, is_open = number + 1, t, now, True
                        out.append((site, number, "created", opened, exceeded, exceeded + linger, level))
                    else:
                        level = max(level, now)
                        out.append((site, number, "updated", opened, exceeded, exceeded + linger, level))
            state.update((last, number, opened, exceeded, level, is_open))
            if is_open:
                state.setTimeoutDuration(linger * 1000)
        yield pd.DataFrame(out, columns=["site", "episode", "transition", "opened", "last_exceeded", "expires", "level"])

    kind = "last long, number long, opened long, exceeded long, level int, is_open boolean"
    return runs.groupBy("site").applyInPandasWithState(run, EPISODE, kind, "append", GroupStateTimeout.ProcessingTimeTimeout)


def recompute(stream: DataFrame, table: str, keys: list[str], order: list[str], touched: Callable[[DataFrame, DataFrame], DataFrame], publish: Callable[[DataFrame, int], None], checkpoint: str):
    """Store each batch by an idempotent upsert into versioned folders of ``table`` and publish what ``touched`` makes of it.

    Events whose neighbourhood is not a key (quakes, fires, warning chains) are pure functions
    of the set of records, so they are computed again for what a batch touches. A batch that
    is replayed after a failure writes the same folder.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        before = _version(spark, table, number - 1)
        both = batch if before is None else before.unionByName(batch)
        newest(both, keys, order).write.mode("overwrite").parquet(f"{table}/version={number}")
        after = spark.read.parquet(f"{table}/version={number}")
        publish(touched(after, batch), number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def _version(spark: SparkSession, table: str, number: int) -> DataFrame | None:
    if number < 0:
        return None
    path = f"{table}/version={number}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(hadoop) else None
