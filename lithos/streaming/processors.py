"""Processors with keyed state for ``transformWithState``: timers of any kind of event, and feeds that come in two stages.

They need the state store provider of RocksDB (``with_state_store``). Run over a stream they keep their state between batches; over a
table they start from nothing and timers don't fire. Rows of a key are taken in order of their time, whatever order a batch has them in.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session with the provider set and its stores' coordinator started, which tables need too."""
    _ = spark.streams.active
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


ASSESSED = "event string, digest string, level int, at long, expires long, retracted boolean"
LIFE = "event string, transition string, revision long, level int, at long, expires long"


class Lifecycle(StatefulProcessor):
    """Transitions of events from their assessments: created, updated, retracted, expired.

    An assessment with the digest of the last one says nothing. An event ends when it is retracted, when an
    assessment comes at or after its expiry, or when the timer of event time reaches that; an assessment of an ended event that
    lasts beyond its own time revives it as an update. Each transition adds one to the revision.
    What is known of an ended event is forgotten ``keep_ms`` after its expiry. Times are in milliseconds.
    """

    def __init__(self, keep_ms: int, timed: bool = True):
        self.keep_ms, self.timed = keep_ms, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("event", "status string, digest string, revision long, level int, expires long")

    def _timer(self, at: int) -> None:
        if self.timed:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        status, digest, revision, level, expires = self.state.get() if self.state.exists() else (None, None, 0, None, None)
        out = []

        def say(transition: str, at: int) -> None:
            nonlocal revision
            revision += 1
            out.append(Row(event=key[0], transition=transition, revision=revision, level=level, at=at, expires=expires))

        for r in sorted(rows, key=lambda r: (r.at, r.digest)):
            if status == "active" and expires <= r.at:
                status = "expired"
                say(status, expires)
            if r.retracted:
                if status == "active":
                    status = "retracted"
                    say(status, r.at)
                continue
            lives = r.expires > r.at
            changed = digest != r.digest
            if status is None:
                digest, level, expires = r.digest, r.level, r.expires
                say("created", r.at)
                status = "active"
                if not lives:
                    status = "expired"
                    say(status, r.at)
            elif (status == "active" and changed) or (status != "active" and lives and changed):
                digest, level, expires, status = r.digest, r.level, r.expires, "active"
                say("updated", r.at)
        if status is not None:
            self.state.update((status, digest, revision, level, expires))
            self._timer(expires if status == "active" else expires + self.keep_ms)
        yield from out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.state.exists():
            status, digest, revision, level, expires = self.state.get()
            if status != "active":
                self.state.clear()
            else:
                self.state.update(("expired", digest, revision + 1, level, expires))
                self.handle.registerTimer(expires + self.keep_ms)
                yield Row(event=key[0], transition="expired", revision=revision + 1, level=level, at=expires, expires=expires)

    def close(self) -> None:
        pass


def lifecycle(assessed: DataFrame, keep_ms: int = 7 * 86_400_000, late: str = "10 minutes") -> DataFrame:
    """(event, transition, revision, level, at, expires) from assessments; timers fire as the watermark passes them."""
    timed = assessed.isStreaming
    rows = assessed.select(*(F.col(c.split(" ")[0]).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in ASSESSED.split(", ")))
    rows = rows.withColumn("retracted", F.coalesce("retracted", F.lit(False)))
    if timed:
        rows = rows.withColumn("_time", F.timestamp_millis("at")).withWatermark("_time", late)
    return rows.groupBy("event").transformWithState(Lifecycle(keep_ms, timed), LIFE, "append", "EventTime" if timed else "None")


TRY = "identifier string, item string, language string, poll long, outcome string, headline string"
STAGE = "identifier string, poll long, outcome string, published long, texts array<struct<language: string, headline: string>>"


class TwoStages(StatefulProcessor):
    """Warnings whose text comes in several languages, each fetched by itself and perhaps in vain.

    A warning is published as soon as its main language is there and again whenever a translation adds to it. A fetch that
    fails is tried again at later polls, ``tries`` times; then the warning is given up if it was the main language's, else that
    translation is. A broken document isn't tried again: of the main language it rejects the warning. Once nothing is open, no
    more is taken; a new version of the list's entry (``item``) starts afresh. All documents of a poll count at once.
    """

    def __init__(self, main: str, others: tuple[str, ...], tries: int, keep_ms: int, timed: bool = True):
        self.main, self.others, self.tries, self.keep_ms, self.timed = main, others, tries, keep_ms, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "item string, final boolean, published long, languages string")
        self.documents = handle.getMapState("documents", "language string", "headline string, attempts int, settled boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        item, final, published, said = self.item.get() if self.item.exists() else (None, False, 0, "")
        docs = {k[0]: tuple(v) for k, v in self.documents.iterator()}
        out = []

        def say(poll: int, outcome: str, texts: list | None = None) -> None:
            out.append(Row(identifier=key[0], poll=poll, outcome=outcome, published=published, texts=texts))

        for poll, tried in groupby(sorted(rows, key=lambda r: (r.poll, r.item, r.language, r.outcome)), key=lambda r: r.poll):
            for r in tried:
                if r.item != item:
                    item, final, said, docs = r.item, False, "", {}
                headline, attempts, settled = docs.get(r.language, (None, 0, False))
                if final or settled or r.language not in (self.main, *self.others):
                    continue
                if r.outcome == "failed":
                    attempts += 1
                settled = r.outcome != "failed" or attempts >= self.tries
                docs[r.language] = (r.headline if r.outcome == "ok" else None, attempts, settled)
                if r.language == self.main and settled and r.outcome != "ok":
                    final = True
                    say(poll, "gave up" if r.outcome == "failed" else "rejected")
            have = [(x, docs[x][0]) for x in (self.main, *sorted(self.others)) if x in docs and docs[x][0] is not None]
            if final or not have or have[0][0] != self.main:
                continue
            languages = ",".join(x for x, _ in have)
            if languages != said:
                published, said = published + 1, languages
                say(poll, "published", [Row(language=x, headline=h) for x, h in have])
            final = all(x in docs and docs[x][2] for x in self.others)
        if item is not None:
            self.item.update((item, final, published, said))
            self.documents.clear()
            for language, d in docs.items():
                self.documents.updateValue((language,), d)
            if self.timed:
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        yield from out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.item.clear()
        self.documents.clear()
        yield from ()

    def close(self) -> None:
        pass


def two_stages(tries: DataFrame, main: str = "id", others: tuple[str, ...] = ("en",), most: int = 5, keep_ms: int = 7 * 86_400_000) -> DataFrame:
    """(identifier, poll, outcome, published, texts) from fetches (identifier, item, language, poll, outcome: ok, failed or broken, headline).

    Over a stream, a warning of which nothing was heard for ``keep_ms`` is forgotten.
    """
    timed = tries.isStreaming
    rows = tries.select(*(F.col(c.split(" ")[0]).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in TRY.split(", ")))
    return rows.groupBy("identifier").transformWithState(TwoStages(main, others, most, keep_ms, timed), STAGE, "append", "ProcessingTime" if timed else "None")
