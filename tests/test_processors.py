"""Processors with state: over streams batch by batch, with timers, and over tables."""

import random

import pytest

from lithos.streaming import processors as p


@pytest.fixture(scope="module")
def stateful(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    yield p.with_state_store(spark)
    spark.conf.set(key, before)


def streamed(spark, tmp_path, ddl, batches, make):
    """What each batch gives; timers would keep a query going, so each start makes one batch."""
    src, sink, out = str(tmp_path / "in"), str(tmp_path / "out"), []
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(src)
        q = make(spark.readStream.schema(ddl).parquet(src)).writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        now = [tuple(r) for r in spark.read.parquet(sink).collect()] if list((tmp_path / "out").glob("*.parquet")) else []
        left = list(now)
        for r in seen:
            left.remove(r)
        seen = now
        out.append(sorted(left, key=str))
    return out


def test_lifecycle_with_timers(stateful, tmp_path):
    M = 60_000
    day = 20_000 * 86_400_000
    batches = [
        [("a", "1", 2, 0, 30 * M, False), ("b", "1", 2, 0, 500 * M, False), ("a", "1", 2, 5 * M, 30 * M, False)],
        [("a", "2", 3, 10 * M, 40 * M, False), ("b", "1", 2, 11 * M, 500 * M, True)],
        [("c", "1", 1, 100 * M, 300 * M, None)],  # the watermark passes a's expiry
        [("a", "3", 1, 110 * M, 400 * M, False), ("d", "1", 1, 100 * M, 90 * M, False)],
    ]
    batches = [[(e, d, n, day + at, day + expires, r) for e, d, n, at, expires, r in b] for b in batches]
    got = streamed(stateful, tmp_path, p.ASSESSED, batches, lambda s: p.lifecycle(s, keep_ms=1000 * M))
    said = [[(r[0], r[1], r[2]) for r in b] for b in got]
    assert said[0] == [("a", "created", 1), ("b", "created", 1)]
    assert said[1] == [("a", "updated", 2), ("b", "retracted", 2)]
    assert ("c", "created", 1) in said[2] and ("a", "expired", 3) in said[2] + said[3]
    assert {("a", "updated", 4), ("d", "created", 1), ("d", "expired", 2)} <= set(said[3])
    assert all(r[4] == day + 40 * M for b in got for r in b if r[:2] == ("a", "expired"))


def test_two_stages_over_a_stream(stateful, tmp_path):
    t = lambda i, lang, poll, outcome="ok", item="1": (i, item, lang, poll, outcome, f"{lang}{poll}")
    batches = [
        [t("a", "id", 1), t("b", "id", 1), t("b", "en", 1), t("c", "id", 1, "failed"), t("d", "id", 1, "broken"), t("e", "id", 1)],
        [t("a", "en", 2, "failed"), *(t("c", "id", k, "failed") for k in range(2, 6)), *(t("e", "en", k, "failed") for k in range(2, 7)), t("b", "id", 2)],
        [t("a", "en", 3), t("c", "id", 6), t("e", "en", 7), t("d", "id", 3, item="2"), t("a", "fr", 3)],
    ]
    got = streamed(stateful, tmp_path, p.TRY, batches, p.two_stages)
    said = [[(r[0], r[2], r[3], ",".join(x.headline for x in r[4] or [])) for r in b] for b in got]
    assert said[0] == [("a", "published", 1, "id1"), ("b", "published", 1, "id1,en1"), ("d", "rejected", 0, ""), ("e", "published", 1, "id1")]
    assert said[1] == [("c", "gave up", 0, "")]
    assert said[2] == [("a", "published", 2, "id1,en3"), ("d", "published", 1, "id3")]


def test_batches_and_one_table_agree(stateful, tmp_path):
    rng = random.Random(3)
    rows = [(f"w{rng.randrange(12)}", str(k // 150), rng.choice(["id", "en", "fr"]), k, rng.choice(["ok", "failed", "failed", "failed", "broken"]), f"h{k}") for k in range(300)]
    make = lambda df: p.two_stages(df, others=("en", "fr"), most=2)
    got = [r for b in streamed(stateful, tmp_path, p.TRY, [rows[:100], rows[100:]], make) for r in b]
    assert sorted(got, key=str) == sorted((tuple(r) for r in make(stateful.createDataFrame(rows, p.TRY)).collect()), key=str)
    assert {"published", "gave up", "rejected"} == {r[2] for r in got}
    assert p.two_stages(stateful.createDataFrame([], p.TRY)).count() == 0
