import datetime as dt

from lithos.streaming import streams


def feed(spark, tmp_path, ddl, batches):
    """A file stream that gives each batch in turn."""
    src = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(src))
        yield i, spark.readStream.schema(ddl).parquet(str(src))




def collected(spark, tmp_path, ddl, batches, make, name):
    for _, s in feed(spark, tmp_path, ddl, batches):
        sink = str(tmp_path / "out")
        # timers would keep a query going, so each start makes one batch
        q = make(s).writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        assert q.awaitTermination(60) and q.exception() is None
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_dedup(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    batches = [[("a", t), ("a", t), ("b", t)], [("a", t + dt.timedelta(hours=1)), ("c", t)]]
    got = collected(spark, tmp_path, "msg_id string, published_at timestamp", batches, streams.dedup, "d")
    assert sorted(r.msg_id for r in got) == ["a", "b", "c"]


def test_changed_records(spark, tmp_path):
    t = lambda h: dt.datetime(2026, 1, 1, h)
    ddl = "connector string, key string, content string, fetched_at timestamp"
    batches = [[("c", "k", "1", t(1)), ("c", "k", "1", t(2)), ("c", "k", "2", t(3))], [("c", "k", "2", t(4)), ("c", "k", "1", t(5)), ("c", "j", "1", t(5))]]
    got = collected(spark, tmp_path, ddl, batches, streams.changed_records, "c")
    assert sorted((r.key, r.content, r.fetched_at.hour) for r in got) == [("j", "1", 5), ("k", "1", 1), ("k", "1", 5), ("k", "2", 3)]


def test_flood_episodes(spark, tmp_path):
    batches = [[("s", 0, 2), ("s", 100, 1), ("s", 50, 4)], [("s", 200, 3), ("s", 200 + 86_400, 2)], [("s", 5, 4)]]
    got = collected(spark, tmp_path, "site string, fetched long, level int", batches, streams.flood_episodes, "f")
    rows = sorted((r.episode, r.opened, r.last_exceeded, r.transition, r.level) for r in got)
    assert rows == [(1, 0, 0, "created", 2), (1, 0, 50, "updated", 4), (1, 0, 200, "expired", 4), (1, 0, 200, "updated", 4), (2, 86_600, 86_600, "created", 2)]


def test_recompute_is_idempotent(spark, tmp_path):
    said = []
    table = str(tmp_path / "t")
    ddl = "id string, t long, v long"
    for _, s in feed(spark, tmp_path, ddl, [[("a", 1, 1), ("b", 1, 1)], [("a", 2, 5), ("a", 0, 9)]]):
        q = streams.recompute(s, table, ["id"], ["t"], lambda after, batch: after.join(batch.select("id").distinct(), "id"), lambda df, n: said.append(sorted((r.id, r.v) for r in df.collect())), str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    assert said == [[("a", 1), ("b", 1)], [("a", 5)]]
