"""The processors with kept state as streams over files: what is published, and that a started query goes on."""

from test_operators import REPORTS
from test_warning_state import messages

from lithos.streaming import fires, quakes
from lithos.streaming import warnings as warning_state


def published(spark, tmp_path, ddl, batches, start):
    """What each batch publishes; the query is started anew for each."""
    src, out = str(tmp_path / "in"), {}
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(src)
        q = start(spark.readStream.schema(ddl).parquet(src), lambda df, n: out.setdefault(n, sorted(tuple(r)[:3] for r in df.collect())), str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(180) and q.exception() is None
    return [out[n] for n in sorted(out)]


def test_fires(spark, tmp_path):
    d = lambda i, t, lat=-7.0: (i, t, lat, 107.5, "A", False, 1.0, t)
    table = fires.fire_table(spark, str(tmp_path / "t"))
    got = published(spark, tmp_path, fires.DETECTION, [[d("a", 0), d("b", 0, -7.03)], [d("c", 3600, -7.015)]], lambda s, p, cp: fires.fire_events(s, table, p, cp))
    assert got == [[("a", "created", None), ("b", "created", None)], [("a", "updated", None), ("b", "merged", "a")]]


def test_warnings(spark, tmp_path):
    import random

    base = messages(random.Random(1), 2)[0]
    m = lambda k, refs: tuple((base | {"identifier": f"m{k}", "sent": k, "digest": f"x{k}", "msg_type": "Alert", "references": refs, "polygons": ["p"], "relevant": True, "expires_at": 10**6})[c] for c in warning_state.MESSAGE_COLUMNS)
    state = warning_state.WarningState(spark, str(tmp_path / "s"), 2)
    got = published(spark, tmp_path, warning_state.MESSAGE, [[m(1, []), m(2, [])], [m(3, [("m1", 1), ("m2", 2)])]], lambda s, p, cp: warning_state.warning_events(s, state, p, cp, lambda: 100))
    assert got == [[("m1", "created", None), ("m2", "created", None)], [("m1", "updated", None), ("m2", "merged", "m1")]]


def test_quakes(spark, tmp_path):
    r = lambda i, source, t, arrived: (i, source, t, -7.0, 107.0, 5.0, arrived, [], False, arrived)
    state = quakes.QuakeState(spark, str(tmp_path / "s"), 2)
    got = published(spark, tmp_path, REPORTS, [[r("a", "bmkg", 0.0, 1.0), r("z", "bmkg", 9000.0, 1.0)], [r("b", "usgs", 10.0, 2.0)]], lambda s, p, cp: quakes.quake_events(s, state, p, cp))
    assert [[x[:2] for x in b] for b in got] == [[("bmkg", "a"), ("bmkg", "z")], [("usgs", "b")]]
    placed = {x.id: x.event for x in quakes.placed(state, 9).collect()}
    assert placed["a"] == placed["b"] != placed["z"]
