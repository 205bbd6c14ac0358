"""Fire events joined batch by batch against an oracle that takes one step at a time."""

import math
import random

from lithos.policies import EARTH_KM, FirePolicy
from lithos.streaming import fires

DAY = 86_400
POLICY = FirePolicy(km=3.0)


def linked(a, b):
    p, q = math.radians(a["lat"]), math.radians(b["lat"])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b["lon"] - a["lon"]) / 2) ** 2
    return abs(a["t"] - b["t"]) <= POLICY.gap_seconds and 2 * EARTH_KM * math.asin(math.sqrt(h)) <= POLICY.km


def level(ms):
    out = 1
    for d in ms:
        win = [m for m in ms if d["t"] - POLICY.window_seconds < m["t"] <= d["t"]]
        if len(win) >= POLICY.many_detections:
            return 3
        if any(m["high"] for m in win) or len({(m["product"], m["t"]) for m in win}) >= 2:
            out = 2
    return out


class Oracle:
    """Events by name; a batch of one detection is the step of an event at a time."""

    def __init__(self):
        self.seen, self.events, self.log = {}, {}, []

    def say(self, e, transition, into=None):
        ev = self.events[e]
        ev["revision"] += 1
        self.log.append((e, transition, into, ev["revision"]))

    def batch(self, ds):
        new = []
        for d in sorted(ds, key=lambda d: (d["fetched"], d["t"], d["id"])):
            if d["id"] not in self.seen:
                self.seen[d["id"]] = d
                new.append(d)
        hits = {}
        for d in new:
            for e, ev in self.events.items():
                if ev["status"] == "active" and any(linked(d, m) for m in ev["members"]):
                    hits.setdefault(e, []).append(d)
        for e in [e for e, by in hits.items() if by[0]["fetched"] > max(m["fetched"] for m in self.events[e]["members"]) + POLICY.linger_seconds]:
            self.events[e]["status"] = "expired"
            self.say(e, "expired")
            del hits[e]
        left = list(new)
        while left:
            group, todo, events = [], [left.pop(0)], []
            while todo:
                d = todo.pop()
                group.append(d)
                near = [x for x in left if linked(d, x)]
                for e in [e for e, by in hits.items() if d in by and e not in events]:
                    events.append(e)
                    near += [x for x in hits[e] if x in left and x not in near]
                left = [x for x in left if x not in near]
                todo += near
            group.sort(key=lambda d: (d["fetched"], d["t"], d["id"]))
            events.sort(key=lambda e: (min(m["t"] for m in self.events[e]["members"]), e))
            if not events:
                events = [group[0]["id"]]
                self.events[events[0]] = {"members": [], "status": "active", "revision": 0}
            for e in events[1:]:
                self.events[events[0]]["members"] += self.events[e]["members"]
                self.events[e]["status"] = "merged"
                self.say(e, "merged", events[0])
            ev = self.events[events[0]]
            ev["members"] += group
            self.say(events[0], "created" if ev["revision"] == 0 else "updated")

    def expire(self, now, limit):
        due = sorted((max(m["fetched"] for m in ev["members"]) + POLICY.linger_seconds, e) for e, ev in self.events.items() if ev["status"] == "active")
        for _, e in [x for x in due if x[0] <= now][:limit]:
            self.events[e]["status"] = "expired"
            self.say(e, "expired")

    def rows(self):
        return sorted((m["id"], e, ev["status"] == "active", ev["revision"], level(ev["members"])) for e, ev in self.events.items() if ev["status"] != "merged" for m in ev["members"])


def made(rng, n, days):
    out = []
    for i in range(n):
        t = rng.randrange(days * DAY)
        # around a corner of four regions
        out.append({"id": f"d{i:04}", "t": t, "lat": -7 + rng.uniform(-0.12, 0.12), "lon": 107 + rng.uniform(-0.12, 0.12), "product": rng.choice("AB"), "high": rng.random() < 0.1, "frp": 1.0, "fetched": t + rng.choice([0, 3600, DAY, 2 * DAY])})
    return out


def state(table, version):
    return sorted((r.id, r.event, r.live, r.revision, r.level) for r in table.read(version).collect())


def frame(spark, ds):
    return spark.createDataFrame([tuple(d[c.split(" ")[0]] for c in fires.DETECTION.split(", ")) for d in ds], fires.DETECTION)


def test_batches_equal_the_oracle(spark, tmp_path):
    rng = random.Random(2)
    ds = made(rng, 160, 5)
    ds.sort(key=lambda d: d["fetched"])
    for i in range(0, 160, 40):  # batches come late, others again
        ds[i : i + 20], ds[i + 20 : i + 40] = ds[i + 20 : i + 40], ds[i : i + 20]
    cuts = [0, 60, 61, 160]
    table, oracle, said = fires.fire_table(spark, str(tmp_path / "t")), Oracle(), []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = ds[a:b] + ds[: 5 * k]
        said += [(r.event, r.transition, r.into, r.revision) for r in fires.absorb(table, frame(spark, part), k, POLICY).collect()]
        for turn in sorted({d["fetched"] // DAY for d in part}):
            oracle.batch([d for d in part if d["fetched"] // DAY == turn])
    assert sorted(said, key=str) == sorted(oracle.log, key=str)
    assert state(table, 10 * fires.MOST_SLICES) == oracle.rows()
    assert {x[1] for x in said} == {"created", "updated", "merged", "expired"}
    # the timer ends at most so many at a time, those due first
    now = max(d["fetched"] for d in ds)
    oracle.log.clear()
    due = fires.expire(table, 10 * fires.MOST_SLICES, now, 3, POLICY).collect()
    oracle.expire(now, 3)
    assert sorted((r.event, r.transition, r.into, r.revision) for r in due) == sorted(oracle.log) and len(due) == 3
    assert state(table, 11 * fires.MOST_SLICES) == oracle.rows()


def test_one_at_a_time_and_again(spark, tmp_path):
    rng = random.Random(5)
    ds = [d | {"lat": -7 + rng.uniform(-0.03, 0.03), "lon": 107 + rng.uniform(-0.03, 0.03)} for d in made(rng, 7, 1)]
    table, oracle = fires.fire_table(spark, str(tmp_path / "t")), Oracle()
    for k, d in enumerate(ds):
        got = fires.step(table, frame(spark, [d]), k, POLICY).count()
        oracle.batch([d])
        if k == 3:  # a batch that runs again after a failure
            assert fires.step(table, frame(spark, [d]), k, POLICY).count() == got
    assert state(table, 100) == oracle.rows()


def test_touches_only_its_regions(spark, tmp_path):
    far = [{"id": f"f{i}", "t": 0, "lat": -7.5, "lon": 100.5 + i, "product": "A", "high": False, "frp": None, "fetched": 0} for i in range(6)]
    table = fires.fire_table(spark, str(tmp_path / "t"))
    fires.step(table, frame(spark, far), 0, POLICY)
    fires.step(table, frame(spark, [far[2] | {"id": "x", "t": 60, "fetched": 60}]), 1, POLICY)
    newest = [f.rpartition("=")[2] for f in table.newest(2)]
    assert sorted(newest) == ["0"] * 5 + ["1"]
    assert {r.event for r in table.read(2).collect() if r.id in ("x", "f2")} == {"f2"}


def test_empty_batch(spark, tmp_path):
    table = fires.fire_table(spark, str(tmp_path / "t"))
    assert fires.absorb(table, frame(spark, []), 0).count() == 0 and fires.step(table, frame(spark, []), 1).count() == 0
    assert table.read(5).count() == 0 and fires.expire(table, 6, 10**12).count() == 0
