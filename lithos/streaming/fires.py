"""Fire events kept between batches: single linkage, joined one batch at a time.

The members of events are stored by region, a degree square. A batch reads the regions that its detections can reach and
those that the events it touches lie in, and writes only the ones that change. The detections of a batch arrive together:

1. Detections that are stored already are left out.
2. A stored event that a detection links to has lapsed if the first of these was received after the event's expiry; it
   ends then and takes no part. Others live on for the rest of the batch.
3. Living events and new detections that links connect become one event: the stored one with the oldest first
   detection (ties to the smaller name), into which the others are merged, or a new one named by the first received.

A batch of one detection is a step of an event at a time. Detections received over more than the linger are
taken in slices no longer than that, as an event may lapse within them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.graph import connected_components
from lithos.operators import fire, joins
from lithos.policies import FirePolicy
from lithos.session import cut
from lithos.streaming.parts import PartTable

DETECTION = "id string, t long, lat double, lon double, product string, high boolean, frp double, fetched long"
STATE = f"{DETECTION}, event string, revision long, level int, live boolean, parts array<long>"
TRANSITION = "event string, transition string, into string, revision long, level int, detections long, first_t long, last_t long, expires long"
#: Slices of one batch at most.
MOST_SLICES = 1 << 16


def region(lat: Column, lon: Column) -> Column:
    """The degree square of a place; there are 64,800."""
    return (F.least(F.floor(lat), F.lit(89)) + 90) * 360 + F.pmod(F.floor(lon) + 180, F.lit(360))


def regions_near(lat: Column, lon: Column, km: float) -> Column:
    """The degree squares within a distance of less than a degree."""
    dy = km / 110.5
    dx = km / (110.5 * F.greatest(F.cos(F.radians(F.least(F.abs(lat) + dy, F.lit(89.0)))), F.lit(0.02)))
    return F.array_distinct(F.array(*[region(lat + y * dy, lon + x * dx) for y in (-1, 0, 1) for x in (-1, 0, 1)]))


def fire_table(spark: SparkSession, path: str) -> PartTable:
    return PartTable(spark, path, STATE)


def _events(members: DataFrame, policy: FirePolicy) -> DataFrame:
    """What members say of their events."""
    return members.groupBy("event").agg(
        F.max("revision").alias("revision"), F.max("level").alias("level"), F.count(F.lit(1)).alias("detections"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
        (F.max("fetched") + policy.linger_seconds).alias("expires"),
    )


def step(table: PartTable, batch: DataFrame, version: int, policy: FirePolicy = FirePolicy(), remember_seconds: int = 30 * 86_400) -> DataFrame:
    """Joins a batch, received within a span of the linger, into the state and returns its transitions.

    Ended events' detections are remembered for a time, so that one sent again isn't taken for new.
    """
    names = [c.split(" ")[0] for c in DETECTION.split(", ")]
    new = batch.groupBy("id").agg(F.min_by(F.struct(*names), F.struct("fetched", "t")).alias("d")).select("d.*")
    new = cut(new.withColumn("part", region(F.col("lat"), F.col("lon"))))
    reach = [r["part"] for r in new.select(F.explode(regions_near(F.col("lat"), F.col("lon"), policy.km)).alias("part")).distinct().collect()]
    here = table.read(version, reach)
    new = cut(new.join(here.select("id").distinct(), "id", "left_anti"))
    links = joins.near_between(new, here.filter("live"), policy.km, policy.gap_seconds)
    own = here.filter("live").select(F.col("id").alias("b"), "event", "parts")
    links = cut(links.join(own, "b").join(new.select(F.col("id").alias("a"), "fetched"), "a").groupBy("a", "event").agg(F.first("fetched").alias("fetched"), F.first("parts").alias("parts")))
    further = [r["part"] for r in links.select(F.explode("parts").alias("part")).distinct().collect()]
    state = table.read(version, sorted({*reach, *further}))
    touched = links.groupBy("event").agg(F.min("fetched").alias("touch"))
    members = state.filter("live").join(touched.select("event"), "event", "left_semi")
    events = cut(_events(members, policy).join(touched, "event").withColumn("lives", F.col("touch") <= F.col("expires")))

    alive = events.filter("lives")
    edges = joins.near_pairs(new, policy.km, policy.gap_seconds).unionByName(links.join(alive, "event", "left_semi").select("a", F.col("event").alias("b")))
    of = connected_components(edges).toDF("node", "component")
    stored = alive.join(of, F.col("event") == F.col("node")).select("event", "component", "first_t", "revision", "level")
    found = new.join(of, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id")).drop("node")
    heads = found.groupBy("component").agg(F.min_by("id", F.struct("fetched", "t", "id")).alias("opener"))
    heads = heads.join(stored.groupBy("component").agg(F.min_by(F.struct("event", "revision"), F.struct("first_t", "event")).alias("s")), "component", "left")
    heads = cut(heads.select("component", F.coalesce("s.event", "opener").alias("head"), (F.coalesce("s.revision", F.lit(0)) + 1).cast("long").alias("next")))

    into = stored.select("event", "component").join(heads, "component").select("event", "head", "next")
    moved = members.join(into, "event").select(*names, F.col("head").alias("event"), F.col("next").alias("revision"), "part")
    joined = found.join(heads, "component").select(*names, F.col("head").alias("event"), F.col("next").alias("revision"), "part")
    grown = moved.unionByName(joined)
    # one row an event holds what is true of all its members
    rated = fire.window_levels(grown, "event", F.col("t") * 1_000_000, "product", F.coalesce(F.col("high"), F.lit(False)), policy)
    now = rated.groupBy("event").agg(F.max("level").alias("level"), F.sort_array(F.collect_set("part")).alias("parts"))
    grown = grown.join(now, "event").withColumn("live", F.lit(True))
    lapsed = members.join(events.filter("NOT lives"), "event", "left_semi").withColumn("live", F.lit(False)).withColumn("revision", F.col("revision") + 1)
    columns = [*(c.split(" ")[0] for c in STATE.split(", ")), "part"]
    changed = cut(grown.select(*columns).unionByName(lapsed.select(*columns)))

    # whole parts: what didn't change in them goes along
    latest = new.agg(F.max("fetched")).first()[0]
    parts = F.broadcast(changed.select("part").distinct())  # at most all degree squares
    rest = state.join(changed.select("id"), "id", "left_anti").join(parts, "part", "left_semi")
    if latest is not None:
        rest = rest.filter(F.col("live") | (F.col("fetched") >= latest - remember_seconds))
    table.write(changed.unionByName(rest.select(*columns)), version)

    after = _events(changed.filter("live"), policy)
    none = F.lit(None).cast("string")
    said = after.withColumn("transition", F.when(F.col("revision") == 1, "created").otherwise("updated")).withColumn("into", none)
    merged = events.join(into.filter("event <> head"), "event").drop("next").withColumn("transition", F.lit("merged")).withColumnRenamed("head", "into")
    ended = events.filter("NOT lives").withColumn("transition", F.lit("expired")).withColumn("into", none)
    over = [x.withColumn("revision", F.col("revision") + 1) for x in (merged, ended)]
    order = [c.split(" ")[0] for c in TRANSITION.split(", ")]
    return cut(said.select(*order).unionByName(over[0].select(*order)).unionByName(over[1].select(*order)))


def expire(table: PartTable, version: int, now: int, limit: int = 100, policy: FirePolicy = FirePolicy()) -> DataFrame:
    """Ends the living events that are due, the first ``limit`` of them by expiry and name, and returns their transitions."""
    live = table.read(version).filter("live")
    due = cut(_events(live.select("event", "revision", "level", "t", "fetched"), policy).filter(F.col("expires") <= now).orderBy("expires", "event").limit(limit))
    ending = live.join(F.broadcast(due.select("event")), "event", "left_semi")  # at most ``limit`` rows
    parts = [r["part"] for r in ending.select(F.explode("parts").alias("part")).distinct().collect()]
    if parts:
        state = table.read(version, sorted(parts))
        ends = F.broadcast(due.select("event", F.lit(True).alias("ends")))
        ended = F.coalesce(F.col("ends"), F.lit(False)) & F.col("live")
        rows = state.join(ends, "event", "left").withColumn("revision", F.col("revision") + ended.cast("long")).withColumn("live", F.col("live") & ~ended)
        table.write(rows.select(*(c.split(" ")[0] for c in STATE.split(", ")), "part"), version)
    return due.select(
        "event", F.lit("expired").alias("transition"), F.lit(None).cast("string").alias("into"), (F.col("revision") + 1).alias("revision"), "level", "detections", "first_t", "last_t", "expires",
    )


def absorb(table: PartTable, batch: DataFrame, number: int, policy: FirePolicy = FirePolicy()) -> DataFrame:
    """Joins a batch of any span, slice by slice, and returns all transitions; ``number`` grows from batch to batch.

    A slice costs a few small jobs, so a long replay takes one for each linger of its span.
    """
    batch = cut(batch.select(*(F.col(c.split(" ")[0]).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in DETECTION.split(", "))))
    turn = F.floor(F.col("fetched") / policy.linger_seconds)
    turns = [r["turn"] for r in batch.select(turn.alias("turn")).distinct().orderBy("turn").collect()]
    if len(turns) > MOST_SLICES:
        raise ValueError(f"a batch was received over {len(turns)} times the linger")
    out = batch.sparkSession.createDataFrame([], TRANSITION)
    for k, at in enumerate(turns):
        out = out.unionByName(step(table, batch.filter(turn == at), number * MOST_SLICES + k, policy))
    return out


def fire_events(stream: DataFrame, table: PartTable, publish: Callable[[DataFrame, int], None], checkpoint: str, policy: FirePolicy = FirePolicy()):
    """Joins the batches of a stream of detections into the state and publishes the transitions of each."""
    return stream.writeStream.foreachBatch(lambda batch, number: publish(absorb(table, batch, number + 1, policy), number)).option("checkpointLocation", checkpoint)
