"""Joins that the optimizer has no rule for, as equi joins on buckets with an exact condition beside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions.geo import haversine_km
from lithos.operators import slices
from lithos.policies import EPSILON, MatchRule
from lithos.session import spread as over_cores


def band_join(left: DataFrame, right: DataFrame, on_left: Column, on_right: Column, width: float, condition: Column, how: str = "inner", equal: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rows with |on_left - on_right| <= width and ``condition``.

    Both sides get a bucket of ``width``; the left side looks in its own and the two next
    to it, so the plan is a hash or sort-merge join and never a nested loop. A pair
    meets in one bucket only. For semi and anti joins the right side is repeated instead.
    """
    spread = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    bl, br = F.floor(on_left / width).cast("long"), F.floor(on_right / width).cast("long")
    if how in ("left_semi", "left_anti"):
        l, r = left.withColumn("_bl", bl), right.withColumn("_s", spread).withColumn("_br", br + F.col("_s")).drop("_s")
    elif how == "inner":
        l, r = left.withColumn("_s", spread).withColumn("_bl", bl + F.col("_s")).drop("_s"), right.withColumn("_br", br)
    else:
        raise ValueError(how)
    on = (F.col("_bl") == F.col("_br")) & (F.abs(on_left - on_right) <= width) & condition
    for a, b in equal or []:
        on = on & (F.col(a) == F.col(b))
    return l.join(r, on, how).drop("_bl", "_br")


def quake_match(rule: MatchRule, a: str = "a_", b: str = "b_") -> tuple[Column, Column]:
    """(matches, score) of two records whose columns have these prefixes; time in seconds."""
    dt = F.abs(F.col(f"{a}t") - F.col(f"{b}t"))
    dm = F.abs(F.col(f"{a}mag") - F.col(f"{b}mag"))
    km = haversine_km(F.col(f"{a}lat"), F.col(f"{a}lon"), F.col(f"{b}lat"), F.col(f"{b}lon"))
    ok = (dt <= rule.seconds) & (dm <= rule.magnitude + EPSILON) & (km <= rule.km + EPSILON)
    return ok, dt / rule.seconds + km / rule.km + dm / rule.magnitude


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def matches(left: DataFrame, right: DataFrame, rule: MatchRule, how: str = "inner") -> DataFrame:
    """Records (id, t, lat, lon, mag) of two sources that match; inner joins have a score.

    They meet by an equi join on cells of time, latitude and longitude, twice as wide as the rule, so the
    candidates of a record are those near it in time *and* place. One side stands in the cells that its
    neighbourhood touches (two at most of each kind, but for places near a pole), the other in its own; for
    semi and anti joins the right side is spread instead. Cells of longitude close around the globe.
    """
    ok, score = quake_match(rule)
    a, b = prefixed(over_cores(left), "a_"), prefixed(over_cores(right), "b_")
    cell_t, cell_y = 2.0 * max(rule.seconds, 1e-3), max(2.0 * rule.km / 110.5, 1e-6)
    around = max(1, int(360 // cell_y))
    cell_x = 360.0 / around

    def column(x: Column) -> Column:
        return F.pmod(F.floor(x / cell_x), F.lit(around))

    def own(df: DataFrame, p: str) -> DataFrame:
        return df.withColumn("_ct", F.floor(F.col(f"{p}t") / cell_t)).withColumn("_cy", F.floor(F.col(f"{p}lat") / cell_y)).withColumn("_cx", column(F.col(f"{p}lon")))

    def spread(df: DataFrame, p: str) -> DataFrame:
        t, lat, lon = F.col(f"{p}t"), F.col(f"{p}lat"), F.col(f"{p}lon")
        dlat = rule.km / 110.5 + EPSILON
        dlon = F.lit(dlat) / F.greatest(F.cos(F.radians(F.least(F.abs(lat) + dlat, F.lit(89.9)))), F.lit(1e-3))
        whole = (F.abs(lat) + dlat >= 89.9) | (2 * dlon + cell_x >= 360)
        some = F.sequence(F.floor((lon - dlon) / cell_x), F.floor((lon + dlon) / cell_x))
        xs = F.array_distinct(F.transform(F.when(whole, F.sequence(F.lit(0).cast("long"), F.lit(around - 1).cast("long"))).otherwise(some), lambda x: F.pmod(x, F.lit(around))))
        out = df.withColumn("_ct", F.explode(F.sequence(F.floor((t - rule.seconds) / cell_t), F.floor((t + rule.seconds) / cell_t))))
        out = out.withColumn("_cy", F.explode(F.sequence(F.floor((lat - dlat) / cell_y), F.floor((lat + dlat) / cell_y))))
        return out.withColumn("_cx", F.explode(xs))

    cells = ["_ct", "_cy", "_cx"]
    if how == "inner":
        out = spread(a, "a_").join(own(b, "b_"), cells).filter(ok).drop(*cells)
        return out.withColumn("score", score)
    if how not in ("left_semi", "left_anti"):
        raise ValueError(how)
    l = own(a, "a_")
    r = spread(b, "b_")
    r = r.withColumnsRenamed({c: c + "r" for c in cells})
    on = ok
    for c in cells:
        on = on & (F.col(c) == F.col(c + "r"))
    return l.join(r, on, how).drop(*cells)


def best_match(left: DataFrame, right: DataFrame, rule: MatchRule) -> DataFrame:
    """The lowest score of each left record; ties to the smaller right id."""
    w = Window.partitionBy("a_id").orderBy("score", "b_id")
    return matches(left, right, rule).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def same_source_pairs(df: DataFrame, rule: MatchRule) -> DataFrame:
    """Pairs within one source, each once, the earlier (time, id) first."""
    out = matches(df, df, rule)
    return out.filter((F.col("a_t") < F.col("b_t")) | ((F.col("a_t") == F.col("b_t")) & (F.col("a_id") < F.col("b_id"))))


def shifted_match_rates(left: DataFrame, right: DataFrame, rule: MatchRule, shifts: list[int]) -> DataFrame:
    """How many left records match a right one by chance, with their time shifted by so many seconds."""
    s = F.explode(F.array(*[F.lit(x) for x in shifts]))
    moved = left.withColumn("shift", s).withColumn("t", F.col("t") + F.col("shift"))
    n = left.count()
    hit = matches(moved, right, rule, "left_semi").groupBy(F.col("a_shift").alias("shift")).agg(F.count(F.lit(1)).alias("hits"))
    spine = left.sparkSession.createDataFrame([(x,) for x in shifts], "shift int")
    return spine.join(hit, "shift", "left").select("shift", F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("hits", F.lit(0)) * 1000.0 / max(1, n)).alias("per_thousand"))


def mask(points: DataFrame, circles: DataFrame, keep: bool = True, cell: float = 0.05) -> DataFrame:
    """Points outside all circles (keep) or the first circle, by list position, of each point inside one.

    Circles (pos, c_lat, c_lon, radius_km) are spread over the grid cells that they touch, so
    the join is on cells, whatever the number of circles.
    """
    dlat = F.col("radius_km") / 110.5
    dlon = F.col("radius_km") / (110.5 * F.greatest(F.cos(F.radians(F.least(F.abs("c_lat") + dlat, F.lit(89.0)))), F.lit(0.01)))

    def cells(c: Column, d: Column) -> Column:
        return F.explode(F.sequence(F.floor((c - d) / cell), F.floor((c + d) / cell)))

    spread = circles.withColumn("_cy", cells(F.col("c_lat"), dlat)).withColumn("_cx", cells(F.col("c_lon"), dlon))
    at = points.withColumn("_py", F.floor(F.col("lat") / cell)).withColumn("_px", F.floor(F.col("lon") / cell))
    on = (F.col("_py") == F.col("_cy")) & (F.col("_px") == F.col("_cx")) & (haversine_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon")) <= F.col("radius_km"))
    if keep:
        return at.join(spread, on, "left_anti").drop("_py", "_px")
    found = at.join(spread, on)
    return found.groupBy(*points.columns).agg(F.min("pos").alias("circle"))


def near_pairs(points: DataFrame, km: float, seconds: int, cell_time: str = "t", apart: str | None = None) -> DataFrame:
    """Pairs (a, b) of points (id, t, lat, lon) within both distances, ends included; for the clustering of fires.

    With ``apart`` only pairs that differ in that column.

    Cells are as wide as the distance and buckets as long as the gap, so partners are in the same cell or one of its
    26 neighbours. A point looks in its own and in the half of them that come after it: each pair is met once.
    """
    cy = km / 110.5
    lat_cell = F.floor(F.col("lat") / cy)
    p = over_cores(points).select("id", F.col(cell_time).alias("t"), "lat", "lon", lat_cell.alias("y"), F.floor(F.col(cell_time) / seconds).alias("k"), *([F.col(apart).alias("apart")] if apart else []))
    # degrees of longitude shrink with latitude: a band of cells has the width its poleward edge needs
    band = F.least(F.greatest(F.abs(F.col("y") - 1), F.abs(F.col("y") + 2)) * cy, F.lit(89.0))
    cx = km / (110.5 * F.cos(F.radians(band)))
    steps = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    a = p.select(*[F.col(c).alias(f"a_{c}") for c in p.columns], F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(y).alias("y")) for k, y in steps])).alias("s"))
    a = a.withColumn("y", F.col("a_y") + F.col("s.y")).withColumn("k", F.col("a_k") + F.col("s.k"))
    own = (F.col("s.k") == 0) & (F.col("s.y") == 0)
    a = a.withColumn("d", F.explode(F.when(own, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(-1), F.lit(0), F.lit(1)))))
    a = a.withColumn("x", F.floor(F.col("a_lon") / cx) + F.col("d")).withColumn("here", own & (F.col("d") == 0)).drop("s", "d")
    b = p.select(*[F.col(c).alias(f"b_{c}") for c in p.columns], "y", "k").withColumn("x", F.floor(F.col("b_lon") / cx))
    j = a.join(b, ["y", "k", "x"]).filter(~F.col("here") | (F.col("a_id") < F.col("b_id")))
    j = j.filter("a_apart <> b_apart") if apart else j
    ok = (F.abs(F.col("a_t") - F.col("b_t")) <= seconds) & (haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) <= km)
    return j.filter(ok & (F.col("a_id") != F.col("b_id"))).select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))


def near_between(left: DataFrame, right: DataFrame, km: float, seconds: int) -> DataFrame:
    """Pairs (a, b) of a left and a right point (id, t, lat, lon) within both distances, ends included.

    Left points look in the 27 cells of place and time around them, right points stand in their own.
    """
    cy = km / 110.5
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])

    def width(y: Column) -> Column:
        # of a cell of longitude, as the poleward edge of its band needs
        return km / (110.5 * F.cos(F.radians(F.least(F.greatest(F.abs(y - 1), F.abs(y + 2)) * cy, F.lit(89.0)))))

    def own(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{name}_{c}") for c in ("id", "t", "lat", "lon")], F.floor(F.col("lat") / cy).alias("y"), F.floor(F.col("t") / seconds).alias("k"))

    a = own(over_cores(left), "a").withColumn("y", F.explode(F.transform(steps, lambda d: F.col("y") + d))).withColumn("k", F.explode(F.transform(steps, lambda d: F.col("k") + d)))
    a = a.withColumn("x", F.explode(F.transform(steps, lambda d: F.floor(F.col("a_lon") / width(F.col("y"))) + d)))
    b = own(right, "b").withColumn("x", F.floor(F.col("b_lon") / width(F.col("y"))))
    ok = (F.abs(F.col("a_t") - F.col("b_t")) <= seconds) & (haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) <= km)
    return a.join(b, ["y", "k", "x"]).filter(ok).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def lookup_or_reject(df: DataFrame, table: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(joined rows, rows without an entry): a missing entry is an error and never a silent drop."""
    j = df.join(table.withColumn("_found", F.lit(True)), on, "left")
    return j.filter("_found").drop("_found"), df.join(table, on, "left_anti")


def as_of(left: DataFrame, right: DataFrame, key: str, at_left: str, at_right: str, value: str) -> DataFrame:
    """Each left row with the value of the newest right row at or before it, in the same key.

    Both sides are sorted into slices of time, so neither is repeated and a key that holds most rows is many tasks.
    """
    l = left.select("*", F.col(at_left).alias("_t"), F.lit(1).alias("_o"), F.lit(None).cast(right.schema[value].dataType).alias("_r"))
    r = right.select(F.col(key), F.col(at_right).alias("_t"), F.lit(0).alias("_o"), F.col(value).alias("_r"))
    both = l.unionByName(r, allowMissingColumns=True)
    return slices.carried(both, key, ["_t", "_o"], F.col("_r"), value).filter("_o = 1").drop("_t", "_o", "_r")


def positional(left: DataFrame, right: DataFrame, order: str = "pos") -> DataFrame:
    """The i-th response with the i-th request."""
    return left.join(right, order)


def day_spine(df: DataFrame, start: str, days: int, keys: list[str], date: str) -> DataFrame:
    """Each key's days from ``start`` on, with its row of the day or nulls."""
    spine = df.select(*keys, start).distinct().withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(days))))
    spine = spine.withColumn(date, F.date_add(start, F.col("_d"))).drop("_d")
    return spine.join(df.drop(start), [*keys, date], "left")


def for_pairs(df: DataFrame, requests: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows of ``df`` for parallel arrays of values: each request's i-th values of the arrays name the columns' values of a row.

    ``columns``: column of ``df`` by array of ``requests``; other columns of a request come along.
    """
    zipped = F.arrays_zip(*[F.col(a).alias(c) for a, c in columns.items()])
    rest = [c for c in requests.columns if c not in columns]
    asked = requests.select(*rest, F.explode(zipped).alias("_z")).select(*rest, *[F.col(f"_z.{c}").alias(c) for c in columns.values()])
    return asked.join(df, list(columns.values()))


def candidates(reports: DataFrame, members: DataFrame, seconds: float) -> DataFrame:
    """(id, event) of the events that a report may join: those with a member near it in time, and its home.

    ``reports``: id, t, home; ``members``: event, m_t.
    """
    near = band_join(reports.select("id", "t"), members.select("event", "m_t"), F.col("t"), F.col("m_t"), seconds, F.lit(True))
    home = reports.filter("home IS NOT NULL").select("id", F.col("home").alias("event"))
    return near.select("id", "event").union(home).distinct()


def recorded_checks(recorded: DataFrame, events: DataFrame, before_days: int = 1, after_days: int = 2) -> DataFrame:
    """Recorded fires (fire, day, lat, lon, radius_km) with how many events (first_day, lat, lon, level) began from a day before to two days after within their radius, and the highest level."""
    e = events.select("first_day", F.col("lat").alias("e_lat"), F.col("lon").alias("e_lon"), "level")
    spine = recorded.withColumn("first_day", F.explode(F.sequence(F.date_sub("day", before_days), F.date_add("day", after_days))))
    hit = spine.join(e, "first_day").filter(haversine_km(F.col("lat"), F.col("lon"), F.col("e_lat"), F.col("e_lon")) <= F.col("radius_km"))
    found = hit.groupBy("fire").agg(F.count(F.lit(1)).alias("events"), F.max("level").alias("level"))
    return recorded.join(found, "fire", "left").select("fire", F.coalesce("events", F.lit(0)).alias("events"), "level")
