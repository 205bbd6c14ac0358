"""River discharge and rain: thresholds from climatology, outlooks and episodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions.geo import round_half_up
from lithos.operators import slices
from lithos.policies import FloodPolicy


def _with_quantiles(out: DataFrame, df: DataFrame, keys: list[str], value: str, shares: list[float], name: str) -> DataFrame:
    """``out``, one row a key, with an array of exact quantiles of each key's values; null without any."""
    q = slices.quantiles(df, keys, value, shares).drop("n").withColumnsRenamed({k: f"_{k}" for k in keys} | {"quantiles": name})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return out.join(q, on, "left").select(*out.columns, name)


def thresholds(df: DataFrame, keys: list[str], value: str, policy: FloodPolicy = FloodPolicy(), min_samples: int | None = None) -> DataFrame:
    """Exact, linearly interpolated percentiles of each key; NaN and null samples don't count.

    ``ok`` tells whether there are enough samples, none is negative or infinite, and the thresholds strictly increase above 0.
    """
    wrong = (F.col(value) < 0) | (F.col(value) == float("inf"))
    v = F.when(~F.isnan(value) & ~wrong, F.col(value))
    names = ["p" + f"{100 * x:g}".replace(".", "_") for x in policy.quantiles]
    out = df.groupBy(*keys).agg(F.count(v).alias("samples"), F.count_if(wrong).alias("_wrong"))
    out = _with_quantiles(out, df.withColumn("_value", v), keys, "_value", list(policy.quantiles), "_q")
    for i, n in enumerate(names):
        out = out.withColumn(n, F.col("_q")[i])
    rising = F.lit(True)
    for a, b in zip(names[1:], names[2:], strict=False):
        rising = rising & (F.col(a) < F.col(b))
    return out.withColumn("ok", (F.col("_wrong") == 0) & (F.col("samples") >= (policy.min_samples if min_samples is None else min_samples)) & (F.col(names[1]) > 0) & rising).drop("_q", "_wrong")


def nearest_rank(df: DataFrame, keys: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """The element at place ceil(q * n)."""
    places = [F.greatest(F.ceil(F.lit(float(q)) * F.col("n")) - 1, F.lit(0)) for q in quantiles]
    found = slices.order_statistics(df, keys, value, places).withColumnsRenamed({k: f"_{k}" for k in keys})
    own = df.select(*keys).distinct()
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return own.join(found, on, "left").select(*keys, *[F.col("values")[i].alias("r" + f"{100 * q:g}".replace(".", "_")) for i, q in enumerate(quantiles)])


def annual_maxima(df: DataFrame, keys: list[str], day: str, value: str, min_days: int) -> DataFrame:
    """Each year's highest value and its first day, for years with enough days."""
    v = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    out = v.groupBy(*keys, F.year(day).alias("year")).agg(F.count(F.lit(1)).alias("days"), F.max(value).alias("maximum"), F.min_by(day, F.struct(-F.col(value), F.col(day))).alias("on_day"))
    return out.filter(F.col("days") >= min_days)


def median_of_maxima(maxima: DataFrame, keys: list[str]) -> DataFrame:
    return maxima.groupBy(*keys).agg(F.percentile("maximum", F.lit(0.5)).alias("median_maximum"))


def bias_ratio(df: DataFrame, keys: list[str], model: str, reference: str, policy: FloodPolicy = FloodPolicy()) -> DataFrame:
    """Ratio of the two p98 over common days (null if the reference's isn't positive), and the factor for thresholds."""
    both = df.filter(F.col(model).isNotNull() & F.col(reference).isNotNull())
    out = both.select(*keys).distinct()
    for name, c in (("_m", model), ("_r", reference)):
        out = _with_quantiles(out, both, keys, c, [0.98], name).withColumn(name, F.col(name)[0])
    ratio = F.when(F.col("_r") > 0, F.col("_m") / F.col("_r"))
    return out.withColumn("ratio", ratio).drop("_m", "_r").withColumn("correction", F.when(F.col("ratio") < policy.bias_cutoff, F.col("ratio")).otherwise(1.0))


def top_days(df: DataFrame, keys: list[str], day: str, value: str, n: int = 5) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(day))
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def rolling_day_maxima(df: DataFrame, keys: list[str], hour: str, value: str, hours: int) -> DataFrame:
    """The largest sum over ``hours`` full hours that end on each day; ``hour`` counts hours since the epoch.

    A window may begin on the day before; one that lacks an hour doesn't count. Sums are rounded to 9 decimals.
    """
    w = Window.partitionBy(*keys).orderBy(hour).rangeBetween(-(hours - 1), 0)
    s = df.withColumn("_s", F.sum(value).over(w)).withColumn("_c", F.count(value).over(w)).filter(F.col("_c") == hours)
    return s.groupBy(*keys, F.floor(F.col(hour) / 24).alias("epoch_day")).agg(F.max(round_half_up(F.col("_s"), 9)).alias("day_max"))


def outlook(days: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Highest level, its first day, and possible only if all days at that level are merely possible."""
    top = days.groupBy(*keys).agg(F.max("level").alias("level"), F.min_by(date, F.struct(-F.col("level"), F.col(date))).alias("peak_date"), F.collect_list(F.struct("level", "possible")).alias("_d"))
    same = F.filter("_d", lambda x: x["level"] == F.col("level"))
    return top.withColumn("possible", F.forall(same, lambda x: x["possible"])).drop("_d")


def episodes(runs: DataFrame, site: str, at: str, exceeds: Column, linger: int) -> DataFrame:
    """Runs that exceed, with the number of their episode: a new one opens when the last exceedance is ``linger`` or more ago."""
    w = Window.partitionBy(site).orderBy(at)
    hit = runs.filter(exceeds)
    new = F.coalesce(F.col(at) - F.lag(at).over(w) >= linger, F.lit(True))
    return hit.withColumn("_new", new.cast("int")).withColumn("episode", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def episode_summary(found: DataFrame, site: str, at: str, level: str, linger: int) -> DataFrame:
    return found.groupBy(site, "episode").agg(F.min(at).alias("opened"), F.max(at).alias("last_exceeded"), (F.max(at) + linger).alias("expires"), F.max(level).alias("level"), F.count(F.lit(1)).alias("runs"))


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str, n_cells: int | None = None, digits: int = 3) -> DataFrame:
    """Area-weighted mean; with ``n_cells``, keys that lack a cell drop out."""
    v = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(value))
    out = df.groupBy(*keys).agg(F.sum(v * F.col(weight)).alias("_s"), F.sum(F.when(v.isNotNull(), F.col(weight))).alias("_w"), F.count(v).alias("cells"))
    if n_cells is not None:
        out = out.filter(F.col("cells") == n_cells)
    return out.withColumn("mean", round_half_up(F.col("_s") / F.col("_w"), digits)).drop("_s", "_w")


def river_cells(df: DataFrame, keys: list[str], value: str, min_days: int) -> DataFrame:
    """Mean of the values rounded to 4 decimals; cells with too few days lose theirs."""
    v = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(value))
    out = df.groupBy(*keys).agg(F.avg(v).alias("_m"), F.count(v).alias("days"))
    return out.withColumn("mean", F.when(F.col("days") >= min_days, round_half_up(F.col("_m"), 4))).drop("_m")


def smaller_downstream(df: DataFrame, river: str, order: str, value: str) -> DataFrame:
    """Stations whose predecessor in the river's list has a larger mean."""
    w = Window.partitionBy(river).orderBy(order)
    return df.withColumn("smaller_than_upstream", F.coalesce(F.lag(value).over(w) > F.col(value), F.lit(False)))


def main_stem(cells: DataFrame, station: str, share: float = 0.3) -> DataFrame:
    """Of each station's candidate cells (mean, distance, lat, lon): the nearest with a mean of at least ``share`` of the largest."""
    w = Window.partitionBy(station)
    ok = cells.withColumn("_top", F.max("mean").over(w)).filter(F.col("mean") >= share * F.col("_top")).drop("_top")
    pick = w.orderBy("distance", F.desc("mean"), "lat", "lon")
    return ok.withColumn("_n", F.row_number().over(pick)).filter("_n = 1").drop("_n")


def candidate_offsets(stations: DataFrame, k: int, step: float) -> DataFrame:
    """The (2k + 1) squared grid around each station."""
    s = F.sequence(F.lit(-k), F.lit(k))
    out = stations.withColumn("dy", F.explode(s)).withColumn("dx", F.explode(s))
    return out.withColumn("cell_lat", round_half_up(F.col("lat") + F.col("dy") * step, 4)).withColumn("cell_lon", round_half_up(F.col("lon") + F.col("dx") * step, 4))


def running_sums(df: DataFrame, keys: list[str], hour: str, value: str, hours: int) -> DataFrame:
    """The sum over ``hours`` full hours of each row, fresh and as a difference of running totals; both rounded to 9 decimals."""
    w = Window.partitionBy(*keys).orderBy(hour)
    s = df.withColumn("_all", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    frame = w.rangeBetween(-(hours - 1), 0)
    s = s.withColumn("_c", F.count(value).over(frame)).withColumn("fresh", round_half_up(F.sum(value).over(frame), 9))
    first = F.first(F.col("_all") - F.col(value)).over(w.rowsBetween(-(hours - 1), 0))
    return s.withColumn("running", round_half_up(F.col("_all") - first, 9)).filter(F.col("_c") == hours).drop("_all", "_c")
