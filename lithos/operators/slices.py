"""Order-dependent results of keys that may hold most of a table: rows are sorted into slices, of which a key may have many.

A slice is a range of (key, order) that Spark's range partitioning draws from a sample, so a key with a third of all rows is spread
over a third of the slices. What a slice needs to know of those before it is one row a key and slice: a last value or a count.
Keys and slices together are few more than there are keys, as a slice adds at most one row to those of its keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.session import cut


def sliced(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with the number of each row's slice; numbers of a key's slices rise with the order, and rows that tie share one."""
    return cut(df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Keys are equal, nulls too."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"_{k}"]) for k in keys])


def _marked(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_{k}" for k in keys})


def carried(df: DataFrame, key: str, order: list[str], value: Column, name: str, before: bool = False) -> DataFrame:
    """``df`` with ``name``: of the rows at or (``before``) only before each, in its key, the last ``value`` that isn't null."""
    r = sliced(df.withColumn("_v", value), [key], order)
    w = Window.partitionBy("_slice", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    own = r.withColumn("_own", F.last("_v", ignorenulls=True).over(w))
    tails = r.groupBy(key, "_slice").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_tail"))
    up = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = _marked(tails.withColumn("_carry", F.last("_tail", ignorenulls=True).over(up)).drop("_tail"), [key, "_slice"])
    out = own.join(carry, _same(own, carry, [key, "_slice"]), "left")
    return out.select(*[own[c] for c in df.columns], F.coalesce("_own", "_carry").alias(name))


def order_statistics(df: DataFrame, keys: list[str], value: str, places: list[Column]) -> DataFrame:
    """(keys, n, values): of each key's values that aren't null, those at the places from 0, which are expressions of the number ``n``.

    Values are counted first, so one that a key has often is one row.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    r = sliced(counted, keys, ["_v"])
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    s = r.groupBy(*keys, "_slice").agg(F.sum("_c").alias("_rows"))
    s = s.withColumn("_start", F.coalesce(F.sum("_rows").over(upto), F.lit(0))).withColumn("n", F.sum("_rows").over(whole))
    asked = s.withColumn("_p", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), p.cast("long").alias("at")) for i, p in enumerate(places)])))
    asked = asked.filter((F.col("_p.at") >= F.col("_start")) & (F.col("_p.at") < F.col("_start") + F.col("_rows")))
    # only the slices that hold a place are gone through
    wanted = _marked(cut(asked.groupBy(*keys, "_slice", "_start", "n").agg(F.collect_list("_p").alias("_places"))), [*keys, "_slice"])
    rows = r.join(wanted, _same(r, wanted, [*keys, "_slice"])).select(*[r[c] for c in r.columns], "_start", "n", "_places")
    run = Window.partitionBy(*keys, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_end", F.col("_start") + F.sum("_c").over(run))
    hit = rows.select(*keys, "n", "_v", "_c", "_end", F.explode("_places").alias("_p")).filter((F.col("_p.at") < F.col("_end")) & (F.col("_p.at") >= F.col("_end") - F.col("_c")))
    values = F.transform(F.sort_array(F.collect_list(F.struct(F.col("_p.i").alias("i"), "_v"))), lambda x: x["_v"])
    return hit.groupBy(*keys).agg(F.first("n").alias("n"), values.alias("values"))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, n, quantiles): exact, linearly interpolated quantiles of each key's values that aren't null."""
    at = [F.lit(float(q)) * (F.col("n") - 1) for q in shares]
    found = order_statistics(df, keys, value, [f(p) for p in at for f in (F.floor, F.ceil)])

    def between(i: int, p: Column) -> Column:
        a, b = F.col("values")[2 * i], F.col("values")[2 * i + 1]
        return F.when(a == b, a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b).cast("double")

    return found.select(*keys, "n", F.array(*[between(i, p) for i, p in enumerate(at)]).alias("quantiles"))
