"""Exact quantiles of keys of any size by selection: rounds of histograms narrow each wanted rank to few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .steps import written

BINS = 1_024  # of a histogram; a key and a rank have so many counts a round at most
FEW = 10_000  # rows of a key that are sorted at once to pick the rank


def _bin():
    """The bin of ``v`` between ``lo`` and ``hi``, rising with v; halves, so that no difference overflows."""
    share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    return F.when(F.col("hi") / 2 > F.col("lo") / 2, F.least(F.floor(share * BINS), F.lit(BINS - 1))).otherwise(F.when(F.col("v") > F.col("lo"), BINS - 1).otherwise(0)).cast("int")


def values_at(rows: DataFrame, wanted: DataFrame, keys: list[str], value: str, few: int = FEW) -> DataFrame:
    """keys, rank, value: the value at each wanted rank (keys, rank from 0) of its key's sorted values.

    Each round counts a key's values in bins between the least and greatest that a rank can still be, with the
    bins' own extremes, and goes on with the bin that holds the rank: counts meet before they are exchanged,
    so a key that holds all rows sends BINS counts a task. A rank is done when its bin has one value, or
    no more than ``few`` rows, which are sorted. Nulls, NaN and infinite values do not count; null keys are a
    key; ranks outside a key give no row. Rounds re-read the rows: as many as it takes, mostly one or two.
    """
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    v = F.col(value).cast("double")
    rows = rows.select(*keys, v.alias("v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    extent = rows.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    asked = wanted.select(*keys, "rank").distinct().alias("w")
    # ``at`` is the rank among the n rows between lo and hi
    todo = written(extent.alias("x").join(asked, same("x", "w")).where("rank >= 0 AND rank < n").select(*(F.col(f"w.{k}") for k in keys), "rank", F.col("rank").alias("at"), "lo", "hi", "n"))
    done = todo.where("lo = hi").select(*keys, "rank", F.col("lo").alias("value"))
    while True:
        todo = todo.where("lo < hi")
        large = todo.where(F.col("n") > few)
        within = lambda t: rows.alias("r").join(t.alias("t"), [*same("r", "t"), F.col("v").between(F.col("lo"), F.col("hi"))]).select(*(F.col(f"t.{k}") for k in keys), "rank", "at", "lo", "hi", "v")
        sort = Window.partitionBy(*keys, "rank").orderBy("v")
        small = within(todo.where(F.col("n") <= few)).withColumn("i", F.row_number().over(sort) - 1).where("i = at").select(*keys, "rank", F.col("v").alias("value"))
        done = done.unionByName(small)
        if large.isEmpty():
            return done
        bins = within(large).groupBy(*keys, "rank", "at", _bin().alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.sum("n").over(Window.partitionBy(*keys, "rank").orderBy("bin")) - F.col("n")
        held = bins.withColumn("before", before).where("at >= before AND at < before + n")
        todo = written(held.select(*keys, "rank", (F.col("at") - F.col("before")).alias("at"), "lo", "hi", "n"))
        done = done.unionByName(todo.where("lo = hi").select(*keys, "rank", F.col("lo").alias("value")))


def quantiles(rows: DataFrame, keys: list[str], value: str, share: float, between: bool = True, few: int = FEW) -> DataFrame:
    """keys, n, quantile: each key's exact quantile, interpolated between neighbours, or the first value that reaches the share.

    ``n`` counts what ``values_at`` counts; keys without such values have n 0 and a null quantile.
    """
    v = F.col(value).cast("double")
    counted = written(rows.groupBy(*keys).agg(F.count_if(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).alias("n")))
    place = (F.col("n") - 1) * F.lit(share) if between else F.greatest(F.ceil(F.round(F.col("n") * F.lit(share), 9)) - 1, F.lit(0)).cast("double")
    placed = counted.withColumns({"low": F.floor(place), "part": place - F.floor(place)})
    ranks = placed.where("n > 0").select(*keys, F.explode(F.array("low", F.least(F.col("low") + 1, F.col("n") - 1))).alias("rank"))
    found = values_at(rows, ranks, keys, value, few).alias("f")
    p = placed.alias("p")
    met = p.join(found, [*(F.col(f"p.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys), F.col("rank").between(F.col("low"), F.col("low") + 1)], "left")
    low, high = (F.max(F.when(F.col("rank") == F.col("low") + i, F.col("value"))) for i in (0, 1))
    mid = F.when(F.col("part") > 0, low * (1 - F.col("part")) + F.coalesce(high, low) * F.col("part")).otherwise(low)
    return met.groupBy(*(F.col(f"p.{k}").alias(k) for k in keys), "n", "part").agg(mid.alias("quantile")).drop("part")
