"""Connected components by alternating large-star and small-star steps; edges stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside_key, drop_saved, saved


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least of u and its neighbours as m."""
    return beside_key(edges, "u", ["v"], {"m": F.least("u", F.min("v"))})


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of longs to (node, comp): every node with an edge and the smallest node it reaches.

    Loops and repeated edges are ignored; no edges give no rows. Hot nodes are pre-aggregated
    before each shuffle and salted in the joins.
    """
    now = saved(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while True:
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            now.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.agg(F.count_if(F.expr("up > 1 or up > 0 and down > 0"))).first()[0]:  # stars only
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
            )
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _least(large).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            large.groupBy("u").agg(F.min("v").alias("v"))
        )
        then = saved(small.where("u <> v").distinct())
        drop_saved(now)
        now = then
