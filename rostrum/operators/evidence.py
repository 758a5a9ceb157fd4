"""Evidence of corrections: entries of every stage in one table, vetoed or applied."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Stages in their order.
STAGES = ("rule", "year", "llm")


def entries(stages: dict[str, DataFrame], key: str, pair: str, place: str, vetoes: DataFrame) -> DataFrame:
    """(key, pair, pos, stage, outcome) of the corrections of every stage.

    A correction is vetoed if exactly one veto of its key names its pair, white space and case aside.
    """
    rows = [df.select(key, F.col(pair).alias("pair"), F.col(place).alias("pos"), F.lit(name).alias("stage")) for name, df in stages.items()]
    every = reduce(DataFrame.unionByName, rows).withColumn("k", F.lower(F.trim("pair")))
    one = vetoes.groupBy(key, F.lower(F.trim(pair)).alias("k")).agg(F.count("*").alias("vetoes")).where("vetoes = 1")
    return every.join(one, [key, "k"], "left").select(key, "pair", "pos", "stage", F.when(F.col("vetoes") == 1, "vetoed").otherwise("applied").alias("outcome"))


def grouped(rows: DataFrame, key: str) -> DataFrame:
    """Counts by stage and outcome of each key, in the order of display: vetoed ones first, then by stage."""
    order = F.create_map(*(F.lit(x) for k, s in enumerate(STAGES) for x in (s, k)))
    groups = rows.groupBy(key, "stage", "outcome").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    at = Window.partitionBy(key).orderBy(F.col("outcome") == "applied", order[F.col("stage")])
    return groups.withColumn("rank", F.row_number().over(at))
