"""Readers of nested and plain-text inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASR_SCHEMA = (
    "results struct<channels: array<struct<alternatives: array<struct<transcript: string, "
    "words: array<struct<word: string, start: double, end: double, confidence: double, punctuated_word: string, speaker: string>>>>>>>"
)


def asr_words(responses: DataFrame, key: str, column: str) -> DataFrame:
    """A response's words, one row each, in order; responses without words give no rows."""
    parsed = responses.select(key, F.from_json(column, ASR_SCHEMA).alias("r"))
    words = F.get(F.get(F.col("r.results.channels"), F.lit(0))["alternatives"], F.lit(0))["words"]
    return parsed.select(key, F.posexplode(words).alias("p", "w")).select(key, F.col("p").cast("long").alias("pos"), "w.*")


def word_list(spark: SparkSession, path: str, least: int = 25_000) -> DataFrame | None:
    """Lower-cased single-token lines of a text file; None (disabled) with fewer than ``least`` forms."""
    forms = spark.read.text(path).select(F.lower(F.trim("value")).alias("token"))
    forms = forms.where((F.col("token") != "") & ~F.col("token").rlike(r"(?U)\s")).distinct()
    return forms if forms.limit(least).count() >= least else None


def dictionary_json(spark: SparkSession, path: str) -> DataFrame:
    """Entity records of a JSON array file."""
    return spark.read.option("multiLine", True).json(path)


def term_import(spark: SparkSession, path: str, existing: DataFrame, capacity: int = 10_000) -> DataFrame:
    """Lines of a user's file: term, outcome (added, invalid, duplicate, existing, over capacity), by first line."""
    from pyspark.sql import Window

    from ..functions.textfn import valid_term

    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    terms = lines.select("at", F.explode(F.split("value", ",")).alias("t")).select("at", F.trim("t").alias("term")).where("term <> ''")
    have = existing.select(F.lower("term").alias("key")).distinct().withColumn("had", F.lit(True))
    terms = terms.withColumn("key", F.lower("term")).join(have, "key", "left")
    first = Window.partitionBy("key").orderBy("at", "term")
    terms = terms.withColumn("n", F.row_number().over(first))
    outcome = F.when(~valid_term("term"), "invalid").when(F.col("had"), "existing").when(F.col("n") > 1, "duplicate").otherwise("added")
    terms = terms.select("at", "term", outcome.alias("outcome"))
    room = terms.where("outcome = 'added'").orderBy("at", "term").limit(max(0, capacity - existing.count()))
    kept = room.select("at", "term", F.lit(True).alias("room"))
    return terms.join(kept, ["at", "term"], "left").select("term", F.when((F.col("outcome") == "added") & F.col("room").isNull(), "over capacity").otherwise(F.col("outcome")).alias("outcome"))
