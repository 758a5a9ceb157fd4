"""The index of names: every kind of key that a strategy looks up, with its owner, in one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import textfn as T

#: Kinds of keys, one for each way in which a span is looked up.
KEY_KINDS = ("text", "fused", "phonetic", "component", "surname", "initials")
INDEX = "key_kind string, key string, canonical string, kind string, type string, abbreviation string, load long, place int, fanout long"


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all tasks: its rows are few bytes and much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def words(c) -> Column:
    return F.filter(F.split(F.trim(c), T.U + r"\s+"), lambda w: w != "")


def initials_key(c) -> Column:
    """A span with the spaces around its full stops dropped and the others made full stops: "K. Ofori-Atta" is "k.ofori-atta"."""
    joined = F.regexp_replace(F.regexp_replace(F.lower(c), T.U + r"\s*\.\s*", "."), " ", ".")
    return F.regexp_replace(joined, r"\.$", "")


def name_index(records: DataFrame, aliases: DataFrame, kinds: tuple[str, ...] = KEY_KINDS) -> DataFrame:
    """key_kind, key, canonical, kind, type, abbreviation, load, place, fanout: who owns each key, of ``kinds`` of keys.

    ``records`` has id, canonical, kind, type, abbreviation, last_wins, load (its position in the load, each
    its own), ``aliases`` id, alias, place (from 0). Records load in their order, the canonical before its
    aliases. A canonical takes its own text only if it is free, and so does an alias, but that of a record
    that wins last takes it in any case; (load, place) of a text tells who had it first. A fused text belongs
    to the last who took one of its texts. Phonetic keys are those of canonicals that took their own text and
    of supplementary records' aliases; such a key has a row for each name, ``fanout`` of them. A component is
    a word of the texts of one name only. Persons of two words and more have surnames (the last word, and
    hyphenated ones) and initials before their last word; the first loaded owns them. Names count as what
    their first record says; blank texts have no keys.
    """
    own = records.select("canonical", F.col("canonical").alias("text"), "load", F.lit(-1).alias("place"), F.lit(False).alias("last"))
    more = aliases.join(records, "id").select("canonical", F.col("alias").alias("text"), "load", "place", F.col("last_wins").alias("last"))
    writes = own.unionByName(more).select(F.lower("text").alias("key"), "text", "canonical", "last", F.struct("load", "place").alias("at")).where("trim(key) <> ''")
    held = writes.groupBy("key").agg(
        F.min(F.struct("at", "canonical")).alias("first"), F.max(F.when(F.col("last"), F.struct("at", "canonical"))).alias("last")
    )
    texts = held.select("key", F.coalesce("last.canonical", "first.canonical").alias("canonical"), "first.at.*")
    taken = held.select("key", "first.at", "first.canonical").unionByName(writes.where("last").select("key", "at", "canonical"))
    fused = taken.groupBy(T.fuse("key").alias("key")).agg(F.max_by("canonical", F.struct("at.load", "at.place")).alias("canonical")).where("key <> ''")

    # names by sound: where a name's own text stands first, that is its position
    sounding = held.where("first.at.place = -1").select(F.col("first.canonical").alias("canonical"), F.col("first.canonical").alias("text"))
    spelled = aliases.join(records.where("type = 'supplementary'"), "id").select("canonical", F.col("alias").alias("text"))
    sounds = spread(sounding.unionByName(spelled)).select(T.phonetic_key(F.lower("text")).alias("key"), "canonical").where("key <> ''").distinct()
    fanout = sounds.groupBy("key").agg(F.count("*").alias("fanout"))
    first_at = held.select(F.col("key").alias("low"), "first.at.*")
    sounds = sounds.join(fanout, "key").join(first_at, F.lower("canonical") == F.col("low"), "left").drop("low")

    parts = writes.select(F.explode(words("key")).alias("key"), "canonical").distinct()
    parts = parts.groupBy("key").agg(F.count("*").alias("fanout"), F.min("canonical").alias("canonical")).where("fanout = 1")

    people = records.where("kind = 'person'").select("canonical", "load", words("canonical").alias("w")).where("size(w) >= 2")
    last = F.lower(F.element_at("w", -1))
    surnames = people.select("canonical", "load", F.explode(F.array_distinct(F.concat(F.array(last), F.transform(F.filter("w", lambda x: x.contains("-")), F.lower)))).alias("key"))
    letters = F.transform(F.slice("w", 1, F.size("w") - 1), lambda x: F.lower(F.substring(x, 1, 1)))
    several = F.when(F.size(letters) >= 2, F.array(F.array_join(letters, "."))).otherwise(F.array().cast("array<string>"))
    shapes = F.transform(F.array_distinct(F.concat(letters, several)), lambda x: F.concat_ws(".", x, last))
    initials = people.select("canonical", "load", F.explode(shapes).alias("key"))
    owner = lambda rows: rows.groupBy("key").agg(F.min(F.struct("load", "canonical")).alias("o")).select("key", "o.*")

    rows = {"text": texts, "fused": fused, "phonetic": sounds, "component": parts, "surname": owner(surnames), "initials": owner(initials)}
    made = [df.withColumn("key_kind", F.lit(kind)) for kind, df in rows.items() if kind in kinds]
    index = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made)
    what = records.groupBy("canonical").agg(
        F.min_by(F.struct("kind", "type"), "load").alias("what"), F.min_by("abbreviation", F.when(F.col("abbreviation").isNotNull() & (F.col("kind") == "party"), F.col("load"))).alias("abbreviation")
    )
    lacking = {"load": "long", "place": "int", "fanout": "long"}  # some kinds of keys have none of these
    index = index.withColumns({c: F.lit(None).cast(t) for c, t in lacking.items() if c not in index.columns})
    out = index.join(what.select("canonical", "what.*", "abbreviation"), "canonical")
    return out.select("key_kind", "key", "canonical", "kind", "type", "abbreviation", "load", F.col("place").cast("int").alias("place"), F.coalesce("fanout", F.lit(1).cast("long")).alias("fanout"))


def write_index(index: DataFrame, name: str, buckets: int = 64) -> DataFrame:
    """The index as a table partitioned by kind of key and bucketed by key, so that look-ups by key need no exchange of it."""
    index.write.partitionBy("key_kind").bucketBy(buckets, "key").sortBy("key").mode("overwrite").saveAsTable(name)
    return index.sparkSession.table(name)


def keys_of(index: DataFrame, kind: str) -> DataFrame:
    return index.where(F.col("key_kind") == kind).drop("key_kind")
