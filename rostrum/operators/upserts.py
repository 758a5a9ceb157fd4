"""Table changes as DataFrame to DataFrame functions, for batch jobs and foreachBatch alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def next_versions(rows: DataFrame, key: str, version: str) -> DataFrame:
    return rows.groupBy(key).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("version"))


def replace_generation(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """``old`` with the keys of ``new`` replaced by its rows, where its version is not below the newest."""
    newest = old.groupBy(key).agg(F.max(version).alias("_newest"))
    fresh = new.join(newest, key, "left").where(F.col("_newest").isNull() | (F.col(version) >= F.col("_newest"))).drop("_newest")
    return old.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def append_missing(have: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows whose keys are not there yet are appended (an insert that does nothing on conflict)."""
    return have.unionByName(new.join(have.select(*keys).distinct(), keys, "left_anti"))


def upsert(have: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last change of each key by ``order`` wins over what is there."""
    values = [c for c in have.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_v")).select(*keys, "_v.*")
    return have.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*have.columns))


def prune(rows: DataFrame, expired: Column, id_: str, most: int) -> DataFrame:
    """Without the ``most`` lowest ids among the expired rows."""
    gone = rows.where(expired).select(id_).orderBy(id_).limit(most)
    return rows.join(gone, id_, "left_anti")


def partial_update(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns that ``changes`` supplies (not null) replace those of the row with its key."""
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in changes.columns if c != key))
    made = [F.coalesce(f"_{c}", c).alias(c) if c in changes.columns and c != key else F.col(c) for c in rows.columns]
    return rows.join(new, key, "left").select(*made)
