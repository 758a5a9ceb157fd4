"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is named and there is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = getattr(spark, "_rostrum_scratch", None)
        if not named:
            named = spark._rostrum_scratch = "file://" + tempfile.mkdtemp(prefix="rostrum-")
    return named.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rostrum-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._rostrum_path = path
    return out


def drop_saved(*tables: DataFrame | None) -> None:
    """Delete the files of tables made by :func:`saved` that no later step reads; others are left alone."""
    gone = {p for df in tables if df is not None and (p := getattr(df, "_rostrum_path", None))}
    _drop([(s, p) for s, p in _MADE if p in gone])


def made_so_far() -> int:
    """A mark for :func:`drop_since`."""
    return len(_MADE)


def drop_since(mark: int, *keep: DataFrame) -> None:
    """Delete what :func:`saved` has made since ``mark``, but for ``keep``: steps whose result is saved need it no more."""
    kept = {getattr(df, "_rostrum_path", None) for df in keep}
    _drop([(s, p) for s, p in _MADE[mark:] if p not in kept])


def _drop(entries: list[tuple[SparkSession, str]]) -> None:
    for spark, path in entries:
        _delete(spark, path)
        _MADE.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone by now
            return


def fresh(df: DataFrame, name: str) -> str:
    """``name``, led by as many underscores as it takes for no column of ``df`` to have it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def salted(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` dealt into 64 salts (column salt) by the hash of their ``by`` columns."""
    return rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(64)).cast("int"))


def held_salts() -> Column:
    """Aggregate of a key's salted rows: the salts that they hold, as bits."""
    return F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")


def per_salt(per_key: DataFrame) -> DataFrame:
    """A key's row once for each of its salts, to join with the salted rows; there are never more of those than rows."""
    each = F.explode(F.expr("filter(sequence(0, 63), i -> getbit(salts, i) = 1)"))
    return per_key.withColumn("salt", each).drop("salts")


def beside_key(rows: DataFrame, key: str, by: list[str], aggregates: dict[str, Column], where: str = "true") -> DataFrame:
    """``rows`` with ``aggregates`` of their key, for keys that meet ``where``; no task has all rows of a key.

    The aggregates are combined before their shuffle, and the join deals a key's rows by salts.
    """
    dealt = salted(rows, by)
    per_key = dealt.groupBy(key).agg(held_salts(), *(c.alias(name) for name, c in aggregates.items())).where(where)
    return dealt.join(per_salt(per_key), [key, "salt"]).drop("salt")


U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHashes(dict):
    """Word bytes to 64-bit hashes; forgets everything at ``most`` words, so memory is bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(text: str | None, memo: WordHashes) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.fromiter(map(memo.__getitem__, words), U, len(words))


def shingle_set(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width``-word shingles; fewer words make one shingle, none make none."""
    n = len(h)
    if not n:
        return h
    w = min(width, n)
    s = h[: n - w + 1].copy()
    with np.errstate(over="ignore"):
        for j in range(1, w):
            s = s * U(0x9E3779B97F4A7C15) + h[j : n - w + 1 + j]
        return np.unique(mix(s + U(w)))
