"""Approximate nearest vectors by cosine: inverted lists with product-quantised residuals, exact scores for a shortlist."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .steps import written

SAMPLE_VALUES = 16_000_000  # numbers of the sample that the driver may hold: 64 MB
SAMPLE_ROWS = 65_536
SHARD_ROWS = 65_536  # rows of a list that one task meets at once, in expectation
QUERY_BLOCK = 2_048  # queries that meet a shard at once, in expectation
MET_VALUES = 4_000_000  # scores and table entries that a task holds at once


@dataclass(frozen=True)
class VectorIndex:
    """rows (list, shard, id, code, unit: unit-length vector), the lists' sizes and the fitted centres."""

    rows: DataFrame
    sizes: DataFrame
    centres: np.ndarray
    books: np.ndarray


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    step = max(1, MET_VALUES // len(centres))
    return np.concatenate([(half - x[i : i + step] @ centres.T).argmin(1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, int)


def _probes(v: np.ndarray, centres: np.ndarray, probes: int) -> Iterator[np.ndarray]:
    """The nearest ``probes`` centres of each row of ``v``, a bounded number of rows at a time."""
    half, step = (centres**2).sum(1) / 2, max(1, MET_VALUES // len(centres))
    for i in range(0, len(v), step):
        yield np.argsort(half - v[i : i + step] @ centres.T, axis=1, kind="stable")[:, :probes].astype(np.int32)


def _shortlisted(v: np.ndarray, codes: np.ndarray, ids: np.ndarray, centre: np.ndarray, books: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row of ``v``, ids, scores) for a bounded number of rows of ``v`` at a time: the ``most`` coded rows of highest score for each."""
    parts, entries = books.shape[:2]
    step = max(1, MET_VALUES // (len(ids) + parts * entries))
    for i in range(0, len(v), step):
        w = v[i : i + step]
        by_entry = np.einsum("ped,qpd->pqe", books, w.reshape(len(w), parts, -1))
        near = np.repeat((w @ centre)[:, None], len(ids), 1)
        for p in range(parts):
            near += by_entry[p][:, codes[:, p]]
        top = np.argpartition(-near, most - 1, axis=1)[:, :most] if len(ids) > most else np.tile(np.arange(len(ids)), (len(w), 1))
        yield i, ids[top], np.take_along_axis(near, top, 1)


def _lloyd(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of ``x`` (rows in a fixed order), started at evenly spaced rows; empty ones keep their place."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        of = _nearest(x, centres)
        count = np.bincount(of, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, of, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def _unit(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    v = F.col(vector)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # the length as an array, so that it is not added up anew for each number
    rows = vectors.select(F.col(id_).alias("id"), F.zip_with(v, F.array_repeat(norm, F.size(v)), lambda x, n: (x / n).cast("float")).alias("unit"), norm.alias("norm"))
    return rows.where("id IS NOT NULL AND norm > 0 AND norm < double('infinity')").drop("norm")  # null, empty, zero and non-finite vectors have no direction


def vector_index(vectors: DataFrame, id_: str, vector: str, lists: int | None = None, parts: int = 16, entries: int = 256) -> VectorIndex:
    """Index every row that has a direction (id, vector of one length; null ids and rows of another length than most have no place).

    Centres of ``lists`` lists (by default the root of the rows, at most 4096) and the codebooks of residuals
    are fitted on a sample bounded by SAMPLE_ROWS and SAMPLE_VALUES, the rows of smallest hash of their id;
    then each row finds its list and code in the tasks. A list is cut into shards by its counted size, so a
    list that holds a third of all rows is many groups.
    """
    units = _unit(vectors, id_, vector)
    shape = units.groupBy(F.size("unit").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim, n = (shape["dim"], shape["n"]) if shape else (parts, 0)
    most = min(SAMPLE_ROWS, max(1, SAMPLE_VALUES // dim))
    units = units.where(F.size("unit") == dim)
    sample = units.select("unit").orderBy(F.xxhash64("id"), "unit").limit(most).toPandas()
    x = np.array(sample["unit"].tolist(), np.float32).reshape(-1, dim) if n else np.zeros((1, dim), np.float32)
    k = min(lists or min(4096, max(1, int(n**0.5))), len(x))
    parts = next(p for p in range(min(parts, dim), 0, -1) if dim % p == 0)
    centres = _lloyd(x, k)
    rest = (x - centres[_nearest(x, centres)]).reshape(len(x), parts, -1)
    books = np.stack([_lloyd(np.ascontiguousarray(rest[:, p]), min(entries, 256, len(x))) for p in range(parts)])

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            v = np.array(rows["unit"].tolist(), np.float32).reshape(-1, dim)
            of = _nearest(v, centres)
            left = (v - centres[of]).reshape(len(v), parts, -1)
            codes = np.stack([_nearest(np.ascontiguousarray(left[:, p]), books[p]) for p in range(parts)], 1).astype(np.uint8)
            yield pd.DataFrame({"list": of, "id": rows["id"], "code": [c.tobytes() for c in codes], "unit": rows["unit"]})

    kind = units.schema["id"].dataType.simpleString()
    coded = written(units.mapInPandas(code, f"list int, id {kind}, code binary, unit array<float>"))
    sizes = written(coded.groupBy("list").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("shards")))
    sharded = coded.join(F.broadcast(sizes), "list").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))  # at most 4096 rows of sizes
    rows = written(sharded.drop("shards").repartitionByRange("list", "shard", "id").sortWithinPartitions("list", "shard", "id"))
    return VectorIndex(rows, sizes, centres, books)


def nearest_vectors(queries: DataFrame, index: VectorIndex, id_: str, vector: str, k: int, probes: int | None = None, shortlist: int | None = None) -> DataFrame:
    """q, id, score, rank: about the ``k`` nearest rows of each query by cosine (score, then id).

    A query meets the ``probes`` lists (default: three in four, which vectors without clusters need; with
    clusters a few do) whose centres are nearest; codes alone are read there, and the best ``shortlist`` (default 8 k) are scored
    exactly. Queries meet shards in blocks, so no task holds all queries or all rows. Queries without a
    direction, or of another length, give no rows; those of an empty index none either.
    """
    centres, books = index.centres, index.books
    probes = min(probes or max(8, len(centres) * 3 // 4), len(centres))
    shortlist, dim = shortlist or 8 * k, centres.shape[1]
    asked = written(_unit(queries, id_, vector).where(F.size("unit") == dim).select(F.col("id").alias("q"), F.col("unit").alias("qv")))
    blocks = -(-asked.count() * probes // (QUERY_BLOCK * len(centres))) or 1
    kind_q, kind = (df.schema[c].dataType.simpleString() for df, c in ((asked, "q"), (index.rows, "id")))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            v, done = np.array(rows["qv"].tolist(), np.float32).reshape(-1, dim), 0
            for near in _probes(v, centres, probes):
                part = rows.iloc[done : done + len(near)]
                done += len(near)
                yield pd.DataFrame({"q": part["q"], "qv": part["qv"], "lists": list(near)})

    # a query's lists become rows outside Python, which would hold its vector once for each
    probed = asked.mapInPandas(probe, f"q {kind_q}, qv array<float>, lists array<int>").select("q", "qv", F.explode("lists").alias("list")).withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
    probed = probed.join(F.broadcast(index.sizes), "list").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    met = index.rows.select("list", "shard", "id", "code").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def best(q: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(rows):
            return pd.DataFrame({"q": [], "id": [], "near": []})
        rows = rows.sort_values("id")  # so that ties fall alike in every run
        codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1).astype(np.intp)
        ids, who, out = rows["id"].to_numpy(), q["q"].to_numpy(), []
        v, centre = np.array(q["qv"].tolist(), np.float32).reshape(-1, dim), centres[int(rows["list"].iloc[0])]
        for first, near_ids, near in _shortlisted(v, codes, ids, centre, books, shortlist):
            out.append(pd.DataFrame({"q": who[first : first + len(near)].repeat(near.shape[1]), "id": near_ids.ravel(), "near": near.ravel()}))
        return pd.concat(out)

    keys = ["list", "shard", "block"]
    found = probed.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInPandas(best, f"q {kind_q}, id {kind}, near float")
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "id"))
    short = written(found.withColumn("at", order).where(F.col("at") <= shortlist).select("q", "id"))
    dot = F.aggregate(F.zip_with("unit", "qv", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    scored = short.join(index.rows.select("id", "unit"), "id").join(asked, "q").select("q", "id", dot.alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
