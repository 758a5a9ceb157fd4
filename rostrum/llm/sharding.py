"""Uniform random sharding with exact shard sizes, by a hypergeometric communication matrix.

The rows of the input tasks and the cells of the output (a shard is cut into cells of bounded size) are
the two margins of a matrix of row counts that a uniform permutation of all rows would give; its entries
are drawn exactly. Each task permutes the cell labels of its own row of the matrix over its rows, rows go
to their cells, and each cell is permuted again. No task sees more than its input or one cell.

The matrix is never held whole: the tasks are the leaves of a binary tree, each inner node splits its
cells' counts between its two halves with a generator seeded by the node, and a task replays only the
nodes on its own path.
"""

from __future__ import annotations

from bisect import bisect_left
from math import exp, lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh, saved


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Exact sizes, at most one apart: the first ``rows % shards`` shards have one more."""
    return rows // shards + (np.arange(shards) < rows % shards).astype(np.int64)


def cell_sizes(rows: int, shards: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, first slot, size) of every cell; each shard is cut evenly into cells of at most ``most``."""
    shard, first, size = [], [], []
    for s, n in enumerate(shard_sizes(rows, shards).tolist()):
        cells = max(1, -(-n // most))
        sizes = shard_sizes(n, cells)
        shard += [s] * cells
        first += (np.cumsum(sizes) - sizes).tolist()
        size += sizes.tolist()
    return np.array(shard, np.int64), np.array(first, np.int64), np.array(size, np.int64)


def _split(rng: np.random.Generator, cells: np.ndarray, take: int) -> np.ndarray:
    """How many of ``take`` rows come from each cell, all subsets being equally likely."""
    total = int(cells.sum())
    if total < 10**9:
        return rng.multivariate_hypergeometric(cells, take, method="marginals")
    if len(cells) == 1:
        return np.array([take], np.int64)
    half = len(cells) // 2
    left = int(cells[:half].sum())
    k = _outward(rng, left, total - left, take)
    return np.concatenate((_split(rng, cells[:half], k), _split(rng, cells[half:], take - k)))


def _outward(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """A hypergeometric draw for populations beyond numpy's: inversion outward from the mode."""
    least, most = max(0, take - bad), min(take, good)
    mode = min(most, max(least, (take + 1) * (good + 1) // (good + bad + 2)))

    def ln(n: int, k: int) -> float:
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    u = rng.random() - (p := exp(ln(good, mode) + ln(bad, take - mode) - ln(good + bad, take)))
    lo = hi = mode
    up = down = p
    while u > 0 and (lo > least or hi < most):
        if hi < most:
            up *= (good - hi) * (take - hi) / ((hi + 1) * (bad - take + hi + 1))
            hi += 1
            u -= up
            if u <= 0:
                return hi
        if lo > least:
            down *= lo * (bad - take + lo) / ((good - lo + 1) * (take - lo + 1))
            lo -= 1
            u -= down
            if u <= 0:
                return lo
        if up + down < 1e-30:
            break
    return mode


def row_of_matrix(task: int, counts: np.ndarray, cells: np.ndarray, seed: int) -> np.ndarray:
    """Rows that ``task`` sends to each cell; the same whoever asks, and consistent between tasks."""
    before = np.concatenate(([0], np.cumsum(counts)))
    lo, hi, mine = 0, len(counts), cells
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = _split(rng, mine, int(before[mid] - before[lo]))
        lo, hi, mine = (lo, mid, left) if task < mid else (mid, hi, mine - left)
    return mine


def shard(docs: DataFrame, shards: int = 24, seed: int = 7, cell_rows: int = 8192) -> DataFrame:
    """``docs`` plus shard (0 to shards - 1) and slot (its place there, gapless from 0).

    All assignments with these sizes are equally likely (up to the generator). Shard sizes differ by one
    row at most, whatever the values are: null or repeated rows are rows like others. An empty table
    gives none. Earlier shard and slot columns are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    from_task, at_row, in_cell, first_slot = (fresh(docs, c) for c in ("task", "at", "cell", "first"))
    fixed = saved(docs.withColumn(from_task, F.spark_partition_id()).withColumn(at_row, F.monotonically_increasing_id()))
    by_task = {r[0]: r[1] for r in fixed.groupBy(from_task).agg(F.count("*")).collect()}
    tasks = sorted(by_task)  # one count an input task, which is all that is broadcast
    counts = np.array([by_task[t] for t in tasks], np.int64)
    shared = spark.sparkContext.broadcast((tasks, counts))
    names = fixed.columns

    def label(batches):
        tasks, counts = shared.value
        owner, first, size = cell_sizes(int(counts.sum()), shards, cell_rows)
        known: dict[int, np.ndarray] = {}

        def labels_of(task: int) -> np.ndarray:
            if task not in known:
                if len(known) > 8:
                    known.clear()
                i = bisect_left(tasks, task)
                n = row_of_matrix(i, counts, size, seed)
                known[task] = np.random.default_rng([seed, i, 1]).permutation(np.repeat(np.arange(len(size)), n))
            return known[task]

        for b in batches:
            task, at = (b.column(names.index(c)).to_numpy() for c in (from_task, at_row))
            place = at & (2**33 - 1)  # the low bits count the rows of a task
            cell = np.empty(len(at), np.int64)
            for t in np.unique(task).tolist():
                own = task == t
                cell[own] = labels_of(t)[place[own]]
            more = [pa.array(cell), pa.array(owner[cell].astype(np.int32)), pa.array(first[cell])]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*names, in_cell, "shard", first_slot])

    schema = StructType([*fixed.schema, *StructType.fromDDL(f"{in_cell} long, shard int, {first_slot} long")])
    # second permutation: by a keyed hash of the place of origin, which no value of the rows touches
    again = Window.partitionBy(in_cell).orderBy(F.xxhash64(F.lit(seed), F.col(at_row)), at_row)
    placed = fixed.mapInArrow(label, schema).withColumn("slot", F.col(first_slot) + F.row_number().over(again) - 1)
    return placed.drop(from_task, at_row, in_cell, first_slot)
