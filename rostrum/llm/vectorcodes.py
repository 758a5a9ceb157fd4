"""Codes of vectors by product quantisation, whose codebooks a heap-ordered Lloyd iteration refines.

Vectors are cut into parts; each part position has a codebook. Blocks of vectors keep, for each position and
entry, a heap of their parts: the key is the slack between the distance to the nearest entry that is not its
own and the distance to its own, plus what the entry's drift had added up to when the part was put there.
Entries that move add to their drift; only parts whose key the drift has reached can have another nearest
entry, so only they are popped and compared with all entries again, exactly. The other parts are not looked
at. Tasks pass on how much the sums of their entries have changed, so a round moves one codebook's worth of
numbers a task. Blocks are written to the shared folder each round: a lost executor costs its tasks only.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside_key, drop_saved, saved

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK = 4096


def cuts(dims: int) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end; equal ones if the parts divide its length."""
    at = [i * dims // PARTS for i in range(PARTS + 1)]
    return list(zip(at, at[1:]))


def most(dims: int) -> int:
    """The largest component whose squared distances still add up to a long."""
    return isqrt((1 << 62) // max(1, dims)) // 2


def scaled(flat: np.ndarray, dims: int) -> np.ndarray:
    """Components times SCALE, floored, one row a vector, held to what a long can sum."""
    limit = most(dims)
    return np.clip(np.floor(flat.astype(np.float64) * SCALE), -limit, limit).astype(np.int32).reshape(-1, dims)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    out = np.empty((len(x), len(book)), np.int64)
    for e, c in enumerate(book):
        d = x.astype(np.int64) - c
        out[:, e] = (d * d).sum(1)
    return out


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries, the lower of equals, and the slack to the next: what rounding could add to it is taken off."""
    d = distances(x, book)
    own = d.argmin(1)
    near = np.sqrt(d[np.arange(len(x)), own].astype(np.float64))
    if len(book) == 1:
        return own, np.full(len(x), np.inf)
    d[np.arange(len(x)), own] = np.iinfo(np.int64).max
    far = np.sqrt(d.min(1).astype(np.float64))
    return own, far - near - 1e-9 * (far + near)


class Heaps:
    """Of one part position: a heap for each entry. A heap is a run in rising order of its keys; its violated parts lead it."""

    def __init__(self, sizes: np.ndarray, items: np.ndarray, keys: np.ndarray):
        ends = np.cumsum(sizes)
        self.items = [items[b - n : b] for n, b in zip(sizes, ends)]
        self.keys = [keys[b - n : b] for n, b in zip(sizes, ends)]

    @classmethod
    def empty(cls, entries: int) -> Heaps:
        return cls(np.zeros(entries, np.int64), np.zeros(0, np.uint16), np.zeros(0, np.float32))

    def pop(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts whose keys the drift of their entry has reached, and those entries; they leave their heaps."""
        gone, of = [], []
        for e, (items, keys) in enumerate(zip(self.items, self.keys)):
            n = np.searchsorted(keys, drift[e], side="right")
            if n:
                gone.append(items[:n])
                of.append(np.full(n, e))
                self.items[e], self.keys[e] = items[n:], keys[n:]
        return (np.concatenate(gone), np.concatenate(of)) if gone else (np.zeros(0, np.uint16), np.zeros(0, np.int64))

    def push(self, items: np.ndarray, own: np.ndarray, slack: np.ndarray, drift: np.ndarray) -> None:
        # rounded down, so that a key is never reached too late
        key = np.nextafter((slack + drift[own]).astype(np.float32), np.float32(-np.inf))
        for e in np.unique(own):
            new = own == e
            keys = np.concatenate((self.keys[e], key[new]))
            order = np.argsort(keys, kind="stable")
            self.items[e], self.keys[e] = np.concatenate((self.items[e], items[new]))[order], keys[order]

    def entries(self, n: int) -> np.ndarray:
        out = np.zeros(n, np.uint8)
        for e, items in enumerate(self.items):
            out[items] = e
        return out

    def packed(self) -> list[bytes]:
        sizes = np.array([len(x) for x in self.items], "<i4")
        return [sizes.tobytes(), np.concatenate(self.items).astype("<u2").tobytes(), np.concatenate(self.keys).astype("<f4").tobytes()]


def _read_heaps(raw: bytes, n: int, entries: int):
    for at in range(0, len(raw), 4 * entries + 6 * n):
        sizes = np.frombuffer(raw, "<i4", entries, at)
        items = np.frombuffer(raw, "<u2", n, at + 4 * entries)
        yield Heaps(sizes, items, np.frombuffer(raw, "<f4", n, at + 4 * entries + 2 * n))


class _Change:
    """How a task's parts change the sums and counts of all entries."""

    def __init__(self, dims: int, entries: int):
        self.sums = [np.zeros((entries, b - a), np.int64) for a, b in cuts(dims)]
        self.counts = np.zeros((PARTS, entries), np.int64)

    def add(self, part: int, x: np.ndarray, entry: np.ndarray, sign: int) -> None:
        np.add.at(self.sums[part], entry, sign * x.astype(np.int64))
        self.counts[part] += sign * np.bincount(entry, minlength=self.counts.shape[1])

    def flat(self) -> np.ndarray:
        return np.concatenate([self.counts.ravel(), *(s.ravel() for s in self.sums)])


def _names(label_type: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("ids", pa.list_(pa.int64())), ("labels", pa.list_(label_type)), ("vectors", pa.binary()), ("heaps", pa.binary()),
        ("scanned", pa.int64()), ("change", pa.list_(pa.int64())),
    ])


def _row(schema: pa.Schema, ids, labels, vectors, heaps, scanned, change) -> pa.RecordBatch:
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) if x is not None else None
    columns = [one(ids), one(labels), pa.array([vectors], pa.binary()), pa.array([heaps], pa.binary()), pa.array([scanned], pa.int64()), one(change)]
    columns = [c if c is not None else pa.nulls(1, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _first(books: list[np.ndarray], dims: int):
    """Blocks of a task's vectors (id, label, vector), every part in the heap of its nearest entry."""
    entries = len(books[0])
    drift = np.zeros(entries)

    def run(batches):
        change, schema = _Change(dims, entries), None
        ids, labels, flat, waiting = [], [], [], 0

        def block():
            nonlocal ids, labels, flat, waiting
            x = scaled(np.concatenate(flat), dims)
            heaps = []
            for p, (a, b) in enumerate(cuts(dims)):
                own, slack = _nearest(x[:, a:b], books[p])
                h = Heaps.empty(entries)
                h.push(np.arange(len(x), dtype=np.uint16), own, slack, drift)
                heaps += h.packed()
                change.add(p, x[:, a:b], own, 1)
            row = _row(schema, pa.concat_arrays(ids), pa.concat_arrays(labels), x.astype("<i4").tobytes(), b"".join(heaps), len(x) * PARTS, None)
            ids, labels, flat, waiting = [], [], [], 0
            return row

        for batch in batches:
            schema = schema or _names(batch.schema.field(1).type)
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                vectors = part.column(2)
                if waiting and waiting + len(part) > BLOCK:
                    yield block()
                ids.append(part.column(0))
                labels.append(part.column(1))
                flat.append(vectors.flatten().to_numpy(zero_copy_only=False))
                waiting += len(part)
        if waiting:
            yield block()
        if schema:
            yield _row(schema, None, None, None, None, None, pa.array(change.flat()))

    return run


def _opened(row: dict, dims: int, entries: int):
    x = np.frombuffer(row["vectors"], "<i4").reshape(len(row["ids"]), dims)
    return x, list(_read_heaps(row["heaps"], len(x), entries))


def _settle(x: np.ndarray, heaps: list[Heaps], books: list[np.ndarray], drift: np.ndarray, change: _Change | None) -> int:
    """Pop what the drift has reached, compare it with all entries, put it where it belongs; how many parts that took."""
    scanned = 0
    for p, ((a, b), h) in enumerate(zip(cuts(x.shape[1]), heaps)):
        items, before = h.pop(drift[p])
        if not len(items):
            continue
        part = x[items, a:b]
        own, slack = _nearest(part, books[p])
        h.push(items, own, slack, drift[p])
        scanned += len(items)
        moved = own != before
        if change and moved.any():
            change.add(p, part[moved], before[moved], -1)
            change.add(p, part[moved], own[moved], 1)
    return scanned


def _next(books: list[np.ndarray], drift: np.ndarray, dims: int):
    entries = len(books[0])

    def run(batches):
        change, schema = _Change(dims, entries), None
        for batch in batches:
            schema = batch.schema
            for k in range(len(batch)):
                row = {name: batch.column(i)[k] for i, name in enumerate(schema.names)}
                opened = {"ids": row["ids"].values, "vectors": row["vectors"].as_py(), "heaps": row["heaps"].as_py()}
                x, heaps = _opened(opened, dims, entries)
                scanned = _settle(x, heaps, books, drift, change)
                yield _row(schema, row["ids"].values, row["labels"].values, opened["vectors"], b"".join(c for h in heaps for c in h.packed()), scanned, None)
        if schema:
            yield _row(schema, None, None, None, None, None, pa.array(change.flat()))

    return run


def _last(books: list[np.ndarray], drift: np.ndarray, dims: int):
    """(vec_id, label, code, error) of the vectors of all blocks."""
    entries = len(books[0])

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                row = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
                opened = {"ids": row["ids"].values, "vectors": row["vectors"].as_py(), "heaps": row["heaps"].as_py()}
                x, heaps = _opened(opened, dims, entries)
                _settle(x, heaps, books, drift, None)
                codes = np.stack([h.entries(len(x)) for h in heaps], 1)
                error = np.zeros(len(x), np.int64)
                for p, (a, b) in enumerate(cuts(dims)):
                    d = x[:, a:b].astype(np.int64) - books[p][codes[:, p]]
                    error += (d * d).sum(1)
                text = codes.tobytes().hex()
                code = pa.array([text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string())
                yield pa.RecordBatch.from_arrays([opened["ids"], row["labels"].values, code, pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def _updated(state: DataFrame, sums: list[list[int]], books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks of the mean of each entry's parts, floored; unused entries stay. ``sums`` takes up the changes."""
    changes = state.where("change is not null").select(F.posexplode("change").alias("at", "x"))
    for r in changes.groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # a codebook's numbers
        sums[r["at"]] += int(r["x"])
    entries, out = len(books[0]), []
    at = PARTS * entries
    for p, book in enumerate(books):
        new = book.copy()
        for e in range(entries):
            n = sums[p * entries + e]
            for i in range(book.shape[1]):
                if n:
                    new[e, i] = sums[at] // n
                at += 1
        out.append(new)
    return out


def drifted(drift: np.ndarray, books: list[np.ndarray], new: list[np.ndarray]) -> np.ndarray:
    """``drift`` of each position and entry, plus how far the entry has moved and the farthest of the others has."""
    out = drift.copy()
    for p, (old, now) in enumerate(zip(books, new)):
        step = np.sqrt(((now - old) ** 2).sum(1).astype(np.float64)) * (1 + 1e-9)
        for e in range(len(old)):
            out[p, e] += step[e] + max(np.delete(step, e), default=0.0)
    return out * (1 + 1e-9)


def fitted(vectors: DataFrame, id_: str = "vec_id", label: str = "label", vector: str = "embedding") -> tuple[DataFrame, list[np.ndarray], np.ndarray]:
    """(blocks, codebooks, drift) after all rounds: blocks are settled but for the last drift."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.col(vector).isNotNull() & whole).select(F.col(id_).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    lead = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).collect()
    dims = len(lead[0].vector) if lead else 0
    x = scaled(np.array([v for r in lead if len(r.vector) == dims for v in r.vector], np.float64), dims) if dims else np.zeros((max(1, len(lead)), 0), np.int32)
    books = [x[:, a:b].astype(np.int64) for a, b in cuts(dims)]
    schema = f"ids array<long>, labels array<{kept.schema['label'].dataType.simpleString()}>, vectors binary, heaps binary, scanned long, change array<long>"
    drift = np.zeros((PARTS, len(x)))
    state = saved(kept.where(F.size("vector") == dims).mapInArrow(_first(books, dims), schema))
    sums = [0] * (PARTS * len(x) + len(x) * dims)
    for k in range(ROUNDS):
        new = _updated(state, sums, books)
        drift, books = drifted(drift, books, new), new
        if k < ROUNDS - 1:
            then = saved(state.where("ids is not null").mapInArrow(_next(books, drift, dims), schema))
            drop_saved(state)
            state = then
    return state.where("ids is not null"), books, drift


def vector_codes(vectors: DataFrame, id_: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every vector without a null or non-finite component.

    The first codebook is that of the smallest ids (fewer vectors: fewer entries), of equal ids the smaller
    vectors; null ids come last. Lengths that the number of parts does not divide give parts that differ by
    one component at most. The vector of the smallest id gives the length; others are dropped. Components
    are held to ``most`` in size, so that errors are longs (32,768 before scaling, at 64 components). Rows
    that repeat are coded each time and count each time. An empty table gives no rows.
    """
    state, books, drift = fitted(vectors, id_, label, vector)
    dims = sum(b.shape[1] for b in books)
    kind = state.schema["labels"].dataType.elementType.simpleString()
    coded = saved(state.mapInArrow(_last(books, drift, dims), f"vec_id long, label {kind}, code string, error long"))
    digest = hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()
    rows = coded.withColumn("of", F.to_json(F.struct("label")))  # null labels are one label
    rows = beside_key(rows, "of", ["vec_id", "code"], {"label_error": F.sum("error")}).drop("of")
    return rows.withColumn("codebooks_sha256", F.lit(digest)).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
