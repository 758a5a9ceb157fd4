"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits.

Every shingle is hashed once: high bits choose its bin, the rest compete for the bin's minimum. An empty
bin takes the value of a bin that a hash of (bin, attempt) points to, trying again until that bin is not
empty. Only the low ``BITS`` bits of each bin are kept, so likeness corrects for chance agreement.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, WordHashes, mix, saved, shingle_set, word_hashes

BINS = 256
BITS = 4
WIDTH = 5


@lru_cache(maxsize=256)
def _probes(part: int, attempts: int = 64) -> np.ndarray:
    """Bins to try for each empty bin, for one part of the endless row of attempts."""
    i = np.arange(part * attempts * BINS, (part + 1) * attempts * BINS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return (mix(i * U(0x9E3779B97F4A7C15) + U(1)) % U(BINS)).astype(np.int64).reshape(attempts, BINS)


def fingerprint(shingles: np.ndarray) -> np.ndarray | None:
    """Low-order bits of the densified bins; None for the empty set."""
    if not len(shingles):
        return None
    low = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, (shingles >> U(56)).astype(np.int64), shingles & U(2**56 - 1))
    empty = low == np.iinfo(np.uint64).max
    if empty.any():
        source = np.arange(BINS)
        open_, part = np.flatnonzero(empty), 0
        if len(open_) == BINS - 1:  # every attempt ends at the same bin
            source[:] = np.flatnonzero(~empty)[0]
            open_ = open_[:0]
        while len(open_):  # each bin draws on by itself until it meets one that is not empty
            probe = _probes(part)[:, open_]
            ok = ~empty[probe]
            found = ok.any(axis=0)
            source[open_[found]] = probe[ok.argmax(axis=0)[found], np.flatnonzero(found)]
            open_, part = open_[~found], part + 1
        low = low[source]
    return (mix(low) & U(2**BITS - 1)).astype(np.uint8)


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated Jaccard similarity, corrected for chance agreement of low bits, within 0 and 1."""
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


def packed(bins: np.ndarray | None) -> str:
    """Two bins a byte, as hexadecimal; empty for the empty set."""
    return "" if bins is None else ((bins[0::2] << 4) | bins[1::2]).tobytes().hex()


def _of(text: str, memo: WordHashes) -> np.ndarray | None:
    return fingerprint(shingle_set(word_hashes(text, memo), WIDTH))


def _row(doc, text: str, own, follows: str, other, memo: WordHashes) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + follows[:half]
    made = _of(edited, memo)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc, len(text), digest, packed(own), packed(made), likeness(own, made), likeness(own, other)


_KINDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every text (shingles of WIDTH words, A-Z lower-cased; null: empty).

    Equal texts have equal fingerprints; a text without words has the empty one. One pass, no shuffle.
    """

    def run(batches):
        memo = WordHashes()
        for b in batches:
            made = [packed(_of(x.as_py() or "", memo)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def _pressed(batches):
    """Texts as zstd frames: their exchange is the largest cost."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    for b in batches:
        made = [press.compress(x.as_py().encode("utf-8", "surrogatepass")) for x in b.column(2)]
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(made, pa.binary())], names=["doc_id", "tie", "text"])


def beside_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of the text with its second half replaced by the next document's head.

    The next document is the one below in descending doc_id (null ids last, repeated ids by the hash of
    their text, equal rows in any order); after the last comes the first. Rows are range-partitioned once;
    a task streams its sorted rows, and only the two rows at its ends are matched with other tasks'.
    A single document is its own next; an empty table gives no rows.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(_pressed, "doc_id long, tie long, text binary")
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    names = [k.split()[0] for k in _KINDS.split(", ")]

    def stream(batches):
        import zstandard
        from pyspark import TaskContext

        open_ = zstandard.ZstdDecompressor().decompress

        pid, memo, done, last, head = TaskContext.get().partitionId(), WordHashes(), [], None, None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]

        def out():
            cols = list(zip(*done))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[*names, "pid", "head", "tail"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = open_(text.as_py()).decode("utf-8", "surrogatepass")
                now = (doc, text, _of(text, memo))
                if last is None:
                    head = text
                else:
                    done.append((*_row(*last, text, now[2], memo), pid, None, None))
                last = now
                if len(done) >= 2000:
                    yield out()
        if last is not None:  # its next document is in another task
            done.append((last[0], None, None, None, None, None, None, pid, head, last[1]))
            yield out()

    made = saved(dealt.select("doc_id", "text").mapInArrow(stream, f"{_KINDS}, pid int, head string, tail string"))
    ends = made.where("tail is not null")
    pids = sorted(r.pid for r in ends.select("pid").collect())  # one number a task
    after = spark.createDataFrame(list(zip(pids, pids[1:] + pids[:1])), "pid int, next int")
    heads = ends.select(F.col("pid").alias("next"), F.col("head").alias("follows"))
    open_ = ends.select("doc_id", "pid", "tail").join(after, "pid").join(heads, "next").select("doc_id", "tail", "follows")

    def close(batches):
        memo = WordHashes()
        for b in batches:
            done = [_row(d, t, _of(t, memo), f, _of(f, memo), memo) for d, t, f in zip(*(c.to_pylist() for c in b.columns))]
            if done:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

    return made.where("tail is null").select(*names).unionByName(open_.mapInArrow(close, _KINDS))
