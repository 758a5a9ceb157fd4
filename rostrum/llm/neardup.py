"""MinHash near-duplicate detection with sequential Bayesian verification.

Banded MinHash proposes pairs; batches of signature values update a Beta posterior of each pair's
similarity and prune it once the probability of reaching the threshold is below ``miss``; what is
left is verified exactly on the full shingle sets.

Pairs are never expanded within a group: equal shingle sets form one class first; of each class one
representative takes part. In rounds, every bucket draws a centre, and each representative tries the
centres of other components with which it shares most buckets; what links becomes one component. Once
few pairs are left for the bucket members (or after ``most_rounds``), every pair of different
components in a bucket whose set sizes and parity marks allow the threshold is tried, so no link that joins
two components is lost; a bucket is dealt into blocks for that, so that no task has a large bucket.
"""

from __future__ import annotations

from math import lgamma, exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, WordHashes, beside_key, drop_saved, drop_since, held_salts, made_so_far, mix, per_salt, salted, saved, shingle_set, word_hashes
from .components import components

#: Cells of the parity marks (2**11, so that the high 11 bits of a hash name one).
MARKS = 2048
#: Nodes of rows without a doc_id are numbered from here; doc_ids are smaller.
NAMELESS = 2**62
SIG_SCHEMA = "doc_id long, node long, text_hash long, n_shingles long, set_hash binary, sig binary, bands array<long>"


def _multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) | U(1)


def min_hashes(s: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Minimum of each multiplicative hash over the set, in blocks that stay in cache."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 256):
            np.minimum(low, np.multiply.outer(a, s[i : i + 256]).min(axis=1), out=low)
    return low


def signatures(docs: DataFrame, width: int, bands: int, rows: int, seed: int) -> DataFrame:
    """Per document: set size, hash of the whole set, 16 low bits of each MinHash, and the band keys."""

    def run(batches):
        a, memo = _multipliers(bands * rows, seed), WordHashes()
        place = (np.arange(bands, dtype=np.uint64) + U(1)) * U(0x9E3779B97F4A7C15)
        for batch in batches:
            ids, n, sets, sigs, keys, at = batch.columns[:3], [], [], [], [], [0]
            for text in batch.column(3):
                s = shingle_set(word_hashes(text.as_py(), memo), width)
                n.append(len(s))
                if not len(s):
                    sets.append(None), sigs.append(None), at.append(at[-1])
                    continue
                m = min_hashes(s, a)
                with np.errstate(over="ignore"):
                    whole = [int(mix(s * U(k)).sum(dtype=np.uint64)) for k in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
                    k = place.copy()
                    for c in m.reshape(bands, rows).T:
                        k = mix(k * U(0x100000001B3) + c)
                sets.append(b"".join(x.to_bytes(8, "little") for x in whole))
                sigs.append((mix(m) & U(0xFFFF)).astype("<u2").tobytes())
                keys.append(k.view(np.int64))
                at.append(at[-1] + bands)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*ids, pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))],
                names=["doc_id", "node", "text_hash", "n_shingles", "set_hash", "sig", "bands"],
            )

    return _noded(docs).mapInArrow(run, SIG_SCHEMA)


def _noded(docs: DataFrame) -> DataFrame:
    """doc_id, node (doc_id, or a number of the text where that is null), text_hash and text."""
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    nameless = F.lit(NAMELESS) + F.pmod(F.xxhash64("text", F.lit(1)), F.lit(NAMELESS))
    return given.select("doc_id", F.coalesce("doc_id", nameless).alias("node"), F.xxhash64("text").alias("text_hash"), "text")


def least_matches(total: int, batch: int, threshold: float, miss: float) -> list[int]:
    """For each batch end n: the fewest matches at which P(similarity >= threshold | matches of n) >= miss.

    Uniform prior, so the posterior is Beta(m + 1, n - m + 1); its upper tail is a binomial sum.
    """
    need = []
    for n in range(batch, total + 1, batch):
        tail, least = 0.0, 0
        for m in range(n + 1):  # P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)
            tail += exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * log(threshold) + (n + 1 - m) * log(1 - threshold))
            if tail >= miss:
                least = m
                break
        need.append(least)
    return need


def _sets(docs: DataFrame, sigs: DataFrame, width: int) -> DataFrame:
    """Signature and full shingle set (sorted 64-bit hashes) of the texts in ``sigs`` (node, text_hash, sig)."""

    def run(batches):
        memo = WordHashes()
        for b in batches:
            sets = [shingle_set(word_hashes(t.as_py(), memo), width) for t in b.column(2)]
            bits = np.array([_parities(s) for s in sets], np.int64).reshape(-1)
            at = pa.array(range(0, len(bits) + 1, MARKS // 64), pa.int32())
            hashes = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), hashes, pa.ListArray.from_arrays(at, pa.array(bits))], names=["node", "sig", "hashes", "marks"]
            )

    texts = _noded(docs).select("node", "text_hash", "text")
    named = sigs.join(texts, ["node", "text_hash"]).dropDuplicates(["node", "text_hash"])
    return named.select("node", "sig", "text").mapInArrow(run, "node long, sig binary, hashes binary, marks array<long>")


def _parities(s: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes in each of MARKS cells, packed.

    Two sets' parities differ in at most as many cells as the sets differ in members, so too many differing
    cells rule a link out for certain.
    """
    return np.packbits((np.bincount((s >> U(53)).astype(np.int64), minlength=MARKS) & 1).astype(np.uint8)).view(np.int64)


def _verified(pairs: DataFrame, sets: DataFrame, hashes: int, batch: int, percent: int, miss: float) -> DataFrame:
    """Pairs that survive the signature batches and hold on the full sets."""
    need = least_matches(hashes, batch, percent / 100, miss)

    def holds(x: np.ndarray, y: np.ndarray) -> bool:
        if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both)

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(b.num_rows, hashes) for c in (2, 3))
            live, got = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            for k, least in enumerate(need):
                part = slice(k * batch, (k + 1) * batch)
                got[live] += (x[live, part] == y[live, part]).sum(axis=1)
                live = live[got[live] >= least]
            keep = [i for i in live.tolist() if holds(*(np.frombuffer(b.column(c)[i].as_py(), np.uint64) for c in (4, 5)))]
            kept = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(kept), b.column(1).take(kept)], names=["a", "b"])

    sides = [sets.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("hashes").alias(f"hashes_{c}")) for c in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sig_a", "sig_b", "hashes_a", "hashes_b")
    return both.mapInArrow(run, "a long, b long")


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members with their components, of the buckets that hold more than one component."""
    placed = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    ends = {"lo": F.min("comp"), "hi": F.max("comp")}
    return saved(beside_key(placed, "key", ["rep"], ends, "lo < hi").select("key", "rep", "n", "comp"))


#: Members of a bucket that one task compares with so many others.
BLOCK = 512


def _pairs(placed: DataFrame, marked: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in a bucket whose sizes and parity marks allow the threshold.

    A bucket of k blocks is dealt to k * k groups; each member goes to the groups of its block.
    """
    sized = beside_key(placed, "key", ["rep"], {"blocks": F.ceil(F.count("*") / BLOCK)}).join(marked, "rep")
    own = F.expr("pmod(xxhash64(rep), blocks)")
    x = sized.select("*", own.alias("bx"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("by")).alias("x")
    y = sized.select(
        "key", "rep", F.col("n").alias("m"), "comp", "marks", own.alias("by"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("bx")
    ).alias("y")
    apart = "aggregate(zip_with(x.marks, y.marks, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"
    fits = f"100 * n >= {percent} * m and 100 * m >= {percent} * n and {100 + percent} * {apart} <= {100 - percent} * (n + m)"
    both = x.join(y, F.expr(f"x.key = y.key and x.bx = y.bx and x.by = y.by and x.comp < y.comp and {fits}"))
    return both.selectExpr("x.rep as a", "y.rep as b").distinct()


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 4,
    batch: int = 32, miss: float = 1e-9, seed: int = 11, per_round: int = 4, most_rounds: int = 3,
) -> DataFrame:
    """Groups of documents linked by ``100 * |A & B| >= percent * |A | B|`` over ``width``-word shingles.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable), kept and text_hash (xxhash64 of
    the text), one row per input row. Banding misses a pair at the threshold with probability
    (1 - 0.8**rows)**bands (5e-8 here). Words are runs without ASCII white space, A-Z lower-cased. Null,
    empty or blank texts have no shingles and stand alone. Copies share a component. Equal rows count as
    one document. Rows that repeat a doc_id with other texts link by their own texts each, and are one node
    where the doc_id is the smallest of both texts' copies. A row without a doc_id links by its text and is
    kept if no document of its group has a doc_id and its text stands for the group. doc_ids are below
    2**62. An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    sig = saved(signatures(docs, width, bands, rows, seed))
    mark = made_so_far()
    dealt = salted(sig.where("n_shingles > 0"), ["node", "text_hash"])  # copies of one text may be a third of all rows
    classes = dealt.groupBy("set_hash").agg(held_salts(), F.min("node").alias("rep"))
    chosen = classes.select(F.col("rep").alias("node"), F.col("set_hash").alias("own"))
    reps = sig.drop("doc_id").join(chosen, "node").where("set_hash = own").dropDuplicates(["node", "set_hash"])
    members = reps.select(F.explode("bands").alias("key"), F.col("node").alias("rep"), F.col("n_shingles").alias("n"))
    ends = {"lo": F.min("rep"), "hi": F.max("rep")}
    members = saved(beside_key(members, "key", ["rep"], ends, "lo < hi").select("key", "rep", "n"))
    shared = members.select(F.col("rep").alias("node")).distinct()
    sets = saved(_sets(docs, reps.select("node", "text_hash", "sig").join(shared, "node", "left_semi"), width))

    def verified(pairs: DataFrame) -> DataFrame:
        return saved(_verified(pairs, sets, bands * rows, batch, percent, miss))

    fits = f"100 * n >= {percent} * m and 100 * m >= {percent} * n"
    found = spark.createDataFrame([], "node long, comp long")
    placed = members.withColumn("comp", F.col("rep"))
    for round_ in range(most_rounds):
        if round_:
            known = placed.groupBy("key", "comp").agg(F.count("*").alias("k")).groupBy("key")
            known = known.agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"))
            open_ = known.agg(F.sum((F.col("k") * F.col("k") - F.col("kk")) / 2), F.sum("k")).first()
            if (open_[0] or 0) <= 2 * (open_[1] or 0):  # few pairs are left for the bucket members
                break
        draw = F.struct(F.xxhash64("rep", "key", F.lit(round_)).alias("h"), F.col("rep").alias("centre"), F.col("n").alias("m"), F.col("comp").alias("other"))
        drawn = beside_key(placed, "key", ["rep"], {"c": F.min(draw)}).select("rep", "comp", "n", "c.centre", "c.m", "c.other")
        tries = drawn.where("comp <> other").where(fits).groupBy("rep", "centre").agg(F.count("*").alias("k"))
        best = F.slice(F.sort_array(F.collect_list(F.struct("k", "centre")), False), 1, per_round)  # at most ``bands`` to sort
        tries = tries.groupBy("rep").agg(best.alias("best")).select(F.col("rep").alias("a"), F.explode("best.centre").alias("b"))
        links = verified(tries)
        before = found, placed
        found = saved(components(links.unionByName(found.select(F.col("node").alias("a"), F.col("comp").alias("b")))))
        placed = _mixed(members, found)
        drop_saved(links, *before)

    links = verified(_pairs(placed, sets.select(F.col("node").alias("rep"), "marks"), percent))
    found = saved(components(links.unionByName(found.select(F.col("node").alias("a"), F.col("comp").alias("b")))))
    drop_since(mark, found)

    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_hash", "salts", F.coalesce("comp", "rep").alias("comp"))
    some = dealt.join(per_salt(named), ["set_hash", "salt"]).drop("salt")
    none = sig.where("n_shingles = 0").withColumn("comp", F.col("node"))
    out = some.select(*none.columns).unionByName(none)
    named_comp = F.when(F.col("doc_id").isNotNull() & (F.col("comp") < NAMELESS), F.col("comp"))
    return out.select("doc_id", "n_shingles", named_comp.alias("component_id"), (F.col("node") == F.col("comp")).alias("kept"), "text_hash")
