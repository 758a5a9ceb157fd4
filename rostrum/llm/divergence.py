"""Divergence of the sources of each language: a tournament of resident groups and circulating vectors.

A group (language and source) is a vector of term counts, cut into slices of terms, so that no vector is
ever whole in one place. Groups of a slice sit in seats, a few to a seat. A seat stays in the partition that
its key gives it; in every round of a round-robin tournament (the circle method) a seat's compressed vectors
go to the seat it meets, so that after all rounds each two seats have met once. A meeting gives both
directions of each pair of groups. Sums over slices give the pairs' values. What distinguishes a group from
its language is ranked by a heap in each slice, and then over the heaps' few entries.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Terms of a slice (as expected; they are dealt by hash), groups of a seat, and rounds of one job.
SLICE_TERMS, SEAT_GROUPS, WAVE = 1 << 14, 4, 8
#: Terms of a task's groups before it passes its counts on; bytes of a text that are split at once.
_MOST, _STRETCH = 300_000, 1 << 22
_KEY = ["lang", "slice", "seat"]
#: A-Z in lower case, a-z and all bytes of non-ASCII characters stay; the rest parts terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_SEAT = pa.schema([
    ("lang", pa.string()), ("slice", pa.int32()), ("seat", pa.int32()), ("seats", pa.int32()), ("sources", pa.list_(pa.string())),
    ("sizes", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64())), ("kinds", pa.int64()), ("width", pa.int64()), ("vectors", pa.binary()),
    ("best", pa.list_(pa.struct([("source", pa.string()), ("item", pa.string()), ("value", pa.int64())]))),
])
_SEAT_SQL = (
    "lang string, slice int, seat int, seats int, sources array<string>, sizes array<long>, totals array<long>, kinds long, width long, "
    "vectors binary, best array<struct<source:string,item:string,value:long>>"
)
_PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def terms(text: bytes):
    """Lists of a text's terms, a stretch of the text at a time."""
    clean = text.translate(_TERM_BYTES)
    at = 0
    while at < len(clean):
        end = clean.find(b" ", at + _STRETCH)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def _counted(most: int):
    """(lang, source, term, n, docs) of a task's rows, in several parts if they are many; a null term for each group."""

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def parts():
            for (lang, source), (n, docs) in held.items():
                k = len(n) + 1
                words = pa.array([None, *n], pa.binary()).cast(pa.string())
                counts = [pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())]
                columns = [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), words, *counts]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for words in terms(text.as_py()):
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
                size += len(n) - before
                if size >= most:
                    yield from parts()
                    held.clear()
                    size = 0
        yield from parts()

    return run


def share(count: np.ndarray, total: int, kinds: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 kinds)), digit by digit, so exact for totals up to 9 * 10^15."""
    rest, by = count.astype(np.int64) + 2, np.int64(total + 2 * kinds)
    out = rest // by
    for _ in range(3):
        rest = rest % by * 1000
        out = out * 1000 + rest // by
    return out + 1


def divergence_of(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _seated(top: int):
    """Of one seat's rows: its groups' vectors, compressed, and each group's ``top`` terms above its language."""

    def run(key, rows):
        import zstandard

        lang, slice_, seat = (k.as_py() for k in key)
        heads = rows.filter(pc.is_null(rows.column("id"))).sort_by("source").to_pylist()
        entries = rows.filter(pc.is_valid(rows.column("id")))
        place = pc.index_in(entries.column("source"), pa.array([h["source"] for h in heads], pa.string())).to_numpy()
        ids, counts, overall = (entries.column(c).to_numpy() for c in ("id", "n", "total"))
        words = entries.column("term").combine_chunks() if entries.num_rows else None
        packed, sizes, best = [], [], []
        for k, h in enumerate(heads):
            own = np.flatnonzero(place == k)
            own = own[np.argsort(ids[own])]
            sizes.append(len(own))
            packed += [np.diff(ids[own], prepend=0).astype("<u4").tobytes(), counts[own].astype("<u8").tobytes()]
            if not len(own):
                continue
            p, q = share(counts[own], h["group_n"], h["kinds"]), share(overall[own], h["lang_n"], h["kinds"])
            above = np.flatnonzero(p > q)
            value = divergence_of(p[above], q[above])
            if len(above) > top:
                fit = value >= np.partition(value, len(value) - top)[len(value) - top]
                above, value = above[fit], value[fit]
            heap = heapq.nsmallest(top, ((-int(v), words[int(i)].as_py().encode()) for v, i in zip(value, own[above])))
            best += [{"source": h["source"], "item": w.decode(), "value": -v} for v, w in heap]
        one = heads[0]
        row = {
            "lang": lang, "slice": slice_, "seat": seat, "seats": one["seats"], "sources": [h["source"] for h in heads], "sizes": sizes,
            "totals": [h["group_n"] for h in heads], "kinds": one["kinds"], "width": one["width"],
            "vectors": zstandard.ZstdCompressor(level=3).compress(b"".join(packed)), "best": best,
        }
        return pa.Table.from_pylist([row], schema=_SEAT)

    return run


def _vectors(row: dict):
    """(source, p of every term of the slice) of a seat's groups, one at a time."""
    import zstandard

    raw, at = zstandard.ZstdDecompressor().decompress(row["vectors"]), 0
    for source, size, total in zip(row["sources"], row["sizes"], row["totals"]):
        ids = np.cumsum(np.frombuffer(raw, "<u4", size, at).astype(np.int64))
        counts = np.zeros(row["width"], np.int64)
        counts[ids] = np.frombuffer(raw, "<u8", size, at + 4 * size).astype(np.int64)
        at += 12 * size
        yield source, share(counts, total, row["kinds"]) if row["width"] else counts


def _meeting(inner: bool):
    """A seat and the seats that visit it: both directions of each pair of groups; with ``inner`` of its own groups too."""

    def run(key, hosts, guests):
        out: dict[str, list] = {name: [] for name in _PAIRS.names}

        def met(a, p, b, q):
            value = int(divergence_of(p, q).sum()) if len(p) else 0  # the same for both directions
            for source, item in ((a, b), (b, a)):
                for name, x in zip(_PAIRS.names, (key[0].as_py(), source, item, value)):
                    out[name].append(x)

        for host in hosts.to_pylist():
            own = list(_vectors(host))
            if inner:
                for k, (a, p) in enumerate(own):
                    for b, q in own[:k]:
                        met(a, p, b, q)
            for guest in guests.to_pylist():
                for b, q in _vectors(guest):
                    for a, p in own:
                        met(a, p, b, q)
        return pa.table(out, schema=_PAIRS)

    return run


def _visitors(seats: DataFrame, first: int, last: int) -> DataFrame:
    """Seats that visit in rounds ``first`` to ``last`` - 1, under the key of the seat they meet.

    With an even number e of seats (an empty one is added), seat e - 1 meets in round r the seat x with
    2x = r mod e - 1, and each other seat i the seat r - i mod e - 1, or seat e - 1 where that is itself.
    """
    rows = seats.withColumns({"even": F.expr("seats + seats % 2"), "round": F.explode(F.sequence(F.lit(first), F.lit(last - 1)))}).where("round < even - 1")
    facing = F.expr("if(seat = even - 1, pmod(round * (even div 2), even - 1), if(pmod(round - seat, even - 1) = seat, even - 1, pmod(round - seat, even - 1)))")
    rows = rows.withColumn("facing", facing.cast("int")).where("facing < seats")
    host = F.expr("if((seat + facing) % 2 = 0, least(seat, facing), greatest(seat, facing))")
    return rows.withColumn("host", host).where("host <> seat").drop("seat", "even", "round", "facing").withColumnRenamed("host", "seat").select(*seats.columns)


def divergences(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: how far a language's sources are apart, and each one's ``top`` terms.

    A term is kept for a language if ``least_docs`` of its rows hold it. Part ``pair`` has every other source
    of the language with the summed divergence of all kept terms, part ``term`` the terms that a source uses
    more than its language does. Null texts, langs and sources are empty ones. Rows that repeat count each
    time, whatever their doc_id; a language without kept terms has values of 0; ties go by the item's bytes;
    an empty table gives no rows.
    """
    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    given = given.withColumn("text", F.col("text").cast("binary"))
    parts = given.mapInArrow(_counted(_MOST), "lang string, source string, term string, n long, docs long")
    counts = saved(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
    kept = saved(kept.where(F.col("docs") >= least_docs).drop("docs"))
    langs = saved(kept.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("total").alias("lang_n")))
    slices = max(1, -(-(langs.agg(F.max("kinds")).first()[0] or 0) // SLICE_TERMS))
    kept = kept.withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(slices)).cast("int"))
    kept = kept.withColumn("id", (F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term")) - 1).cast("long"))
    entries = saved(counts.where("term is not null").drop("docs").join(kept, ["lang", "term"]))
    # one small row a group: its seat, and what its language's terms add up to
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = counts.where("term is null").select("lang", "source").withColumn("seat", F.floor(at / SEAT_GROUPS).cast("int"))
    groups = groups.withColumn("seats", F.max("seat").over(Window.partitionBy("lang")) + 1)
    groups = groups.join(entries.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = saved(groups.fillna(0, ["group_n", "kinds", "lang_n"]))
    heads = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    heads = heads.join(entries.groupBy("lang", "slice").agg((F.max("id") + 1).alias("width")), ["lang", "slice"], "left").fillna(0, ["width"])
    rows = heads.unionByName(entries.join(groups.select("lang", "source", "seat"), ["lang", "source"]), allowMissingColumns=True)
    seats = saved(rows.groupBy(*_KEY).applyInArrow(_seated(top), _SEAT_SQL))
    most = groups.agg(F.max("seats")).first()[0] or 0
    resident, met = seats.drop("best"), []
    for first in range(0, max(1, most + most % 2 - 1), WAVE):
        visitors = _visitors(resident, first, min(first + WAVE, max(1, most + most % 2 - 1)))
        wave = resident.groupBy(*_KEY).cogroup(visitors.groupBy(*_KEY)).applyInArrow(_meeting(first == 0), "lang string, source string, item string, value long")
        met.append(saved(wave.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))))
    pairs = met[0]
    for more in met[1:]:
        pairs = pairs.unionByName(more)  # no two waves have a pair in common
    pairs = pairs.withColumn("part", F.lit("pair"))
    best = seats.select("lang", F.explode("best").alias("b")).select("lang", "b.*").withColumn("part", F.lit("term"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = pairs.unionByName(best).withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
