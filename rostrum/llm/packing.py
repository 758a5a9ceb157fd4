"""Best-fit packing of tokenised documents by bin completion.

Only the number of pieces of each length matters to the plan, so the search runs over a table of at
most ``size`` counts, whatever the input. Around the largest length left it enumerates undominated
fillings in rising order of waste; the first one is applied as often as the counts allow. That plan and the
best-fit plan are the incumbents; where they are above the lower bound, the most wasteful sequences are
packed anew by branch and bound over their undominated fillings, pruned by the waste that a better plan
may have. The plan is a bounded list of patterns; Spark gives every piece its rank among the pieces of its
length, and the rank selects the pattern's copy and place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import saved

_LETTERS = "'(?:[sdmt]|ll|ve|re)| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"


class Encoder:
    """Byte-level BPE ids of texts as little-endian uint32 bytes, equal to those of ``tokenizers``.

    A pre-token never crosses a single space between other characters, so ids are kept by chunk between
    spaces (at most ``most`` chunks); a text with a chunk of white space only is encoded as a whole. The
    strings of added tokens are those tokens, as ``tokenizers`` has it; with ``special_as_text`` they are
    ordinary text.
    """

    def __init__(self, vocabulary: str, most: int = 300_000, special_as_text: bool = False):
        import json
        import re

        import tiktoken

        # The vocabulary file spells bytes as printable characters: those of Latin-1 as they are, the
        # other bytes in rising order from U+0100.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)
        added = model.get("added_tokens", ())
        special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take white space or whole words are not supported")
        longest_first = "|".join(re.escape(t) for t in sorted(special, key=len, reverse=True))
        self.added = re.compile(f"({longest_first})") if special and not special_as_text else None
        self.special = special
        ranks = {bytes(byte[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
        core = tiktoken.Encoding("vocabulary", pat_str=_LETTERS, mergeable_ranks=ranks, special_tokens={})
        self.encode = lambda text: bytes(core._core_bpe.encode_to_tiktoken_buffer(text, set()))
        self.known: dict[str, bytes] = {}
        self.most = most

    def _chunk(self, chunk: str) -> bytes | None:
        got = self.known.get(chunk)
        if got is None:
            if not chunk or chunk.isspace():
                return None
            if len(chunk) > 64:
                return self.encode(" " + chunk)
            if len(self.known) >= self.most:
                self.known.clear()
            got = self.known[chunk] = self.encode(" " + chunk)
        return got

    def ids(self, text: str | None) -> bytes:
        if self.added and text and self.added.search(text):  # the text between added tokens stands alone
            parts = self.added.split(text)
            return b"".join(self.special[x] if k % 2 else self._plain(x) for k, x in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str | None) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        get, out = self.known.get, [self.encode(first)]
        if not first or first.isspace():
            return self.encode(text)
        for chunk in rest:
            got = get(chunk)
            if got is None:
                got = self._chunk(chunk)
                if got is None:
                    return self.encode(text)
            out.append(got)
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(vocabulary)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, rank long"


def pieces(docs: DataFrame, vocabulary: str, size: int, end_id: int) -> DataFrame:
    """Pieces of at most ``size`` ids; pid and rank count the pieces of a length within their task."""

    def run(batches):
        from pyspark import TaskContext

        pid, enc, seen = TaskContext.get().partitionId(), encoder(vocabulary), [0] * (size + 1)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = enc.ids(text.as_py()) + end
                total = len(ids) // 4
                lo, hi = 0, total % size or min(size, total)
                k = 0
                while lo < total:
                    rows.append((doc, k, lo, hi - lo, zlib.crc32(memoryview(ids)[4 * lo : 4 * hi]), pid, seen[hi - lo]))
                    seen[hi - lo] += 1
                    lo, hi, k = hi, hi + size, k + 1
            for i in range(0, len(rows), 20_000):
                cols = list(zip(*rows[i : i + 20_000]))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=NAMES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


NAMES = [x.split()[0] for x in PIECES.split(", ")]


def _sums(stock: list[tuple[int, int]], room: int) -> list[int]:
    """For each k, the sums up to ``room`` of the k smallest (length, count) of ``stock``, as bits."""
    mask, reach, out = (1 << room + 1) - 1, 1, [1]
    for s, n in stock:
        n, k = min(n, room // s), 1
        while n > 0:
            reach |= reach << min(k, n) * s
            n, k = n - k, 2 * k
        reach &= mask
        out.append(reach)
    return out


def _dominated(fill: list[int], stock: list[tuple[int, int]], waste: int) -> bool:
    """Whether some of the pieces of ``fill`` could make way for one longer piece of the stock without overflow.

    What they fill is then filled as well by that piece, and they fit wherever it would have gone.
    """
    if len(fill) > 24:
        return False
    used, sums, at = Counter(fill), 1, 0
    rising = sorted(fill)
    for x, n in stock:
        while at < len(rising) and rising[at] < x:
            sums |= sums << rising[at]
            at += 1
        if n > used[x] and at and sums >> max(x - waste, 1) & (1 << min(x, waste + 1)) - 1:
            return True
    return False


def fillings(left: dict[int, int], room: int, least: int = 0) -> Iterator[list[int]]:
    """Undominated fillings of ``room`` that sum to ``least`` or more, by falling sum, longest pieces first."""
    stock = sorted((s, n) for s, n in left.items() if n and s <= room)
    reach = _sums(stock, room)

    def of(total: int, upto: int) -> Iterator[list[int]]:
        if not total:
            yield []
            return
        for i in range(min(upto, bisect_right(stock, (total, 1 << 62))) - 1, -1, -1):
            s, n = stock[i]
            if not reach[i + 1] >> total & 1:
                return
            for k in range(min(n, total // s), 0, -1):
                if reach[i] >> total - k * s & 1:
                    for rest in of(total - k * s, i):
                        yield [s] * k + rest

    first = True
    for total in range(reach[-1].bit_length() - 1, least - 1, -1):
        if reach[-1] >> total & 1:
            for fill in of(total, len(stock)):
                if first or not _dominated(fill, stock, room - total):  # the first is never dominated
                    yield fill
                first = False


def least_sequences(counts: dict[int, int], size: int) -> int:
    """A lower bound on the sequences that pieces of these lengths take (Martello and Toth's second one)."""
    n = np.zeros(size + 1, object)
    for s, k in counts.items():
        n[s] += k
    weight = n * np.arange(size + 1)
    best = -(-int(weight.sum()) // size)
    half = size // 2
    for k in range(1, half + 1):  # pieces under k are left out; none of length k or more fits beside those over size - k
        alone, wide = int(n[size - k + 1 :].sum()), int(n[half + 1 : size - k + 1].sum())
        spare = wide * size - int(weight[half + 1 : size - k + 1].sum())
        best = max(best, alone + wide + max(0, -(-(int(weight[k : half + 1].sum()) - spare) // size)))
    return best


Plan = list[tuple[int, list[int]]]


def _applied(counts: dict[int, int], size: int, choose) -> Plan:
    """Patterns that use up ``counts``: the longest piece and what ``choose`` adds, as often as counts allow."""
    left = {s: n for s, n in counts.items() if n}
    out = []
    while left:
        top = max(left)
        left[top] -= 1
        fill = [top, *choose(left, size - top)]
        left[top] += 1
        need = Counter(fill)
        times = min(left[s] // n for s, n in need.items())
        for s, n in need.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        out.append((times, fill))
    return out


def _best_fit(left: dict[int, int], room: int) -> list[int]:
    """The longest piece that fits, again and again."""
    out, use = [], Counter()
    for s in sorted(left, reverse=True):
        k = min(left[s] - use[s], room // s)
        out += [s] * k
        use[s] += k
        room -= k * s
    return out


def _sequences(plan_: Plan) -> int:
    return sum(times for times, _ in plan_)


def _searched(counts: dict[int, int], size: int, best: Plan, nodes: int) -> Plan:
    """The best plan of few pieces by branch and bound; ``best`` is the incumbent."""
    total, bound = sum(s * n for s, n in counts.items()), least_sequences(counts, size)
    left, chosen, spent = dict(counts), [], 0

    def branch(waste: int) -> bool:
        """True where the search is over."""
        nonlocal best, spent
        spent += 1
        top = max((s for s, n in left.items() if n), default=0)
        if not top:
            if len(chosen) < _sequences(best):
                best = [(1, list(f)) for f in chosen]
            return _sequences(best) <= bound
        if spent >= nodes:
            return True
        left[top] -= 1
        for fill in fillings(left, size - top):
            lost = size - top - sum(fill)
            if waste + lost > (_sequences(best) - 1) * size - total:  # no better plan wastes so much
                break
            for s in fill:
                left[s] -= 1
            chosen.append([top, *fill])
            over = branch(waste + lost)
            chosen.pop()
            for s in fill:
                left[s] += 1
            if over:
                left[top] += 1
                return True
        left[top] += 1
        return False

    branch(0)
    return best


def plan(counts: dict[int, int], size: int, few: int = 120, nodes: int = 3000) -> Plan:
    """(copies, lengths) patterns that use up ``counts`` pieces of each length below ``size``.

    Packing is NP-hard, so the search has a stated bound: branch and bound takes the most wasteful
    sequences with ``few`` pieces at most and ends after ``nodes`` nodes; the incumbent stands then. A table
    of ``few`` pieces or less is searched as a whole. :func:`least_sequences` says how far a plan can be
    from the best one.
    """
    own = {s: n for s, n in counts.items() if n and s < size}
    best = min((_applied(own, size, f) for f in (lambda left, room: next(fillings(left, room), []), _best_fit)), key=_sequences)
    if _sequences(best) <= least_sequences(own, size):
        return best
    kept, again, pieces_ = [], [], 0
    for times, fill in sorted(best, key=lambda p: sum(p[1])):  # the most wasteful first
        take = min(times, max(0, (few - pieces_) // len(fill)))
        pieces_ += take * len(fill)
        again += [(take, fill)] * (take > 0)
        kept += [(times - take, fill)] * (take < times)
    tail = Counter()
    for times, fill in again:
        for s in fill:
            tail[s] += times
    return kept + _searched(tail, size, again, nodes)


def _places(patterns: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, offset): where runs of ranks go."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for times, fill in patterns:
        at = 0
        for s in fill:
            first = taken.get(s, 0)
            out.setdefault(s, []).append((first, sequence, at))
            taken[s] = first + times
            at += s
        sequence += times
    return {s: np.array(v, np.int64) for s, v in out.items()}


def pack(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """Every piece of every document with its sequence_id and offset.

    A document's ids plus ``end_id``; null or empty texts are the end id alone. Longer ones are cut into
    ``size`` ids, the first piece being the shorter one. Full pieces are sequences of their own; all
    others go where the plan puts their length and rank. Rows that repeat, doc_ids too, stay separate rows.
    Other columns are not read; an empty table gives no rows.
    """
    cut = saved(pieces(docs, vocabulary, size, end_id))
    by_task = cut.groupBy("length", "pid").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    first = saved(by_task.withColumn("first", F.coalesce(before, F.lit(0))))
    # at most ``size`` rows, whatever the input
    counts = {r.length: r.n for r in first.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    patterns = plan(counts, size)
    places = _places(patterns)
    made = sum(times for times, _ in patterns)
    shared = docs.sparkSession.sparkContext.broadcast(places)

    def run(batches):
        where = shared.value
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length).tolist():
                own = np.flatnonzero(length == s)
                if s == size:
                    sequence[own] = made + rank[own]
                    continue
                table = where[s]
                i = np.searchsorted(table[:, 0], rank[own], side="right") - 1
                sequence[own] = table[i, 1] + rank[own] - table[i, 0]
                offset[own] = table[i, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*NAMES[:5], "sequence_id", "offset"])

    # lengths times tasks: too many rows to broadcast
    ranked = cut.join(first.select("length", "pid", "first").hint("merge"), ["length", "pid"])
    ranked = ranked.select(*NAMES[:5], (F.col("rank") + F.col("first")).alias("rank"))
    return ranked.mapInArrow(run, ", ".join(PIECES.split(", ")[:5]) + ", sequence_id long, offset long")
