"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

The automaton holds every run of consecutive words of every item. Training words are streamed through
it; the longest matching length at each word tells which windows of items end there. Spans of hit
words are removed from the text, and texts that are mostly benchmark are emptied.
"""

from __future__ import annotations

import re
from array import array
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import fresh, saved

#: A-Z to a-z; bytes that are no word characters (below 0x80, other than 0-9 and a-z) to spaces.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def folded(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD) if text else b""


class ItemAutomaton:
    """Suffix automaton over the word ids of several items, with the items that own each window.

    Transitions are one table from (state, word) to state; states have no objects of their own.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: dict[int, int] = {}  # state << 32 | word
        self.link, self.length = array("i", [-1]), array("i", [0])
        # the words that lead out of a state, as a linked list: only copies of states need them
        self._last, self._word, self._before = array("i", [-1]), array("i"), array("i")
        self.names = [name for name, _ in items]
        spelled = [array("i", [self.words.setdefault(w, len(self.words)) for w in words]) for _, words in items]
        for ids in spelled:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.shortest = min([window, *(len(x) for x in spelled if x)])
        self.sizes = sorted({min(window, len(x)) for x in spelled if x})
        #: state * (window + 1) + size of every whole window: the item that holds it, or a list of several in their order.
        self.owners: dict[int, int | list[int]] = {}
        for item, ids in enumerate(spelled):
            state, length, size = 0, 0, min(window, len(ids))
            for c in ids:
                state, length = self.step(state, length, c)
                if length >= size and size:
                    key = self._at(state, size) * (window + 1) + size
                    have = self.owners.get(key)
                    if have is None:
                        self.owners[key] = item
                    elif isinstance(have, list):
                        if have[-1] != item:
                            have.append(item)
                    elif have != item:
                        self.owners[key] = [have, item]
        del self._last, self._word, self._before
        self._found: dict[int, list[tuple[int, list[int]]]] = {}

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self._last.append(-1)
        return len(self.length) - 1

    def _lead(self, state: int, c: int, to: int) -> None:
        key = state << 32 | c
        if key not in self.next:
            self._word.append(c)
            self._before.append(self._last[state])
            self._last[state] = len(self._word) - 1
        self.next[key] = to

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt.get(last << 32 | c)
        if q is not None:  # another item has been here
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        now = self._state(length[last] + 1, 0)
        p = last
        while p >= 0 and p << 32 | c not in nxt:
            self._lead(p, c, now)
            p = link[p]
        if p >= 0:
            q = nxt[p << 32 | c]
            link[now] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return now

    def _clone(self, p: int, c: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, self.link[q])
        at = self._last[q]
        while at >= 0:
            self._lead(twin, self._word[at], self.next[q << 32 | self._word[at]])
            at = self._before[at]
        self.link[q] = twin
        while p >= 0 and self.next.get(p << 32 | c) == q:
            self.next[p << 32 | c] = twin
            p = self.link[p]
        return twin

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """The state and longest matching length after one more word."""
        to = self.next.get(state << 32 | c)
        while to is None and state:
            state = self.link[state]
            length = self.length[state]
            to = self.next.get(state << 32 | c)
        return (0, 0) if to is None else (to, length + 1)

    def _at(self, state: int, size: int) -> int:
        """The state of the suffix of ``size`` words of a match that ended in ``state``."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def windows(self, state: int) -> list[tuple[int, list[int]]]:
        """(size, items) of every whole window that is a suffix of the state's longest word run."""
        if state not in self._found:
            if len(self._found) >= 50_000:  # start again rather than grow on
                self._found.clear()
            out, s = [], state
            while s > 0:
                for size in self.sizes:
                    have = self.owners.get(s * (self.window + 1) + size)
                    if have is not None:
                        out.append((size, have if isinstance(have, list) else [have]))
                s = self.link[s]
            self._found[state] = sorted(out)
        return self._found[state]

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Marks of hit words, and the items of which a window occurs."""
        hit, items = np.zeros(len(words), bool), set()
        ids = list(map(self.words.get, words))
        known = np.fromiter((x is not None for x in ids), bool, len(ids))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if hi - lo < self.shortest:
                continue
            state = length = 0
            for j in range(lo, hi):
                state, length = self.step(state, length, ids[j])
                if length >= self.shortest:
                    for size, owners in self.windows(state):
                        if size > length:
                            break
                        hit[j - size + 1 : j + 1] = True
                        items.update(owners)
        return hit, items


def _cut(text: str, marks: np.ndarray, min_span: int, max_cover: float) -> str:
    """``text`` without its hit spans of at least ``min_span`` words; empty if too much of it is hit."""
    if marks.sum() > max_cover * len(marks):
        return ""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(folded(text))]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], marks.view(np.int8), [0]))))
    out, done = [], 0
    for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if hi - lo >= min_span:
            out.append(raw[done : at[lo][0]])
            done = at[hi - 1][1]
    return b"".join([*out, raw[done:]]).decode("utf-8", "surrogatepass")


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 10, min_span: int = 1, max_cover: float = 0.5,
    most_words: int = 600_000, keep_text: bool = True,
) -> DataFrame:
    """``docs`` plus n_words, n_hit, item_ids (sorted as strings) and clean (text without hit spans).

    ``items`` has item_id and text. Words are runs of ``[0-9a-z]`` and non-ASCII characters, A-Z
    lower-cased. A window is ``window`` consecutive item words, or a whole shorter item. Spans of at
    least ``min_span`` hit words are cut out; a text of which more than ``max_cover`` is hit becomes
    empty. Without ``keep_text`` clean is null and no text leaves the tasks.

    One automaton holds about ``most_words`` item words (items are dealt by hash), which takes
    about 240 MB in a Python worker and on the driver (0.4 kB a word, measured) and 27 MB to broadcast.
    A larger item table is dealt into several automata: each but the last is one pass over the texts that
    writes only the marks of hit texts, which the last pass joins by text, so nothing is lost. Null text
    has no words and stays null. Items without words match nothing; items that repeat an item_id count
    once. Rows of ``docs`` that repeat stay; an empty table gives none. Columns of ``docs`` with the added
    names are replaced, others pass through.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_words", "n_hit", "item_ids", "clean")])
    sized = items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("text is not null and item_id is not null")
    total = sized.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    parts = max(1, -(-total // most_words))

    def automaton(part: int):
        own = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else sized
        rows = [(r.item_id, folded(r.text).split()) for r in own.orderBy("item_id", "text").toLocalIterator()]
        return spark.sparkContext.broadcast(ItemAutomaton(rows, window))

    marks, items_ = fresh(docs, "hits"), fresh(docs, "items")
    if parts > 1:
        key = fresh(docs, "text_key")
        whole = F.sha2("text", 256)
        texts = docs.select(F.col("text").cast("string").alias("text"))
        found = [saved(_marked(texts, automaton(k)).select(whole.alias(key), "hits", "items").distinct()) for k in range(parts - 1)]
        every = reduce(DataFrame.unionByName, found).groupBy(key)  # at most ``parts`` rows a text
        every = every.agg(F.collect_list("hits").alias(marks), F.array_distinct(F.flatten(F.collect_list("items"))).alias(items_))
        docs = docs.withColumn(key, whole).join(every, key, "left").drop(key)
    return _scanned(docs, automaton(parts - 1), min_span, max_cover, keep_text, marks, items_)


def _marked(texts: DataFrame, automaton) -> DataFrame:
    """text, hits (packed marks) and items of the texts that an automaton hits."""

    def run(batches):
        sam = automaton.value
        for b in batches:
            at, hits, items = [], [], []
            for i, text in enumerate(b.column(0)):
                hit, found = sam.scan(folded(text.as_py()).split())
                if found:
                    at.append(i), hits.append(np.packbits(hit).tobytes()), items.append(sorted(sam.names[k] for k in found))
            rows = [b.column(0).take(pa.array(at, pa.int64())), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(rows, names=["text", "hits", "items"])

    return texts.mapInArrow(run, "text string, hits binary, items array<string>")


def _scanned(docs: DataFrame, automaton, min_span: int, max_cover: float, keep_text: bool, marks: str, items: str) -> DataFrame:
    """The last pass; marks and items of earlier automata, if there are such columns, are merged in."""
    names = docs.columns
    rest = [c for c in names if c not in (marks, items) and (keep_text or c != "text")]
    kinds = StructType.fromDDL("n_words long, n_hit long, item_ids array<string>, clean string")
    out = StructType([*docs.select(*rest).schema, *kinds])
    arrow = [(f.name, to_arrow_type(f.dataType)) for f in kinds]

    def run(batches):
        sam = automaton.value
        for b in batches:
            col = dict(zip(names, b.columns))
            made = []
            for i, text in enumerate(x.as_py() for x in col["text"]):
                hit, found = sam.scan(folded(text).split())
                owners = {sam.names[k] for k in found}
                if marks in col:
                    for before in col[marks][i].as_py() or ():
                        hit |= np.unpackbits(np.frombuffer(before, np.uint8), count=len(hit)).astype(bool)
                    owners |= set(col[items][i].as_py() or ())
                n_hit = int(hit.sum())
                clean = None if not keep_text else _cut(text, hit, min_span, max_cover) if n_hit else text
                made.append((len(hit), n_hit, sorted(owners), clean))
            added = [pa.array([m[k] for m in made], kind) for k, (_, kind) in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([col[c] for c in rest] + added, names=rest + [n for n, _ in arrow])

    return docs.mapInArrow(run, out)
