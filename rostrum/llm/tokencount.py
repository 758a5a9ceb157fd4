"""Token counts with a linear longest-match automaton.

The vocabulary is a trie with failure links. Each node also keeps how many pieces greedy longest matching
pops when it leaves the node along its link, so a word's count needs one walk over its bytes and no piece
is ever built.
"""

from __future__ import annotations

import json
import re
from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = 256
_PARTS = re.compile(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class LongestMatch:
    """Greedy longest-match piece counts; a vocabulary piece is a tuple of bytes, END marking a word's end.

    Every byte is a piece, even if the vocabulary lacks it. An end that no piece takes costs nothing.
    """

    def __init__(self, pieces):
        self.next: list[dict[int, int]] = [{}]
        piece = {0: False}
        for word in [*((b,) for b in range(256)), (END,), *pieces]:
            at = 0
            for c in word:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    piece[to] = False
                at = to
            piece[at] = True
        self.link, self.popped = [0] * len(self.next), [0] * len(self.next)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                queue.append(v)
                if piece[v]:
                    self.popped[v] = int(v != self.next[0][END])
                    continue
                z, n = self.link[u], self.popped[u]
                while c not in self.next[z]:
                    n += self.popped[z]
                    z = self.link[z]
                self.link[v], self.popped[v] = self.next[z][c], n

    def count(self, word: bytes) -> int:
        nxt, link, popped = self.next, self.link, self.popped
        v = n = 0
        for c in (*word, END):
            while c not in nxt[v]:
                n += popped[v]
                v = link[v]
            v = nxt[v][c]
        while v:
            n += popped[v]
            v = link[v]
        return n


def spelled_pieces(vocabulary: str) -> list[tuple[int, ...]]:
    """Pieces of a vocabulary file whose words end in ``</w>`` and whose bytes are printable characters."""
    # Bytes that Latin-1 prints stand for themselves, the others follow from U+0100 in rising order.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", ())}
    out = []
    for piece in model["model"]["vocab"]:
        if piece not in special:
            ends = piece.endswith("</w>") and piece != "</w>"
            out.append((*(byte[c] for c in piece.removesuffix("</w>" if ends else "")), *[END] * ends))
    return [p for p in out if p]


@lru_cache(maxsize=2)
def automaton(vocabulary: str) -> LongestMatch:
    return LongestMatch(spelled_pieces(vocabulary))


class _Counts(dict):
    """Piece counts of chunks between white space; forgets all at ``most`` chunks."""

    def __init__(self, vocabulary: str, most: int = 400_000):
        super().__init__()
        self.match, self.most = automaton(vocabulary), most

    def __missing__(self, chunk: str) -> int:
        n = sum(self.match.count(w.encode("utf-8", "surrogatepass")) for w in _PARTS.findall(chunk))
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = n
        return n


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_chars, n_chunks (runs without white space), n_tokens of every whole text.

    Texts are lower-cased and cut into letter runs, single digits and runs of other signs. Null and empty
    texts have no tokens. Every row gives one row, in one pass without a shuffle.
    """

    def run(batches):
        counts = _Counts(vocabulary)
        for b in batches:
            chars, chunks, tokens = [], [], []
            for text in b.column(1):
                text = text.as_py() or ""
                words = text.lower().split()
                chars.append(len(text)), chunks.append(len(words)), tokens.append(sum(map(counts.__getitem__, words)))
            cols = [pa.array(x, pa.int64()) for x in (chars, chunks, tokens)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_chars", "n_chunks", "n_tokens"])

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return given.mapInArrow(run, "doc_id long, n_chars long, n_chunks long, n_tokens long")
