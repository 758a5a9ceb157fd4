"""Likelihood of texts under a subword lattice: all segmentations of every word count, none is chosen.

The pieces come from an existing vocabulary. A text is a sequence of independent pieces that an end closes, so
its probability is the product over its words of what the paths of the word's lattice sum up to, and of the
end. The vocabulary's scores are where the pieces' weights begin; rounds of expectation maximisation over the
words of the training documents refine them.

Texts are read once. Each task deals its documents to blocks as bags of numbers of the block's words; the
blocks' words are counted and weighed once for the whole corpus, and what a block asked for comes back to it.
No table of all words is in one place, and no text is exchanged.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, saved

#: What marks the begin of a word in the pieces.
MARK = "▁"
#: A block is closed at so many words, documents or bytes of bags; bytes of a text that are split at once.
_WORDS, _DOCS, _BAGS, _STRETCH = 1 << 18, 50_000, 16 << 20, 1 << 22
_ONE = 1 << 16  # expected counts are summed in such fractions, so that no order of tasks changes them
_DEALT = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("bag", pa.binary()), ("place", pa.int32()), ("word", pa.binary()), ("n", pa.int64())])
_DEALT_SQL = "block long, doc_id long, held_out boolean, bag binary, place int, word binary, n long"


def read_pieces(model_file: str) -> tuple[list[str | int], list[float]]:
    """(pieces, start weights) of a vocabulary; the 256 byte pieces are numbers. Weights are logarithms.

    The scores of a unigram vocabulary are log-probabilities. Those of one made by merges are its ranks, which
    begin as Zipf's weights; bytes and a mark alone then rank last. Longer pieces that no merge makes are left out.
    """
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and (sp.get_score(i) > -1e8 or sp.id_to_piece(i) == MARK)]
    scores = [sp.get_score(i) for i in ids]
    if all(s == int(s) for s in scores):
        low = min(s for s in scores if s > -1e8)
        scores = [-math.log(2 - (low if sp.is_byte(i) else max(s, low))) for i, s in zip(ids, scores)]
    return [int(sp.id_to_piece(i)[3:5], 16) if sp.is_byte(i) else sp.id_to_piece(i) for i in ids], scores


class Lattice:
    """The segmentations of words into pieces with weights (logarithms). A character that is no piece is spelled in bytes."""

    def __init__(self, pieces: list[str | int], weights):
        self.weights, self.tree, self.bytes = list(weights), {}, {}
        for k, piece in enumerate(pieces):
            if isinstance(piece, int):
                self.bytes[piece] = k
                continue
            for j in range(1, len(piece)):
                self.tree.setdefault(piece[:j], None)
            self.tree[piece] = k
        self.least = min(self.weights)

    def spelled(self, char: str) -> tuple[list[int], float]:
        """Byte pieces of a character and their weight; a byte that the vocabulary lacks weighs as its least piece."""
        own = [self.bytes.get(b) for b in char.encode("utf-8", "surrogatepass")]
        return [k for k in own if k is not None], sum(self.least if k is None else self.weights[k] for k in own)

    def arcs(self, word: str):
        """(from, to, piece or None, weight) in order of from."""
        s, tree, weights = MARK + word, self.tree, self.weights
        for i in range(len(s)):
            if tree.get(s[i]) is None:
                yield i, i + 1, None, self.spelled(s[i])[1]
            for j in range(i + 1, len(s) + 1):
                k = tree.get(s[i:j], -1)
                if k == -1:
                    break
                if k is not None:
                    yield i, j, k, weights[k]

    def forward(self, word: str) -> float:
        """Logarithm of the summed weights of all paths."""
        return self._forward(self.arcs(word), len(word) + 1)[-1]

    @staticmethod
    def _forward(arcs, n: int) -> list[float]:
        exp, log1p = math.exp, math.log1p
        alpha: list = [None] * (n + 1)
        alpha[0] = 0.0
        for i, j, _, w in arcs:
            v, old = alpha[i] + w, alpha[j]
            if old is None:
                alpha[j] = v
            else:
                alpha[j] = v + log1p(exp(old - v)) if v > old else old + log1p(exp(v - old))
        return alpha

    def expect(self, word: str, times: int, into: np.ndarray) -> None:
        """Add to ``into`` how often each piece is expected in ``times`` such words."""
        arcs = list(self.arcs(word))
        n = len(word) + 1
        alpha = self._forward(arcs, n)
        beta = self._forward(((n - j, n - i, k, w) for i, j, k, w in reversed(arcs)), n)
        for i, j, k, w in arcs:
            share = round(_ONE * times * math.exp(alpha[i] + w + beta[n - j] - alpha[n]))
            for piece in (k,) if k is not None else self.spelled((MARK + word)[i])[0]:
                into[piece] += share


class Lattices(Lattice):
    """The same for many words at once: words of equal length walk the trie of the pieces side by side.

    The trie is a table over the characters, but A-Z, that most pieces have and that are pieces themselves;
    words with others, and long ones, are taken one by one.
    """

    def __init__(self, pieces: list[str | int], weights, letters: int = 200, longest: int = 48):
        super().__init__(pieces, weights)
        self.longest = longest
        common = Counter(c for p in pieces if isinstance(p, str) for c in set(p) if self.tree.get(c) is not None and not "A" <= c <= "Z")
        self.letter = np.zeros(0x110000, np.uint8)  # 0: none
        for k, (c, _) in enumerate(common.most_common(letters)):
            self.letter[ord(c)] = k + 1
        step, piece = {}, [-1, -1]  # state 0 is nowhere, 1 the root
        for k, p in enumerate(pieces):
            if isinstance(p, str) and all(own := self.letter[[*map(ord, p)]].tolist()):
                at = 1
                for c in own:
                    at = step.setdefault((at, c), len(piece))
                    if at == len(piece):
                        piece.append(-1)
                piece[at] = k
        self.step, self.piece = np.zeros((len(piece), letters + 1), np.int32), np.array(piece)
        for (at, c), to in step.items():
            self.step[at, c] = to

    def _groups(self, many: list[str]):
        """(places in ``many``, characters as rows by position) of words of equal length; the others' places come last, without."""
        rest, by_length = [], {}
        mark = self.letter[ord(MARK)]
        for k, w in enumerate(many):
            (by_length.setdefault(len(w), []) if mark and 0 < len(w) < self.longest else rest).append(k)
        for n, places in by_length.items():
            points = np.frombuffer("".join(map(many.__getitem__, places)).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n)
            own = self.letter[points].T
            fit = (own > 0).all(0)
            places = np.array(places)
            rest += places[~fit].tolist()
            if fit.any():
                yield places[fit], np.concatenate((np.full((1, int(fit.sum())), mark), own[:, fit]))
        yield np.array(rest, np.int64), None

    def _walk(self, letters: np.ndarray):
        """Forward weights by position, and the arcs (from, to, words, pieces, weights) that they came by."""
        n, size = letters.shape
        alpha, arcs, weight = np.full((n + 1, size), -np.inf), [], np.array(self.weights)
        alpha[0] = 0.0
        for i in range(n):
            live, state = np.arange(size), np.ones(size, np.int32)
            for j in range(i + 1, n + 1):
                state = self.step[state, letters[j - 1, live]]
                on = state > 0
                live, state = live[on], state[on]
                if not len(live):
                    break
                k = self.piece[state]
                if (end := k >= 0).any():
                    own, k = live[end], k[end]
                    arcs.append((i, j, own, k, weight[k]))
                    alpha[j, own] = np.logaddexp(alpha[j, own], alpha[i, own] + weight[k])
        return alpha, arcs

    def forwards(self, many: list[str]) -> np.ndarray:
        out = np.zeros(len(many))
        for places, letters in self._groups(many):
            out[places] = [self.forward(many[k]) for k in places] if letters is None else self._walk(letters)[0][-1]
        return out

    def expects(self, many: list[str], times: np.ndarray, into: np.ndarray) -> None:
        for places, letters in self._groups(many):
            if letters is None:
                for k in places:
                    self.expect(many[k], int(times[k]), into)
                continue
            alpha, arcs = self._walk(letters)
            beta = np.full_like(alpha, -np.inf)
            beta[-1] = 0.0
            for i, j, own, _, w in sorted(arcs, key=lambda a: -a[0]):
                beta[i, own] = np.logaddexp(beta[i, own], w + beta[j, own])
            for i, j, own, k, w in arcs:
                share = np.rint(_ONE * times[places[own]] * np.exp(alpha[i, own] + w + beta[j, own] - alpha[-1, own]))
                np.add.at(into, k, share.astype(np.int64))


def words(text: bytes):
    """Lists of a text's words, A-Z in lower case, a stretch of the text at a time."""
    low = text.lower()
    at = 0
    while at < len(low):
        end = at + _STRETCH
        while end < len(low) and low[end] not in b" \t\n\v\f\r":
            end += 1
        yield low[at:end].split()
        at = end


def _bag(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising places and their counts as bytes that compress."""
    both = np.stack((np.diff(places, prepend=0), counts)).astype("<u4")
    return np.ascontiguousarray(both.view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1)).tobytes()


def _opened(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(bag, np.uint8).reshape(2, 4, -1).transpose(0, 2, 1)).view("<u4").reshape(2, -1)
    return np.cumsum(both[0].astype(np.int64)), both[1].astype(np.int64)


class _Places(dict):
    """Numbers of words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        return k


def _dealt(most_words: int, most_docs: int, most_bytes: int):
    """A task's documents as bags of words of their block, and each block's words with their number in training documents."""

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        first = TaskContext.get().partitionId() << 32
        blocks, vocabulary, train, ends, size, docs = 0, _Places(), np.zeros(1 << 12, np.int64), 0, 0, 0

        def closed():
            k = len(vocabulary)
            columns = [pa.array(np.full(k + 1, first + blocks)), *(pa.nulls(k + 1, t) for t in (pa.int64(), pa.bool_(), pa.binary()))]
            columns += [pa.array([None, *range(k)], pa.int32()), pa.array([b"", *vocabulary], pa.binary()), pa.array(np.concatenate(([ends], train[:k])))]
            return pa.RecordBatch.from_arrays(columns, schema=_DEALT)

        for b in batches:
            rows: list[tuple] = []

            def written():
                made = list(zip(*rows)) or [[]] * 4
                columns = [pa.array(c, f.type) for c, f in zip(made, _DEALT)]
                return pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(rows), f.type) for f in list(_DEALT)[4:])], schema=_DEALT)

            for doc, held, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                found = [np.fromiter(map(vocabulary.__getitem__, some), np.int32, len(some)) for some in words(text.as_py())]
                places, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int32), return_counts=True)
                if len(vocabulary) > len(train):
                    train = np.concatenate((train, np.zeros(max(len(train), len(vocabulary) - len(train)), np.int64)))
                if not held:
                    train[places] += n
                    ends += 1
                bag = press.compress(_bag(places, n))
                rows.append((first + blocks, doc, held, bag))
                size, docs = size + len(bag), docs + 1
                if len(vocabulary) >= most_words or size >= most_bytes or docs >= most_docs:
                    yield written()
                    yield closed()
                    rows.clear()
                    blocks, vocabulary, train, ends, size, docs = blocks + 1, _Places(), np.zeros(1 << 12, np.int64), 0, 0, 0
            yield written()
        if docs:
            yield closed()

    return run


def _together(batches, least: int = 40_000):
    """Batches joined until they have ``least`` rows, so that words of equal length are many."""
    waiting, size = [], 0
    for b in batches:
        waiting.append(b)
        size += len(b)
        if size >= least:
            yield pa.Table.from_batches(waiting)
            waiting, size = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def _strings(column) -> list[str]:
    return [w.decode("utf-8", "replace") for w in column.to_pylist()]


def _expected(pieces, weights):
    """(piece, n) of a task's training words (word, n), in fractions of ``_ONE``."""

    def run(batches):
        lattices, out = Lattices(pieces, weights), np.zeros(len(pieces), np.int64)
        for t in _together(batches):
            lattices.expects(_strings(t.column(0)), t.column(1).to_numpy(), out)
        got = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(got.astype(np.int32)), pa.array(out[got])], names=["piece", "n"])

    return run


def _weighed(pieces, weights):
    """(word, n, logp) of words (word, n)."""

    def run(batches):
        lattices = Lattices(pieces, weights)
        for t in _together(batches):
            logp = pa.chunked_array([lattices.forwards(_strings(t.column(0)))])
            yield from pa.Table.from_arrays([t.column(0), t.column(1), logp], names=["word", "n", "logp"]).to_batches()

    return run


def _scored(total: int, kinds: int, ends: int, end_weight: float):
    """Scores of a block's documents from the answers for its words (place, n, logp). Sums are exact, so their order is no matter."""
    def base_of(n):
        return np.log10((n + 1) / (total + kinds + 1))

    def run(key, docs, answers):
        import zstandard

        place = answers.column("place").to_numpy()
        known, logp = np.zeros(len(place), np.int64), np.zeros(len(place))
        known[place], logp[place] = answers.column("n").to_numpy(), answers.column("logp").to_numpy()
        base, logp = base_of(known), logp / math.log(10)
        open_ = zstandard.ZstdDecompressor()
        out: list[list] = [[], [], [], []]
        for bag in docs.column("bag").to_pylist():
            at, n = _opened(open_.decompress(bag)) if bag else (np.zeros(0, np.int64),) * 2
            out[0].append(int(n.sum()) + 1)
            out[1].append(int(n[known[at] > 0].sum()) + (ends > 0))
            out[2].append(math.fsum([*(n * base[at]).tolist(), float(base_of(ends))]))
            out[3].append(math.fsum([*(n * logp[at]).tolist(), end_weight / math.log(10)]))
        columns = [docs.column("doc_id"), docs.column("held_out"), *(pa.array(c, pa.int64()) for c in out[:2])]
        columns += [pa.array(np.full(len(docs), total)), *(pa.array(c, pa.float64()) for c in out[2:])]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def held_out(of: int = 7, rest: int = 2) -> Column:
    """True where crc32 of the doc_id as text leaves ``rest`` (null ids are not held out)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == rest, F.lit(False))


def text_scores(docs: DataFrame, vocabulary: str, rounds: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Learns from the documents that are not held out. ``score`` is the decimal logarithm of the text's
    probability under the lattice, ``base_score`` that under add-one counts of whole words; the end of a text
    is a token. Pieces are smoothed by one. Null and empty texts are an end alone. Rows that repeat count and
    are scored each time, rows without a doc_id are learned from; equal texts have equal scores. Without
    training documents the vocabulary's own weights stand. An empty table gives no rows.
    """
    given = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    dealt = saved(given.mapInArrow(_dealt(_WORDS, _DOCS, _BAGS), _DEALT_SQL))
    asked = dealt.where("word is not null")
    lexicon = saved(asked.groupBy("word").agg(F.sum("n").alias("n")))
    total, kinds, ends = lexicon.agg(F.sum("n"), F.count_if(F.col("n") > 0), F.sum(F.when(F.length("word") == 0, F.col("n")))).first()
    total, kinds, ends = total or 0, kinds or 0, ends or 0
    pieces, weights = read_pieces(vocabulary)
    learned = lexicon.where("n > 0 and length(word) > 0")
    norm = math.log(sum(map(math.exp, weights)) + 1)
    weights, end_weight = [w - norm for w in weights], -norm
    for _ in range(rounds if total else 0):
        counts = [_ONE] * len(pieces)
        found = learned.mapInArrow(_expected(pieces, weights), "piece int, n long")
        for r in found.groupBy("piece").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():  # one row a piece
            counts[r["piece"]] += int(r["n"])
        norm = math.log(sum(counts) + _ONE * (ends + 1))
        weights, end_weight = [math.log(c) - norm for c in counts], math.log(_ONE * (ends + 1)) - norm
    known = lexicon.where("length(word) > 0").mapInArrow(_weighed(pieces, weights), "word binary, n long, logp double")
    answers = asked.where("place is not null").select("block", "place", "word").join(known, "word").select("block", "place", "n", "logp")
    bags = dealt.where("word is null").select(F.col("block").alias("of"), "doc_id", "held_out", "bag")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = saved(bags.groupBy("of").cogroup(answers.groupBy("block")).applyInArrow(_scored(total, kinds, ends, end_weight), schema))
    drop_saved(dealt, lexicon)
    return out
