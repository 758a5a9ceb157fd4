"""Personal data: candidate generators, gradient-boosted trees, calibrated thresholds, redaction.

Strict patterns give base spans, which always stay. High-recall generators propose further spans, which
may overlap; boosted trees score them by format and context, and those over their kind's calibrated
threshold are added. Trees learn from the corpus itself. Positives are base spans, rewritten in place into
the loose shapes of their kind. Negatives are the same shapes broken; loose candidates of the corpus that
break their kind's rules; and whole shapes, or whatever loose candidates stand there, behind words that the
corpus puts before other numbers and never before a base span ("version", "ratio"). What a word is worth as
context is counted over the corpus, without the example at hand.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_DIGIT = re.compile("[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive digits, and starts at the first digit of a run only: the same leftmost matches in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _part(x: str) -> bool:
    x = x.lstrip("0")
    return len(x) < 3 or len(x) == 3 and x <= "255"


def _digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict patterns, by kind and start."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            done = m.end()
            out.append((0, lo, done))
        at = text.find("@", max(done, at + 1))
    if not _DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_part, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


_AT = r"(?:@|[ ]?[(\[{][ ]?at[ ]?[)\]}][ ]?|[ ]at[ ])"
_DOT = r"(?:\.|[ ]?[(\[{][ ]?dot[ ]?[)\]}][ ]?|[ ]dot[ ])"
#: Shapes that base patterns miss: (kind, pattern). Long runs are possessive and begin at their start only, so matching stays linear.
LOOSE = (
    (0, re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+", re.I)),
    (1, re.compile(r"(?<![0-9.])[0-9]{1,3}(?:[.,][0-9]{1,3}){3}(?![0-9])")),
    (1, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-]?[0-9]{4}){2}[ ./_-]?[0-9]{1,7}(?![0-9])")),
    (3, re.compile(r"(?<![0-9])(?:00[0-9]{1,3}[ .-]?|[0-9][ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    (3, re.compile(r"(?<![0-9+./-])(?:0[0-9]{1,4}|\(0[0-9]{1,4}\))(?:[ ./-][0-9]{2,8}){1,5}+(?![0-9])")),
)
_NEEDS = (("@", "(", "[", "{", " dot ", " Dot ", " DOT "), *[()] * 5)
_CUES = (
    re.compile(r"mail|contact|write|address|correo|courriel|schreib", re.I),
    re.compile(r"\bip\b|host|server|addr|login", re.I),
    re.compile(r"card|visa|credit|pay|carte|karte|tarjeta", re.I),
    re.compile(r"phone|call|tel|mobile|fax|cell|appel|ruf", re.I),
)
_SPELLED = re.compile(r"(?:[ ]?[(\[{][ ]?|[ ])(at|dot)(?:[ ]?[)\]}][ ]?|[ ])", re.I)
#: A run of digits and the marks between them, which is one number of its text.
_RUN = re.compile(r"[0-9](?:[0-9]|[ ./,:_()+-]{1,2}(?=[0-9]))*+")
_WORD = re.compile(r"[^\W\d_]+")
#: Words before spans are counted in so many buckets, by hash.
BUCKETS = 4096


def word_before(text: str, lo: int) -> int:
    """Bucket of the last word before a place; 0 where none is near."""
    near = _WORD.findall(text, max(0, lo - 48), lo)
    return 1 + hash_of(near[-1].lower()) % (BUCKETS - 1) if near else 0


class Contexts:
    """How often each word stands before a base span of each kind, and before other numbers (the last row)."""

    def __init__(self, counts: np.ndarray | None = None):
        self.counts = np.zeros((len(KINDS) + 1, BUCKETS), np.int64) if counts is None else counts
        self.sums = self.counts.sum(1).tolist()

    def rate(self, kind: int, bucket: int, own: int) -> float:
        """Log-odds of the word before a base span of the kind against other numbers, without the example itself (``own``: its row, or -1)."""
        good = int(self.counts[kind, bucket]) - (own == kind)
        other = int(self.counts[-1, bucket]) - (own == len(KINDS))
        good_all, other_all = self.sums[kind] - (own == kind), self.sums[-1] - (own == len(KINDS))
        share = lambda n, total: (n + 1.0) / (total + 100.0)
        return float(np.log(share(max(0, good), good_all) / share(max(0, other), other_all)))

    def barren(self, bucket: int) -> bool:
        """Whether the word stands before numbers, several times, and never before a base span."""
        return bool(self.counts[-1, bucket] >= 5 and not self.counts[:-1, bucket].any())


def numbers(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Places of the numbers that touch no base span."""
    taken = sorted((a, b) for _, a, b in base)
    out, k = [], 0
    for m in _RUN.finditer(text) if _DIGIT.search(text) else ():
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k == len(taken) or taken[k][0] >= m.end():
            out.append(m.span())
    return out


def proper(kind: int, span: str) -> bool:
    """Whether a loose span, read as its strict shape, keeps its kind's rules.

    Emails: a last label of two letters at least. Phones without 00: area and exchange start with 2 to 9.
    """
    if kind == 0:
        local, _, domain = _SPELLED.sub(lambda m: "@" if m[1].lower() == "at" else ".", span).partition("@")
        last = domain.rpartition(".")[2]
        return len(last) > 1 and last.isalpha() and local[:1] != "." and local[-1:] != "."
    if kind == 1 and ":" in span:
        try:
            return bool(ipaddress.IPv6Address(span))
        except ValueError:
            return False
    digits = _digits(span)
    if kind == 1:
        return all(map(_part, re.split("[.,]", span)))
    if kind == 2:
        return 13 <= len(digits) <= 19 and _luhn(digits)
    if span.lstrip("(")[:1] == "0" and not span.startswith("00"):
        return 9 <= len(digits) <= 12
    return span.startswith("00") or digits[-10] > "1" and digits[-7] > "1"


def rewritten(kind: int, span: str, h: int) -> list[tuple[str, float]]:
    """(loose shape, label) of a base span: each shape that can hold it, whole and broken; ``h`` picks details."""
    digits, out, h = _digits(span), [], h >> 8  # the low bits tell the sample from the rest
    if kind == 0:
        local, _, domain = span.rpartition("@")
        for a, b in ("[]", "()", "{}", ("", "")):
            for gap in ("", " ") if a else (" ",):
                at, dot = f"{gap}{a}at{b}{gap}", f"{gap}{a}dot{b}{gap}"
                # with its digits and without, so that digits alone tell nothing
                for own, there in ((local, domain), (_DIGIT.sub("x", local), _DIGIT.sub("x", domain))):
                    out.append((own + at + there.replace(".", dot), 1.0))
                    out.append((own + at + there.rpartition(".")[0].replace(".", dot) + dot + str(h % 100), 0.0))
    elif kind == 1:
        parts = [p.lstrip("0") or "0" for p in span.split(".")]
        out.append((",".join(parts), 1.0))
        out.append((",".join([*parts[:3], str(256 + h % 744)]), 0.0))
        out.append((",".join([parts[0], *(p.zfill(3) for p in parts[1:])]), 0.0))  # a number with thousands marks
        groups = [f"{(h >> i & 0xFFFF) >> 4 * (h >> i + 2 & 3):x}" for i in range(0, 48, 6)]
        out += [(":".join(groups), 1.0), (":".join(groups[: 3 + h % 4]) + "::" + groups[7], 1.0)]
        out += [(":".join(groups[: 4 + h % 4]), 0.0), (":".join(f"{int(g, 16) % 60:02d}" for g in groups[: 4 + h % 3]), 0.0)]
    elif kind == 2:
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + h % 9) % 10)
        for mark in "./_":
            for d, y in ((digits, 1.0), (wrong, 0.0)):
                out.append((mark.join([d[:4], d[4:8], d[8:12], d[12:]]), y))
    elif len(digits) == 10 or len(digits) == 11 and digits[0] == "1":
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        for shape in ("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "1 ({}) {}-{}", "1-{}-{}-{}"):
            out.append((shape.format(a, b, c), 1.0))
            out.append((shape.format("1" + a[1:], b, c) if h % 4 < 2 else shape.format(a, str(h % 2) + b[1:], c), 0.0))
    if kind == 3 and len(digits) >= 10:
        own = "0" + digits[-9:]
        out += [(f"{own[:3]} {own[3:6]} {own[6:]}", 1.0), (f"{own[:4]}/{own[4:]}", 1.0), (f"({own[:3]}) {own[3:]}", 1.0)]
        out += [(" ".join(own[i : i + 2] for i in range(0, 10, 2)), 1.0), (f"{own[:4]}-{own[4:7]}-{own[7:]}", 1.0)]
        day, month, year = f"0{1 + h % 9}", f"{1 + h // 9 % 12:02d}", str(1900 + h // 108 % 140)
        out += [(mark.join((day, month, year)), 0.0) for mark in "./-"] + [(f"{day}.{month}.{year} {h // 999 % 24:02d}.{h // 7 % 60:02d}", 0.0)]
    if kind == 3 and 11 <= len(digits) <= 13:
        out.append((f"00{digits[:-10]} {digits[-10:-7]} {digits[-7:-4]} {digits[-4:]}", 1.0))
    return [(shape, y) for shape, y in out if not y or proper(kind, shape)]


def made_up(kind: int, h: int) -> str:
    """A whole shape of a kind out of a hash, to stand where no personal data does."""
    h >>= 8
    d = f"{h % 10**18:018d}"
    if kind == 1:
        return ",".join(str(h >> (8 * i) & 255) for i in range(4))
    if kind == 2:
        own = "4" + d[:14]
        own += next(c for c in "0123456789" if _luhn(own + c))
        return "./_"[h % 3].join([own[:4], own[4:8], own[8:12], own[12:]])
    return (f"{2 + h % 8}{d[:2]}-{2 + h // 8 % 8}{d[2:4]}-{d[4:8]}", f"0{d[:2]} {d[2:5]} {d[5:9]}", f"({2 + h % 8}{d[:2]}) {2 + h // 8 % 8}{d[2:4]}-{d[4:8]}")[h % 3]


def features(text: str, kind: int, lo: int, hi: int, contexts: Contexts, own: int = -1) -> list[float]:
    """Format of the span and what stands around it; ``own`` tells where the example itself is counted in ``contexts``."""
    span, before = text[lo:hi], text[max(0, lo - 32) : lo]
    digits = _digits(span)
    parts = [p for p in re.split("[^0-9]+", span) if p]
    prev, nxt = before[-1:], text[hi : hi + 1]
    spelled_ = _SPELLED.sub(lambda m: "@" if m[1].lower() == "at" else ".", span) if kind == 0 else ""
    last = spelled_.rpartition(".")[2]
    return [
        kind, hi - lo, len(digits), len(digits) / (hi - lo), len(parts), float(min((len(p) for p in parts), default=0)),
        float(max((len(p) for p in parts), default=0)), float(all(map(_part, parts))), float(13 <= len(digits) <= 19 and _luhn(digits)),
        float("+" in before[-4:] or "+" in span), span.count("("), span.count("."), span.count("-"), span.count(" "),
        float("@" in span), float(prev.isalnum()), float(nxt.isalnum()), float(prev in ("", " ", "\n", "\t")),
        float(bool(_CUES[kind].search(before))), float(len(set(digits))), contexts.rate(kind, word_before(text, lo), own), span.count(","), span.count(":"),
        float(min((len(p) for p in parts[1:]), default=0)), float(len(last)), float(last.isalpha()), span.count("/"), float(span[:1] == "0"), float("::" in span),
        float(digits[-10:-9] or -1), float(digits[-7:-6] or -1),
    ]


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Spans that the loose generators propose; they may overlap."""
    out = []
    digits = _DIGIT.search(text) is not None
    for (kind, pattern), need in zip(LOOSE, _NEEDS):
        if digits if kind else any(c in text for c in need):  # a digit, or a mark of an address
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return out


def _overlaps(kind: int, lo: int, hi: int, spans: list[tuple[int, int, int]]) -> bool:
    return any(k == kind and a < hi and lo < b for k, a, b in spans)


def sources(text: str, contexts: Contexts) -> Iterator[tuple[int, float | None, tuple[int, int, int]]]:
    """(hash of text and place, label, span) of what gives labelled examples; a base span (no label) gives several.

    A label of -1 asks for a made-up shape in the number's place, which is a negative.
    """
    base, h = base_spans(text), 0
    for span in base:
        h = h or hash_of(text)
        yield hash_of(f"{h}:{span[0]}:{span[1]}"), None, span
    loose = candidates(text)
    if loose:
        taken = [merged(base, k) for k in range(len(KINDS))]
        for kind, lo, hi in loose:
            if not touches(taken[kind], lo, hi) and (not proper(kind, text[lo:hi]) or kind and contexts.barren(word_before(text, lo))):
                h = h or hash_of(text)
                yield hash_of(f"{h}:{kind}:{lo}"), 0.0, (kind, lo, hi)
    for lo, hi in numbers(text, base):
        if contexts.barren(word_before(text, lo)):
            h = h or hash_of(text)
            key = hash_of(f"{h}:number:{lo}")
            yield key, -1.0, (1 + key // 2 % 3, lo, hi)


def examples(text: str, contexts: Contexts, wanted: Callable[[int], bool] = lambda key: True) -> list[tuple[int, float, list[float]]]:
    """(hash of text and place, label, features) of every labelled example of a text whose hash is wanted."""
    out, other = [], len(KINDS)
    for key, label, (kind, lo, hi) in sources(text, contexts):
        if not wanted(key):
            continue
        if label == 0:
            out.append((key, label, features(text, kind, lo, hi, contexts, other if kind else -1)))
            continue
        before, after = text[max(0, lo - 96) : lo], text[hi : hi + 96]
        shapes = [(made_up(kind, key), 0.0)] if label else rewritten(kind, text[lo:hi], key)
        for shape, y in shapes:
            near, end = before + shape + after, len(before) + len(shape)
            own = other if label else kind
            out += [(key, y, features(near, *c, contexts, own)) for c in candidates(near) if c == (kind, len(before), end)]
    return out


def merged(spans: list[tuple[int, int, int]], kind: int) -> tuple[list[int], list[int]]:
    """Starts and ends of a kind's spans, which never overlap each other."""
    own = sorted((a, b) for k, a, b in spans if k == kind)
    return [a for a, _ in own], [b for _, b in own]


def touches(spans: tuple[list[int], list[int]], lo: int, hi: int) -> bool:
    at = bisect_left(spans[0], hi) - 1
    return at >= 0 and spans[1][at] > lo


class Boosted:
    """Gradient-boosted regression trees for the logistic loss, over features cut into few bins."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 16):
        self.n, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.trees: list[list[tuple[int, float, float]]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.start)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[:-1])) for j in range(x.shape[1])]
        for _ in range(self.n):
            q = 1 / (1 + np.exp(-f))
            tree, node = [(0, 0.0, 0.0)] * (2 ** (self.depth + 1)), np.ones(len(y), np.int64)
            self._split(tree, 1, node, x, y - q, q * (1 - q), cuts)
            self.trees.append(tree)
            f += self.rate * self._leaf(tree, x)
        return self

    def _split(self, tree, at, node, x, g, h, cuts) -> None:
        own = node == at
        G, H = g[own].sum(), h[own].sum()
        tree[at] = (-1, 0.0, float(G / (H + 1.0)))
        if at >= 2**self.depth or own.sum() < 10:
            return
        best = (1e-6, None, 0.0)
        for j, c in enumerate(cuts):
            if len(c):
                b = np.searchsorted(c, x[own, j], side="left")
                gs, hs = (np.bincount(b, v[own], len(c) + 1).cumsum()[:-1] for v in (g, h))
                gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, float(c[k]))
        if best[1] is None:
            return
        tree[at] = (best[1], best[2], tree[at][2])
        right = own & (x[:, best[1]] > best[2])
        node[own & ~right] = 2 * at
        node[right] = 2 * at + 1
        for child in (2 * at, 2 * at + 1):
            self._split(tree, child, node, x, g, h, cuts)

    @staticmethod
    def _leaf(tree, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for i, row in enumerate(x):
            at = 1
            while tree[at][0] >= 0:
                at = 2 * at + (row[tree[at][0]] > tree[at][1])
            out[i] = tree[at][2]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        for tree in self.trees:
            f += self.rate * self._leaf(tree, x)
        return 1 / (1 + np.exp(-f))


class Model:
    """Trees, the contexts they know and, for each kind, the least score that is accepted (over 1: none is)."""

    def __init__(self, trees: Boosted | None, thresholds: list[float], contexts: Contexts | None = None):
        self.trees, self.thresholds, self.contexts = trees, thresholds, contexts or Contexts()

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Accepted candidates that overlap no base span or earlier accepted span of their kind."""
        if self.trees is None:
            return []
        new = [c for c in candidates(text) if not _overlaps(*c, base)]
        if not new:
            return []
        scores = self.trees.score(np.array([features(text, *c, self.contexts, len(KINDS) if c[0] else -1) for c in new], np.float64))
        out: list[tuple[int, int, int]] = []
        for score, c in sorted(zip(scores.tolist(), new), key=lambda x: (-x[0], x[1])):
            if score >= self.thresholds[c[0]] and not _overlaps(*c, out):
                out.append(c)
        return out


#: Scores are counted in so many bins; a power of two, so their edges are exact.
BINS = 1024


def contexts_of(texts: DataFrame) -> Contexts:
    """Counts of the words before base spans and other numbers of the whole corpus; their size does not grow with it."""

    def counted(batches):
        counts = np.zeros((len(KINDS) + 1, BUCKETS), np.int64)
        for b in batches:
            for t in b.column(0):
                text = t.as_py() or ""
                base = base_spans(text)
                for kind, lo, _ in base:
                    counts[kind, word_before(text, lo)] += 1
                for lo, _ in numbers(text, base):
                    counts[-1, word_before(text, lo)] += 1
        row, bucket = counts.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (row, bucket, counts[row, bucket])], names=["row", "bucket", "n"])

    counts = np.zeros((len(KINDS) + 1, BUCKETS), np.int64)
    for r in texts.mapInArrow(counted, "row long, bucket long, n long").groupBy("row", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.row, r.bucket] = r.n
    return Contexts(counts)


def fit(docs: DataFrame, most: int = 8000, precision: float = 0.95) -> Model:
    """Trees from at most ``most`` examples, contexts from the whole corpus, thresholds from all other examples of it.

    Trees learn from distinct examples of even hash with the smallest hashes of text and place, so copies
    count once. All other examples are scored and counted by kind and score; a kind's threshold is the
    least score from which they are positive with ``precision``. A kind without positives there accepts
    nothing; without both classes there is no model.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    contexts = contexts_of(texts)
    known = spark.sparkContext.broadcast(contexts)

    def hashes(batches):
        for b in batches:
            keys = [key for t in b.column(0) for key, _, _ in sources(t.as_py() or "", known.value) if key % 2 == 0]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], names=["h"])

    # each distinct hash gives one example at least, and hashes are spread evenly: no task sends more than its part of the sample
    distinct = texts.mapInArrow(hashes, "h long").distinct().count()
    bound = int(min(1.0, 1.2 * most / max(distinct, 1)) * 2**63)

    def labelled(batches):
        for b in batches:
            rows = [e for t in b.column(0) for e in examples(t.as_py() or "", known.value, lambda key: key % 2 == 0 and key < bound)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()),
                 pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["h", "y", "x"],
            )

    rows = texts.mapInArrow(labelled, "h long, y double, x array<double>").distinct().orderBy("h", "y", "x").limit(most).collect()
    nothing = Model(None, [2.0] * len(KINDS))
    if len({r.y for r in rows}) < 2:
        return nothing
    trees = Boosted().fit(np.array([r.x for r in rows]), np.array([r.y for r in rows]))
    top = rows[-1].h  # an even hash up to this one may be of the sample
    shared = spark.sparkContext.broadcast(trees)

    def counted(batches):
        counts = np.zeros((len(KINDS), BINS, 2), np.int64)
        for b in batches:
            rest = [e for t in b.column(0) for e in examples(t.as_py() or "", known.value, lambda key: key % 2 or key > top)]
            if rest:
                x = np.array([e[2] for e in rest])
                at = np.minimum(shared.value.score(x) * BINS, BINS - 1).astype(np.int64)
                np.add.at(counts, (x[:, 0].astype(np.int64), at, np.array([int(e[1]) for e in rest])), 1)
        kind, at, y = counts.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (kind, at, y, counts[kind, at, y])], names=["kind", "bin", "y", "n"])

    counts = np.zeros((len(KINDS), BINS, 2))
    for r in texts.mapInArrow(counted, "kind long, bin long, y long, n long").groupBy("kind", "bin", "y").agg(F.sum("n").alias("n")).collect():
        counts[r.kind, r.bin, r.y] = r.n
    return Model(trees, [_least_score(c, precision) for c in counts], contexts)


def _least_score(counts: np.ndarray, precision: float) -> float:
    """The least bin edge (0.5 at least) from which positives have ``precision``; 2 where there is none."""
    wrong, good = counts[::-1].cumsum(0).T
    ok = np.flatnonzero((good > 0) & (good >= precision * (good + wrong)))
    return max(0.5, float(BINS - 1 - ok[-1]) / BINS) if len(ok) else 2.0


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span, or union of overlapping ones, replaced by its first kind in angle brackets."""
    out, done = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= done:
            out += [text[done:a], f"<{KINDS[k].upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def detect(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """``docs`` plus n_email, n_ip, n_card, n_phone and base (base spans), spans (all), redacted (text).

    Null text is empty (and stays null where redacted). Every row gives one row, repeated ones too, and an
    empty table none; earlier columns of these names are replaced. Without ``keep_text`` neither the text nor the redacted text leaves the tasks.
    """
    new = [*(f"n_{k}" for k in KINDS), "base", "spans", "redacted"]
    docs = docs.drop(*new)
    names = docs.columns
    rest = [c for c in names if keep_text or c != "text"]
    schema = docs.select(*rest).schema
    for c in new:
        schema = schema.add(c, "long" if c.startswith("n_") else "string")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            col = dict(zip(names, b.columns))
            counts, strings = [], []
            for text in col["text"]:
                text = text.as_py()
                base = base_spans(text or "")
                spans = base + m.added(text or "", base)
                counts.append([sum(s[0] == k for s in base) for k in range(len(KINDS))])
                strings.append((spelled(base), spelled(spans), redacted(text, spans) if text and keep_text else text if keep_text else None))
            made = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            made += [pa.array([s[k] for s in strings], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([col[c] for c in rest] + made, names=rest + new)

    return docs.mapInArrow(run, schema)
