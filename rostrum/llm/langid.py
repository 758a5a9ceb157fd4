"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector, drawn from its code point. A letter n-gram is the elementwise
product of its letters' vectors, each rotated by its place (binding permuted letters). A document is the
sum of its n-gram vectors, a language prototype the sum of its normalised training documents; documents go
to the prototype with the largest cosine.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
DIM = 1024
PART = 1024  # distinct n-grams whose vectors are numbers of four or eight bytes at once
_POINT = 21  # bits of a code point


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower case of every code point that is a letter; 0 for others."""
    out = np.zeros(0x110000, np.int64)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = ord(c.lower()[0])
    return out


class Encoder:
    """Texts to distinct n-grams with counts, and n-grams to bound vectors (kept by task, up to a bound)."""

    def __init__(self, seed: int, dim: int = DIM, most: int = 40_000):
        self.fold, self.seed, self.dim, self.most = _letters(), seed, dim, most
        self.letters: dict[int, np.ndarray] = {}
        self.place: dict[int, int] = {}
        self.vectors = np.zeros((1024, dim), np.int8)

    def letter(self, point: int) -> np.ndarray:
        """The vector of a code point (0: the boundary); no two letters share one."""
        if point not in self.letters:
            if len(self.letters) >= 4096:
                self.letters.clear()
            self.letters[point] = np.random.default_rng([self.seed, point]).choice(np.array([-1, 1], np.int8), self.dim)
        return self.letters[point]

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams and their counts; runs of non-letters are one boundary."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        c = self.fold[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        if not c.any():
            return none, none
        c = np.concatenate(([0], c, [0]))
        c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
        return np.unique(c[:-2] << 2 * _POINT | c[1:-1] << _POINT | c[2:], return_counts=True)

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of n-grams; new ones are bound once and kept."""
        get = self.place.get
        at = np.fromiter((get(g, -1) for g in grams.tolist()), np.int64, len(grams))
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.place) + len(new) > self.most:  # start again rather than grow on
                self.place.clear()
                new = np.arange(len(grams))
            used = len(self.place)
            if used + len(new) > len(self.vectors):
                room = max(min(2 * len(self.vectors), self.most), used + len(new))
                more = np.zeros((room - used, self.dim), np.int8)
                self.vectors = np.concatenate((self.vectors[:used], more))
            made = np.ones((len(new), self.dim), np.int8)
            for k in range(GRAM):
                points, which = np.unique(grams[new] >> (GRAM - 1 - k) * _POINT & (1 << _POINT) - 1, return_inverse=True)
                made *= np.array([np.roll(self.letter(p), GRAM - 1 - k) for p in points.tolist()])[which]
            self.vectors[used : used + len(new)] = made
            at[new] = np.arange(used, used + len(new))
            self.place.update(zip(grams[new].tolist(), at[new].tolist()))
        return self.vectors[at]

    def document(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of a text's n-gram vectors, a part of its distinct n-grams at a time."""
        out = np.zeros(self.dim, np.float32)
        for i in range(0, len(grams), PART):
            out += counts[i : i + PART].astype(np.float32) @ self.bound(grams[i : i + PART]).astype(np.float32)
        return out


def train(docs: DataFrame, seed: int = 5, most_languages: int = 2000) -> dict[str, np.ndarray]:
    """Unit prototypes by language from all rows with a text and a lang (columns text, lang).

    Each task bundles its own documents and emits one vector a language; the sums are made by Spark.
    The driver gets languages x DIM numbers, whatever the input; over ``most_languages`` is an error.
    """

    def run(batches):
        enc, sums = Encoder(seed), {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist()):
                grams, counts = enc.grams(text.as_py())
                if len(grams):
                    have = sums.setdefault(lang, {})
                    total = float(counts.sum())
                    for g, n in zip(grams.tolist(), (counts / total).tolist()):
                        have[g] = have.get(g, 0.0) + n
        for lang, have in sums.items():
            grams = np.fromiter(have, np.int64, len(have))
            weights = np.fromiter(have.values(), np.float64, len(have))
            vector = np.zeros(DIM)
            for i in range(0, len(grams), PART):
                vector += weights[i : i + PART] @ enc.bound(grams[i : i + PART]).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(vector)],
                names=["lang", "dim", "value"],
            )

    known = docs.where("text is not null and lang is not null").select(
        F.col("text").cast("string"), F.col("lang").cast("string")
    )
    parts = known.mapInArrow(run, "lang string, dim int, value double")
    # whole numbers, so the sum does not hang on the order of tasks
    whole = F.sum((F.col("value") * 1e9).cast("long")).alias("value")
    rows = parts.groupBy("lang", "dim").agg(whole).limit(most_languages * DIM + 1).collect()
    if len(rows) > most_languages * DIM:
        raise ValueError(f"more than {most_languages} languages")
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r.lang, np.zeros(DIM))[r.dim] = r.value
    return {k: (v / n).astype(np.float32) for k, v in sorted(out.items()) if (n := np.linalg.norm(v))}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], seed: int = 5, keep: bool = False) -> DataFrame:
    """``docs`` without text (with it, to ``keep``; a second copy of it need not travel then), plus lang_pred, score (the cosine, at least 0; ``und`` has 0) and n_grams (distinct ones).

    A null, empty or letterless text is ``und``; without any prototype all texts are. Ties go to the
    first language in the order of names. Rows that repeat stay; an empty table gives none. Earlier
    columns of the added names are replaced, in any case of letters.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score", "n_grams")])
    rest = [c for c in docs.columns if c != "text"]
    out = [*rest, *(["text"] if keep else [])]
    langs = list(prototypes)
    matrix = np.array([prototypes[k] for k in langs], np.float32).reshape(len(langs), DIM)
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    def run(batches):
        enc, p = Encoder(seed), shared.value
        for b in batches:
            names, scores, sizes = [], [], []
            for text in b.column(len(rest)):
                grams, counts = enc.grams(text.as_py())
                sizes.append(len(grams))
                v = enc.document(grams, counts) if len(grams) and langs else None
                n = 0.0 if v is None else float(np.linalg.norm(v))
                if not n:
                    names.append("und"), scores.append(0.0)
                    continue
                cos = p @ v / n
                best = int(cos.argmax())
                names.append(langs[best]), scores.append(min(1.0, max(0.0, float(cos[best]))))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(out)], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())],
                names=[*out, "lang_pred", "score", "n_grams"],
            )

    given = docs.select(*rest, F.col("text").cast("string"))
    schema = given.select(*out).schema.add("lang_pred", "string").add("score", "double").add("n_grams", "long")
    return given.mapInArrow(run, schema)


def held_out() -> Column:
    """True where crc32 of the doc_id as text leaves 2 when divided by 4 (null ids are not held out)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, seed: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learns from the rows that are not held out."""
    prototypes = train(docs.where(~held_out()), seed)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), prototypes, seed)


def likely(scored: DataFrame, langs: list[str], share: float = 0.5, quantile: float = 0.01) -> Column:
    """Whether a text that :func:`predict` has scored is as like its language as that language's own texts are.

    The limit is ``share`` of a low ``quantile`` of the scores of documents whose lang is the one predicted,
    by language and by the power of two of their distinct n-grams, and never rises from longer to shorter
    texts. Texts shorter than any with a known lang have no limit. ``scored`` has lang, lang_pred, score and
    n_grams; a few rows a language come to the driver.
    """
    step = F.floor(F.log2(F.greatest("n_grams", F.lit(1)))).cast("int")
    own = scored.where(F.col("lang") == F.col("lang_pred")).groupBy("lang", step.alias("step"))
    rows = own.agg(F.percentile_approx("score", quantile, 10_000).alias("low")).where(F.col("lang").isin(langs)).collect()
    limits: dict[str, list[float]] = {}
    for r in sorted(rows, key=lambda r: -r.step):  # from the longest texts down, never rising
        steps = limits.setdefault(r.lang, [0.0] * 64)
        steps[r.step] = min([share * r.low, *(x for x in steps[r.step + 1 :] if x)])
    for steps in limits.values():  # lengths that no known text has: as the next shorter ones
        for k in range(1, 64):
            steps[k] = steps[k] or steps[k - 1]
    at = F.create_map(*[x for lang, steps in limits.items() for x in (F.lit(lang), F.array(*map(F.lit, steps)))]) if limits else None
    below = F.lit(0.0) if at is None else F.coalesce(F.get(at[F.col("lang_pred")], step), F.lit(0.0))
    return (F.col("lang_pred") != "und") & (F.col("score") >= below)
