"""Alignment of edited or refined tokens with timed words, veto restore, and text splitting, one document at a time."""

from __future__ import annotations

import difflib
import re
from array import array

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lcs_anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, letter case ignored; the latest pairs among equals.

    Row i of the table has the lengths for the first i words of ``a``; rows are kept as arrays of numbers.
    """
    x, y = [t.lower() for t in a], [t.lower() for t in b]
    rows = [array("i", bytes(4 * (len(y) + 1)))]
    for word in x:
        above, row = rows[-1], array("i", [0])
        for j, other in enumerate(y):
            row.append(above[j] + 1 if word == other else max(above[j + 1], row[j]))
        rows.append(row)
    out, j = [], len(y)
    for i in range(len(x), 0, -1):
        while j and x[i - 1] != y[j - 1] and rows[i - 1][j] < rows[i][j - 1]:
            j -= 1
        if j and x[i - 1] == y[j - 1]:
            j -= 1
            out.append((i - 1, j))
    return out[::-1]


def apply_aligned(words: list[str], tokens: list[str]) -> list[str]:
    """Words with refined tokens: all of them if the numbers agree, else anchors and gaps of equal size only.

    A word of several tokens (a merged name) counts as those; only its first one may replace it.
    """
    if len(words) == len(tokens):
        return list(tokens)
    spelled = [(i, k, t) for i, w in enumerate(words) for k, t in enumerate(w.split())]
    out, a, b = list(words), 0, 0
    for x, y in [*lcs_anchors([t for *_, t in spelled], tokens), (len(spelled), len(tokens))]:
        gap = range(x - a) if x - a == y - b else ()
        for at, to in [*((a + k, b + k) for k in gap), *([(x, y)] if x < len(spelled) else [])]:
            i, k, t = spelled[at]
            if k == 0 and t != tokens[to]:
                out[i] = tokens[to]
        a, b = x + 1, y + 1
    return out


def retime(text: str, words: list[tuple]) -> list[tuple]:
    """Tokens of an edited text with time and speaker of the words (word, start, end, ...) they came from.

    Equal runs keep their times; each token of a replaced run takes the word at its share of the run; an
    insertion has no length and stands where the word before it ends, or where the first one begins; a
    deletion is gone. Without words there are no tokens.
    """
    tokens = text.split()
    if not tokens or not words:
        return []
    key = lambda t: re.sub(r"[^\w']+", "", t.lower())
    diff = difflib.SequenceMatcher(None, [key(t) for t in tokens], [key(w[0] or "") for w in words], autojunk=False)
    out: list[tuple] = []
    for kind, a, b, c, d in diff.get_opcodes():
        if kind == "delete":  # in the text alone
            near = words[c - 1] if c else words[0]
            at = near[2] if c else near[1]
            out += [(t, at, at, *near[3:]) for t in tokens[a:b]]
        elif kind != "insert":
            out += [(t, *words[c + k * (d - c) // (b - a)][1:]) for k, t in enumerate(tokens[a:b])]
    return out


def source_run(original: str, words: list[str], start: int) -> tuple[int, int] | None:
    """First contiguous run of words at or after ``start`` that spells ``original``, punctuation and case aside."""
    key = lambda t: re.sub(r"^[^\w]+|[^\w]+$", "", t).lower()
    want = [key(t) for t in original.split()]
    have = [key(t) for t in words]
    return next(((i, i + len(want)) for i in range(start, len(have) - len(want) + 1) if want and have[i : i + len(want)] == want), None)


def restore_vetoed(text: str, vetoes: list[tuple[str, str]]) -> str:
    """Each vetoed (original, corrected) pair's first occurrence of the corrected form becomes the original again."""
    for original, corrected in vetoes:
        text = text.replace(corrected, original, 1)
    return text


def split_text(text: str, most: int = 1000, overlap: int = 50, marks: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Chunks of at most ``most`` characters, cut at the coarsest mark that works; neighbours share up to ``overlap``."""

    def parts(t: str, level: int) -> list[str]:
        if len(t) <= most:
            return [t]
        mark = marks[level]
        if not mark:
            return [t[i : i + most] for i in range(0, len(t), most)]
        bits = t.split(mark)
        bits = [x + mark for x in bits[:-1]] + bits[-1:]
        return [y for x in bits if x for y in parts(x, level + 1)]

    out, now = [], ""
    for part in parts(text, 0) if text else []:
        if now and len(now) + len(part) > most:
            out.append(now.strip())
            now = now[len(now) - min(overlap, most - len(part)) :] if len(part) < most and overlap else ""
        now += part
    if now.strip():
        out.append(now.strip())
    return [x for x in out if x]


#: So many transcripts of a batch are Python objects at once.
AT_ONCE = 16


def _retiming(key: str):
    """Streams batches of edits, a few transcripts at a time."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                few = b.slice(at, AT_ONCE)
                rows = [
                    (k, i, *t) for k, text, words in zip(*(few.column(c).to_pylist() for c in (key, "text", "words")))
                    for i, t in enumerate(retime(text or "", [(w["word"], w["start"], w["end"], w["speaker"]) for w in words or []]))
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, TIMED)], names=[key, "pos", "word", "start", "end", "speaker"])

    return run


TIMED = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.string())


def retimed(edits: DataFrame, key: str) -> DataFrame:
    """Edited texts (key, text, words array of word, start, end, speaker) to timed tokens, one row a token."""
    few = edits.select(F.col(key).cast("long").alias(key), "text", "words")
    return few.mapInArrow(_retiming(key), f"{key} long, pos int, word string, start double, end double, speaker string")


def text_chunks(docs: DataFrame, key: str, text: str, most: int = 1000, overlap: int = 50) -> DataFrame:
    """Documents to chunks of their text alone, in order."""

    def run(frames):
        for f in frames:
            rows = [(k, i, c) for k, t in zip(f[key], f[text]) for i, c in enumerate(split_text(t or "", most, overlap))]
            yield pd.DataFrame(rows, columns=[key, "ordinal", "chunk"])

    return docs.select(key, text).mapInPandas(run, f"{key} long, ordinal int, chunk string")
