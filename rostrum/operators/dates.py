"""Spoken dates in word streams: years, decades, days and months become digits.

The forms are a small grammar of regular expressions over cleaned words (lower case, without ``.,;:!?``).
Forms are tried in a fixed order at each place; the first that reads a date there replaces its words by one
word with the first one's start and the last one's end, unless that changes nothing. Whether a date begins
at a word depends on that word and the next few only, so a stream is walked from left to right in order
and no more than those few words are held back.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Number words, months, and what cleaning drops.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINALS = (
    "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth "
    "seventeenth eighteenth nineteenth twentieth".split()
)
DECADES = "twenties thirties forties fifties sixties seventies eighties nineties".split()
MONTHS = "january february march april may june july august september october november december".split()
DROPPED = re.compile(r"[.,;:!?]")

VALUES = {w: i for i, w in enumerate(ONES)} | {w: 10 * i for i, w in enumerate(TENS, 2)} | {w: 10 * i for i, w in enumerate(DECADES, 2)}
VALUES |= {w: i for i, w in enumerate(ORDINALS, 1)} | {"thirtieth": 30, "oh": 0, "o": 0}
#: Words of the longest date: two of the day, "of", the month, and "two thousand and ninety two".
LONGEST = 9


def _word(*words: str) -> str:
    return rf"(?>(?:{'|'.join(words)})(?!\S))"


_UNIT, _TENS = _word(*ONES[:10]), _word(*TENS)
_SUFFIX = rf"(?>{_word('oh', 'o')} {_UNIT}|{_TENS}(?> {_UNIT})?|{_word(*ONES)})"
_LONG_SUFFIX = rf"(?>{_TENS}(?> {_UNIT})?|{_word(*ONES[10:])})"  # "twenty six" is a number, "twenty sixteen" a year
_THOUSAND = rf"(?P<thousand>two(?!\S) thousand(?!\S)(?> and(?!\S))?(?> {_SUFFIX})?)"
_CENTURY = rf"(?P<century>{_word(*ONES[13:])} {_SUFFIX}|twenty(?!\S) {_LONG_SUFFIX})"
_YEAR = rf"(?>{_THOUSAND}|{_CENTURY}|(?P<year>(?:19|20)[0-9]{{2}})(?!\S))"
_MONTH = rf"(?P<month>{_word(*MONTHS)})"
_ORDINAL = rf"(?>{_word('(?:twenty|thirty)[ -](?:' + '|'.join(ORDINALS[:9]) + ')', *ORDINALS, 'thirtieth', '[0-9]{1,2}(?:st|nd|rd|th)')})"
_DAY = rf"(?>{_ORDINAL}|(?:twenty|thirty)(?!\S)(?> {_word(*ONES[1:10])})?|{_word('[0-9]{1,2}', *ONES[1:])})"


def _number(words: str) -> int:
    """The sum of number words, or the digits they begin with."""
    digits = re.match("[0-9]+", words)
    return int(digits[0]) if digits else sum(VALUES.get(w, 0) for w in re.split("[ -]", words))


def _year(m: re.Match) -> int | None:
    found = m.groupdict()
    if found.get("thousand"):
        return 2000 + _number(found["thousand"].removeprefix("two thousand").replace(" and", ""))
    if found.get("century"):
        prefix, _, rest = found["century"].partition(" ")
        return VALUES[prefix] * 100 + _number(rest)
    return int(found["year"]) if found.get("year") else None


def _with_suffix(day: int) -> str:
    return f"{day}{'th' if day in (11, 12, 13) else {1: 'st', 2: 'nd', 3: 'rd'}.get(day % 10, 'th')}"


def _day_and_month(m: re.Match, form: str) -> str | None:
    day, year = _number(m["day"]), _year(m)
    if not 1 <= day <= 31:
        return None
    return form.format(day=_with_suffix(day), month=m["month"].title(), year="" if year is None else year, comma="" if year is None else ", ", gap="" if year is None else " ")


def _split(m: re.Match) -> str | None:
    both = m[0].replace(" ", "")
    return both if 1900 <= int(both) <= 2099 else None


#: (form, reading) in their fixed order; a reading of None leaves the place to the next form.
FORMS = tuple(
    (re.compile(pattern), read)
    for pattern, read in (
        (rf"(?P<day>{_ORDINAL})(?> of(?!\S))? {_MONTH}(?> {_YEAR})?", lambda m: _day_and_month(m, "{day} {month}{gap}{year}")),
        (rf"{_MONTH} {_YEAR}", lambda m: f"{m['month'].title()} {_year(m)}"),
        (rf"{_MONTH} (?P<day>{_DAY})(?> {_YEAR})?", lambda m: _day_and_month(m, "{month} {day}{comma}{year}")),
        (rf"(?P<day>[0-9]{{1,2}}) {_MONTH} {_YEAR}", lambda m: _day_and_month(m, "{day} {month}, {year}")),
        (_THOUSAND, lambda m: str(_year(m))),
        (_CENTURY, lambda m: str(_year(m))),
        (r"(?>[0-9] [0-9]{3}|[0-9]{2} [0-9]{2}|[0-9]{3} [0-9])(?!\S)", _split),
        (rf"(?P<prefix>{_word(*ONES[13:], *TENS)}) (?P<decade>{_word(*DECADES)})", lambda m: f"{VALUES[m['prefix']] * 100 + VALUES[m['decade']]}s"),
    )
)
_STARTS = re.compile("[0-9]|" + "|".join([*MONTHS, *ONES[1:], *TENS, *ORDINALS, "thirtieth"]))
#: What a date's first or later words begin with, or are.
_WITHIN = re.compile(rf"{_STARTS.pattern}|(?:{'|'.join(['zero', 'oh', 'o', 'of', 'and', 'thousand', *DECADES])})$")


def clean(word: str | None) -> str:
    """A word as the grammar reads it; it stays one word."""
    return re.sub(r"\s+", "_", DROPPED.sub("", (word or "").lower()).strip()) or "_"


def date_at(spoken: str, place: int, said: list[str | None]) -> tuple[str, int] | None:
    """(date, words) of the date that begins at ``place`` of the cleaned words, if it differs from what was ``said``."""
    if not _STARTS.match(spoken, place):
        return None
    for form, read in FORMS:
        m = form.match(spoken, place)
        text = read(m) if m else None
        if text is not None:
            n = m[0].count(" ") + 1
            same = text.lower() == " ".join(x or "" for x in said[:n]).lower()
            return None if same else (text, n)
    return None


def correct(words: list[str | None]) -> list[tuple[int, int, str]]:
    """(first, end, text) of the runs of words that are dates, left to right."""
    cleaned = [clean(w) for w in words]
    places = np.cumsum([0, *(len(w) + 1 for w in cleaned)]).tolist()
    spoken, out, i = " ".join(cleaned), [], 0
    while i < len(words):
        found = date_at(spoken, places[i], words[i : i + LONGEST])
        if found:
            out.append((i, i + found[1], found[0]))
        i += found[1] if found else 1
    return out


def correct_text(text: str | None) -> str | None:
    """A text with its dates corrected and its words joined by one space; blank texts stay."""
    words = (text or "").split()
    if not words:
        return text
    out, done = [], 0
    for lo, hi, to in correct(words):
        out += [*words[done:lo], to]
        done = hi
    return " ".join([*out, *words[done:]])


def correct_texts(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the dates of one text column corrected; null stays null."""
    names = rows.columns

    def run(batches):
        for b in batches:
            made = pa.array([correct_text(t.as_py()) for t in b.column(names.index(column))], pa.string())
            yield pa.RecordBatch.from_arrays([made if c == column else b.column(k) for k, c in enumerate(names)], names=names)

    return rows.mapInArrow(run, rows.schema)


@lru_cache(1 << 14)
def _may_hold(word: str | None) -> bool:
    """Whether a date may hold the word."""
    return bool(_WITHIN.match(clean(word)))


@lru_cache(1 << 14)
def _date(words: tuple[str | None, ...]) -> tuple[str, int] | None:
    """The date that begins ``words``; streams repeat their dates, so each is read once."""
    return date_at(" ".join(map(clean, words)), 0, list(words))


def _runs(words: list[str | None], key_ends: np.ndarray, end: int) -> list[tuple[int, int, str]]:
    """(first, end, text) of the dates that begin before ``end``, left to right; none goes beyond its key's last word."""
    within, out, done = list(map(_may_hold, words)), [], 0
    for i in (k for k, may in enumerate(within[:end]) if may):
        if i >= done:
            hi, most = i + 1, min(i + LONGEST, int(key_ends[i]))
            while hi < most and within[hi]:
                hi += 1
            if found := _date(tuple(words[i:hi])):
                done = i + found[1]
                out.append((i, done, found[0]))
    return out


def _merging(batches):
    """Streams (key, word, start, end) in order; keeps back the words whose dates may go on, and of the last key its count."""
    held, now, left = None, None, 0

    def decided(columns: list[pa.Array], end: int) -> pa.RecordBatch:
        """The words before ``end`` or the end of a date that begins there; the others are held."""
        nonlocal held, now, left
        key, word, start, stop = columns
        n, number, null = len(key), key.fill_null(0).to_numpy(), key.is_null().to_numpy(zero_copy_only=False)
        first = np.concatenate([[True], (number[1:] != number[:-1]) | (null[1:] != null[:-1])])
        begins, of = np.flatnonzero(first), np.cumsum(first) - 1
        runs = _runs(word.to_pylist(), np.append(begins[1:], n)[of], end)
        end = max([end, *(hi for _, hi, _ in runs[-1:])])
        kept, last, hit = np.ones(n, bool), np.arange(n), np.zeros(n, bool)
        for lo, hi, _ in runs:
            kept[lo + 1 : hi], last[lo], hit[lo] = False, hi - 1, True
        word = pc.replace_with_mask(word, pa.array(hit), pa.array([to for _, _, to in runs], word.type))
        pos = np.cumsum(kept) - 1
        before = pos[begins]  # a key's first word is always kept
        if key[0].as_py() == now:
            before[0] -= left
        pos -= before[of]
        now, left = key[end - 1].as_py(), int(pos[end - 1]) + 1
        held = [c.slice(end) for c in columns]
        at = np.flatnonzero(kept[:end])
        made = [key.take(at), pa.array(pos[at], pa.int64()), word.take(at), start.take(at), stop.take(last[at]), pa.array(hit[at])]
        return pa.RecordBatch.from_arrays(made, names=["key", "pos", "word", "start", "end", "corrected"])

    for b in batches:
        columns = b.columns if held is None else [pa.concat_arrays(both) for both in zip(held, b.columns)]
        held = columns
        if (end := len(columns[0]) - LONGEST + 1) > 0:
            yield decided(columns, end)
    if held is not None and len(held[0]):
        yield decided(held, len(held[0]))


def correct_stream(words: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Words (key, order, word, start, end) with each date merged into one word; pos counts what is left.

    The words of a key stream by in order, once; neither a key nor the words around each word are ever held.
    """
    typed = [F.col(key).cast("long").alias("key"), "word", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")]
    rows = words.select(*typed, *(F.col(c).alias(f"_{k}") for k, c in enumerate(order))).repartition("key")
    rows = rows.sortWithinPartitions("key", *(f"_{k}" for k in range(len(order)))).select("key", "word", "start", "end")
    made = rows.mapInArrow(_merging, "key long, pos long, word string, start double, end double, corrected boolean")
    return made.withColumnRenamed("key", key)
