"""Text functions as Column expressions; patterns carry (?U) where letters may be non-ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefix that makes \w, \s and \d of the JVM's patterns Unicode-aware.
U = "(?U)"


def fuse(c) -> Column:
    """Lower case without white space, hyphens and apostrophes."""
    return F.lower(F.regexp_replace(c, U + r"[\s\-']", ""))


#: Rewrites of the phonetic key, in order.
PHONETIC = (
    ("ph", "f"), ("gh(?!$)", "g"), ("ck", "k"), ("ei|ey", "e"), ("ou|oo", "u"), ("aa", "a"), ("ee", "e"), ("ii", "i"), (r"(.)\1+", "$1"),
)


def phonetic_key(c) -> Column:
    out = fuse(c)
    for pattern, to in PHONETIC:
        out = F.regexp_replace(out, pattern, to)
    return out


def similarity(a, b) -> Column:
    """1 - edit distance / longer length; equal empties are 1."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def clamp(c, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def edge_stripped(c) -> Column:
    """Lower case without punctuation at either end."""
    return F.lower(F.regexp_replace(c, U + r"^[^\w]+|[^\w]+$", ""))


def align_key(c) -> Column:
    return F.regexp_replace(F.lower(c), U + r"[^\w']+", "")


def passage_key(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), U + r"[^\w]+", " "))


def question_key(c) -> Column:
    spaced = F.trim(F.regexp_replace(c, U + r"\s+", " "))
    return F.lower(F.regexp_replace(spaced, r"[?.! ]+$", ""))


def blank_to_null(c) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, U + r"\s+", " ")), F.lit(""))


def initials(c) -> Column:
    """Upper-case first letters of at most two words; null or blank gives ?."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    made = F.upper(F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 1)), ""))
    return F.coalesce(F.nullif(made, F.lit("")), F.lit("?"))


def hms(seconds) -> Column:
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def citation_ids(c) -> Column:
    return F.transform(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\[(\d+)\]"), F.lit(1))), lambda x: x.cast("long"))


def strip_citations(c) -> Column:
    bare = F.regexp_replace(c, r"\s*\[\d+\]", "")
    bare = F.regexp_replace(bare, r"\s+([.,;:!?])", "$1")
    return F.trim(F.regexp_replace(bare, r" {2,}", " "))


def strip_emphasis(c) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(\*\*|__)(.+?)\1", "$2"), r"(?<!\w)[*_](.+?)[*_](?!\w)", "$1"))


def truncated_ip(c) -> Column:
    """IPv4 to /24; IPv6 to /48 (three groups, an elided group counts as 0); anything else is null."""
    four = F.regexp_extract(c, r"^(\d{1,3}\.\d{1,3}\.\d{1,3})\.\d{1,3}$", 1)
    head = F.split(F.split(c, "::")[0], ":")
    six = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.coalesce(F.nullif(F.get(head, i), F.lit("")), F.lit("0")))
    return F.when(four != "", F.concat(four, F.lit(".0"))).when(c.contains(":"), F.concat(F.array_join(six, ":"), F.lit("::")))


#: Marks of browser families, the first that occurs wins.
AGENTS = (("Edg", "Edge"), ("OPR", "Opera"), ("Chrome", "Chrome"), ("Firefox", "Firefox"), ("Safari", "Safari"), ("curl", "curl"))


def agent_family(c) -> Column:
    out = F.when(F.coalesce(c, F.lit("")) == "", "Unknown")
    for mark, family in AGENTS:
        out = out.when(c.contains(mark), family)
    return out.otherwise("Other")


def event_id(*parts) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 32)


def params_hash(c) -> Column:
    """16 hexadecimal digits of a map's entries in key order, nulls dropped."""
    entries = F.array_sort(F.map_entries(F.map_filter(c, lambda _, v: v.isNotNull())))
    return F.substring(F.sha2(F.to_json(entries), 256), 1, 16)


def valid_term(c) -> Column:
    t = F.trim(c)
    return (F.length(t) >= 1) & (F.length(t) <= 200) & t.rlike(U + r"^[\w\s'.\-&()/]+$")


def progressive_delay(failures) -> Column:
    """Milliseconds: none before the third failure, then doubling from 250 up to 4000."""
    return F.when(failures < 3, F.lit(0.0)).otherwise(F.least(F.lit(4000.0), 250 * F.pow(F.lit(2.0), failures - 3)))


def candidate_score(c) -> Column:
    """Half the share of words with a letter, half the word count against 20."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    n = F.size(words)
    alpha = F.size(F.filter(words, lambda w: w.rlike(r"\p{L}")))
    return F.when(n == 0, F.lit(0.0)).otherwise(0.5 * alpha / n + 0.5 * F.least(n, F.lit(20)) / 20)


def escape_like(value: str) -> str:
    """A literal for LIKE with backslash as the escape character."""
    for c in ("\\", "%", "_"):
        value = value.replace(c, "\\" + c)
    return value


def trigrams(c) -> Column:
    """Distinct padded trigrams: two spaces before, one after each word of the lower-cased text."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(
        F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3)))))
    )


def prompt_tokens(*texts) -> Column:
    return F.ceil(sum((F.length(t) for t in texts[1:]), F.length(texts[0])) / 4)
