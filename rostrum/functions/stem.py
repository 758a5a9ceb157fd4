"""English stems (the Porter2 rules) and stop words, as Column expressions and as SQL of the same steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published rules of the English stemmer and the usual English stop words.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their "
    "theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so "
    "than too very s t can will just don should now".split()
)
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
LONG_STARTS = ("gener", "commun", "arsen")
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
REGION = f"^{OTHER}*{VOWEL}+{OTHER}"
SHORT_END = f"(?:{OTHER}{VOWEL}[^aeiouywxY]|^{VOWEL}{OTHER})$"


def _ends(suffixes) -> str:
    """The longest of the suffixes: the leftmost match that reaches the end."""
    return f"(?:{'|'.join(suffixes)})$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _by_suffix(w: Column, pattern: str, change: Callable[[Column, Column], Column]) -> Column:
    """``change`` of the part before the suffix and the suffix, where a word has one."""
    cut = lambda s: F.when(s == "", w).otherwise(change(F.substring(w, F.lit(1), F.length(w) - F.length(s)), s))
    return _let(F.regexp_extract(w, pattern, 0), cut)


def _replacement(table: dict[str, str], suffix: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), suffix)


def _step_1b(w: Column, r1: Column) -> Column:
    def dropped(base: Column) -> Column:
        longer = base.rlike("(?:at|bl|iz)$") | (base.rlike(SHORT_END) & (F.length(base) <= r1))
        return F.when(base.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), F.substring(base, F.lit(1), F.length(base) - 1)).otherwise(F.when(longer, F.concat(base, F.lit("e"))).otherwise(base))

    def change(base: Column, s: Column) -> Column:
        eed = F.when(F.length(base) >= r1, F.concat(base, F.lit("ee"))).otherwise(w)
        return F.when(s.startswith("ee"), eed).when(base.rlike(VOWEL), _let(base, dropped)).otherwise(w)

    return _by_suffix(w, _ends(("eed", "eedly", "ed", "edly", "ing", "ingly")), change)


def _step_2(w: Column, r1: Column) -> Column:
    def change(base: Column, s: Column) -> Column:
        fits = (F.length(base) >= r1) & ((s != "ogi") | base.endswith("l")) & ((s != "li") | base.rlike("[cdeghkmnrt]$"))
        return F.when(fits, F.concat(base, _replacement(STEP_2, s))).otherwise(w)

    return _by_suffix(w, _ends(STEP_2), change)


def _step_3(w: Column, r1: Column, r2: Column) -> Column:
    def change(base: Column, s: Column) -> Column:
        return F.when((F.length(base) >= r1) & ((s != "ative") | (F.length(base) >= r2)), F.concat(base, _replacement(STEP_3, s))).otherwise(w)

    return _by_suffix(w, _ends(STEP_3), change)


def _step_4(w: Column, r2: Column) -> Column:
    return _by_suffix(w, _ends(STEP_4), lambda base, s: F.when((F.length(base) >= r2) & ((s != "ion") | base.rlike("[st]$")), base).otherwise(w))


def _step_5(w: Column, r1: Column, r2: Column) -> Column:
    def change(base: Column, s: Column) -> Column:
        e = (F.length(base) >= r2) | ((F.length(base) >= r1) & ~base.rlike(SHORT_END))
        return F.when(F.when(s == "e", e).otherwise((F.length(base) >= r2) & base.endswith("l")), base).otherwise(w)

    return _by_suffix(w, "[el]$", change)


def _singular(w: Column) -> Column:
    def change(base: Column, s: Column) -> Column:
        ie = F.concat(base, F.when(F.length(base) > 1, "i").otherwise("ie"))
        return F.when(s == "sses", F.concat(base, F.lit("ss"))).when(s.isin("ied", "ies"), ie).when((s == "s") & base.rlike(VOWEL + ".+$"), base).otherwise(w)

    return _by_suffix(w, "(?:sses|ied|ies|us|ss|s)$", change)


def _regions(w: Column) -> Column:
    """The word with the lengths before its first and second region."""
    start = lambda text, pattern: _let(F.length(F.regexp_extract(text, pattern, 0)), lambda n: F.when(n == 0, F.length(text)).otherwise(n))
    first = start(w, f"^(?:{'|'.join(LONG_STARTS)})|{REGION}")
    return _let(first, lambda r1: F.struct(w.alias("w"), r1.alias("r1"), (r1 + start(F.substring(w, r1 + 1, F.length(w)), REGION)).alias("r2")))


def _long_stem(word: Column) -> Column:
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "^'", ""), "^y", "Y"), "([aeiouy])y", "$1Y")
    state = _let(marked, _regions)
    state = _let(state, lambda s: F.struct(_singular(F.regexp_replace(s["w"], "('s'|'s|')$", "")).alias("w"), s["r1"].alias("r1"), s["r2"].alias("r2")))

    def rest(s: Column) -> Column:
        r1, r2 = s["r1"], s["r2"]
        out = _let(_step_1b(s["w"], r1), lambda w: F.regexp_replace(w, f"^(.+{OTHER})[yY]$", "$1i"))
        for step in (lambda w: _step_2(w, r1), lambda w: _step_3(w, r1, r2), lambda w: _step_4(w, r2), lambda w: _step_5(w, r1, r2)):
            out = _let(out, step)
        return F.when(s["w"].isin(*KEPT_AFTER_PLURAL), s["w"]).otherwise(out)

    return F.regexp_replace(_let(state, rest), "Y", "y")


def stem(word: Column | str) -> Column:
    """The English stem of a lower-case word. Words of one or two letters and those of other scripts stay; null gives null."""
    word = F.col(word) if isinstance(word, str) else word
    whole = _replacement(SPECIAL, word)
    return F.when((F.length(word) <= 2) | ~word.rlike("[a-z]"), word).when(whole.isNotNull(), whole).otherwise(_long_stem(word))


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _case(table: dict[str, str]) -> str:
    return "CASE s " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def stem_sql(words: str) -> str:
    """SQL giving word and stem of the distinct column ``word`` of a query, step by step."""
    region = lambda text, pattern: f"CASE WHEN length(regexp_extract({text}, '{pattern}')) = 0 THEN length({text}) ELSE length(regexp_extract({text}, '{pattern}')) END"
    q = f"SELECT DISTINCT word FROM ({words}) WHERE length(word) > 2 AND regexp_matches(word, '[a-z]') AND word NOT IN ({_quoted(SPECIAL)})"
    q = f"SELECT word, regexp_replace(regexp_replace(regexp_replace(word, '^''', ''), '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM ({q})"
    q = f"SELECT *, {region('w', '^(?:' + '|'.join(LONG_STARTS) + ')|' + REGION)} AS r1 FROM ({q})"
    q = f"SELECT *, r1 + {region('w[r1 + 1:]', REGION)} AS r2 FROM ({q})"

    def step(q: str, pattern: str, then: str) -> str:
        q = f"SELECT *, regexp_extract(w, '{pattern}') AS s FROM ({q})"
        q = f"SELECT *, w[:length(w) - length(s)] AS b FROM ({q})"
        return f"SELECT word, r1, r2, kept, CASE WHEN s = '' OR kept THEN w ELSE {then} END AS w FROM ({q})"

    q = f"SELECT * REPLACE (regexp_replace(w, '(''s''|''s|'')$', '') AS w), false AS kept FROM ({q})"
    plural = f"CASE WHEN s = 'sses' THEN b || 'ss' WHEN s IN ('ied', 'ies') THEN b || CASE WHEN length(b) > 1 THEN 'i' ELSE 'ie' END WHEN s = 's' AND regexp_matches(b, '{VOWEL}.+$') THEN b ELSE w END"
    q = step(q, "(?:sses|ied|ies|us|ss|s)$", plural)
    q = f"SELECT * REPLACE (w IN ({_quoted(KEPT_AFTER_PLURAL)}) AS kept) FROM ({q})"
    double = "regexp_matches(b, '(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$')"
    longer = f"regexp_matches(b, '(?:at|bl|iz)$') OR (length(b) <= r1 AND regexp_matches(b, '{SHORT_END}'))"
    past = f"CASE WHEN s IN ('eed', 'eedly') THEN CASE WHEN length(b) >= r1 THEN b || 'ee' ELSE w END WHEN NOT regexp_matches(b, '{VOWEL}') THEN w WHEN {double} THEN b[:-2] WHEN {longer} THEN b || 'e' ELSE b END"
    q = step(q, _ends(("eed", "eedly", "ed", "edly", "ing", "ingly")), past.replace("b[:-2]", "b[:length(b) - 1]"))
    q = f"SELECT * REPLACE (CASE WHEN kept THEN w ELSE regexp_replace(w, '^(.+{OTHER})[yY]$', '\\1i') END AS w) FROM ({q})"
    q = step(q, _ends(STEP_2), f"CASE WHEN length(b) >= r1 AND (s <> 'ogi' OR b LIKE '%l') AND (s <> 'li' OR regexp_matches(b, '[cdeghkmnrt]$')) THEN b || {_case(STEP_2)} ELSE w END")
    q = step(q, _ends(STEP_3), f"CASE WHEN length(b) >= r1 AND (s <> 'ative' OR length(b) >= r2) THEN b || {_case(STEP_3)} ELSE w END")
    q = step(q, _ends(STEP_4), "CASE WHEN length(b) >= r2 AND (s <> 'ion' OR regexp_matches(b, '[st]$')) THEN b ELSE w END")
    q = step(q, "[el]$", f"CASE WHEN CASE s WHEN 'e' THEN length(b) >= r2 OR (length(b) >= r1 AND NOT regexp_matches(b, '{SHORT_END}')) ELSE length(b) >= r2 AND b LIKE '%l' END THEN b ELSE w END")
    special = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SPECIAL.items())
    others = f"SELECT DISTINCT word, CASE word {special} ELSE word END AS stem FROM ({words}) WHERE length(word) <= 2 OR NOT regexp_matches(word, '[a-z]') OR word IN ({_quoted(SPECIAL)})"
    return f"SELECT word, replace(w, 'Y', 'y') AS stem FROM ({q}) UNION ALL {others}"
