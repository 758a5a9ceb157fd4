"""Entity correction over whole texts and over word streams: candidates with evidence, gates, titles, one settling.

Every window of a few tokens is a candidate with its text, how surely its words were heard and where it
stands. The distinct texts are matched once by the joins of ``dictionary.chain``, whatever the size of the
index. Approximate matches then meet the gates at their place. Each token has at most one run: a person after
a title, else the window that the walk's rule takes. What overlaps is settled from left to right.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textfn as T
from . import dictionary as D
from .gates import context_signals, decided, in_lexicon
from .names import words as name_words
from .spans import ahead, settled
from .steps import written

#: Fixed value: what a token of a text is.
TOKEN = r"[A-Za-zÀ-ÿ'\-]+"
#: Punctuation that is no part of a token when words are compared.
_EDGES = r"[.,;:!?\"'()\[\]{}<>“”‘’…—–\-]+"
_RUN = ("n", "span", "canonical", "confidence", "strategy", "kind", "type")


@dataclass(frozen=True)
class Profile:
    """How matches are scored, which gates they meet, and what is accepted. The defaults are fixed values."""

    evidence: bool = True
    confidence_gate: bool = True
    lexicon_gate: bool = True
    context_gate: bool = True
    scope_gate: bool = True
    high: float = 0.90  # heard so surely that nothing is guessed
    ordinary: float = 0.60  # ordinary words heard so surely are not guessed at
    unknown_blocks: bool = True  # ordinary words of unknown confidence are not guessed at
    penalty: float = 0.10  # of persons outside the sitting
    reach: int = 40  # words of context to either side
    text_accept: float = 0.75
    word_accept: float = 0.90
    title_accept: float = 0.65


#: Without gates and evidence; and as the service runs for providers whose words have confidences or have none.
BASELINE = Profile(evidence=False, confidence_gate=False, lexicon_gate=False, context_gate=False, scope_gate=False)
SERVICE = Profile()
UNHEARD = Profile(unknown_blocks=False)


@dataclass(frozen=True)
class Lists:
    """Registry lists: short ones as tuples in lower case, long ones as tables (token); scope: key and canonical of the sitting's members."""

    titles: tuple[str, ...] = ()
    stop: tuple[str, ...] = ()
    word_stop: tuple[str, ...] = ()
    blocked: DataFrame | None = None
    lexicon: DataFrame | None = None
    scope: DataFrame | None = None


def _in(c, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(c).isin(*values), F.lit(False)) if values else F.lit(False)


def aligned(word, token) -> Column:
    """Whether a word and a token are the same but for case and punctuation at the edges."""
    bare = lambda c: F.lower(F.regexp_replace(c, f"^{_EDGES}|{_EDGES}$", ""))
    return F.coalesce(bare(word) == bare(token), F.lit(False))


def _windows(rows: DataFrame, key: str, widest: int, begin: int = 0) -> DataFrame:
    """(key, at, n, span, low, first, last, heard) of every window of up to ``widest`` tokens that begins ``begin`` tokens after a row.

    ``at`` is the row's own. ``heard`` is the lowest confidence of the window's words that have one, within 0
    and 1; null where none has or a token is not its word.
    """
    room = F.size("next_token") - begin
    sized = rows.where(room > 0).withColumn("n", F.explode(F.sequence(F.lit(1), F.least(room, F.lit(widest)))))
    of = lambda c: F.slice(c, begin + 1, F.col("n"))
    heard = F.array_min(F.transform(of("next_heard"), lambda h: F.when(h.isNotNull(), T.clamp(h, 0.0, 1.0))))
    out = sized.select(
        key, "at", "n", F.array_join(of("next_token"), " ").alias("span"), F.get("next_token", F.lit(begin)).alias("first"),
        F.get("next_token", F.col("n") + (begin - 1)).alias("last"), F.when(F.forall(of("next_own"), lambda x: x), heard).alias("heard"),
    )
    return out.withColumn("low", F.lower("span"))


def _known(windows: list[DataFrame], index: DataFrame, lists: Lists, profile: Profile) -> DataFrame:
    """What the distinct texts (low) of all windows stand for, with in_lexicon; each text is matched once.

    Stop words stand for nothing, but for a name that they are when joined.
    """
    texts = reduce(DataFrame.unionByName, (w.select("low") for w in windows)).distinct().select(F.col("low").alias("span_id"), F.col("low").alias("span"))
    lexicon = lists.lexicon if profile.lexicon_gate else None
    found = D.chain(texts.where(~_in("span", lists.stop)), index, lists.blocked, profile.evidence, lexicon)
    if lists.stop:
        joined = D.fused(texts.where(_in("span", lists.stop) & F.col("span").contains(" ")), index)
        found = found.unionByName(joined.withColumns({"confidence": F.lit(0.97), "strategy": F.lit("joined")}))
    found = written(found)
    if lexicon is None:
        found = found.withColumn("in_lexicon", F.lit(False))
    else:
        ordinary = in_lexicon(found.select("span_id", F.col("span_id").alias("span")), lexicon)
        found = found.join(ordinary.select("span_id", "in_lexicon"), "span_id")
    return found.withColumnRenamed("span_id", "low")


def _gated(candidates: DataFrame, key: str, words: DataFrame | None, order: list[str], index: DataFrame, lists: Lists, profile: Profile, accept: float, begin: int = 0) -> DataFrame:
    """``candidates`` (key, at, n, heard, a match) with gate, final_confidence and accepted (by ``accept``)."""
    loose = F.col("strategy").isin(*D.APPROXIMATE)
    rows = candidates.withColumns({"approximate": loose, "person": F.col("kind") == "person", "span_confidence": F.col("heard"), "blocked": F.lit(False)})
    if profile.scope_gate and lists.scope is not None:
        members = lists.scope.select(key, "canonical", F.lit(True).alias("member")).distinct()
        scoped = lists.scope.select(key).distinct().withColumn("scoped", F.lit(True))
        rows = rows.join(members, [key, "canonical"], "left").join(scoped, key, "left")
        rows = rows.withColumn("in_scope", F.when(F.col("scoped"), F.coalesce("member", F.lit(False)))).drop("member", "scoped")
    else:
        rows = rows.withColumn("in_scope", F.lit(None).cast("boolean"))
    if not profile.context_gate or words is None:
        rows = rows.withColumn("signal", F.lit(not profile.context_gate))
    else:
        spans = rows.where("approximate and person").select(key, (F.col("at") + begin).alias("at"), "n").distinct()
        found = context_signals(words, key, order, spans, lists.titles, index.where("type = 'constituency'"), profile.reach)
        rows = rows.join(found.select(key, (F.col("at") - begin).alias("at"), "n", "signal"), [key, "at", "n"], "left")
        rows = rows.withColumn("signal", F.coalesce("signal", F.lit(False)))
    return decided(rows, accept, profile.high if profile.confidence_gate else 2.0, profile.ordinary, profile.unknown_blocks, profile.penalty)


def _title_windows(rows: DataFrame, key: str, lists: Lists) -> DataFrame:
    """Windows of one to three tokens after a title; a stop word alone, and those that end in one, are passed over."""
    return _windows(rows.where(_in("token", lists.titles)), key, 3, 1).where(~_in("last", lists.stop))


def _titled(rows: DataFrame, known: DataFrame, key: str, words: DataFrame | None, order: list[str], index: DataFrame, lists: Lists, profile: Profile) -> DataFrame:
    """(key, at, titled): the person named after the title at ``at``, by the longest window that stands for one.

    Else the next token alone: a surname (0.90, the first loaded), then its sound, then a near text, whatever
    the gates say.
    """
    accept = profile.title_accept
    whole = _gated(_title_windows(rows, key, lists).join(known, "low"), key, words, order, index, lists, profile, accept, 1)
    whole = whole.where("accepted and person").withColumn("confidence", F.col("final_confidence"))
    whole = written(whole.groupBy(key, "at").agg(F.max_by(F.struct(*_RUN), "n").alias("titled")))

    alone = _windows(rows.where(_in("token", lists.titles)), key, 1, 1).join(whole, [key, "at"], "left_anti")
    texts = written(alone.select(F.col("low").alias("span_id"), F.col("low").alias("span")).distinct())
    by_surname = texts.join(D.keys_of(index, "surname"), F.col("span") == F.col("key")).where("kind = 'person'")
    by_surname = by_surname.withColumns({"confidence": F.lit(0.90), "strategy": F.lit("title_person")}).select("span_id", *D.MATCH)
    rest = texts.join(by_surname, "span_id", "left_anti")
    person = lambda found: found.where((F.col("kind") == "person") & (F.col("confidence") >= accept))
    sound = person(D.phonetic(rest, index, profile.evidence))
    free = rest.join(sound, "span_id", "left_anti")
    if lists.blocked is not None:
        free = free.join(lists.blocked.select(F.lower("token").alias("token")).distinct(), F.col("span") == F.col("token"), "left_anti")
    every = by_surname.unionByName(sound).unionByName(person(D.fuzzy(free, index, profile.evidence)))
    other = alone.join(every.withColumnRenamed("span_id", "low"), "low").select(key, "at", F.struct(*_RUN).alias("titled"))
    return whole.unionByName(other)


def _without_title(canonical, title) -> Column:
    """A name without its first word where that is the title it follows."""
    parts = name_words(canonical)
    double = (F.size(parts) > 1) & (F.lower(F.get(parts, F.lit(0))) == F.lower(title))
    return F.when(double, F.regexp_replace(canonical, T.U + r"^\s*\S+\s+", "")).otherwise(canonical)


def _shown(canonical, span) -> Column:
    """A party by its abbreviation where the span is hardly longer than that."""
    short = (F.col("kind") == "party") & F.col("abbreviation").isNotNull() & (F.length(span) <= F.length("abbreviation") + 1)
    return F.when(short, F.upper("abbreviation")).otherwise(canonical)


def _completed(words: DataFrame) -> DataFrame:
    """``words`` with the optional columns that they lack: confidence, speaker, capital, punctuated_word."""
    kinds = {"confidence": "double", "speaker": "string", "capital": "boolean", "punctuated_word": "string"}
    return words.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in words.columns})


def word_rows(words: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Words as the tokens that windows are made of."""
    tokens = _completed(words).withColumns({"token": F.coalesce("word", F.lit("")), "heard": F.col("confidence").cast("double"), "own": F.lit(True)})
    return written(ahead(tokens, key, order, ["token", "heard", "own", "start", "end", "punctuated_word"], 4))


def word_windows(rows: DataFrame, key: str, lists: Lists) -> DataFrame:
    """A stream's windows of one to three words: none begins with a title, a stop word or under three letters, or holds a stop word."""
    begins = ~_in("token", lists.titles) & ~_in("token", lists.word_stop) & (F.length("token") >= 3)
    windows = _windows(rows.where(begins), key, 3)
    if lists.word_stop:
        windows = windows.where((F.col("n") == 1) | ~F.arrays_overlap(F.split("low", " "), F.array(*map(F.lit, lists.word_stop))))
    return windows


def text_windows(rows: DataFrame, key: str, lists: Lists) -> DataFrame:
    """A text's windows of one to four tokens; several begin and end with no stop word, but for initials and titles."""
    windows = _windows(rows, key, 4)
    free = F.col("first").rlike("^[A-Za-z]$") | _in("first", lists.titles)
    return windows.where((F.col("n") == 1) | (free | ~_in("first", lists.stop)) & ~_in("last", lists.stop))


def candidates(
    windows: DataFrame, known: DataFrame, key: str, words: DataFrame | None, order: list[str], index: DataFrame, lists: Lists, profile: Profile, accept: float,
) -> DataFrame:
    """The windows that stand for a name, with gate (why they were rejected, or null), final_confidence and accepted."""
    named = windows.join(known, "low").withColumn("canonical", _shown(F.col("canonical"), F.col("span")))
    return _gated(named, key, words, order, index, lists, profile, accept)


def word_candidates(words: DataFrame, key: str, order: list[str], index: DataFrame, lists: Lists = Lists(), profile: Profile = SERVICE) -> DataFrame:
    """The gated candidates of a stream, for tallies of gates and the like."""
    windows = word_windows(word_rows(words, key, order), key, lists)
    return candidates(windows, _known([windows], index, lists, profile), key, _completed(words), order, index, lists, profile, profile.word_accept)


def _with_runs(rows: DataFrame, key: str, titled: DataFrame, best: DataFrame) -> DataFrame:
    """``rows`` with the run of each token, of n words: a title and the person after it (skip is then 1), else a window; and its text."""
    rows = rows.join(titled, [key, "at"], "left").join(best, [key, "at"], "left")
    rows = rows.withColumns({"skip": F.col("titled").isNotNull().cast("int"), "run": F.coalesce("titled", "run")})
    text = F.when(F.col("skip") == 1, _without_title(F.col("run.canonical"), F.col("token"))).otherwise(F.col("run.canonical"))
    return rows.withColumns({"n": F.col("run.n") + F.col("skip"), "text": text}).drop("titled")


def correct_stream(
    words: DataFrame, key: str, order: list[str], index: DataFrame, lists: Lists = Lists(), profile: Profile = SERVICE
) -> DataFrame:
    """Words (key, order, word, start, end) with corrected runs merged: first word's start, last word's end; pos counts what is left.

    Of the windows of three, two and one words at a word the longest that is accepted wins; one that is its
    name already changes nothing, and a single word may only become up to two, unless it is a party. A title
    and the person after it are one run, of which the title stays. Optional columns: confidence, speaker,
    capital (unknown without) and punctuated_word, whose closing mark a corrected word keeps. Words without
    text are kept. An empty table gives no rows.
    """
    rows, given = word_rows(words, key, order), _completed(words)
    windows = word_windows(rows, key, lists)
    known = _known([windows, _title_windows(rows, key, lists)], index, lists, profile)
    cut = candidates(windows, known, key, given, order, index, lists, profile, profile.word_accept)
    cut = cut.where("accepted").withColumn("confidence", F.col("final_confidence"))
    own = F.when(F.col("n") > 1, F.lower("canonical") == F.col("low")).otherwise(F.col("canonical") == F.col("span"))
    short = (F.col("n") > 1) | own | (F.col("kind") == "party") | (F.size(name_words("canonical")) <= 2)
    best = cut.where(short).groupBy(key, "at").agg(F.max_by(F.struct(*_RUN), "n").alias("run"))
    rows = _with_runs(rows, key, _titled(rows, known, key, given, order, index, lists, profile), best)
    same = F.when(F.col("n") > 1, F.lower("text") == F.lower("run.span")).otherwise(F.col("text") == F.col("run.span"))
    last, of = F.col("n") - 1, lambda c, k: F.get(c, k)
    said = F.concat("text", F.regexp_extract(of("next_punctuated_word", last), r"[.?!]?$", 0))
    made = F.struct(
        F.col("text").alias("word"), of("next_start", F.col("skip")).cast("double").alias("start"), of("next_end", last).cast("double").alias("end"),
        F.col("run.strategy").alias("strategy"), F.when(F.exists("next_punctuated_word", lambda w: w != ""), said).alias("punctuated_word"),
    )
    plain = F.struct(
        "word", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.lit(None).cast("string").alias("strategy"), "punctuated_word"
    )
    rows = rows.select(key, "at", "n", "skip", (F.col("n").isNotNull() & ~same).alias("changes"), plain.alias("plain"), made.alias("made"))
    rows = settled(rows, key, "changes", "skip").where("not gone")
    changed = F.col("taken") & F.coalesce("changes", F.lit(False))
    out = F.when(~changed, F.array("plain")).when(F.col("skip") == 1, F.array("plain", "made")).otherwise(F.array("made"))
    return rows.select(key, "pos", F.posexplode(out).alias("more", "w")).select(key, (F.col("pos") + F.col("more")).alias("pos"), "w.*")


def text_rows(docs: DataFrame, id_: str, text: str, words: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """Tokens of texts (id, pos, token, gap, lead, start) as windows are made of them; ``words`` tell how surely the k-th token was heard."""
    gaps = F.split(text, TOKEN, -1)
    parts = docs.select(F.col(id_).alias("id"), gaps.alias("gaps"), F.posexplode(F.arrays_zip(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("token"), F.slice(gaps, 2, 2**30).alias("gap"))))
    parts = parts.select("id", "pos", F.get("gaps", F.lit(0)).alias("lead"), "col.token", "col.gap")
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", (F.length("lead") + F.coalesce(F.sum(F.length("token") + F.length("gap")).over(before), F.lit(0))).cast("int"))
    if words is None:
        parts = parts.withColumns({"heard": F.lit(None).cast("double"), "own": F.lit(False)})
    else:
        at = F.row_number().over(Window.partitionBy(id_).orderBy(*order)) - 1
        heard = _completed(words).select(F.col(id_).alias("id"), at.alias("pos"), "word", F.col("confidence").cast("double").alias("heard"))
        parts = parts.join(heard, ["id", "pos"], "left").withColumn("own", aligned("word", "token")).drop("word")
    return written(ahead(parts, "id", ["pos"], ["token", "gap", "start", "heard", "own"], 4))


def correct_documents(
    docs: DataFrame, id_: str, text: str, index: DataFrame, lists: Lists = Lists(), profile: Profile = SERVICE, words: DataFrame | None = None, order: list[str] | None = None,
) -> DataFrame:
    """id, corrected text and corrections of every document; null texts stay null without corrections.

    At each token a title with the person after it wins, then the longest window that spells its name
    already, then the surest window, the longer of equals. ``words`` (id, order, word, confidence, speaker,
    capital) are the texts' words, token by token, for the gates; without them every confidence is unknown
    and no context supports a person. ``id_`` names a key without repeats.
    """
    rows = text_rows(docs, id_, text, words, order)
    given = None if words is None else _completed(words).withColumnRenamed(id_, "id")
    if lists.scope is not None:
        lists = replace(lists, scope=lists.scope.withColumnRenamed(id_, "id"))
    windows = text_windows(rows, "id", lists)
    known = _known([windows, _title_windows(rows, "id", lists)], index, lists, profile)
    cut = candidates(windows, known, "id", given, order, index, lists, profile, profile.text_accept)
    cut = cut.where("accepted").withColumn("confidence", F.col("final_confidence"))
    run, own = F.struct(*_RUN), F.lower("canonical") == F.col("low")
    best = cut.groupBy("id", "at").agg(F.max_by(F.when(own, run), F.when(own, F.col("n"))).alias("own"), F.max_by(run, F.struct(F.round("confidence", 9), "n")).alias("other"))
    best = best.select("id", "at", F.coalesce("own", "other").alias("run"))
    rows = _with_runs(rows, "id", _titled(rows, known, "id", given, order, index, lists, profile), best)
    last, of = F.col("n") - 1, lambda c, k: F.get(c, k)
    fix = F.struct(
        of("next_start", F.col("skip")).alias("start"), (of("next_start", last) + F.length(of("next_token", last))).alias("end"),
        F.col("text").alias("canonical"), F.col("run.confidence").alias("confidence"), F.col("run.strategy").alias("strategy"),
    )
    title = F.when(F.col("skip") == 1, F.concat("token", "gap")).otherwise("")
    said = F.zip_with(F.slice("next_token", 2, F.col("run.n")), F.concat(F.slice("next_gap", 2, F.col("run.n") - 1), F.array(F.lit(""))), lambda t, g: F.concat(t, g))
    said = F.when(F.col("skip") == 1, F.array_join(said, "")).otherwise(F.col("run.span"))
    changes = F.col("n").isNotNull() & (F.lower("text") != F.lower(said))
    rows = rows.select(
        "id", "at", "n", changes.alias("changes"), "lead", F.concat("token", "gap").alias("plain"), F.concat(title, "text", of("next_gap", last)).alias("made"), fix.alias("fix")
    )
    rows = settled(rows, "id", "changes").where("not gone")
    changed = F.col("taken") & F.coalesce("changes", F.lit(False))
    piece = F.struct("at", F.when(changed, F.col("made")).otherwise(F.col("plain")).alias("piece"))
    done = rows.groupBy("id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.first("lead").alias("lead"), F.sort_array(F.collect_list(F.when(changed, F.col("fix")))).alias("corrections"))
    made = F.concat("lead", F.array_join(F.col("pieces")["piece"], ""))
    given_ = docs.select(F.col(id_).alias("id"), F.col(text).alias("text"))
    out = given_.join(done.select("id", made.alias("made"), "corrections"), "id", "left")
    none = F.array().cast("array<struct<start:int,end:int,canonical:string,confidence:double,strategy:string>>")
    return out.select(F.col("id").alias(id_), F.coalesce("made", "text").alias("corrected"), F.coalesce("corrections", none).alias("corrections"))
