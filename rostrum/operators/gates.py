"""Gates that keep approximate matches out: confidence, lexicon, block list, context and sitting scope, in that order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textfn as T
from .dictionary import exact, fused, initials
from .spans import ahead

#: Gates in their order of evaluation.
GATES = (
    "asr_confidence", "lexicon", "block_list", "phonetic_key", "phonetic_similarity", "key_fanout", "absolute_distance", "relative_distance",
    "candidate_bound", "component_ambiguity", "context", "sitting_scope", "llm_veto",
)


def in_lexicon(spans: DataFrame, lexicon: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``spans`` (span_id, span) with in_lexicon: every token, bare of punctuation, is an ordinary word (token) and the span is no alias (alias)."""
    tokens = spans.select("span_id", F.explode(F.split(F.lower(F.trim("span")), T.U + r"\s+")).alias("token"))
    words = lexicon.select(F.lower("token").alias("token"), F.lit(True).alias("known")).distinct()
    tokens = tokens.withColumn("token", T.edge_stripped("token"))
    all_known = tokens.join(words, "token", "left").groupBy("span_id").agg(F.every(F.coalesce("known", F.lit(False))).alias("all_known"))
    out = spans.join(all_known, "span_id", "left")
    known = F.coalesce("all_known", F.lit(False))
    if aliases is not None:
        names = aliases.select(F.lower("alias").alias("alias"), F.lit(True).alias("is_alias")).distinct()
        out = out.join(names, F.lower("span") == F.col("alias"), "left")
        known = known & F.col("is_alias").isNull()
    return out.select(*spans.columns, known.alias("in_lexicon"))


def decided(
    candidates: DataFrame, accept: float, high: float = 0.90, ordinary: float = 0.60, unknown_blocks: bool = True, penalty: float = 0.10
) -> DataFrame:
    """Candidates with gate (the first that rejects them, or null), their final confidence, and accepted.

    ``candidates`` has approximate, span_confidence (null: unknown), in_lexicon, blocked, person, signal,
    in_scope (null: no scope) and confidence. Only approximate matches meet gates. Spans heard with
    ``high`` confidence stay as they are; ordinary words heard with ``ordinary`` confidence (or unknown, by
    the provider's policy) too. A person needs a signal. One outside the sitting loses ``penalty``, and
    is rejected where that takes it below ``accept``.
    """
    loose, heard = F.col("approximate"), F.col("span_confidence")
    outside = loose & F.col("person") & ~F.coalesce("in_scope", F.lit(True))
    final = F.when(outside, F.greatest(F.lit(0.0), F.col("confidence") - penalty)).otherwise(F.col("confidence"))
    gate = (
        F.when(loose & F.coalesce(heard >= high, F.lit(False)), "asr_confidence")
        .when(loose & F.col("in_lexicon") & F.coalesce(heard >= ordinary, F.lit(unknown_blocks)), "lexicon")
        .when(loose & F.col("blocked"), "block_list")
        .when(loose & F.col("person") & ~F.col("signal"), "context")
        .when(outside & (F.col("confidence") >= accept) & (final < accept), "sitting_scope")
    )
    return candidates.withColumns({"gate": gate, "final_confidence": final, "accepted": gate.isNull() & (final >= accept)})


def tally(rejections: DataFrame) -> DataFrame:
    """(gate, n): spans by the earliest gate that rejected them (span, gate)."""
    rank = F.create_map(*(F.lit(x) for k, g in enumerate(GATES) for x in (g, k)))
    first = rejections.where(F.col("gate").isin(*GATES)).groupBy("span").agg(F.min_by("gate", rank[F.col("gate")]).alias("gate"))
    return first.groupBy("gate").agg(F.count("*").alias("n"))


def context_signals(
    words: DataFrame, key: str, order: list[str], spans: DataFrame, titles: tuple[str, ...], seats: DataFrame, reach: int = 40, widest: int = 4
) -> DataFrame:
    """``spans`` (key, at, n; at counts words from 1, at most ``widest`` of them) with signal.

    A span has a signal if the last word before it that is no bare punctuation is a title, if its first word
    is capital, or if its context holds the words "member for" or, outside the span, a constituency of one
    or two words (exact, fused or by initials; ``seats`` is their index of names). The context is the turn of its speaker, if its words have
    one speaker, else ``reach`` words to either side. ``words`` has word, speaker and capital.
    """
    per = Window.partitionBy(key).orderBy(*order)
    bare = F.lower(F.regexp_replace("word", T.U + r"^[^\w]+|[^\w]+$", ""))
    rows = ahead(words.withColumn("bare", bare), key, order, ["bare"], 2)
    pairs = rows.select(key, "at", F.explode(F.sequence(F.lit(1), F.size("next_bare"))).alias("k"), "next_bare").select(key, "at", "k", F.array_join(F.slice("next_bare", 1, F.col("k")), " ").alias("span"))
    texts = pairs.select("span").distinct().withColumn("span_id", F.col("span"))
    known = exact(texts, seats).unionByName(fused(texts, seats)).unionByName(initials(texts, seats)).select(F.col("span_id").alias("span")).distinct()
    places = pairs.join(known, "span").groupBy(key, "at").agg(F.max((F.col("k") == 1).cast("int")).alias("one"), F.max((F.col("k") == 2).cast("int")).alias("two"))
    rows = rows.join(places, [key, "at"], "left").fillna(0, ["one", "two"])
    by_place = Window.partitionBy(key).orderBy("at")
    upto = by_place.rowsBetween(Window.unboundedPreceding, -1)
    changed = (~F.col("speaker").eqNullSafe(F.lag("speaker").over(by_place))).cast("int")
    rows = rows.withColumn("turn", F.sum(changed).over(by_place))
    for_next = (F.col("bare") == "member") & (F.lead("bare").over(by_place) == "for")
    same_turn = F.lead("turn").over(by_place) == F.col("turn")
    rows = rows.withColumns({
        "title_before": F.coalesce(F.last(F.when(F.col("bare") != "", F.col("bare")), True).over(upto).isin(*titles), F.lit(False)),
        "member": F.coalesce(for_next, F.lit(False)).cast("int"), "member_in_turn": F.coalesce(for_next & same_turn, F.lit(False)).cast("int"),
        "two_in_turn": F.coalesce(F.col("two") * same_turn.cast("int"), F.lit(0)),
    })
    whole_turn = Window.partitionBy(key, "turn")
    rows = rows.withColumns({
        "last_of_turn": F.max("at").over(whole_turn), "turn_member": F.sum("member_in_turn").over(whole_turn),
        "turn_places": F.sum(F.col("one") + F.col("two_in_turn")).over(whole_turn),
    })

    def total(column: str, lo: int, hi: int):
        return F.coalesce(F.sum(column).over(by_place.rowsBetween(lo, hi)), F.lit(0))

    by_size = {}
    for n in range(1, widest + 1):
        inside, inside_turn = total("one", 0, n - 1) + total("two", -1, n - 1), total("one", 0, n - 1) + total("two_in_turn", -1, n - 1)
        near = (total("member", -reach, n - 2 + reach) > 0) | (total("one", -reach, n - 1 + reach) + total("two", -reach, n - 2 + reach) > inside)
        turn = (F.col("turn_member") > 0) | (F.col("turn_places") > inside_turn)
        one_speaker = F.col("speaker").isNotNull() & (F.col("at") + n - 1 <= F.col("last_of_turn"))
        by_size[n] = F.when(one_speaker, turn).otherwise(near)
    rows = rows.withColumns({f"near_{n}": c for n, c in by_size.items()})
    found = spans.join(rows.select(key, "at", "title_before", "capital", *(f"near_{n}" for n in by_size)), [key, "at"])
    near = F.coalesce(*(F.when(F.col("n") == n, F.col(f"near_{n}")) for n in by_size), F.lit(False))
    return found.select(*spans.columns, (F.col("title_before") | F.coalesce("capital", F.lit(False)) | near).alias("signal"))
