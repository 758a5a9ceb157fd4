"""Matching strategies as joins of distinct spans with the index of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textfn as T
from .names import initials_key, keys_of
from .steps import written

#: What a match tells: the name, how sure it is, by which strategy, and what the name is.
MATCH = ("canonical", "confidence", "strategy", "kind", "type", "abbreviation")
#: Strategies in their order, and those that guess.
RANKS = {"exact": 0, "fused": 1, "initials": 2, "phonetic": 3, "fuzzy": 4, "substring": 5}
APPROXIMATE = ("phonetic", "fuzzy", "substring")


def _hit(found: DataFrame, confidence, strategy: str) -> DataFrame:
    return found.withColumns({"confidence": confidence, "strategy": F.lit(strategy)}).select("span_id", *MATCH)


def _by_key(spans: DataFrame, index: DataFrame, kind: str, key) -> DataFrame:
    """Spans (span_id, span) with the rows of the index under ``key`` of their text; an empty key finds nothing."""
    asked = spans.withColumn("key", key).where("key <> ''")
    return asked.join(keys_of(index, kind).hint("merge"), "key")  # several indexes at once are too much to broadcast


def exact(spans: DataFrame, index: DataFrame) -> DataFrame:
    return _hit(_by_key(spans, index, "text", F.lower("span")), F.lit(1.0), "exact")


def fused(spans: DataFrame, index: DataFrame) -> DataFrame:
    return _hit(_by_key(spans, index, "fused", T.fuse("span")), F.lit(0.98), "fused")


def initials(spans: DataFrame, index: DataFrame) -> DataFrame:
    """Initials before a surname: one gives 0.95, more give 0.93."""
    found = _by_key(spans, index, "initials", initials_key("span"))
    return _hit(found, F.when(F.size(F.split("key", r"\.")) > 2, 0.93).otherwise(0.95), "initials")


def phonetic(spans: DataFrame, index: DataFrame, evidence: bool = True, least_key: int = 4, least_similarity: float = 0.6) -> DataFrame:
    """Equal phonetic keys, scored by similarity to the name, key length and fan-out (how many names share the key).

    The surest wins, of equals the first loaded. Without ``evidence`` the first loaded wins with a flat 0.90.
    """
    found = _by_key(spans, index, "phonetic", T.phonetic_key(F.lower("span")))
    if evidence:
        found = found.where(F.length("key") >= least_key).withColumn("sim", T.similarity(F.lower("span"), F.lower("canonical"))).where(F.col("sim") >= least_similarity)
        found = found.withColumn("confidence", phonetic_score(F.col("sim"), F.length("key"), F.col("fanout")))
    else:
        found = found.withColumn("confidence", F.lit(0.90))
    surest = F.struct(-F.round("confidence", 6), "load", "place", "canonical")
    best = found.groupBy("span_id").agg(F.min_by(F.struct("canonical", "confidence", "kind", "type", "abbreviation"), surest).alias("b"))
    return best.select("span_id", "b.*", F.lit("phonetic").alias("strategy")).select("span_id", *MATCH)


def phonetic_score(similarity, key_length, fanout):
    raw = 0.55 + 0.27 * similarity + 0.10 * F.least(key_length, F.lit(12)) / 12 - 0.30 * F.least(fanout - 1, F.lit(10)) / 10
    return T.clamp(F.when(fanout >= 5, F.least(raw, F.lit(0.749))).otherwise(raw), 0.55, 0.92)


def most_distance(length):
    """Allowed edit distance by the span's length, without bounds on the relative distance."""
    return F.when(length <= 4, 1).when(length <= 7, 2).when(length <= 11, 3).otherwise(4)


def distance_ceiling(length):
    """Allowed edit distance by the span's length, where the relative distance is bounded too."""
    return F.when(length <= 3, 0).when(length <= 6, 1).when(length <= 11, 2).otherwise(3)


def fuzzy_score(relative):
    """Evidence of a bounded match: it falls with the distance relative to the span's length."""
    return T.clamp(0.92 - F.greatest(F.lit(0.0), relative), 0.55, 0.92)


def legacy_fuzzy_score(distance):
    return F.greatest(F.lit(0.70), 1 - 0.12 * distance)


#: Where a key of ``len`` characters is cut into ``cuts`` pieces.
_SIZE = "len div cuts + if({p} >= cuts - len % cuts, 1, 0)"
_BEGIN = "{p} * (len div cuts) + greatest(0, {p} - (cuts - len % cuts))"

#: Keys so short are met in what deletions leave, longer ones by their pieces.
SHORT = 10
#: A piece that so many keys share is hot: what holds it is met by deletions instead.
HOT = 64


def _spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all tasks: each of its rows becomes many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _without(c, most: int, exactly: bool = False):
    """Distinct texts that are left of one without any ``most`` of its characters, or (not ``exactly``) as many at most."""
    one = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    made = F.array(c)
    for _ in range(most):
        less = lambda t: F.when(F.length(t) > 0, one(t) if exactly else F.concat(F.array(t), one(t))).otherwise(F.array(t))
        made = F.array_distinct(F.flatten(F.transform(made, less)))
    return made


def _left(c, lost):
    """Hashes of what ``lost`` deletions (a column, 0 to 4) leave of a text, by its partner's length."""
    cases = F.when(lost == 0, F.array(c))
    for k in range(1, 5):
        cases = cases.when(lost == k, _without(c, k, True))
    return F.transform(cases, lambda t: F.xxhash64(F.col("n"), F.col("len"), F.col("most"), t))


def _sharing_rest(asked: DataFrame, held: DataFrame, columns: list[str]) -> DataFrame:
    """Texts (low, n, most, len) and keys (n, most, len) that are equal after deletions, as many as ``most`` edits and both lengths allow.

    Within ``most`` edits the longer of both loses ``most`` characters and the other so many fewer as it is shorter.
    """
    more = F.col("n") - F.col("len")
    a = _spread(asked).select("low", "most", F.explode(_left(F.col("low"), F.col("most") + F.least(more, F.lit(0)))).alias("h"))
    b = _spread(held).select(*columns, F.explode(_left(F.col("key"), F.col("most") - F.greatest(more, F.lit(0)))).alias("h"))
    return a.join(b.hint("merge"), "h").select("low", "most", *columns)


def _places(most: int) -> list[tuple[int, int, int, int, int, int]]:
    """(most, more, i, j, si, sj): where the first two untouched ones of a key's most + 2 pieces may stand in a text that is ``more`` longer.

    Every piece before the j-th but the i-th has an edit, and pieces move by as many places as edits stand before them at most.
    """
    found = set()
    for i in range(most + 1):
        for j in range(i + 1, most + 2):
            for si in range(-most, most + 1) if i else [0]:
                for step in range(-most, most + 1) if j > i + 1 else [0]:
                    left = most - max(abs(si), i) - max(abs(step), j - i - 1)
                    found |= {(most, si + step + d, i, j, si, si + step) for d in range(-left, left + 1)}
    return sorted(x for x in found if abs(x[1]) <= most)


def _sharing_two_pieces(asked: DataFrame, held: DataFrame, columns: list[str]) -> DataFrame:
    """Texts (low, n, most, len) and keys (most, len) that share two pieces of the key at places that ``most`` edits allow.

    A key cut into most + 2 pieces has two that ``most`` edits leave untouched. One piece of a name is common
    where names are many; two are not.
    """
    spark = asked.sparkSession
    places = spark.createDataFrame([p for d in range(1, 5) for p in _places(d)], "most int, more int, i int, j int, si int, sj int")
    cut = {f"{name}_{p}": F.expr(e.format(p=p)) for p in "ij" for name, e in (("size", _SIZE), ("begin", _BEGIN))}
    hashed = lambda c, si, sj: F.expr(f"xxhash64(most, len, i, j, substring({c}, begin_i + {si} + 1, size_i), substring({c}, begin_j + {sj} + 1, size_j))")
    a = _spread(asked).withColumn("more", F.col("n") - F.col("len")).join(F.broadcast(places), ["most", "more"]).withColumn("cuts", F.col("most") + 2).withColumns(cut)
    a = a.where("begin_i + si >= 0 and begin_i + si + size_i <= begin_j + sj and begin_j + sj + size_j <= n").select("low", "most", hashed("low", "si", "sj").alias("h"))
    pairs = places.select("most", "i", "j").distinct()
    b = _spread(held).join(F.broadcast(pairs), "most").withColumn("cuts", F.col("most") + 2).withColumns(cut).select(*columns, hashed("key", 0, 0).alias("h"))
    return a.join(b.hint("merge"), "h").select("low", "most", *columns)


def _sharing_piece(asked: DataFrame, held: DataFrame, columns: list[str]) -> DataFrame:
    """Texts (low, n, most, len) and keys (most, len) that share a piece of most + 1 at a place that ``most`` edits allow.

    Names may share most of their pieces (numbered ones do), so hot pieces are left out, and texts that hold one
    meet the keys that hold one in what is left of them after as many deletions.
    """
    cut = {"cuts": F.col("most") + 1, "piece": F.explode(F.expr("sequence(0, most)"))}
    of = {"size": F.expr(_SIZE.format(p="piece")), "begin": F.expr(_BEGIN.format(p="piece"))}
    a = _spread(asked).withColumns(cut).withColumns(of).withColumn("shift", F.explode(F.expr("sequence(greatest(-piece, n - len - (most - piece)), least(piece, n - len + most - piece))")))
    a = a.where("begin + shift >= 0 and begin + shift + size <= n").select("low", "most", F.expr("xxhash64(most, len, piece, substring(low, begin + shift + 1, size))").alias("h"))
    b = _spread(held).withColumns(cut).withColumns(of).select(*columns, "most", F.expr("xxhash64(most, len, piece, substring(key, begin + 1, size))").alias("h"))
    hot = written(b.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("h"))
    if hot.isEmpty():
        return a.join(b.drop("most").hint("merge"), "h").select("low", "most", *columns)
    met = a.join(b.join(hot, "h", "left_anti").drop("most").hint("merge"), "h").select("low", "most", *columns)
    less = lambda c: F.explode(F.transform(F.when(F.col("most") == 1, _without(c, 1)).otherwise(_without(c, 2)), lambda t: F.xxhash64(t)))
    a = _spread(a.join(hot, "h", "left_semi").select("low", "most").distinct()).select("low", "most", less(F.col("low")).alias("h"))
    b = _spread(b.join(hot, "h", "left_semi").select(*columns, "most").distinct()).select(*columns, "most", less(F.col("key")).alias("h"))
    return met.unionByName(a.join(b.hint("merge"), ["most", "h"]).select("low", "most", *columns))


def _met(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Texts (low, most: 1 to 4) with keys, all of those within ``most`` edits among them; pairs may repeat.

    Texts and keys meet by equi-joins, and only for lengths that both have. Short keys are met in what deletions
    leave. Longer ones share a piece that one or two edits leave untouched, or two pieces that more do.
    """
    asked = texts.withColumn("n", F.length("low")).withColumn("len", F.explode(F.expr("sequence(n - most, n + most)")))
    lengths = keys.select(F.length("key").alias("len")).distinct()
    asked = asked.join(F.broadcast(lengths), "len", "left_semi")
    wanted = asked.select("n", "most", "len").distinct()
    held = keys.withColumn("len", F.length("key"))
    by_length = held.join(F.broadcast(wanted.select("most", "len").distinct()), "len")
    short, few = F.col("len") <= SHORT, F.col("most") <= 2
    met = _sharing_rest(asked.where(short), held.where(short).join(F.broadcast(wanted), "len"), keys.columns)
    met = met.unionByName(_sharing_piece(asked.where(~short & few), by_length.where(~short & few), keys.columns))
    return met.unionByName(_sharing_two_pieces(asked.where(~short & ~few), by_length.where(~short & ~few), keys.columns))


def near_keys(spans: DataFrame, keys: DataFrame, bounded: bool = False, limit=None) -> DataFrame:
    """(span_id, span, key, canonical, load, d): every key within the edit distance that its span's length allows, but 0.

    Distinct spans are matched once. All pairs are the result; for the nearest key alone see ``nearest``.
    """
    limit = limit or (distance_ceiling if bounded else most_distance)  # 4 at most
    low = written(spans.select(F.lower("span").alias("low")).distinct()).where(F.length("low") >= 4)
    hit = _met(low.withColumn("most", limit(F.length("low"))).where("most > 0"), keys.select("key", "canonical", "load"))
    hit = hit.withColumn("d", F.levenshtein("low", "key", 4)).where("d > 0 and d <= most")
    if bounded:
        hit = hit.where(F.col("d") / F.length("low") <= 0.25)
    hit = hit.select("low", "key", "canonical", "load", "d").distinct()
    return spans.select("span_id", "span", F.lower("span").alias("low")).join(hit, "low").drop("low")


def nearest(spans: DataFrame, keys: DataFrame, limit, deepest: int = 4) -> DataFrame:
    """(span_id, low, b) of the nearest key of each span of four characters or more within ``limit`` of its length.

    ``b`` has d, load, key, canonical and what else of a key of the index ``keys`` has; of keys at the same
    distance the first loaded wins; (load, place, key) name a row. Distances are tried in rising order, each only
    for texts that found nothing before; pairs are aggregated as they meet, with no more of a key than decides,
    and the rest of the nearest ones is looked up.
    """
    texts = written(spans.select(F.lower("span").alias("low")).distinct()).where("length(low) >= 4")
    texts = texts.withColumn("most", limit(F.length("low"))).where("most > 0")
    order = [c for c in ("load", "place", "key") if c in keys.columns]
    rest = [c for c in ("canonical", "kind", "type", "abbreviation") if c in keys.columns]
    held = keys.select(*order)
    found = None
    for d in range(1, deepest + 1):
        open_ = texts.where(F.col("most") >= d)
        if found is not None:
            open_ = open_.join(found.select("low"), "low", "left_anti")
        met = _met(open_.select("low", F.lit(d).alias("most")), held).withColumn("d", F.levenshtein("low", "key", d)).where(F.col("d") > 0)
        at = written(met.groupBy("low").agg(F.min(F.struct("d", *order)).alias("b")))
        found = at if found is None else found.unionByName(at)
    found = found.select("low", "b.*").join(keys.select(*order, *rest).hint("merge"), order)
    return spans.select("span_id", F.lower("span").alias("low")).join(found.select("low", F.struct("d", *order, *rest).alias("b")), "low")


def fuzzy(spans: DataFrame, index: DataFrame, bounded: bool = False, limit=None) -> DataFrame:
    """The nearest text by edit distance (not 0), ties to the first loaded.

    ``bounded`` allows fewer edits, a quarter of the span's length at most, and scores by that share.
    """
    best = nearest(spans, keys_of(index, "text"), limit or (distance_ceiling if bounded else most_distance), 3 if bounded else 4)
    relative = F.col("b.d") / F.length("low")
    if bounded:
        best = best.where(relative <= 0.25)
    score = fuzzy_score(relative) if bounded else legacy_fuzzy_score(F.col("b.d"))
    return best.select("span_id", "b.canonical", score.alias("confidence"), F.lit("fuzzy").alias("strategy"), "b.kind", "b.type", "b.abbreviation")


def substring(spans: DataFrame, index: DataFrame, least: int = 6) -> DataFrame:
    """Names of which a text contains the span's, of at least ``least`` characters; the first loaded wins.

    Spans meet texts by their first ``least`` characters, which must stand somewhere in the text. Parts outnumber
    texts, so they are never broadcast and carry no more than decides; the winners are looked up.
    """
    grams = F.transform(F.sequence(F.lit(1), F.length("key") - least + 1), lambda i: F.substring("key", i, F.lit(least)))
    k = keys_of(index, "text").where(F.length("key") >= least).withColumn("gram", F.explode(F.array_distinct(grams)))
    s = spans.select("span_id", F.lower("span").alias("low")).where(F.length("low") >= least).withColumn("gram", F.substring("low", 1, least))
    k = k.select("key", "load", "place", "gram")
    hit = s.join(k.hint("merge"), "gram").where(F.col("key").contains(F.col("low")) & (F.col("key") != F.col("low")))
    best = hit.groupBy("span_id").agg(F.min(F.struct("load", "place", "key")).alias("b")).select("span_id", "b.key")
    return _hit(best.join(keys_of(index, "text").drop("load", "place").hint("merge"), "key"), F.lit(0.80), "substring")


def component(spans: DataFrame, index: DataFrame, lexicon: DataFrame | None = None, least: int = 6) -> DataFrame:
    """Single words of at least ``least`` characters that are a whole word of the texts of one name; no ordinary word (``lexicon``: token)."""
    one = spans.where(~F.col("span").rlike(T.U + r"\s") & (F.length("span") >= least))
    if lexicon is not None:
        one = one.join(lexicon.select(F.lower("token").alias("token")).distinct(), T.edge_stripped("span") == F.col("token"), "left_anti")
    return _hit(_by_key(one, index, "component", F.lower("span")), F.lit(0.80), "substring")


def chain(
    spans: DataFrame, index: DataFrame, blocked: DataFrame | None = None, evidence: bool = True, lexicon: DataFrame | None = None, least: int = 4
) -> DataFrame:
    """First hit by strategy order for each span (span_id, span); the first hit ends the chain, whatever its confidence.

    Spans under ``least`` characters only match exactly or fused; ``blocked`` ones (token) are not guessed.
    With ``evidence`` approximate hits are scored and bounded by evidence, and a word of one name's texts
    stands for it unless it is ordinary (``lexicon``); without, scores are flat and a name whose text contains
    the span does. The equi-joins of the first strategies see all spans; the dearer ones what those left over.
    """
    spans = written(spans.select("span_id", "span"))
    long = spans.where(F.length("span") >= least)
    loose = long
    if blocked is not None:
        loose = long.join(blocked.select(F.lower("token").alias("token")).distinct(), F.lower("span") == F.col("token"), "left_anti")
    order = F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv))

    def first(found: DataFrame) -> DataFrame:
        pick = F.min_by(F.struct(*MATCH), order[F.col("strategy")])
        return found.groupBy("span_id").agg(pick.alias("b")).select("span_id", "b.*")

    cheap = exact(spans, index).unionByName(fused(spans, index)).unionByName(initials(long, index)).unionByName(phonetic(loose, index, evidence))
    cheap = written(first(cheap))
    rest = loose.join(cheap, "span_id", "left_anti")
    dear = fuzzy(rest, index, evidence).unionByName(component(rest, index, lexicon) if evidence else substring(rest, index))
    return cheap.unionByName(first(dear))


def _rare_first(rows: DataFrame, keys: list[str], grams: DataFrame) -> DataFrame:
    """``rows`` (keys, t) with t ordered by how many names hold a trigram, rarest first."""
    each = rows.select(*keys, F.explode("t").alias("gram")).join(grams, "gram", "left")
    held = F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")))  # the trigrams of one name
    return each.groupBy(*keys).agg(held["gram"].alias("t"))


def trigram_search(queries: DataFrame, names: DataFrame, least: float = 0.3, most: int = 50) -> DataFrame:
    """Names by trigram similarity to each query (queries: q; names: id, canonical, text), at most ``most`` each.

    Similarity is shared over united distinct trigrams; the best text of a record counts. Repeated rows count
    once, nulls and texts without letters match nothing. Trigrams are ordered by how many names hold them:
    two texts above ``least`` share one of each side's rarest, so the commonest ones of a text meet nobody.
    A pair is met where its first shared trigram is, if the lengths and what stands behind allow the limit.
    """
    q = queries.select("q").distinct().select("q", T.trigrams("q").alias("t")).where("size(t) > 0")
    n = names.select("id", "canonical", "text").distinct().withColumn("t", T.trigrams("text")).where("size(t) > 0")
    grams = n.select(F.explode("t").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    tolerant = least - 1e-9  # so that rounding loses no pair; what is met is checked exactly
    front = lambda t: F.slice(t, 1, F.size(t) - F.greatest(F.floor(F.size(t) * tolerant), F.lit(0)).cast("int"))
    q = _rare_first(q, ["q"], grams).select("q", F.col("t").alias("tq"), F.posexplode(front(F.col("t"))).alias("iq", "gram"))
    n = _rare_first(n, ["id", "canonical", "text"], grams).select("id", "canonical", F.col("t").alias("tn"), F.posexplode(front(F.col("t"))).alias("in", "gram"))
    nq, nt = F.size("tq"), F.size("tn")
    behind = F.least(nq - F.col("iq"), nt - F.col("in"))  # the most that can be shared if nothing before is
    met = q.join(n, "gram").where(behind > tolerant * (nq + nt - behind))
    met = met.where(~F.arrays_overlap(F.slice("tq", F.lit(1), F.col("iq")), F.slice("tn", F.lit(1), F.col("in"))))
    shared = met.select("q", "id", "canonical", (nq + nt).alias("both"), F.size(F.array_intersect("tq", "tn")).alias("k"))
    scored = shared.withColumn("similarity", F.col("k") / (F.col("both") - F.col("k"))).where(F.col("similarity") > least)
    best = scored.groupBy("q", "id", "canonical").agg(F.max("similarity").alias("similarity"))
    at = Window.partitionBy("q").orderBy(F.desc("similarity"), "canonical", "id")
    return best.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= most)
