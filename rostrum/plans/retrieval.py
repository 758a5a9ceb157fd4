"""Full-text and vector top-k, rank fusion, passage de-duplication, enrichment, facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textfn as T
from ..functions.stem import STOP_WORDS, stem_sql
from ..operators.fulltext import fulltext_index, search
from ..operators.steps import written
from ..operators.vectorindex import nearest_vectors, vector_index
from ..registry import query, table

POOL = 100


def cosine(vector, target: list[float]):
    """Cosine similarity to a literal vector, as JVM expressions only; null vectors give null."""
    q = F.array(*(F.lit(float(x)) for x in target))
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    length = sum(x * x for x in map(float, target)) ** 0.5
    return dot / (norm * F.lit(length))


def vector_topk(vectors: DataFrame, id_: str, vector: str, target: list[float], k: int) -> DataFrame:
    """Exact top-k by cosine: a scan, an expression and a top-k, no shuffle of vectors."""
    scored = vectors.where(F.col(vector).isNotNull()).select(F.col(id_).alias("id"), cosine(F.col(vector), target).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def terms(text):
    return F.filter(F.split(F.lower(text), r"(?U)[^\w]+"), lambda t: t != "")


def _same(word: str):
    return lambda t: t == word


def fulltext_topk(passages: DataFrame, id_: str, text: str, words: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Passages with all ``words``, by BM25 (score, then id).

    The texts are read and split once: lengths and counts of the words are dealt out by id, and both the
    statistics (one row) and the scores read that exchange.
    """
    doc = passages.select(F.col(id_).alias("id"), terms(F.col(text)).alias("t"))
    doc = doc.select("id", F.size("t").alias("len"), *(F.size(F.filter("t", _same(w))).alias(f"tf{i}") for i, w in enumerate(words))).repartition("id")
    stats = doc.agg(F.count("id").alias("n"), F.avg("len").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))))
    score, all_ = F.lit(0.0), F.col("n") > 0  # with the statistics in it, the filter stays above the exchange that both sides share
    for i in range(len(words)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
        all_ = all_ & (F.col(f"tf{i}") * F.col("n") > 0)
    hits = doc.crossJoin(F.broadcast(stats)).where(all_)  # one row
    return hits.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


_WORDS_SQL = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda w: w <> '' AND w NOT IN ({stop}))"
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query(
    f"""
    WITH d AS (SELECT doc_id AS id, {_WORDS_SQL.format(stop=_STOP_SQL)} AS t FROM documents), a AS (SELECT item_id AS q, {_WORDS_SQL.format(stop=_STOP_SQL)} AS t FROM benchmark),
      st AS ({stem_sql("SELECT unnest(t) AS word FROM d UNION ALL SELECT unnest(t) FROM a")}), tot AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
      p AS (SELECT id, stem AS term, count(*) AS tf, any_value(len) AS len FROM (SELECT id, len(t) AS len, unnest(t) AS word FROM d) JOIN st USING (word) GROUP BY 1, 2),
      df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), w AS (SELECT DISTINCT q, stem AS term FROM (SELECT q, unnest(t) AS word FROM a) JOIN st USING (word)), s AS (
        SELECT q, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 9) AS score, count(*) AS held
        FROM w JOIN p USING (term) JOIN df USING (term), tot GROUP BY 1, 2)
    SELECT q, id, round(score, 6) AS score, rank FROM (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM s JOIN (SELECT q, count(*) AS wanted FROM w GROUP BY 1) USING (q) WHERE held = wanted) WHERE rank <= 100
    """
)
def r1_stemmed_search(spark, sf_dir):
    """Every benchmark item as a search of all documents, by stems, on the written index."""
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), "text")
    return search(asked, fulltext_index(docs, "doc_id", "text"), POOL).withColumn("score", F.round("score", 6))


def ranked(top: DataFrame) -> DataFrame:
    """id and 1-based rank of at most a pool of rows (one small task)."""
    return top.select("id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "id")).alias("rank"))


def fuse(arms: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion; ties go to the first arm's order, then the id."""
    both = None
    for i, arm in enumerate(arms):
        rows = ranked(arm).select("id", (1.0 / (k + F.col("rank"))).alias("part"), F.struct(F.lit(i).alias("arm"), "rank").alias("seen"))
        both = rows if both is None else both.unionByName(rows)
    return both.groupBy("id").agg(F.sum("part").alias("score"), F.min("seen").alias("seen"))


def drop_duplicate_passages(found: DataFrame, order: list) -> DataFrame:
    """First row of each passage key (column ``key``) in order; empty keys are all kept."""
    first = Window.partitionBy(F.when(F.col("key") == "", F.col("id").cast("string")), "key").orderBy(*order)
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


TARGET = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_TARGET_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in TARGET) + "]"


@query(f"SELECT vec_id AS id FROM embeddings WHERE embedding IS NOT NULL ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_TARGET_SQL}) DESC, vec_id LIMIT 100")
def r2_vector_topk(spark, sf_dir):
    return vector_topk(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", TARGET, POOL).select("id")


@query()
def r2_vector_index(spark, sf_dir):
    """The ten nearest rows of each row whose id is divisible by 50, among all rows, by the index."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_vectors(rows.where("vec_id % 50 = 0"), vector_index(rows, "vec_id", "embedding"), "vec_id", "embedding", 10).select("q", "id", "score", "rank")


FULLTEXT_SQL = """
    SELECT id, round(score, 9) AS score FROM (
      SELECT id, ln(1 + (n - df0 + 0.5) / (df0 + 0.5)) * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * len / mean))
             + ln(1 + (n - df1 + 0.5) / (df1 + 0.5)) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * len / mean)) AS score
      FROM (SELECT conv_id * 1000 + turn AS id, len(t) AS len, len(list_filter(t, lambda x: x = 'the')) AS tf0, len(list_filter(t, lambda x: x = 'of')) AS tf1
            FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}\\p{M}_]+'), lambda x: x <> '') AS t FROM conversations)),
           (SELECT count(*) AS n, avg(len(t)) AS mean, count(*) FILTER (WHERE list_contains(t, 'the')) AS df0, count(*) FILTER (WHERE list_contains(t, 'of')) AS df1
            FROM (SELECT list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}\\p{M}_]+'), lambda x: x <> '') AS t FROM conversations))
      WHERE tf0 > 0 AND tf1 > 0) ORDER BY score DESC, id LIMIT 100
"""


def _passages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))


@query(FULLTEXT_SQL)
def r1_fulltext_topk(spark, sf_dir):
    return fulltext_topk(_passages(spark, sf_dir), "id", "text", ["the", "of"], POOL).select("id", F.round("score", 9).alias("score"))


@query(
    """
    WITH a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY label DESC, vec_id) AS r FROM embeddings QUALIFY r <= 100),
         b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id % 41 DESC, vec_id) AS r FROM embeddings QUALIFY r <= 100)
    SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 12) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1
    """
)
def r3_rank_fusion(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    a = rows.select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(POOL)
    b = rows.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 41).cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(POOL)
    return fuse([a, b]).select("id", F.round("score", 12).alias("score"))


def hybrid(passages: DataFrame, vectors: DataFrame, words: list[str], target: list[float], limit: int = 10) -> DataFrame:
    """Both arms over passages (id, text) and vectors (id, embedding): pool, fuse, drop repeats, limit, enrich."""
    arms = [fulltext_topk(passages, "id", "text", words, POOL), vector_topk(vectors, "id", "embedding", target, POOL)]
    # at most two pools of ids, so they are broadcast and only their texts are normalised
    fused = passages.select("id", "text").join(F.broadcast(fuse(arms)), "id").withColumn("key", T.passage_key("text"))
    order = [F.desc("score"), "seen", "id"]
    return drop_duplicate_passages(fused, order).orderBy(*order).limit(min(50, limit)).select("id", "score", "text")


@query()
def r4_hybrid_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return hybrid(docs, vectors, ["the", "of"], TARGET)


@query(
    """
    SELECT id FROM (SELECT doc_id AS id, row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1
    """
)
def w8_passage_dedup(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars", F.sha2("text", 256).alias("key"))
    return drop_duplicate_passages(found, [F.desc("n_chars"), "id"]).select("id")


@query(
    """
    SELECT word, min(pos) AS first_pos FROM (SELECT event_type AS word, event_id AS pos FROM events WHERE event_type NOT IN ('view')) GROUP BY 1 ORDER BY first_pos LIMIT 3
    """
)
def w9_first_seen_suggestions(spark, sf_dir):
    seen = table(spark, sf_dir, "events").where("event_type <> 'view'").groupBy(F.col("event_type").alias("word")).agg(F.min("event_id").alias("first_pos"))
    return seen.orderBy("first_pos").limit(3)


@query(
    """
    SELECT record, id FROM (SELECT coalesce(CASE WHEN user_id % 4 > 0 THEN user_id END, 1000 + event_id % 9) AS record, event_id AS id,
    row_number() OVER (PARTITION BY coalesce(CASE WHEN user_id % 4 > 0 THEN user_id END, 1000 + event_id % 9) ORDER BY value DESC, event_id) AS rn, value FROM events) WHERE rn = 1 ORDER BY value DESC, id LIMIT 3
    """
)
def w10_related_records(spark, sf_dir):
    key = F.coalesce(F.when(F.col("user_id") % 4 > 0, F.col("user_id")), 1000 + F.col("event_id") % 9)
    best = table(spark, sf_dir, "events").groupBy(key.alias("record")).agg(F.max(F.struct("value", (-F.col("event_id")).alias("neg"))).alias("b"))
    return best.select("record", (-F.col("b.neg")).alias("id"), F.col("b.value").alias("value")).orderBy(F.desc("value"), "id").limit(3).select("record", "id")


@query(
    """
    SELECT conv_id, turn FROM conversations JOIN customer ON c_custkey = conv_id WHERE role = 'user' AND c_nationkey BETWEEN 3 AND 12 AND list_has_any([role, c_mktsegment], ['user', 'BUILDING'])
    """
)
def p2_retrieval_filters(spark, sf_dir):
    sittings = table(spark, sf_dir, "customer").where("c_nationkey between 3 and 12").select(F.col("c_custkey").alias("conv_id"), "c_mktsegment")
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").join(sittings, "conv_id")
    return rows.where(F.arrays_overlap(F.array("role", "c_mktsegment"), F.array(F.lit("user"), F.lit("BUILDING")))).select("conv_id", "turn")


@query(
    """
    SELECT c.event_id AS chunk, coalesce(string_agg(e.s_name, ',' ORDER BY e.lo, e.s_suppkey), '') AS names, count(e.s_suppkey) AS n FROM (SELECT event_id, user_id, (event_id % 50)::DOUBLE AS lo, event_id % 50 + 3.0 AS hi FROM events) c
    LEFT JOIN (SELECT s_suppkey, s_name, s_suppkey % 150 AS user_id, (s_suppkey % 50)::DOUBLE AS lo, s_suppkey % 50 + 2.0 AS hi FROM supplier) e ON e.user_id = c.user_id AND e.lo < c.hi AND e.hi > c.lo GROUP BY 1
    """
)
def j11_interval_overlap(spark, sf_dir):
    """Entities that overlap a chunk of their transcript: an equi-join on the transcript carries the range predicate."""
    e = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey"), "s_name", (F.col("s_suppkey") % 150).alias("user_id"), (F.col("s_suppkey") % 50).cast("double").alias("lo"), (F.col("s_suppkey") % 50 + 2).cast("double").alias("hi")
    ).alias("e")
    c = table(spark, sf_dir, "events").select(
        "event_id", "user_id", (F.col("event_id") % 50).cast("double").alias("lo"), (F.col("event_id") % 50 + 3).cast("double").alias("hi")
    ).alias("c")
    both = c.join(e, F.expr("e.user_id = c.user_id and e.lo < c.hi and e.hi > c.lo"), "left")
    names = F.sort_array(F.collect_list(F.when(F.col("s_suppkey").isNotNull(), F.struct("e.lo", "s_suppkey", "s_name"))))
    return both.groupBy(F.col("event_id").alias("chunk")).agg(
        F.array_join(F.transform(names, lambda x: x["s_name"]), ",").alias("names"), F.count("s_suppkey").alias("n")
    )


@query("SELECT conv_id * 1000 + turn AS id, c_name AS title, c_mktsegment AS session_type FROM conversations LEFT JOIN customer ON c_custkey = conv_id AND c_nationkey < 20")
def j12_enrich_metadata(spark, sf_dir):
    meta = table(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("conv_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("session_type"))
    return _passages(spark, sf_dir).join(meta, "conv_id", "left").select("id", "title", "session_type")


@query("SELECT id, rank FROM (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS rank FROM embeddings QUALIFY rank <= 100) WHERE 1.0 / (60 + rank) >= 0.01 ORDER BY rank LIMIT 10")
def p14_relevance_threshold(spark, sf_dir):
    arm = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (-F.col("vec_id")).cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(POOL)
    return ranked(arm).where(1.0 / (60 + F.col("rank")) >= 0.01).orderBy("rank").limit(10)


def resolved(cited, texts, key):
    """Citations with the texts that they name; others go.

    A few texts, or ids that no text has, may have most citations. So the cited texts are found by distinct ids
    and written: where they are few, as is then known, citations meet them without an exchange.
    """
    known = written(texts.join(cited.select(key).distinct(), key, "left_semi"))
    return cited.join(known, key)


@query(
    """
    SELECT o_orderkey AS answer, 1::BIGINT AS pos, o_orderkey % 50 AS doc_id, substr(text, 1, 150) || '...' AS excerpt FROM orders JOIN documents ON doc_id = o_orderkey % 50
    """
)
def j18_validate_citations(spark, sf_dir):
    answers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("answer"), F.expr("concat('See [', o_orderkey % 50, '] and [999999999].')").alias("t"))
    cited = answers.select("answer", F.posexplode(T.citation_ids("t")).alias("p", "doc_id")).select("answer", (F.col("p") + 1).cast("long").alias("pos"), "doc_id")
    texts = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.substring("text", 1, 150), F.lit("...")).alias("excerpt"))
    return resolved(cited, texts, "doc_id").select("answer", "pos", "doc_id", "excerpt")


@query(
    """
    SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 20 AND role IN ('user', 'assistant')
    """
)
def p21_conversation_history(spark, sf_dir):
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("rn", F.row_number().over(newest)).where("rn <= 20")
    return rows.where(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role")


@query("SELECT DISTINCT facet, name FROM (SELECT 'entity' AS facet, unnest([o_orderpriority, o_orderstatus]) AS name FROM orders UNION ALL SELECT 'speaker', role FROM conversations) ORDER BY facet, name LIMIT 300")
def o14_facets(spark, sf_dir):
    entities = table(spark, sf_dir, "orders").select(F.explode(F.array("o_orderpriority", "o_orderstatus")).alias("name")).distinct().orderBy("name").limit(200)
    speakers = table(spark, sf_dir, "conversations").select(F.col("role").alias("name")).distinct().orderBy("name").limit(100)
    return entities.select(F.lit("entity").alias("facet"), "name").unionByName(speakers.select(F.lit("speaker").alias("facet"), "name"))


@query("SELECT name FROM (SELECT DISTINCT n_name AS name FROM nation) ORDER BY name LIMIT 25")
def o15_corpus_hints(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).distinct().orderBy("name").limit(25)


@query(
    """
    SELECT count(*) AS n, count(CASE WHEN vec_id % 3 > 0 THEN 1 END) AS embedded, round(100.0 * count(CASE WHEN vec_id % 3 > 0 THEN 1 END) / count(*), 1)::DOUBLE AS percent,
    CASE WHEN count(CASE WHEN vec_id % 3 > 0 THEN 1 END) = count(*) THEN 'complete' ELSE 'partial' END AS status, count(*) FILTER (WHERE vec_id % 3 = 0) AS missing FROM embeddings
    """
)
def a8_a24_embedding_coverage(spark, sf_dir):
    have = F.when(F.col("vec_id") % 3 > 0, F.col("embedding"))
    found = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"), F.count(have).alias("embedded"), F.count_if(have.isNull()).alias("missing"))
    return found.select(
        "n", "embedded", F.round(100.0 * F.col("embedded") / F.col("n"), 1).alias("percent"),
        F.when(F.col("embedded") == F.col("n"), "complete").otherwise("partial").alias("status"), "missing",
    )


@query("SELECT conv_id AS transcript_id, count(*) AS missing FROM conversations WHERE (conv_id + turn) % 4 = 0 GROUP BY 1")
def a7_unembedded_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("embedding", F.when((F.col("conv_id") + F.col("turn")) % 4 > 0, F.lit(1)))
    return rows.where("embedding is null").groupBy(F.col("conv_id").alias("transcript_id")).agg(F.count("*").alias("missing"))


@query("SELECT conv_id * 1000 + turn AS id, '[' || turn || '] ' || coalesce(role, 'unknown') || ': ' || substr(text, 1, 40) AS passage FROM conversations")
def r28_passage_rendering(spark, sf_dir):
    line = F.concat(F.lit("["), F.col("turn"), F.lit("] "), F.coalesce("role", F.lit("unknown")), F.lit(": "), F.substring("text", 1, 40))
    return _passages(spark, sf_dir).select("id", line.alias("passage"))


@query("SELECT conv_id, CASE WHEN sum(f) = 0 THEN 'ok' WHEN sum(f) = count(*) THEN 'failed' ELSE 'partial' END AS status FROM (SELECT conv_id, CASE WHEN (conv_id + turn) % 3 = 0 THEN 1 ELSE 0 END AS f FROM conversations) GROUP BY 1")
def r36_chunk_status(spark, sf_dir):
    failed = ((F.col("conv_id") + F.col("turn")) % 3 == 0).cast("long")
    n = F.sum(failed)
    status = F.when(n == 0, "ok").when(n == F.count("*"), "failed").otherwise("partial")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(status.alias("status"))


@query(
    "SELECT o_orderkey AS id, coalesce(n_words, o_orderpriority) AS shown, n_words IS NULL AS degraded FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(l_returnflag, ' ' ORDER BY l_linenumber, l_returnflag) AS n_words FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) ON l_orderkey = o_orderkey"
)
def r32_degraded_fallback(spark, sf_dir):
    """What a service answered, where it did; else what was sent, marked as degraded."""
    words = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"])
    answered = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").groupBy("l_orderkey").agg(F.array_join(words, " ").alias("corrected"))
    rows = table(spark, sf_dir, "orders").join(answered, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select(F.col("o_orderkey").alias("id"), F.coalesce("corrected", "o_orderpriority").alias("shown"), F.col("corrected").isNull().alias("degraded"))


@query("SELECT priority, rn AS pos, item FROM (SELECT priority, item, row_number() OVER (ORDER BY priority, item) AS rn FROM (SELECT item, min(priority) AS priority FROM (SELECT 0 AS priority, o_orderpriority AS item FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 1, c_mktsegment FROM customer UNION ALL SELECT 2, n_name FROM nation) WHERE item <> '5-LOW' GROUP BY 1)) WHERE rn <= 12")
def r33_answer_assembly(spark, sf_dir):
    """Parsed items first, topped up from deterministic streams, without what history has, capped."""
    parsed = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.lit(0).alias("priority"), F.col("o_orderpriority").alias("item"))
    streams = table(spark, sf_dir, "customer").select(F.lit(1).alias("priority"), F.col("c_mktsegment").alias("item"))
    filler = table(spark, sf_dir, "nation").select(F.lit(2).alias("priority"), F.col("n_name").alias("item"))
    history = spark.createDataFrame([("5-LOW",)], "item string")
    every = parsed.unionByName(streams).unionByName(filler).groupBy("item").agg(F.min("priority").alias("priority"))
    top = every.join(F.broadcast(history), "item", "left_anti").orderBy("priority", "item").limit(12)
    at = Window.partitionBy(F.lit(1)).orderBy("priority", "item")  # twelve rows
    return top.select("priority", F.row_number().over(at).cast("long").alias("pos"), "item")
