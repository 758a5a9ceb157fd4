"""Queries made of several operators: tools, drivers, reconciliation and answer assembly."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textfn as T
from ..functions.periods import period_of
from ..operators.walks import balanced_batches
from ..operators.spans import ahead
from ..registry import query, table
from .analytics import latest
from .sequences import ASR, low_segments, words


@query("SELECT event_id AS id, event_type || ' x' AS transcript, 2::BIGINT AS n_words FROM events")
def s10_asr_result(spark, sf_dir):
    from ..sources.readers import ASR_SCHEMA

    parsed = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.from_json(F.expr(ASR), ASR_SCHEMA).alias("r"))
    best = F.get(F.get(F.col("r.results.channels"), F.lit(0))["alternatives"], F.lit(0))
    return parsed.select("id", best["transcript"].alias("transcript"), F.size(best["words"]).cast("long").alias("n_words"))


@query("SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 50 AS batch, event_id AS id FROM events")
def s15_t5_history_batches(spark, sf_dir):
    at = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("user_id", F.floor((F.row_number().over(at) - 1) / 50).alias("batch"), F.col("event_id").alias("id"))


@query("SELECT item_id, i - 1 AS pos, w[i] AS word, round(0.3 * (i - 1), 3)::DOUBLE AS start, 0.95::DOUBLE AS confidence FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark))")
def s21_fixture_words(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("p", "word"))
    return rows.select("item_id", F.col("p").cast("long").alias("pos"), "word", F.round(0.3 * F.col("p"), 3).alias("start"), F.lit(0.95).alias("confidence"))


@query(
    """
    SELECT id, max(similarity) AS similarity FROM (SELECT n_nationkey::BIGINT AS id, 1 - levenshtein(n_name, 'NATION_11')::DOUBLE / greatest(length(n_name), 9) AS similarity FROM nation
    UNION ALL SELECT n_nationkey, 1 - levenshtein('Alias ' || n_nationkey, 'NATION_11')::DOUBLE / greatest(length('Alias ' || n_nationkey), 9) FROM nation) WHERE similarity > 0.3 GROUP BY 1 ORDER BY similarity DESC, id LIMIT 50
    """
)
def u1_a6_j7_best_per_record(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_name")
    texts = n.select("id", F.col("n_name").alias("text")).unionByName(n.select("id", F.concat(F.lit("Alias "), "id").alias("text")))
    scored = texts.select("id", T.similarity(F.col("text"), F.lit("NATION_11")).alias("similarity")).where("similarity > 0.3")
    return scored.groupBy("id").agg(F.max("similarity").alias("similarity")).orderBy(F.desc("similarity"), "id").limit(50)


@query("SELECT doc_id AS id, len(list_distinct(string_split(source || ',' || lang || ',' || source, ',')))::BIGINT AS n FROM documents")
def u5_distinct_array(spark, sf_dir):
    given = F.array_distinct(F.array("source", "lang", "source"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.size(given).cast("long").alias("n"))


def _all_upper(rows):
    return rows.select(F.col("item_id").alias("id"), F.forall(F.split("text", " "), lambda w: F.upper(w) == w).alias("all_upper"))


@query("SELECT item_id AS id, upper(text) = text AS all_upper FROM benchmark")
def w6_all_uppercase_span(spark, sf_dir):
    return _all_upper(table(spark, sf_dir, "benchmark"))


@query(
    """
    SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events WHERE user_id = (SELECT min(user_id) FROM events WHERE ('User ' || user_id) ILIKE '%user 1%'))
    WHERE n <= 24 OR list_contains(list_transform(range(0, 24), lambda i: round_even(i * (n - 1) / 23, 0)::BIGINT), pos)
    """
)
def r26_record_summary(spark, sf_dir):
    """A title resolves to its first record; up to 24 of its chunks, evenly spaced, stand for it."""
    rows = table(spark, sf_dir, "events")
    titled = F.concat(F.lit("User "), F.col("user_id").cast("string"))
    record = rows.where(titled.ilike("%user 1%")).agg(F.min("user_id").alias("user_id"))
    per = Window.partitionBy("user_id")
    own = rows.join(F.broadcast(record), "user_id").select("user_id", "event_id", (F.row_number().over(per.orderBy("ts", "event_id")) - 1).cast("double").alias("pos"), F.count("*").over(per).alias("n"))
    places = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.bround(i * (F.col("n") - 1) / 23, 0).cast("double"))
    return own.where((F.col("n") <= 24) | F.array_contains(places, F.col("pos"))).select("user_id", "event_id")


def recent_sql(now):
    return f"""
    WITH e AS (SELECT 'order' AS scope, o_orderkey AS id, o_orderdate AS t FROM orders UNION ALL SELECT 'event', event_id, ts FROM events),
    f AS (SELECT e.*, upto, t >= upto - INTERVAL 7 DAY AND t < upto AS recent FROM e, (SELECT {now} AS upto)), c AS (SELECT count(*) FILTER (WHERE recent) AS n FROM f)
    SELECT scope, id, scope_total, period FROM (SELECT scope, id, count(*) OVER (PARTITION BY scope) AS scope_total, row_number() OVER (PARTITION BY scope ORDER BY t DESC, id DESC) AS rn,
      CASE WHEN n > 0 THEN 'the last 7 days' ELSE 'the whole registry' END AS period FROM f, c WHERE recent OR n = 0 AND t < upto + INTERVAL 1 DAY) WHERE rn <= 25
    """


def _recent_activity(spark, sf_dir, now):
    """``now`` is a table of one row (now). Both periods are asked in one plan; which one counts is a row of it, too."""
    asked = now.select(period_of(F.lit("recent"), F.col("now")).alias("recent"), period_of(F.lit("all"), F.col("now")).alias("all"))
    within = lambda p: (F.col("at") >= F.col(p)["start"]) & (F.col("at") < F.col(p)["end"])
    scopes = {"order": ("orders", "o_orderkey", "o_orderdate"), "event": ("events", "event_id", "ts")}
    rows = {scope: table(spark, sf_dir, name).select(F.col(id_).alias("id"), F.col(at).cast("timestamp").alias("at")).crossJoin(F.broadcast(asked)) for scope, (name, id_, at) in scopes.items()}
    seen = reduce(DataFrame.unionByName, (df.where(within("recent")).agg(F.count("*").alias("n")) for df in rows.values())).agg((F.sum("n") > 0).alias("any"))
    tops = []
    for scope, df in rows.items():
        found = df.crossJoin(F.broadcast(seen)).where(F.when(F.col("any"), within("recent")).otherwise(within("all")))
        total = found.agg(F.count("*").alias("scope_total"))  # one row, before the limit
        top = found.orderBy(F.desc("at"), F.desc("id")).limit(25).crossJoin(F.broadcast(total))
        label = F.when(F.col("any"), F.col("recent.label")).otherwise(F.col("all.label"))
        tops.append(top.select(F.lit(scope).alias("scope"), "id", "scope_total", label.alias("period")))
    return reduce(DataFrame.unionByName, tops)


@query(recent_sql("(SELECT max(ts) FROM events)"))
def r27_recent_activity_tool(spark, sf_dir):
    """The newest rows of each scope with its total, within the week before the last event."""
    return _recent_activity(spark, sf_dir, table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp").alias("now")))


@query(recent_sql("TIMESTAMP '2030-01-01'"))
def r27_recent_activity_fallback(spark, sf_dir):
    """A recent period without rows falls back to all, and says so."""
    return _recent_activity(spark, sf_dir, spark.range(1).select(F.lit("2030-01-01").cast("timestamp").alias("now")))


@query()
def r29_hybrid_correction(spark, sf_dir):
    """Classify, group, bundle, batch, pick each batch's winner, reassemble around what no batch covers."""
    w = words(spark, sf_dir)
    s = low_segments(w)
    batches = balanced_batches(s.select("user_id", F.col("seg").alias("pos"), (F.col("stop") - F.col("start")).cast("double").alias("duration")), "user_id", most=4)
    placed = s.join(batches.withColumnRenamed("pos", "seg"), ["user_id", "seg"])
    span = placed.groupBy("user_id", "batch").agg(F.min("start").alias("lo"), F.max("stop").alias("hi"))
    races = span.select("user_id", "batch", "lo", "hi", F.explode(F.array(F.lit("first text"), F.lit("second longer text"))).alias("text"))
    best = races.groupBy("user_id", "batch", "lo", "hi").agg(F.max_by("text", F.struct(T.candidate_score(F.col("text")).alias("s"), "text")).alias("word"))
    kept = w.join(span.select("user_id", "lo", "hi"), (w.user_id == span.user_id) & (w.start >= span.lo) & (w.start < span.hi), "left_anti")
    kept = kept.select("user_id", "start", F.col("speaker").alias("word"), F.lit(False).alias("corrected"))
    return kept.unionByName(best.select("user_id", F.col("lo").alias("start"), "word", F.lit(True).alias("corrected")))


@query("SELECT 'mixed' AS label, count(DISTINCT lower(o_orderpriority)) AS n FROM orders WHERE lower(o_orderpriority) <> '1-urgent'")
def r34_search_recommendations(spark, sf_dir):
    """Parsed lines and top-ups without the typed query; the label says where they came from."""
    typed = "1-URGENT"
    parsed = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.lower("o_orderpriority").alias("key"), F.lit(1).alias("model"), F.lit(0).alias("plain"))
    filler = table(spark, sf_dir, "orders").select(F.lower("o_orderpriority").alias("key"), F.lit(0).alias("model"), F.lit(1).alias("plain"))
    every = parsed.unionByName(filler).where(F.col("key") != typed.lower()).groupBy("key").agg(F.max("model").alias("model"), F.max("plain").alias("plain"))
    label = F.when((F.max("model") == 1) & (F.max("plain") == 1), "mixed").when(F.max("model") == 1, "model").otherwise("deterministic")
    return every.agg(label.alias("label"), F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, 'Agreed.' AS answer, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 50)::VARCHAR ELSE '' END AS cited FROM orders")
def r35_grounded_answer(spark, sf_dir):
    """Recommendations are split off, valid citations kept when grounded, and markers stripped."""
    raw = F.concat(F.lit("Agreed ["), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 50).otherwise(F.lit(999999)), F.lit("].\nRECOMMENDATIONS:\n- x"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.regexp_extract(raw, r"(?s)^(.*?)\s*(?:\n\s*RECOMMENDATIONS:.*)?$", 1).alias("a"))
    known = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cite")).distinct()
    cites = rows.select("id", F.explode(T.citation_ids("a")).alias("cite")).join(known, "cite").groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("cite")), ",").alias("cited"))
    return rows.join(cites, "id", "left").select("id", T.strip_citations("a").alias("answer"), F.coalesce("cited", F.lit("")).alias("cited"))


@query("SELECT i AS ordinal, CASE WHEN i <= 5 THEN 'Hint ' || i ELSE 'Topic ' || (i - 5) END AS suggestion FROM range(1, 13) r(i)")
def r37_hints_and_filler(spark, sf_dir):
    """Hints come first; filler is a sequence, as long as it has to be."""
    wanted = 12
    hints = spark.range(1, 6).select(F.lit(0).alias("stream"), "id", F.concat(F.lit("Hint "), "id").alias("suggestion"))
    filler = spark.range(1, wanted + 1).select(F.lit(1).alias("stream"), "id", F.concat(F.lit("Topic "), "id").alias("suggestion"))
    top = hints.unionByName(filler).orderBy("stream", "id").limit(wanted)
    at = Window.partitionBy(F.lit(1)).orderBy("stream", "id")  # twelve rows
    return top.select(F.row_number().over(at).cast("long").alias("ordinal"), "suggestion")


@query()
def j15_source_runs(spark, sf_dir):
    """Where each correction's original stands in its transcript's words, successive ones further on."""
    from ..operators.alignment import source_run

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "event_id"])
        spoken, at, out = rows["speaker"].tolist(), 0, []
        for original in rows["speaker"].tolist()[::9]:
            run = source_run(original, spoken, at)
            if run:
                out.append((rows["user_id"].iloc[0], original, *run))
                at = run[1]
        return pd.DataFrame(out, columns=["user_id", "original", "first", "end"])

    w = words(spark, sf_dir).select("user_id", "ts", "event_id", "speaker")
    return w.groupBy("user_id").applyInPandas(walk, "user_id long, original string, first int, end int")


@query("SELECT event_id AS id, gate, coalesce(v, false) AS active FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'deepgram' ELSE 'khaya' END AS provider FROM events) e, (VALUES ('context'), ('lexicon')) g(gate) LEFT JOIN (VALUES ('deepgram', 'context', true), ('deepgram', 'lexicon', true), ('khaya', 'lexicon', true)) p(provider2, gate2, v) ON provider2 = e.provider AND gate2 = g.gate")
def e25_provider_profiles(spark, sf_dir):
    profiles = spark.createDataFrame([("deepgram", "context", True), ("deepgram", "lexicon", True), ("khaya", "lexicon", True)], "provider string, gate string, active boolean")
    asked = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "deepgram").otherwise("khaya").alias("provider"), F.explode(F.array(F.lit("context"), F.lit("lexicon"))).alias("gate")
    )
    return asked.join(F.broadcast(profiles), ["provider", "gate"], "left").select("id", "gate", F.coalesce("active", F.lit(False)).alias("active"))


@query(
    """
    SELECT id, CASE WHEN same = n THEN lowest END AS confidence, same = n AS aligned FROM
    (SELECT s.event_id AS id, s.n, count(*) FILTER (WHERE w.word = s.w[w.rn - s.rn + 1]) AS same, min(w.c) AS lowest FROM
     (SELECT event_id, user_id, rn, CASE WHEN last % 3 = 0 THEN ['other', b] WHEN b IS NULL THEN [a] ELSE [a, b] END AS w, CASE WHEN last % 3 = 0 OR b IS NOT NULL THEN 2 ELSE 1 END AS n FROM
      (SELECT event_id, user_id, event_type AS a, lead(event_type) OVER u AS b, row_number() OVER u AS rn, floor(value)::BIGINT AS last FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id))) s
     LEFT JOIN (SELECT user_id, event_type AS word, value / 100 AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) w ON w.user_id = s.user_id AND w.rn BETWEEN s.rn AND s.rn + s.n - 1 GROUP BY 1, 2)
    """
)
def e24_span_alignment(spark, sf_dir):
    """Spans of two tokens against the words at their place; the lowest confidence where all agree, else unknown."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("word"), (F.col("value") / 100).alias("c"), F.floor("value").alias("f"))
    rows = ahead(e, "user_id", ["ts", "event_id"], ["word", "c"], 2)
    first = F.when(F.col("f") % 3 == 0, F.lit("other")).otherwise(F.get("next_word", F.lit(0)))
    said = F.concat(F.array(first), F.when((F.col("f") % 3 == 0) & (F.size("next_word") < 2), F.array(F.lit(None).cast("string"))).otherwise(F.slice("next_word", 2, 1)))
    same = said == F.col("next_word")
    aligned = F.coalesce(same, F.lit(False))
    return rows.select(F.col("event_id").alias("id"), F.when(aligned, F.array_min("next_c")).alias("confidence"), aligned.alias("aligned"))


def _nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.lower("n_name").alias("key"), F.col("n_nationkey").cast("long").alias("id"))


@query("SELECT lower(n_name) AS q, n_nationkey::BIGINT AS id FROM nation UNION ALL SELECT lower(r_name), n_nationkey::BIGINT FROM region JOIN nation ON lower(r_name) = lower(n_name)")
def e29_fallback_lookup(spark, sf_dir):
    """Every nation and every region is asked for; what is no nation finds nothing."""
    names = _nations(spark, sf_dir)
    asked = names.select(F.col("key").alias("q")).unionByName(table(spark, sf_dir, "region").select(F.lower("r_name").alias("q")))
    return asked.join(names, F.col("q") == F.col("key")).select("q", "id")


@query("SELECT event_id AS id, attempt, CASE WHEN attempt <= 3 THEN pow(2.0, attempt - 1) END AS wait_s, attempt <= 3 AS again FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt FROM events)")
def t2_retry_backoff(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).cast("long")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), nth.alias("attempt"))
    return rows.select("id", "attempt", F.when(F.col("attempt") <= 3, F.pow(F.lit(2.0), F.col("attempt") - 1)).alias("wait_s"), (F.col("attempt") <= 3).alias("again"))


@query(
    """
    SELECT id, missing FROM (SELECT c_custkey AS id, 0::BIGINT AS missing FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT conv_id, count(*) FROM conversations WHERE role = 'assistant' GROUP BY 1) ORDER BY missing = 0 DESC, missing DESC, id LIMIT 50
    """
)
def t3_reconcile(spark, sf_dir):
    return _lacking(spark, sf_dir, "role = 'assistant'").orderBy((F.col("missing") == 0).desc(), F.desc("missing"), "id").limit(50)


@query("SELECT c_custkey AS id, 0::BIGINT AS missing FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT conv_id, count(*) FROM conversations WHERE role = 'assistant' GROUP BY 1")
def t3_reconcile_whole(spark, sf_dir):
    """Every parent without children and every one whose answers are missing, without a limit."""
    return _lacking(spark, sf_dir, "role = 'assistant'")


def _lacking(spark, sf_dir, missing):
    have = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    never = table(spark, sf_dir, "customer").join(have, "c_custkey", "left_anti").select(F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("missing"))
    partial = table(spark, sf_dir, "conversations").where(missing).groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("missing"))
    return never.unionByName(partial)


@query("SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-15' - INTERVAL 15 MINUTE AND ts < TIMESTAMP '2024-01-15'")
def t8_expiry_sweep(spark, sf_dir):
    now = F.lit("2024-01-15").cast("timestamp")
    return table(spark, sf_dir, "events").where((F.col("ts") >= now - F.expr("INTERVAL 15 MINUTES")) & (F.col("ts") < now)).select(F.col("event_id").alias("id"))


@query("SELECT doc_id AS id, CASE WHEN length(text) > 0 THEN least(length(text), 64) END::BIGINT AS dims FROM documents")
def t13_batched_embedding(spark, sf_dir):
    """A model called by batch inside tasks; an item that fails on its own is null. The model here counts letters."""

    def embed(text: str) -> list[float]:
        if not text:
            raise ValueError("empty")
        return [float(text.count(chr(97 + i % 26))) for i in range(min(len(text), 64))]

    def run(frames):
        for f in frames:
            made = []
            for t in f["text"]:
                try:
                    made.append(len(embed(t)))
                except ValueError:
                    made.append(None)
            yield pd.DataFrame({"id": f["id"], "dims": pd.array(made, dtype="Int64")})

    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").mapInPandas(run, "id long, dims long")


@query("SELECT record_id, version, status FROM (SELECT o_custkey AS record_id, o_orderkey AS version, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1 AND status = 'F'")
def j3_published_latest(spark, sf_dir):
    rows = latest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").where("o_orderstatus = 'F'")
    return rows.select(F.col("o_custkey").alias("record_id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"))
