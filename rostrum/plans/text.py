"""Scalar text, date and JSON functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import textfn as T
from ..functions.periods import period_of
from ..registry import query, table
from .matching import phonetic_sql


@query("SELECT s_suppkey AS id, lower(regexp_replace(s_name, '[\\s\\-'']', '', 'g')) AS fused FROM supplier")
def f1_fuse(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), T.fuse("s_name").alias("fused"))


@query(f"SELECT p_partkey AS id, {phonetic_sql('p_name')} AS key FROM part")
def f2_phonetic_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.phonetic_key("p_name").alias("key"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, levenshtein(a.p_name, b.p_name)::BIGINT AS d, CASE WHEN greatest(length(a.p_name), length(b.p_name)) = 0 THEN 1.0::DOUBLE ELSE 1 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)) END AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def f3_edit_similarity(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    a, b = parts.alias("a"), parts.alias("b")
    return a.join(b, F.col("b.p_partkey") == F.col("a.p_partkey") + 1).select(
        F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"), F.levenshtein("a.p_name", "b.p_name").cast("long").alias("d"),
        T.similarity(F.col("a.p_name"), F.col("b.p_name")).alias("similarity"),
    )


@query("SELECT event_id AS id, greatest(0.25, least(0.75, value)) AS clamped FROM events")
def f5_clamp(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), T.clamp(F.col("value"), 0.25, 0.75).alias("clamped"))


@query("SELECT id, string_agg(lower(regexp_replace(w, '^[^\\p{L}\\p{N}\\p{M}_]+|[^\\p{L}\\p{N}\\p{M}_]+$', '', 'g')), ' ' ORDER BY i) AS tokens FROM (SELECT doc_id AS id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents) GROUP BY 1")
def f6_token_normalise(spark, sf_dir):
    """Every token of every text, in place."""
    tokens = F.transform(F.split("text", " ", -1), T.edge_stripped)
    return table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.array_join(tokens, " ").alias("tokens"))


def _keys(docs):
    return docs.select(F.col("doc_id").alias("id"), F.md5(T.align_key("text")).alias("align_md5"), F.md5(T.passage_key("text")).alias("passage_md5"))


@query("SELECT doc_id AS id, md5(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\p{M}_'']+', '', 'g')) AS align_md5, md5(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\p{M}_]+', ' ', 'g'))) AS passage_md5 FROM documents")
def f7_f8_keys(spark, sf_dir):
    return _keys(table(spark, sf_dir, "documents"))


def _questions(items):
    return items.select(F.col("item_id").alias("id"), T.question_key("text").alias("question"), T.blank_to_null("text").alias("clean"))


@query("SELECT item_id AS id, lower(regexp_replace(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')), '[?.! ]+$', '')) AS question, nullif(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')), '') AS clean FROM benchmark")
def f9_f10_questions(spark, sf_dir):
    return _questions(table(spark, sf_dir, "benchmark"))


@query("SELECT item_id AS id, len(regexp_extract_all(text, '[A-Za-zÀ-ÿ''\\-]+'))::BIGINT AS n_tokens, regexp_extract_all(text, '[A-Za-zÀ-ÿ''\\-]+')[1] AS first_token FROM benchmark")
def f11_tokenizer(spark, sf_dir):
    tokens = F.regexp_extract_all("text", F.lit(r"[A-Za-zÀ-ÿ'\-]+"), F.lit(0))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.size(tokens).cast("long").alias("n_tokens"), F.get(tokens, F.lit(0)).alias("first_token"))


@query("SELECT p_partkey AS id, upper(substr(string_split(p_name, ' ')[1], 1, 1) || coalesce(substr(string_split(p_name, ' ')[2], 1, 1), '')) AS initials FROM part")
def f12_initials(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.initials(F.col("p_name")).alias("initials"))


@query(
    """
    SELECT o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate < TIMESTAMP '1996-03-01'
    """
)
def f13_period_month(spark, sf_dir):
    """The period's bounds are literals, so they fold and the filter reaches the scan."""
    asked, dates = period_of(F.lit("1996-02"), F.lit("2001-08-01").cast("timestamp")), F.col("o_orderdate")
    return table(spark, sf_dir, "orders").where((dates >= asked["start"]) & (dates < asked["end"])).select(F.col("o_orderkey").alias("id"))


@query(
    """
    SELECT id, CASE k WHEN 0 THEN now - INTERVAL 7 DAY WHEN 1 THEN TIMESTAMP '1970-01-01' WHEN 2 THEN date_trunc('day', now) WHEN 4 THEN m - INTERVAL 1 MONTH WHEN 5 THEN now - to_days(n::INT) WHEN 7 THEN date_trunc('day', now) - to_days(9)
         WHEN 10 THEN now - INTERVAL 7 DAY WHEN 11 THEN NULL WHEN 8 THEN m - INTERVAL 12 MONTH ELSE m END::TIMESTAMP AS lo,
       CASE k WHEN 1 THEN now + INTERVAL 1 DAY WHEN 4 THEN m WHEN 7 THEN date_trunc('day', now) - to_days(2) WHEN 8 THEN m - INTERVAL 11 MONTH WHEN 11 THEN NULL ELSE now END::TIMESTAMP AS hi,
       CASE WHEN k IN (0, 10) THEN 'the last 7 days' WHEN k = 1 THEN 'the whole registry' WHEN k = 2 THEN 'today' WHEN k = 5 THEN 'the last ' || n || ' days' WHEN k = 4 THEN monthname(m - INTERVAL 1 MONTH) || ' ' || year(m - INTERVAL 1 MONTH)
         WHEN k = 7 THEN strftime(now - to_days(9), '%Y-%m-%d') || ' to ' || strftime(now - to_days(3), '%Y-%m-%d') WHEN k = 8 THEN monthname(m) || ' ' || (year(m) - 1) WHEN k = 11 THEN NULL ELSE monthname(m) || ' ' || year(m) END AS label FROM
    (SELECT o_orderkey AS id, o_orderkey % 12 AS k, o_orderkey % 90 AS n, o_orderdate + INTERVAL 12 HOUR AS now, date_trunc('month', o_orderdate) AS m FROM orders)
    """
)
def f13_periods(spark, sf_dir):
    """Every form of a period, asked as of noon of each order's day."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderdate") + F.expr("interval 12 hours")).cast("timestamp").alias("now"))
    k, now, day = F.col("id") % 12, F.col("now"), lambda n: F.date_format(F.date_sub("now", n), "yyyy-MM-dd")
    forms = (
        F.lit(None).cast("string"), F.lit(" All Time"), F.lit("today"), F.lit("This month"), F.lit("last month"), F.format_string("last %d days", F.col("id") % 90), F.date_format("now", "yyyy-MM"),
        F.concat(day(9), F.lit(".."), day(3)), F.concat(F.date_format("now", "MMMM "), (F.year("now") - 1).cast("string")), F.concat(F.date_format("now", "MMM"), F.lit(".")), F.lit("RECENT "), F.lit("someday"),
    )
    asked = F.coalesce(*(F.when(k == i, form) for i, form in enumerate(forms)))
    found = o.select("id", period_of(asked, now).alias("p"))
    return found.select("id", F.col("p.start").cast("timestamp_ntz").alias("lo"), F.col("p.end").cast("timestamp_ntz").alias("hi"), "p.label")


@query("SELECT o_orderkey AS id, CAST(date_trunc('month', o_orderdate) AS DATE)::VARCHAR AS lo, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE)::VARCHAR AS hi FROM orders")
def f14_month_bounds(spark, sf_dir):
    lo = F.trunc(F.col("o_orderdate").cast("date"), "month")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), lo.cast("string").alias("lo"), F.add_months(lo, 1).cast("string").alias("hi"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE)::VARCHAR ELSE CAST(o_orderdate AS DATE)::VARCHAR || ' to ' || CAST(o_orderdate + INTERVAL 2 DAY AS DATE)::VARCHAR END AS held_on FROM orders")
def f15_held_on(spark, sf_dir):
    lo = F.col("o_orderdate").cast("date")
    hi = F.when(F.col("o_orderkey") % 3 == 0, lo).otherwise(F.date_add(lo, 2))
    label = F.when(lo == hi, lo.cast("string")).otherwise(F.concat(lo.cast("string"), F.lit(" to "), hi.cast("string")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), label.alias("held_on"))


@query("SELECT p_partkey AS id, printf('%02d:%02d:%02d', floor(p_retailprice * 10)::BIGINT // 3600, floor(p_retailprice * 10)::BIGINT % 3600 // 60, floor(p_retailprice * 10)::BIGINT % 60) AS hms FROM part")
def f16_duration(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.hms(F.col("p_retailprice") * 10).alias("hms"))


ANSWER = "concat('Agreed [', o_orderkey % 5, '] and [2] , see [', o_orderkey % 5, '] .')"


@query(
    f"""
    SELECT id, array_to_string(list_distinct_ordered, ',') AS cited, trim(regexp_replace(regexp_replace(regexp_replace(t, '\\s*\\[\\d+\\]', '', 'g'), '\\s+([.,;:!?])', '\\1', 'g'), ' {{2,}}', ' ', 'g')) AS plain FROM
    (SELECT o_orderkey AS id, {ANSWER} AS t, CASE WHEN o_orderkey % 5 = 2 THEN ['2'] ELSE [(o_orderkey % 5)::VARCHAR, '2'] END AS list_distinct_ordered FROM orders)
    """
)
def f17_f18_citations(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(ANSWER).alias("t"))
    return rows.select("id", F.array_join(T.citation_ids("t"), ",").alias("cited"), T.strip_citations("t").alias("plain"))


@query("SELECT o_orderkey AS id, 1 + i AS ordinal, CASE i WHEN 0 THEN 'Topic ' || (o_orderkey % 9) ELSE 'Plain line' END AS item, CASE i WHEN 0 THEN 'because ' || o_orderstatus ELSE 'Suggested' END AS reason FROM orders, (VALUES (0), (1)) v(i)")
def f19_recommendation_lines(spark, sf_dir):
    block = F.concat(F.lit("- Topic "), (F.col("o_orderkey") % 9).cast("string"), F.lit(" | because "), F.col("o_orderstatus"), F.lit("\n* Plain line\n\nno bullet"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.posexplode(F.split(block, "\n")).alias("pos", "line"))
    parts = F.split(F.regexp_extract("line", r"^\s*[-*]\s+(.+)$", 1), r"\s*\|\s*")
    return rows.where(F.col("line").rlike(r"^\s*[-*]\s+\S")).select(
        "id", (F.col("pos") + 1).alias("ordinal"), parts[0].alias("item"), F.coalesce(F.get(parts, F.lit(1)), F.lit("Suggested")).alias("reason")
    )


@query("SELECT p_partkey AS id, p_name || ' and ' || p_brand AS plain FROM part")
def f20_strip_emphasis(spark, sf_dir):
    marked = F.concat(F.lit("**"), F.col("p_name"), F.lit("** and *"), F.col("p_brand"), F.lit("*"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.strip_emphasis(marked).alias("plain"))


@query("SELECT p_partkey AS id, p_name || '.' AS answer, '- ' || p_brand AS recommended FROM part")
def f21_split_answer(spark, sf_dir):
    whole = F.concat(F.col("p_name"), F.lit(".\nRECOMMENDATIONS:\n- "), F.col("p_brand"))
    pattern = r"(?s)^(.*?)\s*(?:\n\s*RECOMMENDATIONS:\s*(.*))?$"
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.regexp_extract(whole, pattern, 1).alias("answer"), F.regexp_extract(whole, pattern, 2).alias("recommended")
    )


@query("SELECT event_id AS id, coalesce(CASE WHEN event_id % 4 = 0 THEN 'S' || event_type END, CASE WHEN event_id % 4 = 1 THEN 'R' || user_id END, CASE WHEN event_id % 4 = 2 THEN event_type END, 'Transcript ' || event_id) AS label FROM events")
def f22_record_label(spark, sf_dir):
    k = F.col("event_id") % 4
    label = F.coalesce(
        T.blank_to_null(F.when(k == 0, F.concat(F.lit("S"), "event_type")).otherwise("  ")), T.blank_to_null(F.when(k == 1, F.concat(F.lit("R"), F.col("user_id")))),
        T.blank_to_null(F.when(k == 2, F.col("event_type"))), F.concat(F.lit("Transcript "), F.col("event_id")),
    )
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), label.alias("label"))


@query("SELECT conv_id, turn, kind, CASE kind WHEN 'speaker' THEN 'What did ' || role || ' say?' ELSE 'More on conversation ' || conv_id END AS suggestion FROM conversations, (VALUES ('speaker'), ('record')) k(kind)")
def f23_f24_suggestions(spark, sf_dir):
    made = F.array(
        F.struct(F.lit("speaker").alias("kind"), F.concat(F.lit("What did "), "role", F.lit(" say?")).alias("suggestion")),
        F.struct(F.lit("record").alias("kind"), F.concat(F.lit("More on conversation "), F.col("conv_id")).alias("suggestion")),
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.inline(made))


IP = "concat(user_id % 256, '.', event_id % 256, '.7.', user_id % 99)"


@query(f"SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN '2001:db8:' || (user_id % 10) || '::' WHEN event_id % 3 = 1 THEN (user_id % 256) || '.' || (event_id % 256) || '.7.0' END AS prefix FROM events")
def f25_truncate_ip(spark, sf_dir):
    six = F.concat(F.lit("2001:db8:"), (F.col("user_id") % 10).cast("string"), F.lit(":1::5"))
    ip = F.when(F.col("event_id") % 3 == 0, six).when(F.col("event_id") % 3 == 1, F.expr(IP)).otherwise("unknown")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), T.truncated_ip(ip).alias("prefix"))


@query("SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Edge' WHEN 2 THEN 'Unknown' ELSE 'Other' END AS family FROM events")
def f26_agent_family(spark, sf_dir):
    ua = F.element_at(F.array(F.lit("x Chrome/1 Safari/2"), F.lit("Chrome/1 Edg/3"), F.lit(""), F.lit("robot")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), T.agent_family(ua).alias("family"))


@query("SELECT event_id AS id, substr(sha256(event_id || ':' || event_type || ':denied'), 1, 32) AS event_hash FROM events")
def f27_event_hash(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), T.event_id(F.col("event_id").cast("string"), "event_type", F.lit("denied")).alias("event_hash"))


@query("SELECT event_id AS id, substr(sha256('[{\"key\":\"type\",\"value\":\"' || event_type || '\"},{\"key\":\"user\",\"value\":\"' || user_id || '\"}]'), 1, 16) AS hash FROM events")
def f28_params_hash(spark, sf_dir):
    params = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"), F.lit("gone"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), T.params_hash(params).alias("hash"))


@query("SELECT p_partkey AS id, regexp_matches(trim(p_name || suffix), '^[\\w\\s''.\\-&()/]+$') AS ok FROM part, (VALUES (''), ('<b>')) s(suffix) WHERE suffix = CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '<b>' END")
def f29_valid_term(spark, sf_dir):
    term = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "").otherwise("<b>"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.valid_term(term).alias("ok"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'dark' ELSE 'light' END AS theme, 'weekly' AS digest FROM customer")
def f30_merge_preferences(spark, sf_dir):
    stored = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("theme"), F.lit("dark"), F.lit("evil"), F.lit("x"))).otherwise(F.create_map(F.lit("z"), F.lit("y")))
    allowed = F.map_filter(stored, lambda k, v: k.isin("theme", "digest") & v.isNotNull())
    defaults = {"theme": "light", "digest": "weekly"}
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), *(F.coalesce(allowed[k], F.lit(v)).alias(k) for k, v in defaults.items()))


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 = 0 THEN 'admin' WHEN c_nationkey % 3 = 1 THEN 'editor' ELSE 'viewer' END AS role FROM customer")
def f31_role_precedence(spark, sf_dir):
    groups = F.when(F.col("c_nationkey") % 3 == 0, F.array(F.lit("editor"), F.lit("admin"))).when(F.col("c_nationkey") % 3 == 1, F.array(F.lit("x"), F.lit("editor"))).otherwise(F.array(F.lit("x")))
    role = F.when(F.array_contains(groups, "admin"), "admin").when(F.array_contains(groups, "editor"), "editor").otherwise("viewer")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), role.alias("role"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 12 < 3 THEN 0.0::DOUBLE ELSE least(4000.0, 250 * pow(2.0, s_suppkey % 12 - 3)) END AS delay_ms FROM supplier")
def f32_progressive_delay(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), T.progressive_delay(F.col("s_suppkey") % 12).alias("delay_ms"))


@query("SELECT doc_id AS id, CASE WHEN len(w) = 0 THEN 0 ELSE 0.5 * len(list_filter(w, lambda x: regexp_matches(x, '\\p{L}')))::DOUBLE / len(w) + 0.5 * least(len(w), 20) / 20 END::DOUBLE AS score FROM (SELECT doc_id, list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents)")
def f34_candidate_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.candidate_score(F.coalesce("text", F.lit(""))).alias("score"))


@query("SELECT conv_id, arg_max(role, (sc, role)) AS winner, max(sc) AS score FROM (SELECT conv_id, role, length(text)::BIGINT % 100 AS sc FROM conversations) WHERE sc > 0 GROUP BY 1")
def f35_select_winner(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", (F.length("text") % 100).cast("long").alias("sc")).where("sc > 0")
    return rows.groupBy("conv_id").agg(F.max_by("role", F.struct("sc", "role")).alias("winner"), F.max("sc").alias("score"))


def _flat(items):
    kept = F.filter(F.transform(F.split("text", " "), lambda x: F.trim(x)), lambda x: x != "")
    return items.select(F.col("item_id").alias("id"), F.array_join(kept, " ").alias("flat"))


@query("SELECT item_id AS id, list_aggregate(list_filter(list_transform(string_split(text, ' '), lambda x: trim(x)), lambda x: x <> ''), 'string_agg', ' ') AS flat FROM benchmark")
def f37_flatten_segments(spark, sf_dir):
    return _flat(table(spark, sf_dir, "benchmark"))


@query("SELECT p_partkey AS id, CASE WHEN length(p_name) <= length(p_brand) + 1 THEN p_brand ELSE p_name END AS display FROM part")
def f39_party_display(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.length("p_name") <= F.length("p_brand") + 1, F.col("p_brand")).otherwise(F.col("p_name")).alias("display"))


@query("SELECT item_id AS id, CASE WHEN regexp_matches(text, '^[A-Z]') THEN 'Replaced' ELSE 'replaced' END || regexp_extract(text, '([.?!]?)$', 1) AS word FROM benchmark")
def f40_replaced_word(spark, sf_dir):
    first = F.when(F.col("text").rlike("^[A-Z]"), "Replaced").otherwise("replaced")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.concat(first, F.regexp_extract("text", r"([.?!]?)\z", 1)).alias("word"))


@query(
    """
    SELECT item_id, min(pos)::INT AS pos, arg_min(gram, pos) AS gram FROM
    (SELECT item_id, unnest(g) AS gram, unnest(range(0, len(g))) AS pos FROM
     (SELECT item_id, list_filter(list_concat(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])),
        lambda x: length(x) >= 4 AND NOT regexp_matches(x, '\\d') AND NOT list_contains(['this', 'that', 'with', 'from'], lower(x))) AS g FROM
      (SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '[\\s\\p{Z}]+'), lambda x: regexp_replace(x, '^[^\\p{L}\\p{N}\\p{M}_]+|[^\\p{L}\\p{N}\\p{M}_]+$', '', 'g')), lambda x: x <> '') AS w FROM benchmark)))
    GROUP BY item_id, lower(gram)
    """
)
def f41_candidate_ngrams(spark, sf_dir):
    """One to three word candidates of at least four characters, without digits or stop words, first seen first."""
    words = F.filter(F.transform(F.split("text", T.U + r"\s+"), lambda w: F.regexp_replace(w, T.U + r"^[^\w]+|[^\w]+$", "")), lambda w: w != "")
    rows = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w"))
    n = F.size("w")

    def run_of(k: int):
        return lambda i: F.array_join(F.slice("w", i, k), " ")

    grams = F.concat(
        *(F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), run_of(k))).otherwise(F.array().cast("array<string>")) for k in (1, 2, 3))
    )
    kept = F.filter(grams, lambda g: (F.length(g) >= 4) & ~g.rlike(r"\d") & ~F.lower(g).isin("this", "that", "with", "from"))
    seen = rows.select("item_id", F.posexplode(kept).alias("pos", "gram"))
    first = seen.groupBy("item_id", F.lower("gram").alias("key")).agg(F.min(F.struct("pos", "gram")).alias("f"))
    return first.select("item_id", F.col("f.pos").alias("pos"), F.col("f.gram").alias("gram"))


@query("SELECT doc_id AS id, ceil((length(text) + length(source)) / 4.0)::BIGINT AS n_tokens FROM documents")
def f42_prompt_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.prompt_tokens("text", "source").cast("long").alias("n_tokens"))


@query("SELECT p_partkey AS id, p_name AS original, p_brand AS corrected, p_partkey % 2 = 0 AS vetoed FROM part")
def f43_veto_lines(spark, sf_dir):
    raw = F.concat(F.when(F.col("p_partkey") % 2 == 0, "VETO: ").otherwise("KEEP: "), "p_name", F.lit(" -> "), "p_brand")
    pattern = r"^(VETO|KEEP):\s*(.+?)\s*->\s*(.+?)\s*$"
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.regexp_extract(raw, pattern, 2).alias("original"), F.regexp_extract(raw, pattern, 3).alias("corrected"),
        (F.regexp_extract(raw, pattern, 1) == "VETO").alias("vetoed"),
    )


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'processing' END AS state, CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'O' THEN 0 ELSE 50 END AS progress FROM orders")
def f44_status_state(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(s == "F", "completed").when(s == "O", "queued").otherwise("processing").alias("state"),
        F.when(s == "F", 100).when(s == "O", 0).otherwise(50).alias("progress"),
    )


@query("SELECT event_id AS id, greatest(0.0, least(1.0, try_cast(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE value::VARCHAR END AS DOUBLE))) AS confidence FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 5 = 0")
def f45_confidence_clamp(spark, sf_dir):
    given = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string"))
    number = given.try_cast("double")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(number.isNotNull(), T.clamp(number, 0.0, 1.0)).alias("confidence"))


@query("SELECT event_id AS id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def p16_json_properties(spark, sf_dir):
    """Sensitive keys of the open map are dropped, the rest is typed."""
    kept = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, _: ~F.lower(k).rlike("password|secret|token|apikey"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), kept["k"].cast("long").alias("k")).where("k is not null")


@query("SELECT '{\"id\":' || event_id || CASE WHEN event_id % 2 = 0 THEN ',\"stage\":\"' || event_type || '\"' ELSE '' END || '}' AS entry FROM events")
def p23_omit_nulls(spark, sf_dir):
    entry = F.struct(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("stage"))
    return table(spark, sf_dir, "events").select(F.to_json(entry).alias("entry"))


@query("SELECT item_id AS id, CASE WHEN len(w) >= 3 AND NOT list_contains(['hello', 'hi', 'thanks', 'the'], lower(w[1])) THEN 'search' ELSE 'chat' END AS route FROM (SELECT item_id, regexp_split_to_array(trim(text), '\\s+') AS w FROM benchmark)")
def p18_question_router(spark, sf_dir):
    w = F.split(F.trim("text"), r"\s+")
    plain = (F.size(w) >= 3) & ~F.lower(w[0]).isin("hello", "hi", "thanks", "the")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.when(plain, "search").otherwise("chat").alias("route"))


@query("SELECT item_id AS id, contains(lower(text), 'then') OR (contains(lower(text), 'an') AND contains(lower(text), 'tion')) AS summary, regexp_matches(text, '(?i)\\b(the|of)\\b') AND regexp_matches(text, '(?i)\\b(in|on|at)\\b') AS registry FROM benchmark")
def p19_p20_intents(spark, sf_dir):
    low = F.lower("text")
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("id"), (low.contains("then") | (low.contains("an") & low.contains("tion"))).alias("summary"),
        (F.col("text").rlike(r"(?i)\b(the|of)\b") & F.col("text").rlike(r"(?i)\b(in|on|at)\b")).alias("registry"),
    )
