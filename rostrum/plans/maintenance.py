"""Appends, upserts, versioned replacement, retention, and stateful rules over attempts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import upserts as O
from ..registry import query, table


@query("SELECT s_suppkey AS id, string_agg(p_name, ';' ORDER BY p_partkey) AS aliases FROM supplier JOIN part ON p_partkey % 100 = s_suppkey WHERE s_acctbal > 0 GROUP BY 1")
def s1_s2_active_with_aliases(spark, sf_dir):
    active = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey")
    kids = table(spark, sf_dir, "part").select((F.col("p_partkey") % 100).alias("s_suppkey"), "p_partkey", "p_name")
    rows = F.sort_array(F.collect_list(F.struct("p_partkey", "p_name")))
    return active.join(kids, "s_suppkey").groupBy(F.col("s_suppkey").alias("id")).agg(F.array_join(F.transform(rows, lambda x: x["p_name"]), ";").alias("aliases"))


@query("SELECT c_mktsegment AS list_kind, count(DISTINCT c_nationkey) AS n_tokens FROM customer GROUP BY 1")
def s3_s4_block_lists(spark, sf_dir):
    lists = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("list_kind")).agg(F.collect_set("c_nationkey").alias("tokens"))
    return lists.select("list_kind", F.size("tokens").cast("long").alias("n_tokens"))


@query("SELECT o_custkey AS record_id, coalesce(max(o_orderkey), 0) + 1 AS version FROM orders GROUP BY 1")
def a13_s12_next_version(spark, sf_dir):
    return O.next_versions(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select(F.col("o_custkey").alias("record_id"), "version")


@query("SELECT o_custkey AS record_id, max(o_orderkey) + 1 AS version, arg_max(o_orderpriority, o_orderkey) AS words FROM orders GROUP BY 1")
def s13_edit_save(spark, sf_dir):
    return _edited(table(spark, sf_dir, "orders"))


def _edited(edited):
    return edited.groupBy(F.col("o_custkey").alias("record_id")).agg((F.max("o_orderkey") + 1).alias("version"), F.max_by("o_orderpriority", "o_orderkey").alias("words"))


@query(
    """
    SELECT o_custkey AS record_id, o_orderkey AS version, 'old' AS generation FROM orders WHERE o_custkey % 10 <> 0
    UNION ALL SELECT DISTINCT o_custkey, 10000000, 'new' FROM orders WHERE o_custkey % 20 = 0
    UNION ALL SELECT o_custkey, o_orderkey, 'old' FROM orders WHERE o_custkey % 20 = 10
    """
)
def s14_t4_replace_chunks(spark, sf_dir):
    """A record's chunks are replaced by a newer generation; a stale one changes nothing."""
    old = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record_id"), F.col("o_orderkey").alias("version"), F.lit("old").alias("generation"))
    ids = old.where("record_id % 10 = 0").select("record_id").distinct()
    new = ids.select("record_id", F.when(F.col("record_id") % 20 == 0, F.lit(10_000_000)).otherwise(F.lit(-1)).cast("long").alias("version"), F.lit("new").alias("generation"))
    return O.replace_generation(old, new, "record_id", "version")


@query("SELECT event_id AS id FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id + 1000000 FROM events WHERE event_id % 3 <> 0")
def s16_append_once(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"))
    have = e.where("key % 3 = 0").select("key", F.col("key").alias("id"))
    new = e.select("key", (F.col("key") + 1_000_000).alias("id"))
    return O.append_missing(have, new, ["key"]).select("id")


@query("SELECT n_nationkey::BIGINT AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'second ' || n_name ELSE n_name END AS value FROM nation UNION ALL SELECT 100 + r_regionkey, r_name FROM region")
def s18_upsert(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    have = n.select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("value"))
    once = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("key"), F.concat(F.lit("first "), "n_name").alias("value"), F.lit(1).alias("at"))
    twice = once.select("key", F.regexp_replace("value", "first", "second").alias("value"), F.lit(2).alias("at"))
    fresh = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).cast("long").alias("key"), F.col("r_name").alias("value"), F.lit(1).alias("at"))
    return O.upsert(have, once.unionByName(twice).unionByName(fresh), ["key"], "at")


@query("SELECT event_id AS id FROM events WHERE NOT (ts < TIMESTAMP '2024-01-10' AND event_id IN (SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-10' ORDER BY event_id LIMIT 1000))")
def s19_retention(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts")
    return O.prune(e, F.col("ts") < F.lit("2024-01-10").cast("timestamp"), "id", most=1000).select("id")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 4 = 0 AND o_orderpriority = '5-LOW' THEN 'me' ELSE o_orderpriority END AS assignee FROM orders")
def s22_partial_update(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("assignee"))
    change = rows.where("id % 4 = 0").select("id", F.lit("X").alias("status"), F.when(F.col("assignee") == "5-LOW", "me").alias("assignee"))
    return O.partial_update(rows, change, "id")


@query("SELECT l_orderkey AS record_id, count(*) AS n FROM lineitem WHERE l_orderkey % 9 <> 0 GROUP BY 1")
def s23_cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    kept = table(spark, sf_dir, "lineitem").join(gone, "l_orderkey", "left_anti")
    return kept.groupBy(F.col("l_orderkey").alias("record_id")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'Archived' ELSE c_mktsegment END AS status FROM customer WHERE c_acctbal >= 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def s24_delete_or_archive(spark, sf_dir):
    """Sittings asked to go: those with records are archived, the others deleted (with a balance below zero; the rest stay)."""
    kept = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("has")).distinct()
    rows = table(spark, sf_dir, "customer").join(kept, "c_custkey", "left").where("c_acctbal >= 0 or has")
    return rows.select(F.col("c_custkey").alias("id"), F.when(F.col("has"), "Archived").otherwise(F.col("c_mktsegment")).alias("status"))


@query("SELECT p_partkey AS id, p_brand AS owner, p_partkey = chosen AS is_default FROM part JOIN (SELECT p_brand AS b, arg_max(p_partkey, (p_retailprice, p_partkey)) AS chosen FROM part GROUP BY 1) ON b = p_brand")
def s25_single_default(spark, sf_dir):
    """Of each owner's templates the chosen one becomes the default, and every other stops being one."""
    p = table(spark, sf_dir, "part")
    chosen = p.groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("chosen"))
    return p.join(chosen, "p_brand").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("owner"), (F.col("p_partkey") == F.col("chosen")).alias("is_default"))


@query("SELECT p_partkey AS id, p_size + coalesce(n, 0) AS usage_count FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def s26_counter_increment(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "part").join(used, "p_partkey", "left").select(F.col("p_partkey").alias("id"), (F.col("p_size") + F.coalesce("n", F.lit(0))).alias("usage_count"))


@query("SELECT o_orderkey AS id, coalesce(nullif(o_orderpriority, '5-LOW'), 'Unassigned') AS assignee FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 8)")
def s27_insert_children(spark, sf_dir):
    parents = table(spark, sf_dir, "customer").where("c_nationkey < 8").select(F.col("c_custkey").alias("o_custkey"))
    rows = table(spark, sf_dir, "orders").join(parents, "o_custkey", "left_semi")
    return rows.select(F.col("o_orderkey").alias("id"), F.coalesce(F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit("Unassigned")).alias("assignee"))


@query("SELECT s_name AS email FROM supplier WHERE lower(s_name) NOT IN (SELECT lower(replace(c_name, 'Customer', 'Supplier')) FROM customer WHERE c_custkey % 2 = 0)")
def s28_insert_users(spark, sf_dir):
    have = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.lower(F.regexp_replace("c_name", "Customer", "Supplier")).alias("key"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("email"), F.lower("s_name").alias("key"))
    return rows.join(have, "key", "left_anti").select("email")


@query("SELECT c_custkey AS id, CASE WHEN lower(c_mktsegment) = 'building' THEN 'BUILDING' ELSE c_mktsegment || ',Building' END AS terms FROM customer")
def s29_dictionary_append(spark, sf_dir):
    terms = F.array("c_mktsegment")
    added = F.when(F.exists(terms, lambda t: F.lower(t) == "building"), terms).otherwise(F.array_append(terms, F.lit("Building")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array_join(added, ",").alias("terms"))


@query("SELECT event_id AS id, coalesce(nullif(event_type, 'view'), 'other') AS category, 'info' AS severity, '{\"k\":\"[redacted]\"}' AS metadata FROM events")
def s17_audit_append(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kept = F.transform_values(F.from_json("props", "map<string,string>"), lambda k, v: F.lit("[redacted]"))
    return e.select(
        F.col("event_id").alias("id"), F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("other")).alias("category"), F.lit("info").alias("severity"), F.to_json(kept).alias("metadata")
    )


@query("SELECT p_brand AS base, p_brand || ' (Copy ' || (max(p_size) + 1) || ')' AS copy FROM part GROUP BY 1")
def f33_copy_name(spark, sf_dir):
    """First free copy number: here the sizes up to a brand's largest are taken."""
    taken = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max("p_size").alias("top"))
    free = taken.select("p_brand", F.explode(F.sequence(F.lit(1), F.col("top") + 1)).alias("k"), "top").where("k > top")
    return free.groupBy(F.col("p_brand").alias("base")).agg(F.concat("p_brand", F.lit(" (Copy "), F.min("k"), F.lit(")")).alias("copy"))


@query("SELECT a.p_partkey AS id, count(*) - 1 AS identical FROM part a JOIN part b ON coalesce(a.p_type, '') = coalesce(b.p_type, '') AND a.p_size = b.p_size GROUP BY 1")
def p9_identical_templates(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.coalesce("p_type", F.lit("")).alias("t"), "p_size")
    same = rows.groupBy("t", "p_size").agg(F.count("*").alias("n"))
    return rows.join(same, ["t", "p_size"]).select(F.col("p_partkey").alias("id"), (F.col("n") - 1).alias("identical"))


@query("SELECT floor(epoch(max(ts)))::BIGINT AS updated FROM events")
def a14_staleness(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.unix_timestamp(F.max("ts")).alias("updated"))


@query(
    """
    SELECT event_id AS id, n_ip, n_mail, n_ip > 20 OR n_mail > 10 AS limited FROM
    (SELECT event_id, count(*) OVER (PARTITION BY user_id % 7 ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 900 PRECEDING AND CURRENT ROW) AS n_ip,
       count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 900 PRECEDING AND CURRENT ROW) AS n_mail FROM events)
    """
)
def t6_sliding_attempts(spark, sf_dir):
    """Attempts of the last 15 minutes up to each one: 20 from an address (users share seven), 10 for an e-mail (the user)."""
    at = F.unix_timestamp("ts")
    by = lambda *key: Window.partitionBy(*key).orderBy(at).rangeBetween(-900, 0)
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.count("*").over(by(F.col("user_id") % 7)).alias("n_ip"), F.count("*").over(by("user_id")).alias("n_mail"))
    return rows.withColumn("limited", (F.col("n_ip") > 20) | (F.col("n_mail") > 10))


@query(
    """
    SELECT event_id AS id, fails FROM (SELECT event_id, CASE WHEN failed THEN sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) ELSE 0 END AS fails FROM
    (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, event_type <> 'purchase' AS failed FROM events)))
    """
)
def t7_t9_consecutive_failures(spark, sf_dir):
    """Failures in a row up to each event; a success starts again (lockouts and breakers open on this count)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    failed = (F.col("event_type") != "purchase").cast("long")
    e = table(spark, sf_dir, "events").withColumn("failed", failed).withColumn("run", F.sum(1 - F.col("failed")).over(w))
    streak = F.sum("failed").over(Window.partitionBy("user_id", "run").orderBy("ts", "event_id"))
    return e.select(F.col("event_id").alias("id"), F.when(F.col("failed") == 1, streak).otherwise(0).alias("fails"))


@query("SELECT DISTINCT o_custkey AS transcript_id FROM orders")
def t1_t11_deduplicated_queue(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("transcript_id")).dropDuplicates()
