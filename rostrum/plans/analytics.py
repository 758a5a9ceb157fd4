"""Registry listings, roll-ups and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query, table

def hours():
    """Sums of doubles hang on the order of rows; sums of decimals do not."""
    return F.col("o_totalprice").cast("decimal(18,2)")


def latest(records, key: str, version: str):
    """Rows of the newest version of each key (a max-aggregate join, so hot keys pre-aggregate)."""
    newest = records.groupBy(key).agg(F.max(version).alias(version))
    return records.join(newest, [key, version])


@query(
    """
    SELECT c_mktsegment AS session_type, count(*) AS n_records, max(o_totalprice) AS max_hours
    FROM orders JOIN (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders GROUP BY 1) ON o_custkey = k AND o_orderkey = v
    JOIN customer ON c_custkey = o_custkey GROUP BY 1
    """
)
def latest_by_session_type(spark, sf_dir):
    newest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", "o_orderkey").alias("hours"))
    sittings = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("session_type"))
    return newest.join(sittings, newest.o_custkey == sittings.c_custkey).groupBy("session_type").agg(
        F.count("*").alias("n_records"), F.max("hours").alias("max_hours")
    )


@query("SELECT (SELECT count(*) FROM customer) AS n_sittings, (SELECT count(*) FROM orders) AS n_records")
def a1_global_counts(spark, sf_dir):
    sittings = table(spark, sf_dir, "customer").agg(F.count("*").alias("n_sittings"))
    return sittings.crossJoin(table(spark, sf_dir, "orders").agg(F.count("*").alias("n_records")))  # one row each


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def a2_count_by_status(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0)::DOUBLE AS hours FROM orders WHERE o_orderstatus = 'P'")
def a3_total_hours(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return done.agg(F.coalesce(F.sum(hours()), F.lit(0)).cast("double").alias("hours"))


@query(
    """
    SELECT CAST(date_trunc('week', o_orderdate) AS DATE)::VARCHAR AS week, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS hours
    FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 84 DAY AND o_orderdate < TIMESTAMP '2001-08-01' GROUP BY 1
    """
)
def a4_weekly_buckets(spark, sf_dir):
    as_of = F.lit("2001-08-01").cast("timestamp")
    recent = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= as_of - F.expr("INTERVAL 84 DAYS")) & (F.col("o_orderdate") < as_of))
    return recent.groupBy(F.date_trunc("week", "o_orderdate").cast("date").cast("string").alias("week")).agg(
        F.count("*").alias("n"), F.sum(hours()).cast("double").alias("hours")
    )


@query(
    """
    SELECT o_orderpriority AS assignee, max(o_orderstatus) AS role, max(o_custkey) AS avatar, count(*) AS n
    FROM orders GROUP BY 1 ORDER BY n DESC, assignee LIMIT 10
    """
)
def a5_workload_topk(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("assignee")).agg(
        F.max("o_orderstatus").alias("role"), F.max("o_custkey").alias("avatar"), F.count("*").alias("n")
    ).orderBy(F.desc("n"), "assignee").limit(10)


@query(
    """
    SELECT o_orderkey AS id, o_custkey AS sitting_id, c_name AS title, o_orderstatus AS status FROM orders JOIN customer ON c_custkey = o_custkey
    WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'
    """
)
def j1_assigned_records(spark, sf_dir):
    mine = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus <> 'F'")
    sittings = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return mine.join(sittings, mine.o_custkey == sittings.c_custkey).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("sitting_id"), F.col("c_name").alias("title"), F.col("o_orderstatus").alias("status")
    )


@query(
    """
    SELECT l_orderkey AS record_id, l_linenumber::BIGINT AS ordinal, o_custkey AS sitting_id, n_name AS place, l_quantity AS seconds
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    WHERE l_quantity >= 49 AND n_name = 'NATION_3'
    """
)
def j2_four_way_chain(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select("l_orderkey", "l_linenumber", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sittings = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    places = table(spark, sf_dir, "nation").where("n_name = 'NATION_3'").select("n_nationkey", "n_name")
    chain = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(sittings, F.col("o_custkey") == F.col("c_custkey"))
    return chain.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").cast("long").alias("ordinal"), F.col("o_custkey").alias("sitting_id"),
        F.col("n_name").alias("place"), F.col("l_quantity").alias("seconds"),
    )


@query(
    """
    SELECT o_custkey AS record_id, o_orderkey AS version, o_orderstatus AS status, o_totalprice AS hours FROM orders
    JOIN (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders GROUP BY 1) ON k = o_custkey AND v = o_orderkey
    """
)
def j3_latest_version_join(spark, sf_dir):
    return latest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select(
        F.col("o_custkey").alias("record_id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("hours")
    )


@query(
    """
    SELECT o_custkey AS record_id, o_orderkey AS version FROM orders o
    WHERE o_orderkey = (SELECT max(i.o_orderkey) FROM orders i WHERE i.o_custkey = o.o_custkey) AND o_orderstatus = 'O'
    """
)
def j4_correlated_latest(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("version_rows")
    return spark.sql(
        "SELECT o_custkey AS record_id, o_orderkey AS version FROM version_rows o WHERE o_orderkey = "
        "(SELECT max(i.o_orderkey) FROM version_rows i WHERE i.o_custkey = o.o_custkey) AND o_orderstatus = 'O'"
    )


@query("SELECT c_custkey AS id, c_name AS title FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j5_never_indexed(spark, sf_dir):
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(done, "c_custkey", "left_anti").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))


@query(
    """
    SELECT DISTINCT o_custkey AS sitting_id, trim(m) AS member FROM
    (SELECT o_custkey, unnest(string_split(o_orderpriority || ',' || o_orderstatus || ', ', ',')) AS m FROM orders) WHERE trim(m) <> ''
    """
)
def j8_unnest_members(spark, sf_dir):
    members = F.split(F.concat("o_orderpriority", F.lit(","), "o_orderstatus", F.lit(", ")), ",")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sitting_id"), F.explode(members).alias("m"))
    return rows.select("sitting_id", F.trim("m").alias("member")).where("member <> ''").distinct()


@query(
    """
    SELECT n_nationkey::BIGINT AS id, n_name AS canonical, count(s_suppkey) AS n_aliases
    FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2
    """
)
def j9_alias_parity(spark, sf_dir):
    aliases = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("s_suppkey").alias("n"))
    kinds = table(spark, sf_dir, "nation")
    return kinds.join(aliases, kinds.n_nationkey == aliases.s_nationkey, "left").select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("canonical"), F.coalesce("n", F.lit(0)).alias("n_aliases")
    )


@query(
    """
    SELECT c_custkey AS id, count(o_orderkey) AS n_records, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS records
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
    """
)
def j10_sittings_with_records(spark, sf_dir):
    return _with_records(spark, sf_dir, table(spark, sf_dir, "customer").select("c_custkey"))


def _with_records(spark, sf_dir, page):
    kids = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    rows = page.join(kids, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_custkey").alias("id"))
    return rows.agg(
        F.count("o_orderkey").alias("n_records"), F.array_join(F.sort_array(F.collect_list("o_orderkey")), ",").alias("records")
    )


@query(
    """
    SELECT c_custkey AS id, c_mktsegment AS session_type, c_acctbal AS priority FROM customer
    WHERE c_mktsegment <> 'MACHINERY' AND c_nationkey >= 5 AND c_nationkey <= 9 ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 20
    """
)
def p1_filtered_page(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'").where("c_nationkey >= 5").where("c_nationkey <= 9")
    page, size = max(1, 2), min(100, max(1, 20))
    return wanted.orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").offset((page - 1) * size).limit(size).select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("session_type"), F.col("c_acctbal").alias("priority")
    )


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_name ILIKE '%r#00000_1%' OR c_mktsegment ILIKE '%r#00000_1%'")
def p3_user_search(spark, sf_dir):
    q = "%r#00000_1%"  # wildcards of the query hold, as given
    return table(spark, sf_dir, "customer").where(F.col("c_name").ilike(q) | F.col("c_mktsegment").ilike(q)).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query(
    """
    SELECT p_partkey AS id, p_name AS name, p_size::BIGINT AS usage_count FROM part
    WHERE (p_name ILIKE '%e%' OR coalesce(p_type, '') ILIKE '%e%') AND p_brand = 'Brand#11' ORDER BY p_size >= 40 DESC, p_size DESC, p_name, p_partkey
    """
)
def p4_template_list(spark, sf_dir):
    q = "%e%"
    found = table(spark, sf_dir, "part").where((F.col("p_name").ilike(q) | F.coalesce("p_type", F.lit("")).ilike(q)) & (F.col("p_brand") == "Brand#11"))
    return found.orderBy((F.col("p_size") >= 40).desc(), F.desc("p_size"), "p_name", "p_partkey").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("usage_count")
    )


@query("SELECT c_custkey AS id FROM customer WHERE c_name ILIKE '%r#00000\\_%' ESCAPE '\\' OR c_name ILIKE '%\\#000000001%' ESCAPE '\\'")
def p5_escaped_like(spark, sf_dir):
    from ..functions.textfn import escape_like

    table(spark, sf_dir, "customer").createOrReplaceTempView("titled")
    return spark.sql(
        "SELECT c_custkey AS id FROM titled WHERE c_name ILIKE :a OR c_name ILIKE :b",
        args={"a": "%" + escape_like("r#00000_") + "%", "b": "%" + escape_like("#000000001") + "%"},
    )


@query(
    """
    SELECT o_orderkey AS id, CAST(o_orderdate AS DATE)::VARCHAR AS date FROM orders
    WHERE o_orderpriority ILIKE '%urgent%' OR o_orderkey = 77 ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 10
    """
)
def p7_resolve_title_or_id(spark, sf_dir):
    found = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").ilike("%urgent%") | (F.col("o_orderkey") == 77))
    return found.orderBy(F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")).limit(10).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").cast("string").alias("date")
    )


@query(
    """
    SELECT id, exact, CASE WHEN n_exact = 1 AND exact THEN 'chosen' WHEN n_exact = 1 THEN 'other' ELSE 'ambiguous' END AS outcome FROM
    (SELECT s_suppkey AS id, lower(trim(s_name)) = lower(' Supplier#000000001 '.trim()) AS exact,
     count(*) FILTER (WHERE lower(trim(s_name)) = lower('Supplier#000000001')) OVER () AS n_exact FROM supplier WHERE s_name ILIKE '%#00000000%')
    """
)
def p8_exact_title_preference(spark, sf_dir):
    found = table(spark, sf_dir, "supplier").where(F.col("s_name").ilike("%#00000000%"))
    exact = F.lower(F.trim("s_name")) == F.lower(F.trim(F.lit(" Supplier#000000001 ")))
    total = found.agg(F.count_if(exact).alias("n_exact"))
    return found.crossJoin(F.broadcast(total)).select(  # one row
        F.col("s_suppkey").alias("id"), exact.alias("exact"),
        F.when((F.col("n_exact") == 1) & exact, "chosen").when(F.col("n_exact") == 1, "other").otherwise("ambiguous").alias("outcome"),
    )


@query(
    """
    SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'Edited' WHEN 'view' THEN CASE WHEN value > 50 THEN 'Reviewed' ELSE 'Opened' END
    WHEN 'purchase' THEN 'Published' ELSE 'Updated' END AS activity FROM events
    """
)
def p11_activity_label(spark, sf_dir):
    kind = F.col("event_type")
    label = F.when(kind == "click", "Edited").when((kind == "view") & (F.col("value") > 50), "Reviewed").when(kind == "view", "Opened")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), label.when(kind == "purchase", "Published").otherwise("Updated").alias("activity"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> '')")
def p12_publish_guard(spark, sf_dir):
    texts = table(spark, sf_dir, "lineitem").where("l_returnflag <> ''").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").join(texts, "o_orderkey", "left_semi").select(F.col("o_orderkey").alias("id"))


@query("SELECT c_custkey AS \"custKey\", c_name AS \"displayName\", c_nationkey AS \"nationKey\" FROM customer")
def p10_camel_case_rows(spark, sf_dir):
    names = {"c_custkey": "custKey", "c_name": "displayName", "c_nationkey": "nationKey"}
    return table(spark, sf_dir, "customer").select(*(F.col(a).alias(b) for a, b in names.items()))


@query(
    """
    SELECT DISTINCT event_type AS topic, event_type = 'click' OR starts_with(event_type, 'pur') AS subscribed FROM events
    """
)
def p15_topic_subscription(spark, sf_dir):
    patterns = ["click", "pur*"]
    topics = table(spark, sf_dir, "events").select(F.col("event_type").alias("topic")).distinct()
    hit = F.lit(False)
    for p in patterns:
        hit = hit | (F.col("topic").startswith(p[:-1]) if p.endswith("*") else F.col("topic") == p)
    return topics.withColumn("subscribed", hit)


@query(
    """
    SELECT r.role, p.permission, list_contains(r.permissions, p.permission) AS allowed FROM
    (VALUES ('viewer', ['read']), ('editor', ['read', 'edit']), ('admin', ['read', 'edit', 'manage'])) r(role, permissions),
    (VALUES ('read'), ('edit'), ('manage')) p(permission)
    """
)
def p17_permission_matrix(spark, sf_dir):
    roles = spark.createDataFrame([("viewer", ["read"]), ("editor", ["read", "edit"]), ("admin", ["read", "edit", "manage"])], "role string, permissions array<string>")
    asked = F.explode(F.array(F.lit("read"), F.lit("edit"), F.lit("manage"))).alias("permission")
    return roles.select("role", "permissions", asked).select("role", "permission", F.array_contains("permissions", F.col("permission")).alias("allowed"))


@query("SELECT list_sort(list_distinct(flatten(list(permissions))))::VARCHAR AS permissions, sum(len(permissions))::BIGINT AS n FROM (VALUES (['read']), (['read', 'edit']), (['publish'])) r(permissions)")
def a15_admin_superset(spark, sf_dir):
    roles = spark.createDataFrame([(["read"],), (["read", "edit"],), (["publish"],)], "permissions array<string>")
    every = F.sort_array(F.array_distinct(F.flatten(F.collect_list("permissions"))))
    return roles.agg(F.concat(F.lit("["), F.array_join(every, ", "), F.lit("]")).alias("permissions"), F.sum(F.size("permissions")).cast("long").alias("n"))


@query(
    """
    SELECT a.role AS lower_role, b.role AS upper_role, len(list_filter(a.permissions, lambda x: NOT list_contains(b.permissions, x)))::BIGINT AS n_missing FROM
    (VALUES ('viewer', 1, ['read']), ('editor', 2, ['read', 'edit']), ('admin', 3, ['edit', 'manage'])) a(role, rank, permissions)
    JOIN (VALUES ('viewer', 1, ['read']), ('editor', 2, ['read', 'edit']), ('admin', 3, ['edit', 'manage'])) b(role, rank, permissions) ON b.rank = a.rank + 1
    """
)
def a16_permission_hierarchy(spark, sf_dir):
    roles = spark.createDataFrame([("viewer", 1, ["read"]), ("editor", 2, ["read", "edit"]), ("admin", 3, ["edit", "manage"])], "role string, rank int, permissions array<string>")
    a, b = roles.alias("a"), roles.alias("b")
    return a.join(b, F.col("b.rank") == F.col("a.rank") + 1).select(
        F.col("a.role").alias("lower_role"), F.col("b.role").alias("upper_role"), F.size(F.array_except("a.permissions", "b.permissions")).cast("long").alias("n_missing")
    )


ACTIVITY_SQL = """
    SELECT * FROM (SELECT 'record' AS kind, o_orderkey AS id, floor(epoch(o_orderdate))::BIGINT AS happened, count(*) OVER () AS total FROM orders
        WHERE o_orderdate >= TIMESTAMP '2001-01-01' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25)
    UNION ALL SELECT * FROM (SELECT 'event' AS kind, event_id AS id, floor(epoch(ts))::BIGINT AS happened, count(*) OVER () AS total FROM events
        WHERE value > 10 ORDER BY ts DESC, event_id DESC LIMIT 25)
    ORDER BY happened DESC, kind, id DESC
"""


@query(ACTIVITY_SQL)
def o4_recent_activity(spark, sf_dir):
    """Each branch is counted before its limit (a global aggregate beside a top-k, not a one-task window)."""

    def branch(kind, rows, id_, at):
        top = rows.orderBy(F.desc(at), F.desc(id_)).limit(25)
        total = rows.agg(F.count("*").alias("total"))
        return top.crossJoin(F.broadcast(total)).select(F.lit(kind).alias("kind"), F.col(id_).alias("id"), F.unix_timestamp(at).alias("happened"), "total")

    records = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp'2001-01-01'")
    events = table(spark, sf_dir, "events").where("value > 10")
    both = branch("record", records, "o_orderkey", "o_orderdate").unionByName(branch("event", events, "event_id", "ts"))
    return both.orderBy(F.desc("happened"), "kind", F.desc("id"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 8")
def o5_recent_eight(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(8).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")
    )


@query("SELECT list_slice(list_sort(list(n_name)), 11, 15)::VARCHAR AS page FROM nation")
def o7_array_page(spark, sf_dir):
    terms = table(spark, sf_dir, "nation").agg(F.sort_array(F.collect_list("n_name")).alias("terms"))  # 25 rows
    return terms.select(F.concat(F.lit("["), F.array_join(F.slice("terms", 11, 5), ", "), F.lit("]")).alias("page"))


@query(
    """
    SELECT id, cnt, kind FROM (SELECT c_custkey AS id, 0::BIGINT AS cnt, 'never' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT o_custkey, count(*), 'partial' FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ORDER BY cnt = 0 DESC, cnt DESC, id LIMIT 50
    """
)
def o9_index_gaps(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    never = table(spark, sf_dir, "customer").join(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    never = never.select(F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("cnt"), F.lit("never").alias("kind"))
    partial = orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("cnt")).withColumn("kind", F.lit("partial"))
    return never.unionByName(partial).orderBy((F.col("cnt") == 0).desc(), F.desc("cnt"), "id").limit(50)


@query("SELECT o_custkey AS record_id, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def o11_latest_row(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("record_id")).agg(
        F.max("o_orderkey").alias("version"), F.max_by("o_orderstatus", "o_orderkey").alias("status")
    )


@query(
    """
    SELECT event_id AS id, user_id FROM events WHERE user_id = 7 AND event_type = (SELECT max(event_type) FROM events WHERE user_id = 7) ORDER BY event_id
    """
)
def o12_evidence_of_version(spark, sf_dir):
    mine = table(spark, sf_dir, "events").where("user_id = 7")
    newest = mine.agg(F.max("event_type").alias("event_type"))
    return mine.join(F.broadcast(newest), "event_type").select(F.col("event_id").alias("id"), "user_id").orderBy("id")


@query("SELECT conv_id AS record_id, turn, role FROM conversations WHERE conv_id = 3 ORDER BY turn")
def o16_chunks_in_order(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("conv_id = 3").select(F.col("conv_id").alias("record_id"), "turn", "role").orderBy("turn")


@query(
    """
    SELECT DISTINCT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
    WHERE n <= 3 OR list_contains([0, round_even((n - 1) / 2, 0)::BIGINT, n - 1], pos)
    """
)
def o10_even_sample(spark, sf_dir):
    """At most three chunks of each record, evenly spaced, the first and last among them (rounding half to even)."""
    per = Window.partitionBy("conv_id")
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", (F.row_number().over(per.orderBy("turn")) - 1).cast("double").alias("pos"), F.count("*").over(per).alias("n")
    )
    cap = 3
    wanted = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda i: F.bround(i * (F.col("n") - 1) / (cap - 1), 0).cast("double"))
    return rows.where((F.col("n") <= cap) | F.array_contains(wanted, F.col("pos"))).select("conv_id", "turn").distinct()


@query("SELECT c_custkey AS id, c_name AS email FROM customer WHERE c_custkey = 11 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000012' AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = 11)")
def p22_point_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    found = rows.where((F.col("c_custkey") == 11) | (F.col("c_name") == "Customer#000000012"))
    return found.orderBy((F.col("c_custkey") == 11).desc()).limit(1).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("email"))


@query(
    """
    SELECT sum(CASE WHEN r.r_name IS NULL THEN 0 ELSE 1 END)::BIGINT AS n, count(DISTINCT c_custkey) AS sittings, count(DISTINCT o_orderkey) AS records, count(DISTINCT n_nationkey) AS places
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region r ON r_regionkey = n_regionkey
    """
)
def a9_distinct_counts(spark, sf_dir):
    chain = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")
    chain = chain.join(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey")), "n_nationkey").join(table(spark, sf_dir, "region"), "r_regionkey")
    return chain.agg(
        F.count("r_name").alias("n"), F.countDistinct("c_custkey").alias("sittings"), F.countDistinct("o_orderkey").alias("records"), F.countDistinct("n_nationkey").alias("places")
    )
