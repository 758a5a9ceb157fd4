"""Evaluation, percentiles, parity and dictionary checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.correction import SERVICE
from ..operators.quantiles import quantiles
from ..registry import query, table
from .matching import INDEX_SQL, SAID_SQL, said, said_in_texts


@query(
    """
    SELECT source, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fn) END AS recall, unchanged FROM
    (SELECT source, count(*) FILTER (WHERE p AND quality = 1) AS tp, count(*) FILTER (WHERE p AND quality = 0) AS fp, count(*) FILTER (WHERE NOT p AND quality = 1) AS fn,
     count(*) FILTER (WHERE NOT p)::DOUBLE / count(*) AS unchanged FROM (SELECT source, quality, n_chars > 600 AS p FROM documents JOIN labels USING (doc_id)) GROUP BY 1)
    """
)
def a17_precision_recall(spark, sf_dir):
    gold = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") > 600).alias("p")).join(gold, "doc_id")
    good = F.col("quality") == 1
    found = rows.groupBy("source").agg(
        F.count_if(F.col("p") & good).alias("tp"), F.count_if(F.col("p") & ~good).alias("fp"), F.count_if(~F.col("p") & good).alias("fn"),
        (F.count_if(~F.col("p")) / F.count("*")).alias("unchanged"),
    )

    def share(part):
        whole = F.col("tp") + F.col(part)
        return F.when(whole == 0, 1.0).otherwise(F.col("tp") / whole)

    return found.select("source", share("fp").alias("precision"), share("fn").alias("recall"), "unchanged")


@query("SELECT event_type AS strategy, count(*) AS applied FROM events GROUP BY 1")
def a18_by_strategy(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("strategy")).agg(F.count("*").alias("applied"))


def _parity(source, target):
    a = source.groupBy(F.col("s_nationkey").cast("long").alias("k")).agg(F.count("*").alias("a"))
    b = target.groupBy(F.col("c_nationkey").cast("long").alias("k")).agg(F.count("*").alias("b"))
    n, m = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return a.join(b, "k", "full").select("k", n.alias("n_source"), m.alias("n_target"), (n == m).alias("equal"))


@query("SELECT coalesce(a.k, b.k)::BIGINT AS k, coalesce(a.n, 0) AS n_source, coalesce(b.n, 0) AS n_target, coalesce(a.n, 0) = coalesce(b.n, 0) AS equal FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) b ON a.k = b.k")
def a20_parity_counts(spark, sf_dir):
    return _parity(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer"))


@query("SELECT event_type AS role, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def a21_permission_cardinality(spark, sf_dir):
    """Roles (event types) and what they are permitted (users), as a map would hold them."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("role")).agg(F.countDistinct("user_id").alias("n"))


@query("SELECT event_type, median(value)::DOUBLE AS median, count(*) AS n FROM events GROUP BY 1")
def a22_median(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.percentile("value", 0.5).alias("median"), F.count("*").alias("n"))


@query("SELECT l_returnflag AS flag, median(l_extendedprice)::DOUBLE AS median, count(*) AS n FROM lineitem GROUP BY 1")
def a22_median_of_hot_keys(spark, sf_dir):
    """The median of few keys that hold all rows, by rounds of histograms instead of a list of a key's values."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("price"))
    return quantiles(rows, ["flag"], "price", 0.5).select("flag", F.col("quantile").alias("median"), "n")


@query("SELECT l_linestatus AS status, quantile_disc(l_extendedprice, 0.95)::DOUBLE AS p95, count(*) AS n FROM lineitem GROUP BY 1")
def a25_p95_of_hot_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("price"))
    return quantiles(rows, ["status"], "price", 0.95, between=False).select("status", F.col("quantile").alias("p95"), "n")


@query(
    """
    SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failed, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.95) > 90 AS slow,
      count(*) FILTER (WHERE event_type = 'error') * 4 > count(*) AS unsound FROM events GROUP BY 1
    """
)
def a25_run_flags(spark, sf_dir):
    """A run's rows, failures and latency percentile, with a flag for each limit that it exceeds."""
    failed = F.count_if(F.col("event_type") == "error")
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)")
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), failed.alias("failed"), p95.alias("p95"))
    return rows.withColumns({"slow": F.col("p95") > 90, "unsound": F.col("failed") * 4 > F.col("n")})


@query("SELECT user_id, list_sort(list(value))[floor(count(*) * 0.95)::BIGINT + 1] AS p95 FROM events GROUP BY 1")
def a26_p95_by_index(spark, sf_dir):
    """The value at index floor(0.95 n) of the sorted ones: a rank within the key, no list of its values."""
    by_value = Window.partitionBy("user_id").orderBy("value", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "value", F.row_number().over(by_value).alias("rank"), F.count("*").over(Window.partitionBy("user_id")).alias("n"))
    return rows.where("rank = floor(n * 0.95) + 1").select("user_id", F.col("value").alias("p95"))


@query(
    """
    SELECT 'blank' AS rule, count(*) AS n FROM part WHERE trim(coalesce(p_name, '')) = '' UNION ALL SELECT 'space', count(*) FROM part WHERE p_name <> trim(regexp_replace(p_name, '\\s+', ' ', 'g'))
    UNION ALL SELECT 'control', count(*) FROM part WHERE regexp_matches(p_name, '[\\x00-\\x1f]') UNION ALL SELECT 'duplicate', count(*) FROM (SELECT lower(p_name) FROM part GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'many_sources', count(*) FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1)
    """
)
def fq1_dictionary_checks(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    n = F.col("p_name")
    rules = {
        "blank": p.where(F.trim(F.coalesce(n, F.lit(""))) == ""), "space": p.where(n != F.trim(F.regexp_replace(n, r"\s+", " "))),
        "control": p.where(n.rlike(r"[\x00-\x1f]")), "duplicate": p.groupBy(F.lower(n)).count().where("count > 1"),
        "many_sources": p.groupBy(n).agg(F.countDistinct("p_brand").alias("k")).where("k > 1"),
    }
    out = None
    for rule, rows in rules.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT coalesce(a.s_name, b.name) AS name, a.s_name IS NOT NULL AS in_json, b.name IS NOT NULL AS in_csv FROM supplier a FULL JOIN (SELECT replace(s_name, '#00000000', '#1') AS name FROM supplier) b ON a.s_name = b.name WHERE a.s_name IS NULL OR b.name IS NULL")
def fq2_export_parity(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit(True).alias("a"))
    b = a.select(F.regexp_replace("name", "#00000000", "#1").alias("name"), F.lit(True).alias("b"))
    both = a.join(b, "name", "full").where("a is null or b is null")
    return both.select("name", F.col("a").isNotNull().alias("in_json"), F.col("b").isNotNull().alias("in_csv"))


@query("SELECT p_partkey AS id, p_name || CASE WHEN p_name <> p_brand THEN ';' || p_brand ELSE '' END AS aliases FROM part")
def fq3_clean_aliases(spark, sf_dir):
    raw = F.array(F.col("p_name"), F.concat(F.lit(" "), F.col("p_brand")), F.lit("  "), F.col("p_name"))
    clean = F.array_distinct(F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x != ""))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(clean, ";").alias("aliases"))


@query(
    """
    SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE AS sum_qty, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS sum_price, count(*) AS n FROM lineitem
    WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
    """
)
def scan_rollup(spark, sf_dir):
    """A scan-heavy roll-up: filter and columns reach the scan, sums are partial before the shuffle."""
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("sum_price"), F.count("*").alias("n")
    )


@query(
    f"""
    WITH {INDEX_SQL} SELECT id, got, got IS NOT NULL AS covered, coalesce(got = canonical, false) AS correct FROM
    (SELECT s.id, s.canonical, CASE form WHEN 1 THEN s.canonical WHEN 2 THEN a.canonical WHEN 3 THEN b.canonical WHEN 4 THEN CASE WHEN s.kind <> 'person' THEN s.canonical END END AS got
     FROM {SAID_SQL} s LEFT JOIN surnames a ON a.key = lower(surname) LEFT JOIN initials b ON b.key = lower(substr(given, 1, 1) || '.' || surname))
    """
)
def r31_span_evaluation(spark, sf_dir):
    """A gold span is judged by the correction that covers its first token's place; one left alone has none."""
    fixes = said_in_texts(spark, sf_dir, SERVICE).select("id", F.explode("corrections").alias("c"))
    gold = said(spark, sf_dir).select("id", F.col("canonical").alias("want"), F.when(F.col("form") == 2, len("Heard hon ")).otherwise(len("Heard ")).alias("offset"))
    over = gold.join(fixes, "id").where("c.start <= offset and offset < c.end").select("id", F.col("c.canonical").alias("got"))
    out = gold.join(over, "id", "left")
    return out.select("id", "got", F.col("got").isNotNull().alias("covered"), F.coalesce(F.col("got") == F.col("want"), F.lit(False)).alias("correct"))
