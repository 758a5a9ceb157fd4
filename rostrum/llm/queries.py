"""The ``opN_<name>`` queries: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, html, langid, lattice, packing, pii, quality, sharding, tokencount
from .common import table
from .decontaminate import decontaminate
from .divergence import divergences
from .neardup import near_duplicates
from .vectorcodes import vector_codes


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; ROSTRUM_TOKENIZERS names another folder."""
    folder = os.environ.get("ROSTRUM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = sharding.shard(docs, shards=24)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, keep_text=False)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.beside_edits(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return quality.perplexities(table(spark, sf_dir, "documents"), trusted)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identify(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), size=1024, end_id=2)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.detect(docs, pii.fit(docs), keep_text=False)
    return out.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"), least_docs=10, top=10)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.text_scores(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (
    op1_html_extraction, op2_token_counts, op3_sharding, op4_minhash_neardup, op5_decontamination, op6_fingerprints,
    op7_quality, op8_language_id, op9_packing, op10_pii, op11_source_divergence, op12_vector_codes, op13_lm_scoring,
)}
def _book(k: int) -> str:
    """Entries after round ``k`` of the iteration."""
    return f"""
a{k} AS (SELECT vec_id, p, arg_min(e, (d, e)) AS e FROM (SELECT vec_id, p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts JOIN c{k} USING (p)) GROUP BY ALL),
m{k} AS (SELECT p, e, list(m ORDER BY i) AS m FROM (SELECT p, e, i, floor(sum(x[i]) / count(*))::BIGINT AS m FROM a{k} JOIN parts USING (vec_id, p), range(1, len(x) + 1) r(i) GROUP BY ALL) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m, c) AS c FROM c{k} LEFT JOIN m{k} USING (p, e)),"""


#: The other operators cannot be expressed in SQL on whole tables; tests/llm holds them against brute force.
SQL: dict[str, str] = {
    "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT g.lang, g.source, coalesce(sum(c), 0)::BIGINT AS n FROM groups g LEFT JOIN counts USING (lang, source) GROUP BY ALL),
p AS (SELECT k.lang, s.source, k.term, coalesce(c, 0) AS c, 1 + 1000000000 * (coalesce(c, 0) + 2) // (s.n + 2 * v) AS p, 1 + 1000000000 * (total + 2) // (l.n + 2 * v) AS q
      FROM kept k JOIN langs l USING (lang) JOIN sums s USING (lang) LEFT JOIN counts c ON c.lang = k.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(f), 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN (SELECT x.lang, x.source, y.source AS item, (x.p - y.p) * (x.p - y.p) // (x.p + y.p) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source) z
      ON z.lang = a.lang AND z.source = a.source AND z.item = b.source GROUP BY ALL),
best AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
      UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT FROM best)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
""",
    "op12_vector_codes": f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS x FROM kept, range(8) r(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < 16),{"".join(map(_book, range(6)))}
codes AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM (SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM
  (SELECT vec_id, p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts JOIN c6 USING (p)) GROUP BY ALL) GROUP BY ALL)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(v, ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM c6)) AS codebooks_sha256
FROM codes JOIN kept USING (vec_id)
""",
}
