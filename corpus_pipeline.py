"""The corpus pipeline: language ID, near-duplicates, decontamination, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last
return the columns of ``documents``. ``run`` writes each stage's rows as Parquet to the shared folder and
reads them again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm import langid, packing, pii
from rostrum.llm.common import drop_saved, drop_since, made_so_far, saved, table
from rostrum.llm.decontaminate import decontaminate
from rostrum.llm.neardup import near_duplicates
from rostrum.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: What a stage wrote for its own result, which goes once the next stage reads that result from its own files.
_LEFT: list[DataFrame] = []


def _drop_left(docs: DataFrame) -> None:
    """Drop what the stage before wrote on its way, but for what ``docs`` still reads."""
    read = docs.inputFiles()
    for df in [df for df in _LEFT if not any(df._rostrum_path.removeprefix("file://") in f for f in read)]:
        drop_saved(df)
        _LEFT.remove(df)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are of no language; fills null langs with the predicted one.

    Null, empty and letterless texts go, and those far less like their language's prototype than that
    language's own texts of their length (:func:`rostrum.llm.langid.likely`). All other rows stay,
    repeated ones and those without a doc_id too; an empty table gives none.
    """
    prototypes = langid.train(docs.where(~langid.held_out()))
    scored = saved(langid.predict(docs.select(*COLUMNS), prototypes, keep=True))
    _LEFT.append(scored)
    out = scored.where(langid.likely(scored, list(prototypes))).withColumn("lang", F.coalesce("lang", "lang_pred"))
    return out.select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group (five words, 0.8): the one with the smallest doc_id.

    Equal rows are one document. A doc_id with several texts keeps those whose group it stands for. Rows
    without a doc_id stay, one for each text, only where no document of their group has one. Texts
    without words are alone in their group. An empty table gives no rows.
    """
    _drop_left(docs)
    kept = near_duplicates(docs, width=5, percent=80).where("kept")
    kept = kept.select(F.coalesce("doc_id", F.lit(-1)).alias("id"), "doc_id", "text_hash").distinct().withColumnRenamed("doc_id", "named")
    given = docs.withColumns({"id": F.coalesce("doc_id", F.lit(-1)), "text_hash": F.xxhash64("text")})
    same = (F.col("named").isNull() == F.col("doc_id").isNull())
    one = given.join(kept, ["id", "text_hash"]).where(same).dropDuplicates(["id", "named", "text_hash"])
    return one.select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark spans out of the texts; drops documents that are mostly benchmark or left empty.

    Documents without a hit stay as they are, null and empty texts too; rows that repeat stay.
    """
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, max_cover=0.5)
    out = out.where("n_hit = 0 or length(trim(clean)) > 0").withColumn("text", F.col("clean"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in angle brackets; keeps every row (null and empty texts as they are)."""
    out = pii.detect(docs, pii.fit(docs)).withColumn("text", F.col("redacted"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens (null and empty texts: the end id alone)."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), size=1024, end_id=2)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("best-fit packing", packed),
]

#: Stages cannot be expressed in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark = made_so_far()
        done = saved(stage(spark, docs, sf_dir))
        drop_since(mark, done)  # what the stage itself wrote, and the stage before
        drop_saved(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
