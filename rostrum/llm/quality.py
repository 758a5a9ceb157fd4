"""Quality by perplexity under an interpolated modified Kneser-Ney model of byte n-grams.

Trusted text gives n-gram counts per language; continuation counts, discounts and back-off weights are
Spark aggregations and joins sharded by n-gram. Documents are dealt into blocks of bounded size; a block
asks for its distinct n-grams once, the joins resolve their probabilities, and the answers meet the block
again to score its documents. Thresholds are quantiles of the perplexities of trusted documents that the
model has not learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import drop_saved, saved

ORDER = 4  # bytes; seven at most, so that n-grams are positive longs
#: One in so many trusted documents is held out of the model and sets the thresholds.
FOLDS = 4
_CHUNK = 1 << 20


def grams(text: bytes) -> np.ndarray:
    """The n-gram that ends at each byte, as a number; the text is led in by ORDER - 1 zero bytes."""
    b = np.frombuffer(bytes(ORDER - 1) + text, np.uint8)
    g = np.zeros(len(text), np.int64)
    for i in range(ORDER):
        g = (g << 8) | b[i : i + len(text)]
    return g


def _pressed(dealt: DataFrame) -> DataFrame:
    """(block, doc_id, text, lang) with the text as a zstd frame: the exchange of whole texts is the largest cost."""

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            made = [press.compress(x.as_py().encode("utf-8", "surrogatepass")) if x.is_valid else None for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary()), b.column(3)], names=["block", "doc_id", "text", "lang"])

    return dealt.mapInArrow(run, "block int, doc_id long, text binary, lang string")


def _opened(column):
    import zstandard

    open_ = zstandard.ZstdDecompressor()
    for x in column:
        yield open_.decompress(x.as_py()) if x.is_valid else None


def _distinct(texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of texts with counts, merged chunk by chunk."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting, size = [], 0

    def merge():
        nonlocal keys, counts, waiting, size
        k, n = np.unique(np.concatenate(waiting), return_counts=True)
        both, at = np.unique(np.concatenate((keys, k)), return_inverse=True)
        counts = np.bincount(at, np.concatenate((counts, n)), len(both)).astype(np.int64)
        keys, waiting, size = both, [], 0

    for text in texts:
        g = grams(text)
        waiting.append(g)
        size += len(g)
        if size >= _CHUNK:
            merge()
    if size:
        merge()
    return keys, counts


def _counted(key, docs: pa.Table, trusted: pa.Table) -> pa.Table:
    """Of one block: counts of trusted n-grams (n > 0), and all distinct n-grams as requests (n = 0)."""
    ids = {*trusted.column("doc_id").to_pylist()}
    texts: dict[str, tuple[list, list]] = {}
    for doc, text, lang in zip(docs.column("doc_id").to_pylist(), _opened(docs.column("text")), docs.column("lang").to_pylist()):
        good, every = texts.setdefault(lang, ([], []))
        if text:
            every.append(text)
            if doc in ids:
                good.append(text)
    out = [pa.table({"block": pa.array([], pa.int32()), "lang": pa.array([], pa.string()), "gram": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})]
    for lang, (good, every) in texts.items():
        for texts_, counted in ((good, True), (every, False)):
            k, n = _distinct(texts_)
            out.append(pa.table({
                "block": pa.array(np.full(len(k), key[0].as_py(), np.int32)), "lang": pa.array([lang] * len(k), pa.string()),
                "gram": pa.array(k), "n": pa.array(n if counted else np.zeros(len(k), np.int64)),
            }))
    return pa.concat_tables(out)


def _scored(key, docs: pa.Table, answers: pa.Table) -> pa.Table:
    known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    langs = answers.column("lang").to_numpy(zero_copy_only=False)
    g, p = answers.column("gram").to_numpy(), answers.column("logp").to_numpy().astype(np.float64)
    for lang in set(langs.tolist()):
        own = langs == lang
        order = np.argsort(g[own])
        known[lang] = g[own][order], p[own][order]
    sizes, sums = [], []
    for text, lang in zip(_opened(docs.column("text")), docs.column("lang").to_pylist()):
        x = grams(text) if text else np.zeros(0, np.int64)
        sizes.append(len(x))
        if not len(x) or lang not in known:
            sums.append(None)
            continue
        keys, values = known[lang]
        sums.append(float(sum(values[np.searchsorted(keys, x[i : i + _CHUNK])].sum() for i in range(0, len(x), _CHUNK))))
    return pa.table({
        "doc_id": docs.column("doc_id"), "lang": docs.column("lang"), "n_bytes": pa.array(sizes, pa.int64()),
        "logp": pa.array(sums, pa.float64()),
    })


def _mask(k: int) -> int:
    return (1 << (8 * k)) - 1


def probabilities(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lang, gram, logp) for the distinct ``wanted`` (lang, gram) of languages with ``counts`` (lang, gram, n).

    Orders below the highest count distinct left extensions. Discounts D1, D2, D3+ of each order and
    language come from its counts of counts. The lowest order is interpolated with uniform bytes.
    """
    seen = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        seen[k] = seen[k + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit(_mask(k))).alias("gram")).agg(F.count("*").alias("n"))
    langs = counts.select("lang").distinct()
    asked = wanted.join(langs, "lang", "left_semi")
    p = None
    for k in range(1, ORDER + 1):
        e = seen[k]
        of = [F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        d = e.groupBy("lang").agg(*of).select(
            "lang",
            *[
                F.greatest(F.lit(0.0), F.least(F.lit(float(i)), F.coalesce(i - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0)), F.lit(0.5)))).alias(f"d{i}")
                for i in (1, 2, 3)
            ],
        )
        context = F.shiftright("gram", 8).alias("context")
        c = e.groupBy("lang", context).agg(
            F.sum("n").alias("total"), F.sum((F.col("n") == 1).cast("long")).alias("u1"),
            F.sum((F.col("n") == 2).cast("long")).alias("u2"), F.sum((F.col("n") >= 3).cast("long")).alias("u3"),
        )
        r = asked.select("lang", F.col("gram").bitwiseAND(F.lit(_mask(k))).alias("gram")).distinct()
        r = r.withColumn("context", F.shiftright("gram", 8)).withColumn("short", F.col("gram").bitwiseAND(F.lit(_mask(k - 1))))
        r = r.join(e, ["lang", "gram"], "left").join(c, ["lang", "context"], "left").join(d, "lang", "left")
        if p is None:
            r = r.withColumn("below", F.lit(1 / 256))
        else:
            r = r.join(p.select("lang", F.col("gram").alias("short"), F.col("p").alias("below")), ["lang", "short"], "left")
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = F.coalesce(F.greatest(F.lit(0.0), F.col("n") - cut), F.lit(0.0))
        freed = F.col("d1") * F.col("u1") + F.col("d2") * F.col("u2") + F.col("d3") * F.col("u3")
        p = r.select(
            "lang", "gram", F.coalesce((own + freed * F.col("below")) / F.col("total"), F.col("below")).alias("p")
        )
    return p.select("lang", "gram", F.log(F.greatest(F.col("p"), F.lit(1e-12))).alias("logp"))


def perplexities(docs: DataFrame, trusted: DataFrame, quantile: float = 0.95, block_bytes: int = 24 << 20) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, kept for every document.

    ``trusted`` has the doc_id of documents to learn from. A language's threshold is the ``quantile`` of the
    perplexities (to 1 % of their logarithm) of those trusted documents that were held out, one in FOLDS by
    a hash of the doc_id; where none was, of those learned from. Documents above it are not kept. Null or
    empty texts have no perplexity and are not kept; those of a language without trusted text have none and
    are kept unjudged. Null languages are the language ``und``. Rows that repeat stay, and so do those
    without a doc_id, which are never trusted. An empty table gives no rows. Blocks are dealt by doc_id and
    text, so that neither an absent nor a repeated doc_id fills a block.
    """
    given = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    )
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    spread = min(blocks, 16)  # blocks that the rows of one doc_id are dealt to

    def block(part: Column) -> Column:
        return F.pmod(F.xxhash64("doc_id") + part, F.lit(blocks)).cast("int").alias("block")

    place = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int"))
    place = F.coalesce(place, block(F.pmod(F.xxhash64("text"), F.lit(spread)))).alias("block")
    dealt = _pressed(given.select(place, "doc_id", "text", "lang"))
    known = trusted.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)) == 0
    learned = known.where(~held).withColumn("part", F.explode(F.array(*map(F.lit, range(spread))))).select(block(F.col("part")), "doc_id")
    made = saved(
        dealt.groupBy("block").cogroup(learned.distinct().groupBy("block")).applyInArrow(_counted, "block int, lang string, gram long, n long")
    )
    counts = saved(made.where("n > 0").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    asked = made.where("n = 0").select("block", "lang", "gram")
    known_ = probabilities(counts, asked.select("lang", "gram").distinct())
    answers = asked.join(known_.withColumn("logp", F.col("logp").cast("float")), ["lang", "gram"])  # half the bytes to exchange
    scores = saved(
        dealt.groupBy("block").cogroup(answers.select("block", "lang", "gram", "logp").groupBy("block"))
        .applyInArrow(_scored, "doc_id long, lang string, n_bytes long, logp double")
    )
    drop_saved(made, counts)
    scores = scores.withColumn("log_ppl", -F.col("logp") / F.col("n_bytes")).drop("logp")
    judges = scores.join(known.withColumn("held", held), "doc_id").where("log_ppl is not null")
    bins = judges.groupBy("lang", "held", F.floor(F.col("log_ppl") * 100).alias("bin")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("lang", "held")
    bins = bins.withColumn("upto", F.sum("n").over(own.orderBy("bin"))).withColumn("all", F.sum("n").over(own))
    limits = bins.where(F.col("upto") >= quantile * F.col("all")).groupBy("lang", "held").agg((F.min("bin") + 1).alias("bin"))
    limits = limits.groupBy("lang").agg(F.max_by("bin", "held").alias("bin"))
    limits = limits.select("lang", F.exp(F.col("bin") / 100).alias("threshold"))
    out = scores.withColumn("perplexity", F.exp("log_ppl")).join(F.broadcast(limits), "lang", "left")  # one row a language
    kept = (F.col("n_bytes") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "n_bytes", "perplexity", "threshold", kept.alias("kept"))
