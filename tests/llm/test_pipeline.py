"""The pipeline against a brute-force version of its stages."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from rostrum.llm import pii  # noqa: E402
from rostrum.llm.common import saved, table  # noqa: E402

from .test_operators import brute_groups  # noqa: E402

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    given = table(spark, DIR, "documents")
    odd = spark.createDataFrame([(90_001, None, "en", "x", 0), (90_002, "12 34 !!", "en", "x", 8)], given.schema)
    docs = given.unionByName(odd)
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, DIR))
        out[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    rows = {name: {r.doc_id: r for r in df.collect()} for name, df in out.items() if name != "best-fit packing"}
    first, second, third, fourth = rows.values()
    # letterless texts go, all others stay
    letters = {r.doc_id for r in given.collect() if any(c.isalpha() for c in r.text or "")}
    assert set(first) == letters
    # one of each near-duplicate group stays
    groups = brute_groups([(i, r.text) for i, r in first.items()], 5)
    assert set(second) == {c for _, c in groups.values()}
    # no benchmark window is left, clean texts are as they were
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in table(spark, DIR, "benchmark").collect():
        w = word.findall(r.text.lower())
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))}

    def hit(text):
        w = word.findall(text.lower())
        return any(tuple(w[k : k + 10]) in windows for k in range(len(w)))

    for i, r in second.items():
        assert i not in third or (third[i].text == r.text) == (not hit(r.text))
        assert i in third or hit(r.text)
    # no base span is left
    assert set(fourth) == set(third)
    for i, r in third.items():
        assert not pii.base_spans(fourth[i].text) or not pii.base_spans(r.text)
        assert fourth[i].n_chars == len(fourth[i].text)
    # everything is packed, no sequence overflows
    pieces = out["best-fit packing"].collect()
    assert {r.doc_id for r in pieces} == set(fourth)
    used = Counter()
    for r in pieces:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024


def test_language_stage(spark):
    """Other scripts and random letters go; short clean texts and those of a null lang stay."""
    import numpy as np

    rng = np.random.default_rng(4)
    docs = table(spark, DIR, "documents")
    letters = list("abcdefghijklmnopqrstuvwxyz")
    noise = [" ".join("".join(rng.choice(letters, 9)) for _ in range(120)) for _ in range(10)]
    other = ["".join(chr(0x4E00 + int(k)) for k in rng.integers(0, 5000, 300)), " ".join("".join(chr(0x430 + int(k)) for k in rng.integers(0, 32, 6)) for _ in range(90))]
    short = ["the and", "one", "Was it there, and with that?"]
    rows = [(80_000 + i, t, None, "x", len(t)) for i, t in enumerate(noise + other + short)]
    rows += [(None, "the and of it", "en", "x", 1), (None, "the and of it", "en", "x", 1), (81_000, "", "en", "x", 0)]
    given = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    out = corpus_pipeline.language_id(spark, given, DIR)
    got = Counter(r.doc_id for r in out.collect())
    assert not [i for i in range(80_000, 80_000 + len(noise + other)) if got[i]]
    assert all(got[80_000 + len(noise + other) + i] for i in range(len(short))) and got[None] == 2 and not got[81_000]
    assert out.where("lang is null").count() == 0
    clean = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert clean <= set(got)
    assert corpus_pipeline.language_id(spark, docs.limit(0), DIR).count() == 0


def test_near_dedup_stage(spark):
    """Rows of one doc_id with different texts, and rows without one, are judged by their texts."""
    a, b, c = "a b c d e f g h i j k l m n", "o p q r s t u v w x y z", "one two three four five six seven"
    rows = [(7, a), (7, b), (9, a), (3, b), (3, b), (None, a), (None, c), (None, c), (8, None), (8, None), (-1, "alone here with some words")]
    docs = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, DIR)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted([(7, a), (3, b), (None, c), (8, None), (-1, rows[-1][1])], key=key)


def test_run_matches_stages(spark):
    rows = corpus_pipeline.run(spark, DIR)
    assert rows.columns[:2] == ["doc_id", "piece"] and rows.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_what_a_stage_left_goes_once_it_is_not_read(spark, tmp_path):
    """The next stage drops what the language stage wrote, unless its documents still read it."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    corpus_pipeline._LEFT.clear()
    lazy = corpus_pipeline.language_id(spark, docs, "/root/testdata/sf0.001")
    corpus_pipeline._drop_left(lazy)
    assert len(corpus_pipeline._LEFT) == 1 and lazy.count()
    lazy.write.parquet(str(tmp_path / "docs"))
    corpus_pipeline._drop_left(spark.read.parquet(str(tmp_path / "docs")))
    assert not corpus_pipeline._LEFT


def test_language_id_holds_little(spark):
    """The bound vectors that a task keeps never take more rows than their bound, and texts pass once, unchanged."""
    import numpy as np

    from rostrum.llm import langid

    enc = langid.Encoder(5, 64, most=3000)
    few = langid.Encoder(5, 64, most=100_000)
    for k in range(6):
        grams = np.unique(np.random.default_rng(k).integers(97, 123, (2000, 3)) @ np.array([1 << 42, 1 << 21, 1]))
        assert (enc.document(grams, np.ones(len(grams), np.int64)) == few.document(grams, np.ones(len(grams), np.int64))).all()
        assert len(enc.vectors) <= 3000
    docs = spark.createDataFrame([(1, "one text"), (2, None), (3, "")], "doc_id long, text string")
    kept = langid.predict(docs, {}, keep=True)
    assert kept.columns == ["doc_id", "text", "lang_pred", "score", "n_grams"]
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(1, "one text"), (2, None), (3, "")}
