"""Every query of the engine against its SQL in DuckDB, and unit tests of functions, walks, readers and writers."""

import os

import duckdb
import pytest

from rostrum import plans, registry  # noqa: F401

DIR = os.environ.get("ROSTRUM_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "float", round(v, 9)
    return ("int" if isinstance(v, int) and not isinstance(v, bool) else type(v).__name__), v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in registry.SQL:
        assert rows
        return
    found = duck.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert rows == want


@pytest.mark.parametrize("name", ["e2_exact", "e3_e4_fused", "e5_initials", "e6_phonetic", "e9_component"])
def test_query_makes_its_own_index(spark, name):
    """A query whose kinds of keys nothing has made before in the session gives the rows that it gives beside all others."""
    found = lambda: sorted(map(tuple, registry.QUERIES[name](spark, DIR).collect()))
    kept = spark.__dict__.pop("_rostrum_indexes", None)
    try:
        alone = found()
        del spark.__dict__["_rostrum_indexes"]
        plans.matching.index_of(spark, DIR)
        assert alone and alone == found()
    finally:
        if kept is not None:
            spark.__dict__["_rostrum_indexes"] = kept


def test_text_functions_on_accents(spark):
    """Whole words with accents, composed or not, pass the normalisers and the whole-table queries lose no row."""
    from pyspark.sql import functions as F

    from rostrum.functions import textfn as T

    texts = ["«Élan vital», ça va?", "Cafe\u0301 au lait!", "Ñandú… y más", "ÜBER straße", None, "日本語 テスト"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select(T.align_key("text"), T.passage_key("text"), T.question_key("text"), T.edge_stripped(F.split("text", " ")[0])).collect()
    assert [tuple(r) for r in rows] == [
        ("élanvitalçava", "élan vital ça va", "«élan vital», ça va", "élan"), ("cafe\u0301aulait", "cafe\u0301 au lait", "cafe\u0301 au lait", "cafe\u0301"),
        ("ñandúymás", "ñandú y más", "ñandú… y más", "ñandú"), ("überstraße", "über straße", "über straße", "über"), (None,) * 4,
        ("日本語テスト", "日本語 テスト", "日本語 テスト", "日本語"),
    ]
    for name, of in (
        ("f6_token_normalise", "documents"), ("f7_f8_keys", "documents"), ("f9_f10_questions", "benchmark"), ("f37_flatten_segments", "benchmark"),
        ("w6_all_uppercase_span", "benchmark"), ("r11_equal_length_apply", "conversations"), ("r14_guards", "conversations"),
    ):
        assert registry.QUERIES[name](spark, DIR).count() == registry.table(spark, DIR, of).count(), name


def test_whole_tables_are_compared(spark):
    def rows(name):
        return registry.table(spark, DIR, name).count()

    q = lambda n: registry.QUERIES[n](spark, DIR)
    assert q("a20_parity_counts").agg({"n_target": "sum"}).first()[0] == rows("customer")
    assert q("j10_sittings_with_records").count() == rows("customer")
    assert q("s13_edit_save").count() == registry.table(spark, DIR, "orders").select("o_custkey").distinct().count()
    assert q("t3_reconcile_whole").agg({"missing": "sum"}).first()[0] == registry.table(spark, DIR, "conversations").where("role = 'assistant'").count()
    assert q("e29_fallback_lookup").count() >= rows("nation")


#: (period, start, end, label) as of noon of 15 March 2024.
PERIODS = (
    (None, "2024-03-08 12:00", "2024-03-15 12:00", "the last 7 days"), (" Recent", "2024-03-08 12:00", "2024-03-15 12:00", "the last 7 days"),
    ("all time", "1970-01-01 00:00", "2024-03-16 12:00", "the whole registry"), ("Everything", "1970-01-01 00:00", "2024-03-16 12:00", "the whole registry"),
    ("today", "2024-03-15 00:00", "2024-03-15 12:00", "today"), ("this month", "2024-03-01 00:00", "2024-03-15 12:00", "March 2024"),
    ("last month", "2024-02-01 00:00", "2024-03-01 00:00", "February 2024"), ("last 10 days", "2024-03-05 12:00", "2024-03-15 12:00", "the last 10 days"),
    ("2023-12", "2023-12-01 00:00", "2024-01-01 00:00", "December 2023"), ("2024-03", "2024-03-01 00:00", "2024-03-15 12:00", "March 2024"),
    ("2024-01-02..2024-01-03", "2024-01-02 00:00", "2024-01-04 00:00", "2024-01-02 to 2024-01-03"), ("July 2023", "2023-07-01 00:00", "2023-08-01 00:00", "July 2023"),
    ("Jan.", "2024-01-01 00:00", "2024-02-01 00:00", "January 2024"), ("february", "2024-02-01 00:00", "2024-03-01 00:00", "February 2024"), ("", "2024-03-08 12:00", "2024-03-15 12:00", "the last 7 days"),
    ("April", "2024-04-01 00:00", "2024-03-15 12:00", "April 2024"), ("last 1 day", "2024-03-14 12:00", "2024-03-15 12:00", "the last 1 days"), ("december 2023", "2023-12-01 00:00", "2024-01-01 00:00", "December 2023"),
)


def test_periods(spark):
    """Every form as its range and label; what is no period is null."""
    from pyspark.sql import functions as F

    from rostrum.functions.periods import period_of

    wrong = ("someday", "2024-13", "2024-01-02 to 2024-01-03", "last week", "smarch 2024", "2024-02-30..2024-03-01", "last 99999999999 days")
    asked = spark.createDataFrame([(p,) for p, *_ in PERIODS] + [(w,) for w in wrong], "asked string")
    made = period_of(F.col("asked"), F.lit("2024-03-15 12:00:00").cast("timestamp"))
    rows = asked.select("asked", made.alias("p")).select("asked", F.date_format("p.start", "yyyy-MM-dd HH:mm"), F.date_format("p.end", "yyyy-MM-dd HH:mm"), "p.label").collect()
    assert [tuple(r) for r in rows] == [*PERIODS, *((w, None, None, None) for w in wrong)]
    plan = registry.QUERIES["f13_period_month"](spark, DIR)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan


def test_settings():
    from rostrum.functions.settings import Hybrid, hybrid

    said = []
    assert hybrid({}, said.append) == Hybrid() and not said
    given = {"HYBRID_CONFIDENCE_THRESHOLD": "0.5x", "HYBRID_GAP_TOLERANCE": "2", "HYBRID_PADDING": "", "HYBRID_MAX_CALLS_PER_MODEL": " 3 "}
    assert hybrid(given, said.append) == Hybrid(0.5, 2.0, 0.25, 3) and not said
    wrong = {"HYBRID_CONFIDENCE_THRESHOLD": "1.5", "HYBRID_GAP_TOLERANCE": "-1", "HYBRID_PADDING": "much", "HYBRID_MAX_CALLS_PER_MODEL": "2.5"}
    assert hybrid(wrong, said.append) == Hybrid() and len(said) == 4


def test_turn_chunks(spark):
    """Streamed chunks equal those of a plain walk over each turn."""
    import random

    from rostrum.operators.walks import turn_chunks

    rng = random.Random(5)
    rows, at = [], 0.0
    for k in range(400):
        at += rng.choice([0.5, 0.5, 2.5, 4.0])
        rows.append((k // 200, k, f"w{k}", "s" if k < 120 else rng.choice([None, "t", "t", "t", "t"]), at, at + 0.4, f"n{k}" if k % 9 == 0 else None))
    words = spark.createDataFrame(rows, "id long, k int, word string, speaker string, start double, end double, entity string")
    got = [tuple(r) for r in turn_chunks(words, "id", ["k"], 5, 12, 2.0).orderBy("id", "ordinal").collect()]
    want, turns = [], []
    for r in rows:
        if not turns or turns[-1][-1][0] != r[0] or turns[-1][-1][3] != r[3]:
            turns.append([])
        turns[-1].append(r)
    for t in turns:
        while t:
            n = len(t)
            if n > 12:
                gaps = [(t[j][4] - t[j - 1][5], -j) for j in range(5, 12) if t[j][4] - t[j - 1][5] >= 2.0]
                n = -max(gaps)[1] if gaps else 12
            own, t = t[:n], t[n:]
            ordinal = sum(x[0] == own[0][0] for x in want)
            want.append((own[0][0], ordinal, own[0][3], n, own[0][4], own[-1][5], " ".join(x[2] for x in own), sorted(x[6] for x in own if x[6])))
    assert got == want


def test_readers(spark, tmp_path):
    from rostrum.sources import readers, writers

    (tmp_path / "terms.txt").write_text("Alpha\nalpha, Beta\n<bad>\n\nGamma\n")
    have = spark.createDataFrame([("GAMMA",)], "term string")
    got = {r.term: r.outcome for r in readers.term_import(spark, str(tmp_path / "terms.txt"), have, capacity=2).collect()}
    assert got == {"Alpha": "added", "alpha": "duplicate", "Beta": "over capacity", "<bad>": "invalid", "Gamma": "existing"}
    (tmp_path / "words.txt").write_text("One\ntwo words\n\nthree\n")
    assert sorted(r.token for r in readers.word_list(spark, str(tmp_path / "words.txt"), least=2).collect()) == ["one", "three"]
    assert readers.word_list(spark, str(tmp_path / "words.txt"), least=3) is None
    names = spark.createDataFrame([("Tema", "place")], "canonical string, entity_type string")
    writers.export_dictionary(names, str(tmp_path / "csv"), str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).collect() == spark.read.json(str(tmp_path / "json")).select("canonical", "entity_type").collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert entry._optional("rostrum.no_such_part") is None
    assert set(entry.oracle_sql()) <= set(entry.queries())
