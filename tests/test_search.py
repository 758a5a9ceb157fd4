"""Stems, the full-text index and its search."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from rostrum.functions.stem import STOP_WORDS, stem

#: Word and stem, as published with the rules.
STEMS = dict(
    x.split(":")
    for x in (
        "consign:consign consigned:consign consigning:consign consignment:consign consist:consist consisted:consist consistency:consist consistent:consist "
        "consistently:consist consisting:consist consists:consist consolation:consol consolations:consol consolatory:consolatori console:consol consoled:consol "
        "consolidate:consolid consolidated:consolid consolidating:consolid consoling:consol consols:consol consonant:conson consort:consort conspicuous:conspicu "
        "conspicuously:conspicu conspiracy:conspiraci conspirator:conspir conspirators:conspir conspire:conspir conspired:conspir conspiring:conspir constable:constabl "
        "constables:constabl constance:constanc constancy:constanc constant:constant knack:knack knackeries:knackeri knacks:knack knave:knave knavish:knavish "
        "kneaded:knead kneading:knead knee:knee kneel:kneel kneeled:kneel kneels:kneel knew:knew knick:knick knif:knif knife:knife knight:knight knightly:knight "
        "knights:knight knit:knit knits:knit knitted:knit knitting:knit knives:knive knob:knob knock:knock knocked:knock knots:knot knotted:knot know:know known:known "
        "dying:die skies:sky news:news inning:inning innings:inning proceed:proceed proceeds:proceed proceeding:proceed hoping:hope hopping:hop gas:gas gaps:gap kiwis:kiwi "
        "ties:tie cries:cri by:by say:say enjoy:enjoy yes:yes boy:boy youth:youth generally:general generous:generous communities:communiti luxuriated:luxuri "
        "parliamentary:parliamentari rational:ration relational:relat ministers:minist agreed:agre feed:feed bed:bed shed:shed formally:formal apologies:apolog"
    ).split()
)


def test_stems(spark):
    rows = spark.createDataFrame([(w,) for w in [*STEMS, "o", "été", "日本", ""]] + [(None,)], "w string").select("w", stem(F.col("w")).alias("s")).collect()
    got = {r.w: r.s for r in rows}
    assert {w: got[w] for w in STEMS} == STEMS
    assert (got["o"], got["été"], got["日本"], got[""], got[None]) == ("o", "été", "日本", "", None)


def plain_search(stems, passages, queries, k):
    """All-terms matches by BM25 from the texts."""
    words = lambda t: [w for w in re.split(r"[^\w]+", (t or "").lower()) if w and w not in STOP_WORDS]
    docs = {i: Counter(stems[w] for w in words(t)) for i, t in passages}
    size = {i: sum(c.values()) for i, c in docs.items()}
    n, mean = len(docs), sum(size.values()) / len(docs)
    df = Counter(t for c in docs.values() for t in c)
    out = set()
    for q, text in queries:
        terms = {stems[w] for w in words(text)}
        hits = [i for i, c in docs.items() if terms and terms <= set(c)]
        score = lambda i: sum(
            math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * docs[i][t] * 2.2 / (docs[i][t] + 1.2 * (0.25 + 0.75 * size[i] / mean)) for t in terms
        )
        best = sorted(hits, key=lambda i: (-round(score(i), 9), i))[:k]
        out |= {(q, i, round(score(i), 8), r) for r, i in enumerate(best, 1)}
    return out


def test_search_equals_a_plain_scorer(spark):
    from rostrum.operators.fulltext import fulltext_index, search

    base = ["ministers agreed", "the minister", "Agreeing motions of the House", "motion: houses, housing!", "water", "budget estimates", "", None, "the of and", "the the the water"]
    passages = [(i, " ".join(filter(None, (base[i % 10], base[(i * 7) % 10], base[(i * i) % 10]))) if i % 10 != 7 else base[7]) for i in range(300)]
    queries = [(1, "the ministers"), (2, "Motions agreeing"), (3, "house housing"), (4, "of the"), (5, ""), (6, None), (7, "water zebra"), (8, "budget, estimate"), (9, "minister minister MINISTER")]
    index = fulltext_index(spark.createDataFrame(passages, "p long, body string"), "p", "body")
    got = {(r.q, r.id, round(r.score, 8), r.rank) for r in search(spark.createDataFrame(queries, "q long, text string"), index, 20).collect()}
    seen = {w for _, t in passages + queries for w in re.split(r"[^\w]+", (t or "").lower()) if w}
    stems = {r.w: r.s for r in spark.createDataFrame([(w,) for w in seen], "w string").select("w", stem(F.col("w")).alias("s")).collect()}
    assert got == plain_search(stems, passages, queries, 20)
    assert {q for q, *_ in got} >= {1, 2, 3, 8, 9} and not {q for q, *_ in got} & {4, 5, 6, 7}


def test_empty_index(spark):
    from rostrum.operators.fulltext import fulltext_index, search

    index = fulltext_index(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert search(spark.createDataFrame([(1, "water")], "q long, text string"), index, 5).count() == 0


def test_a_search_reads_postings_by_term_and_no_text(spark):
    from rostrum.operators.fulltext import fulltext_index

    index = fulltext_index(spark.createDataFrame([(1, "ministers agreed"), (2, "water")], "id long, text string"), "id", "text")
    plan = index.postings.where("term = 'minist'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,minist)" in plan and index.postings.columns == ["term", "id", "tf", "len"]


def test_index_meets_stems_by_blocks(spark, monkeypatch):
    """No step before the postings has a row for each word of each passage: one for each word of a batch of passages, and one for the batch."""
    from rostrum.operators import fulltext as X

    steps, plain = [], X.written
    monkeypatch.setattr(X, "written", lambda df: steps.append(out := plain(df)) or out)
    text = " ".join(f"walked walking river{i}" for i in range(20))
    index = X.fulltext_index(spark.createDataFrame([(i, text) for i in range(500)], "id long, text string").coalesce(1), "id", "text")
    assert index.postings.count() == 21 * 500 and {(r.tf, r.len) for r in index.postings.where("term = 'walk'").collect()} == {(40, 60)}
    before = [x.count() for x in steps if "df" not in x.columns and x.columns != index.postings.columns]
    assert len(before) >= 2 and max(before) <= 23


def test_index_of_many_batches(spark):
    """Odd passages in small batches: every posting once, with the counts of a term's words summed."""
    from rostrum.operators.fulltext import fulltext_index

    base = ["run running runs", None, "", "the of and", "Fluss fluß Été été", "housing houses house house", "日本 run", " ".join(f"w{i} ws{i}" for i in range(50))]
    passages = [(f"p{i:03}", base[i * i % 7 if i % 11 else 7]) for i in range(200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        index = fulltext_index(spark.createDataFrame(passages, "id string, text string").repartition(3), "id", "text")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    words = {i: [w for w in re.split(r"[^\w]+", (t or "").lower()) if w and w not in STOP_WORDS] for i, t in passages}
    stems = {r.w: r.s for r in spark.createDataFrame([(w,) for ws in words.values() for w in ws], "w string").distinct().select("w", stem("w").alias("s")).collect()}
    want = {(t, i): (n, len(ws)) for i, ws in words.items() for t, n in Counter(stems[w] for w in ws).items()}
    got = index.postings.collect()
    assert len(got) == len(want) and {(r.term, r.id): (r.tf, r.len) for r in got} == want
    assert {r.term: r.df for r in index.terms.collect()} == Counter(t for t, _ in want)
    assert [tuple(r) for r in index.totals.collect()] == [(200, sum(map(len, words.values())) / 200)]


def test_postings_are_summed_across_batches(monkeypatch):
    """Blocks of one term and batch stay together however they are cut, and what is held at once is bounded."""
    import random

    import pyarrow as pa

    from rostrum.operators import fulltext as X

    rng, rows = random.Random(2), []
    for term in "abcdefg":
        for batch in range(4):
            for _ in range(rng.randint(1, 3)):
                ids = sorted(rng.sample(range(batch * 10, batch * 10 + 10), rng.randint(1, 9)))
                rows.append({"term": term, "batch": batch, "ids": ids, "tfs": [rng.randint(1, 4) for _ in ids], "lens": [i + 50 for i in ids]})
    want = Counter()
    for r in rows:
        for i, tf in zip(r["ids"], r["tfs"]):
            want[r["term"], i] += tf
    monkeypatch.setattr(X, "ROWS", 30)
    schema = pa.schema({"term": pa.string(), "batch": pa.int64(), "ids": pa.list_(pa.int64()), "tfs": pa.list_(pa.int32()), "lens": pa.list_(pa.int32())})
    for size in (1, 2, 5, len(rows)):
        made = list(X._postings(pa.RecordBatch.from_pylist(rows[at : at + size], schema) for at in range(0, len(rows), size)))
        got = [(r["term"], r["id"], r["tf"], r["len"]) for b in made for r in b.to_pylist()]
        assert got == [(t, i, n, i + 50) for (t, i), n in sorted(want.items())] and max(b.num_rows for b in made) <= 60
    assert list(X._postings(iter([]))) == []


def recall(found, exact):
    held = Counter()
    for q, id_ in found:
        held[q] += id_ in exact[q]
    return sum(held.values()) / sum(map(len, exact.values()))


def exact_nearest(vectors, queries, k):
    import numpy as np

    ids = np.array(sorted(i for i, v in vectors.items() if v is not None))
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return {q: set(ids[np.lexsort((ids, -(x @ (np.array(vectors[q]) / np.linalg.norm(vectors[q])))))[:k]].tolist()) for q in queries}


def test_vector_index_recall_on_the_table(spark):
    """Every row whose id is divisible by 50 against all rows: at least 0.9 of the true ten nearest."""
    from rostrum import plans, registry  # noqa: F401

    sf = "/root/testdata/sf0.01"
    vectors = {r.vec_id: r.embedding for r in registry.table(spark, sf, "embeddings").collect()}
    got = registry.QUERIES["r2_vector_index"](spark, sf).collect()
    exact = exact_nearest(vectors, [i for i, v in vectors.items() if i % 50 == 0 and v is not None], 10)
    assert {r.q for r in got} == set(exact) and recall([(r.q, r.id) for r in got], exact) >= 0.9
    assert all(sorted(r.rank for r in got if r.q == q) == list(range(1, 11)) for q in exact)


def test_vector_index_of_odd_rows(spark):
    from rostrum.operators.vectorindex import nearest_vectors, vector_index

    rows = [(i, [1.0, float(i), 0.5, -float(i % 3)]) for i in range(40)] + [(40, None), (41, []), (42, [0.0] * 4), (43, [float("nan")] * 4), (None, [1.0] * 4), (44, [1.0, None, 2.0, 3.0]), (45, [1.0] * 7)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = nearest_vectors(df, vector_index(df, "id", "v"), "id", "v", 3).collect()
    assert {r.q for r in got} == set(range(40)) and {r.id for r in got} <= set(range(40)) and len(got) == 120
    assert all(r.id == r.q or r.rank > 1 or r.score > 0.999 for r in got)
    empty = df.where("id < 0")
    assert nearest_vectors(df, vector_index(empty, "id", "v"), "id", "v", 3).count() == 0


def test_vector_index_of_clusters_needs_few_lists(spark):
    import numpy as np

    from rostrum.operators.vectorindex import nearest_vectors, vector_index

    rng = np.random.default_rng(5)
    middles = rng.normal(size=(40, 24)) * 3
    vectors = {i: (middles[i % 40 if i % 3 else 0] + rng.normal(size=24) * 0.4).tolist() for i in range(3000)}  # a third of all in one cluster
    df = spark.createDataFrame(list(vectors.items()), "id long, v array<double>")
    asked = [i for i in vectors if i % 50 == 0]
    got = nearest_vectors(df.where("id % 50 = 0"), vector_index(df, "id", "v"), "id", "v", 10, probes=14).collect()
    assert recall([(r.q, r.id) for r in got], exact_nearest(vectors, asked, 10)) >= 0.9


def test_vector_tasks_hold_a_bounded_part(monkeypatch):
    """However many queries and lists meet, what Python holds at once is bounded, and no part of them is lost."""
    import numpy as np

    from rostrum.operators import vectorindex as V

    rng = np.random.default_rng(3)
    v, centres, books = (rng.normal(size=s).astype(np.float32) for s in ((500, 8), (60, 8), (4, 16, 2)))
    codes, ids = rng.integers(0, 16, (300, 4)), np.arange(300) * 2
    monkeypatch.setattr(V, "MET_VALUES", 6000)
    probes = list(V._probes(v, centres, 40))
    assert max(map(len, probes)) == 100 and (np.concatenate(probes) == np.argsort((centres**2).sum(1) / 2 - v @ centres.T, 1, kind="stable")[:, :40]).all()
    near = (v @ centres[0])[:, None] + v @ np.stack([books[p][codes[:, p]] for p in range(4)], 1).reshape(300, 8).T
    got = list(V._shortlisted(v, codes, ids, centres[0], books, 20))
    assert [first for first, *_ in got] == list(range(0, 500, 16))
    assert (np.sort(np.concatenate([s for *_, s in got]), 1) - np.sort(near, 1)[:, -20:] < 1e-4).all() and {tuple(sorted(r)) for _, i, _ in got for r in i} == {tuple(sorted(ids[r])) for r in np.argsort(-near, 1)[:, :20]}


def test_vectors_meet_lists_outside_python(spark, monkeypatch):
    """A query's vector leaves Python once, not once for each list that it meets."""
    from rostrum.operators import vectorindex as V

    seen = []
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(100)], "id long, v array<float>")
    index, plain = V.vector_index(df, "id", "v"), type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, f, schema: seen.append((out := plain(self, f, schema), self)) or out)
    V.nearest_vectors(df, index, "id", "v", 3)
    assert [out.count() for out, _ in seen] == [asked.count() for _, asked in seen] == [100]


def test_trigram_search_equals_all_pairs(spark):
    """The prefixes lose no pair: random names, repeated rows and queries, blanks and nulls."""
    import random

    from rostrum.operators.dictionary import trigram_search

    rng = random.Random(3)
    name = lambda: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 3)))
    names = [(i, name()) for i in range(250)] + [(250, ""), (251, None), (252, "Abc Abc"), (252, "Abc Abc")]
    queries = [name() for _ in range(60)] + [names[3][1]] * 2 + ["", None, "abc"]

    def grams(t):
        return {f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", (t or "").lower()) for i in range(len(w) + 1)}

    want = {}
    for q in set(queries):
        for i, t in names:
            a, b = grams(q), grams(t)
            if a and b and len(a & b) / len(a | b) > 0.3:
                want[q, i] = len(a & b) / len(a | b)
    table = spark.createDataFrame([(i, t, t) for i, t in names], "id long, canonical string, text string")
    got = trigram_search(spark.createDataFrame([(q,) for q in queries], "q string"), table, most=1000).collect()
    assert len(got) == len(want) and {(r.q, r.id): r.similarity for r in got} == want and len(want) > 100
