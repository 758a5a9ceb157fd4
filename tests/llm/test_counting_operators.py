"""Source divergence, vector codes and lattice scores against brute force and their SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.llm import divergence, lattice, queries, vectorcodes

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def by_sql(name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    found = con.execute(queries.SQL[name])
    return [d[0] for d in found.description], sorted(found.fetchall())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    df = queries.QUERIES[name](spark, DIR)
    names, want = by_sql(name)
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == want


# Source divergence


def brute_divergences(rows, least, top):
    """rows: (lang, source, text)."""
    terms = lambda t: re.findall(r"[a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        counts[lang or "", source or ""].update(terms(text))
        docs[lang or ""].update(set(terms(text)))
    out = set()
    for lang in {g[0] for g in counts}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        groups = {g[1]: [c[t] for t in kept] for g, c in counts.items() if g[0] == lang}
        groups[None] = [sum(c) for c in zip(*groups.values())]
        p = {s: [1 + 10**9 * (c + 2) // (sum(cs) + 2 * len(kept)) for c in cs] for s, cs in groups.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for a in set(groups) - {None}:
            pairs = [(b, sum(map(f, p[a], p[b]))) for b in groups if b not in (None, a)]
            best = [(t, f(x, y)) for t, x, y, c in zip(kept, p[a], p[None], groups[a]) if c and x > y]
            for part, found, most in (("pair", pairs, None), ("term", best, top)):
                for k, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.add((lang, a, part, item, value, k + 1))
    return out


@pytest.mark.parametrize("seat,slice_,wave", [(1, 40, 2), (3, 1 << 14, 8)])
def test_divergences(spark, docs, monkeypatch, seat, slice_, wave):
    """Many seats, slices and waves give the same as few; odd rows too."""
    monkeypatch.setattr(divergence, "SEAT_GROUPS", seat)
    monkeypatch.setattr(divergence, "SLICE_TERMS", slice_)
    monkeypatch.setattr(divergence, "WAVE", wave)
    monkeypatch.setattr(divergence, "_MOST", 1 << 18 if seat > 1 else 500)
    odd = [(None, None, None), ("en", None, "The THE the ÉTÉ ête x-y"), ("en", "a", ""), ("xx", "a", "one"), ("xx", "b", "one two"), ("yy", "only", "alone"), ("en", "Ω", "the " * 5000)]
    odd += [("xx", "c", "one"), ("xx", "c", "one")] * 3
    given = docs.select("lang", "source", "text").unionByName(spark.createDataFrame(odd, "lang string, source string, text string")).withColumn("part", F.lit(1))
    got = divergence.divergences(given, 3, 4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in got.collect()} == brute_divergences([(r.lang, r.source, r.text) for r in given.collect()], 3, 4)


def test_divergences_without_terms(spark):
    schema = "lang string, source string, text string"
    assert divergence.divergences(spark.createDataFrame([], schema)).count() == 0
    got = divergence.divergences(spark.createDataFrame([("a", "x", "few words"), ("a", "y", None)], schema)).collect()
    assert sorted(map(tuple, got)) == [("a", "x", "pair", "y", 0, 1), ("a", "y", "pair", "x", 0, 1)]


def test_share_is_exact():
    big = [0, 1, 7, 10**10, 3 * 10**12]
    assert divergence.share(np.array(big), 4 * 10**12, 10**7).tolist() == [1 + 10**9 * (c + 2) // (4 * 10**12 + 2 * 10**7) for c in big]


def test_every_two_seats_meet_once(spark):
    for n in (1, 2, 3, 6, 7):
        seats = spark.createDataFrame([("l", 0, k, n, k) for k in range(n)], "lang string, slice int, seat int, seats int, guest int")
        met = [(r.seat, r.guest) for r in divergence._visitors(seats, 0, n + 1).collect()]
        assert sorted(map(sorted, met)) == [[a, b] for a in range(n) for b in range(a + 1, n)], n


# Vector codes


def brute_codes(rows, entries=16, rounds=6):
    """rows: (vec_id, label, vector) in order."""
    kept = [(i, l, [math.floor(4096 * x) for x in v]) for i, l, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][2]) // 8
    part = lambda v, p: v[p * size : (p + 1) * size]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[part(v, p) for _, _, v in kept[:entries]] for p in range(8)]
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (dist(part(v, p), books[p][e]), e))
    for _ in range(rounds):
        new = []
        for p in range(8):
            of = defaultdict(list)
            for _, _, v in kept:
                of[near(v, p)].append(part(v, p))
            new.append([[sum(c) // len(c) for c in zip(*of[e])] if e in of else b for e, b in enumerate(books[p])])
        books = new
    codes = {(i, tuple(v)): [near(v, p) for p in range(8)] for i, _, v in kept}
    error = {k: sum(dist(part(k[1], p), books[p][e]) for p, e in enumerate(c)) for k, c in codes.items()}
    by_label = Counter()
    for i, l, v in kept:
        by_label[l] += error[i, tuple(v)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{e:02x}" for e in codes[i, tuple(v)]), error[i, tuple(v)], by_label[l], digest) for i, l, v in kept)


def coded(df):
    return sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vectorcodes.vector_codes(df).collect())


def test_vector_codes(spark, monkeypatch):
    """Small blocks, ties, repeated vectors, null labels and broken vectors, with 16 components."""
    monkeypatch.setattr(vectorcodes, "BLOCK", 50)
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 3) if i % 4 else None, [float(x) for x in rng.integers(-3, 3, 16) / 4]) for i in range(400)]
    rows += [(399, 1, rows[399][2])] * 2 + [(500, 1, None), (501, 1, [None] * 16), (502, 1, [float("nan")] * 16), (503, 1, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("code", F.lit("x")).withColumn("of", F.lit("y"))
    assert coded(df) == brute_codes(rows)
    few = spark.createDataFrame(rows[:5], "vec_id long, label int, embedding array<float>")
    assert coded(few) == brute_codes(rows[:5])


def test_vector_codes_odd(spark):
    schema = "vec_id long, label string, embedding array<float>"
    assert vectorcodes.vector_codes(spark.createDataFrame([], schema)).count() == 0
    got = coded(spark.createDataFrame([(2, "a", [1e38] * 9), (1, "a", [0.0] * 9), (None, None, [0.5] * 9), (3, "b", [1.0] * 4), (4, "b", [])], schema)[["vec_id", "label", "embedding"]].where("vec_id is not null"))
    assert [r[0] for r in got] == [1, 2]  # another length than the first's is dropped
    assert got[1][2] == 0  # its own entry
    null_id = vectorcodes.vector_codes(spark.createDataFrame([(None, None, [0.5] * 8), (1, None, [0.0] * 8)], schema)).orderBy("code").collect()
    assert [(r.vec_id, r.code) for r in null_id] == [(1, "00" * 8), (None, "01" * 8)]


def test_heaps_spare_comparisons(spark):
    """In well-parted data hardly any part is looked at again once entries come to rest."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(16, 16)) * 3
    rows = [(i, 0, [float(x) for x in centres[i % 16] + rng.normal(size=16) / 50]) for i in range(3000)]
    state, _, _ = vectorcodes.fitted(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"))
    assert state.agg({"scanned": "sum"}).first()[0] < 3000 * 8 / 20


def test_heaps_settle_as_brute_force():
    rng = np.random.default_rng(4)
    x = rng.integers(-50, 50, (300, 16)).astype(np.int32)
    books = [rng.integers(-50, 50, (5, 2)) for _ in range(8)]
    drift, heaps = np.zeros((8, 5)), []
    for p, (a, b) in enumerate(vectorcodes.cuts(16)):
        heaps.append(vectorcodes.Heaps.empty(5))
        heaps[p].push(np.arange(300, dtype=np.uint16), *vectorcodes._nearest(x[:, a:b], books[p]), drift[p])
    for _ in range(30):
        new = [b + rng.integers(-2, 3, b.shape) for b in books]
        drift, books = vectorcodes.drifted(drift, books, new), new
        vectorcodes._settle(x, heaps, books, drift, None)
        for p, (a, b) in enumerate(vectorcodes.cuts(16)):
            assert (heaps[p].entries(300) == vectorcodes.distances(x[:, a:b], books[p]).argmin(1)).all()


# Lattice scores

PIECES = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "▁aba", *range(256)]


def brute_paths(word, lattice_):
    """Every segmentation as (weight, pieces)."""
    s = lattice.MARK + word
    found = []

    def walk(at, weight, used):
        if at == len(s):
            found.append((weight, used))
        for end in range(at + 1, len(s) + 1):
            if s[at:end] in PIECES:
                walk(end, weight + lattice_.weights[PIECES.index(s[at:end])], [*used, PIECES.index(s[at:end])])
            elif end == at + 1:
                own = [PIECES.index(b) for b in s[at].encode()]
                walk(end, weight + sum(lattice_.weights[k] for k in own), used + own)

    walk(0, 0.0, [])
    return found


def test_lattice_sums_all_segmentations():
    rng = np.random.default_rng(3)
    tool = lattice.Lattice(PIECES, np.log(rng.random(len(PIECES)) / 200))
    for word in ("a", "ab", "abab", "babba", "xé", "ab" * 5, "日"):
        paths = brute_paths(word, tool)
        whole = math.log(sum(math.exp(w) for w, _ in paths))
        assert math.isclose(tool.forward(word), whole, rel_tol=1e-12)
        want = Counter()
        for w, used in paths:
            for k in used:
                want[k] += 3 * math.exp(w - whole)
        got = [0] * len(PIECES)
        tool.expect(word, 3, got)
        assert all(math.isclose(n / lattice._ONE, want[k], abs_tol=1e-3) for k, n in enumerate(got))
    assert math.isfinite(tool.forward("ab" * 50_000))


def test_lattices_side_by_side():
    """Many words at once give what each gives alone: those in the table, with other characters, long and repeated."""
    rng = np.random.default_rng(6)
    weights = np.log(rng.random(len(PIECES)) / 200)
    tool = lattice.Lattices(PIECES, weights, letters=2, longest=9)  # b is in no table
    full = lattice.Lattices(PIECES, weights, longest=9)
    many = ["".join(rng.choice([*"aab"], n)) for n in rng.integers(1, 14, 300)] + ["xé", "a", "a", "日", "▁a"]
    times = rng.integers(1, 9, len(many))
    want, counts = [full.forward(w) for w in many], [0] * len(PIECES)
    for w, n in zip(many, times.tolist()):
        full.expect(w, n, counts)
    for t in (tool, full):
        assert np.allclose(t.forwards(many), want, rtol=1e-12)
        got = np.zeros(len(PIECES), np.int64)
        t.expects(many, times, got)
        assert np.abs(got - counts).max() <= len(many)  # roundings of a half
    assert sum(len(p) for p, letters in full._groups(many) if letters is not None) > 150


def test_bags():
    rng = np.random.default_rng(5)
    for n in (0, 1, 700):
        places, counts = np.sort(rng.permutation(2000)[:n]).astype(np.int64), rng.integers(1, 400, n)
        at, many = lattice._opened(lattice._bag(places, counts))
        assert dict(zip(at.tolist(), many.tolist())) == dict(zip(places.tolist(), counts.tolist()))


def test_stretches(monkeypatch):
    monkeypatch.setattr(lattice, "_STRETCH", 5)
    monkeypatch.setattr(divergence, "_STRETCH", 5)
    text = "Eins zwei  dreiundzwanzig \t vier-fünf\n" * 3
    assert [w for some in lattice.words(text.encode()) for w in some] == text.encode().lower().split()
    assert [w for some in divergence.terms(text.encode()) for w in some] == re.findall(rb"[a-z\x80-\xff]+", text.encode().lower())


@pytest.mark.parametrize("small", [False, True])
def test_text_scores(spark, docs, monkeypatch, small):
    if small:
        monkeypatch.setattr(lattice, "_WORDS", 300)
        monkeypatch.setattr(lattice, "_DOCS", 7)
    odd = [(None, "no id here"), (None, None), (9001, None), (9002, ""), (9003, " \t\n"), (9004, "Same text ÉTÉ \U0001f600"), (9005, "Same text ÉTÉ \U0001f600"), (9005, "Same text ÉTÉ \U0001f600"), (9006, "word " * 30_000), (9007, "x" * 50_000)]
    given = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("score", F.lit("z"))
    got = lattice.text_scores(given, queries.vocabulary("piece_bpe_32k.model"), 1).collect()
    rows = [(r.doc_id, r.text) for r in given.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b""]
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    # the model: one round of expectation maximisation, then the summed segmentations
    pieces, start = lattice.read_pieces(queries.vocabulary("piece_bpe_32k.model"))
    norm = math.log(sum(map(math.exp, start)) + 1)
    tool, expected = lattice.Lattice(pieces, [w - norm for w in start]), [lattice._ONE] * len(pieces)
    for w, n in counts.items():
        if w:
            tool.expect(w.decode(), n, expected)
    norm = math.log(sum(expected) + lattice._ONE * (counts[b""] + 1))
    tool, end = lattice.Lattice(pieces, [math.log(n) - norm for n in expected]), math.log(lattice._ONE * (counts[b""] + 1)) - norm
    memo = {}
    want = Counter()
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own)
        score = (end + sum(memo.setdefault(w, tool.forward(w.decode())) if w in memo or w else 0.0 for w in own)) / math.log(10)
        want[i, held(i), len(own), sum(counts[w] > 0 for w in own), total, f"{base:.6g}", f"{score:.6g}"] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.6g}", f"{r.score:.6g}") for r in got) == want
    same = {r.score for r in got if r.doc_id in (9004, 9005)}
    assert len(same) == 1 and all(r.score < 0 for r in got)


def test_text_scores_without_documents(spark):
    vocabulary = queries.vocabulary("piece_bpe_32k.model")
    schema = "doc_id long, text string"
    assert lattice.text_scores(spark.createDataFrame([], schema), vocabulary).count() == 0
    alone = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = lattice.text_scores(spark.createDataFrame([(alone, "held out alone")], schema), vocabulary).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 4, 0, 0, 0.0) and math.isfinite(r.score) and r.score < 0
