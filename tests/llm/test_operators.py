"""Every training-data operator against a brute-force version, and on awkward tables."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.llm import fingerprint, html, langid, neardup, packing, pii, quality, queries, sharding, tokencount
from rostrum.llm.decontaminate import decontaminate
from rostrum.llm.neardup import least_matches, near_duplicates

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", None), (2, "", None, "a", 0), (3, "one", "en", None, 3), (4, "one", "en", "b", 3),
    (5, " \n\t ", "en", "b", 4), (6, "The cat sat on the mat and looked at the big dog", "en", "b", None),
    (7, "the cat sat on the mat and looked at the big dog", "fr", "b", None), (7, "the cat sat on the mat and looked at the big dog", "fr", "b", None),
    (None, "no id here at all", "en", "b", None), (9, "word " * 30_000, "en", "c", 150_000), (10, "x" * 200_000, None, "c", 200_000),
    (11, "1234567 " * 20_000, "de", "c", None), (12, "\U0001f600 café 日本語", "ja", "c", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    # clashing and extra columns
    return spark.createDataFrame(ODD, SCHEMA).withColumn("shard", F.lit("x")).withColumn("spans", F.lit(1)).withColumn("score", F.lit("y"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words4(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute_groups(rows, width):
    sets = {i: words4(t, width) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, odd, empty, width):
    for table in (docs, odd):
        want = brute_groups([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()], width)
        got = near_duplicates(table, width).collect()
        assert len(got) == table.count()
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept  # its text is in no group
            else:
                assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert near_duplicates(empty, width).count() == 0


def test_near_duplicates_family(spark):
    # one large family whose members differ from each other, plus strays: the same groups as brute force
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.choice(120, rng.integers(0, 9), replace=False):
            w[k] = f"v{rng.integers(3)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == {i: c for i, (_, c) in brute_groups(rows, 4).items()}


def test_near_duplicates_odd_ids(spark):
    """A doc_id with several texts links by each; rows without one are kept only for a group without doc_ids."""
    a, b, c, d = ("a b c d e f g h i j k l m n o p", "q r s t u v w x y z", "one two three four five six", "seven eight nine ten eleven")
    rows = [(7, a), (7, b), (9, a), (3, b), (3, b), (None, a), (None, c), (None, c), (None, c + "!"), (None, d), (5, d)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    texts = {r.x: r.text for r in spark.createDataFrame(rows, "doc_id long, text string").select("text", F.xxhash64("text").alias("x")).collect()}
    seen = sorted((r.doc_id or 0, texts[r.text_hash], r.component_id, r.kept) for r in got)
    want = [(7, a, 7, True), (7, b, 3, False), (9, a, 7, False), (3, b, 3, True), (3, b, 3, True), (0, a, None, False)]
    want += [(0, c, None, True), (0, c, None, True), (0, c + "!", None, True), (0, d, None, False), (5, d, 5, True)]
    assert seen == sorted(want, key=lambda r: (r[0], r[1]))


def test_near_duplicates_blocks(spark, monkeypatch):
    """A bucket dealt into blocks gives the same pairs as one that is whole."""
    placed = spark.createDataFrame([(1, i, 10, i // 2) for i in range(40)], "key long, rep long, n long, comp long")
    marked = spark.createDataFrame([(i, [0] * 32) for i in range(40)], "rep long, marks array<long>")
    whole = {(r.a, r.b) for r in neardup._pairs(placed, marked, 80).collect()}
    monkeypatch.setattr(neardup, "BLOCK", 7)
    assert {(r.a, r.b) for r in neardup._pairs(placed, marked, 80).collect()} == whole
    assert whole == {(i, j) for i in range(40) for j in range(40) if i // 2 < j // 2}


def test_least_matches():
    need = least_matches(64, 32, 0.8, 1e-6)
    assert 0 < need[0] < 0.8 * 32 and need[0] < need[1] < 0.8 * 64


def test_html(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a>Home</a></li></ul></nav>"
        "<!-- x --><div class='ad'>Buy now.</div><div class=cookie-notice>We use cookies.</div><article><h1>Head &amp; more</h1>"
        "<p><b>First one.<br><p>Second  para,\n with <a href=x>a link</a> &#233;t&eacute;.</p><form>Name <input></form>"
        "<section class='comments'><p>Nice article, thanks a lot.</p></section><p>To.</p></article><aside>More</aside><footer>&copy; x</footer></body></html>"
    )
    free = "<body><div id=menu><a>x</a></div><div id=content><p>Some text, with commas, and more.</p><p>More text here, again.</p></div><div class=footer>f</div>"
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", free), (5, "u", "plain < text & more"), (6, "u", "<p" * 50_000), (7, "u", "<div>" * 5000 + "deep, text.")]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Head & more First one. Second para, with a link été. To."
    assert got[2].text == got[3].text == ""
    assert got[4].text == "Some text, with commas, and more. More text here, again."
    assert got[5].text == "plain < text & more" and got[7].text == "deep, text."
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_html_ratios_decide():
    """Without a declared article, with teasers or a summary declared so, and inside and beside a true one."""
    story = [f"This is part {i} of the story, which goes on, with commas, for a good while. It has more than one sentence, too; it is told in full." for i in range(8)]
    told = "".join(f"<p>{s}</p>" for s in story)
    links = "<ul>" + "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(12)) + "</ul>"
    teasers = "".join(f"<article><h2>Other {i}</h2><p>Another thing that happened, number {i}.</p></article>" for i in range(8))
    plain = " ".join(story)
    for page in (
        f"<body>{links}<div><div>{told}</div></div></body>",
        f"<body><div id=x>{told}</div><div class=cards>{teasers}</div></body>",
        f"<body><article>{told}</article>{links}</body>",
    ):
        assert " ".join(html.select(page)) == plain, page
    got = html.select(f"<body><div class=cards>{teasers}</div><div id=x>{told}</div></body>")
    assert got[-8:] == story and len(got) <= 9  # smoothing may keep the story's neighbour
    got = html.select(f"<body><article>{told}{links}</article></body>")
    assert got[:8] == story and len(got) <= 9
    page = f"<body><article><p>In short, it went on.</p></article><div id=x>{told}</div></body>"
    assert " ".join(html.select(page)).endswith(plain)


def test_html_ratios_alone():
    """On whole pages the ratios without the bonus of declared articles give the article."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist()
    for page in pages:
        inner = page[page.index("<article>") : page.index("</article>")]
        want = re.sub(r"\s+", " ", __import__("html").unescape(re.sub(r"</?(?:h1|p|br|article|b)\b[^>]*>", " ", inner))).strip()
        assert re.sub(r"\s+", " ", " ".join(html.select(page, trust=0.0))) == want


def test_html_plain_cases():
    select = lambda page: " ".join(html.select(page))
    # the head may lack its end tag
    assert select("<html><head><title>x</title><body><p>Main text, here.</p>") == "Main text, here."
    assert select("<html><head><title>x</title><p>Main text, here.</p>") == "Main text, here."
    # names that only hold a cue are content, whole names are not
    page = "<article><div class='notice-of-appeal'><p>A notice, given.</p></div><p class=search-history>Searched, often.</p><div class='site-cookie-banner'>No, thanks.</div><p>More, too.</p></article>"
    assert select(page) == "A notice, given. Searched, often. More, too."
    # short cells belong to their table
    rows = "".join(f"<tr><td>{y}</td><td>{y % 7}</td></tr>" for y in range(2001, 2009))
    page = f"<body><p>The table below, as told, gives all numbers.</p><table>{rows}</table><p>So it is, in the end, clear enough.</p></body>"
    assert select(page).count("200") == 8
    # depth and unclosed elements change nothing, and take linear time
    assert select("<div>" * 60_000 + "deep, text.") == "deep, text."
    deep = "<div>" * 300 + "<p>Some text, told here, at length.</p><ul><li><a>x</a></li></ul>" + "</div>" * 300
    assert select(deep) == "Some text, told here, at length."
    assert select("<span class=share>" * 9 + "<span>go</span> on" + "</span>" * 9 + "<p>Text, here.</p>") == "Text, here."
    assert len(html.select("<p" * 200_000)) == 1


def test_html_table(spark):
    """Repeated rows stay, other columns are not read, an empty table gives none; op1 is the operator on pages."""
    rows = [(1, "u", "<p>Text, here.</p>", 5), (1, "u", "<p>Text, here.</p>", 5), (None, None, None, None)]
    given = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert sorted((r.text, r.n_chars) for r in html.extract(given).collect()) == [("", 0), ("Text, here.", 11), ("Text, here.", 11)]
    assert html.extract(given.limit(0)).count() == 0
    got = queries.op1_html_extraction(spark, DIR)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(got.collect()) == sorted(html.extract(spark.read.parquet(f"{DIR}/pages.parquet")).collect())


def test_html_whole_table(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    for r in pages.join(html.extract(pages).select("page_id", "text"), "page_id").collect():
        inner = r.html[r.html.index("<article>") : r.html.index("</article>")]
        want = re.sub(r"\s+", " ", __import__("html").unescape(re.sub(r"</?(?:h1|p|br|article)\b[^>]*>", " ", inner).replace("<b>", ""))).strip()
        assert r.text == want


def test_token_counts(spark, docs, odd, empty):
    vocabulary = queries.vocabulary("word_bpe_49k.json")
    pieces = {tuple(p) for p in tokencount.spelled_pieces(vocabulary)} | {(b,) for b in range(256)}

    def greedy(word):
        w, n = (*word, tokencount.END), 0
        at = 0
        while at < len(w):
            size = next((k for k in range(min(40, len(w) - at), 0, -1) if w[at : at + k] in pieces), 0)
            n += size > 0
            at += size or 1
        return n

    for table in (docs.limit(40), odd.where("doc_id not in (9, 10, 11)")):
        texts = {(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()}
        want = {i: sum(greedy(w.encode()) for w in re.findall(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+", (t or "").lower())) for i, t in texts}
        assert {r.doc_id: r.n_tokens for r in tokencount.count_tokens(table, vocabulary).collect()} == want
    assert tokencount.count_tokens(odd, vocabulary).count() == len(ODD)
    assert tokencount.count_tokens(empty, vocabulary).count() == 0


@pytest.mark.parametrize("cell", [50, 8192])
def test_sharding(docs, odd, empty, cell):
    for table in (docs.repartition(7), odd):
        n = table.count()
        rows = sharding.shard(table, 24, cell_rows=cell).collect()
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert len(rows) == n and Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in table.collect())
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        sizes = [len(slots[s]) for s in range(24)]
        assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(24))
    assert sharding.shard(empty, 24).count() == 0


def test_sharding_names_and_op(spark, docs):
    """Columns of any name survive; the query's size and checksum are those of the texts."""
    names = ["_task", "_at", "_cell", "_first", "task", "at", "cell", "first", "slot"]
    given = docs.limit(50).withColumns({c: F.lit(c) for c in names})
    out = sharding.shard(given, 5, cell_rows=7)
    assert set(out.columns) == {*given.columns, "shard"} and out.count() == 50
    assert all(r[c] == c for r in out.collect() for c in names[:-1])
    got = {r.doc_id: r for r in queries.op3_sharding(spark, DIR).collect()}
    for r in docs.collect():
        raw = (r.text or "").encode()
        assert (got[r.doc_id].size, got[r.doc_id].text_crc32, got[r.doc_id].law, got[r.doc_id].grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


def test_sharding_matrix():
    counts, cells = np.array([5, 0, 9, 3, 7]), np.array([8, 8, 8])
    rows = np.array([sharding.row_of_matrix(i, counts, cells, 1) for i in range(5)])
    assert (rows.sum(axis=1) == counts).all() and (rows.sum(axis=0) == cells).all()
    draws = [sharding.row_of_matrix(0, np.array([10, 10]), np.array([10, 10]), s)[0] for s in range(2000)]
    assert abs(np.mean(draws) - 5) < 0.1 and abs(np.var(draws) - 10 * 0.25 * 10 / 19) < 0.12
    rng = np.random.default_rng(0)
    big = [sharding._outward(rng, 2 * 10**9, 10**9, 300) for _ in range(500)]
    assert abs(np.mean(big) - 200) < 2


def test_items_that_share_a_line(spark):
    """A window that very many items hold names them all, and is built in linear time."""
    line = "read the following text and answer the question below it"
    items = [(f"i{k}", f"{line} number {k} is about {k * 7}") for k in range(4000)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame([(1, f"so {line} now"), (2, "nothing of it")], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in decontaminate(docs, bench, window=10).collect()}
    assert len(got[1].item_ids) == 4000 and got[1].n_hit == 10 and not got[2].item_ids
    assert time.perf_counter() - began < 30


def test_decontaminate(spark, docs, odd, empty):
    items = spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()
    items += [(900, "The Mat"), (901, None), (902, "!!"), (902, "big dog"), (903, "word word word word word word word word word word word")]
    table = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def words(t):
        return word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    sizes = {len(k) for k in windows}
    for given in (docs, odd):
        for most in (2_000_000, 700):
            clash = given.withColumn("hits", F.lit("x")).withColumn("_hits", F.lit(1)).withColumn("items", F.lit(2))
            out = decontaminate(clash, table, most_words=most)
            assert {"hits", "_hits", "items"} <= set(out.columns)
            for r in out.collect():
                assert (r["hits"], r["_hits"], r["items"]) == ("x", 1, 2)
                w, hit, found = words(r.text), set(), set()
                for size in sizes:
                    for k in range(len(w) - size + 1):
                        if tuple(w[k : k + size]) in windows:
                            found |= windows[tuple(w[k : k + size])]
                            hit |= set(range(k, k + size))
                assert (r.n_words, r.n_hit, r.item_ids) == (len(w), len(hit), sorted(found))
                if len(hit) <= 0.5 * len(w) and r.text is not None:
                    assert words(r.clean) == [x for k, x in enumerate(w) if k not in hit]
                elif hit:
                    assert r.clean == ""
    assert decontaminate(empty, table).count() == 0
    assert decontaminate(docs, table.limit(0)).where("n_hit > 0").count() == 0


def test_fingerprints(spark, docs, odd, empty):
    for given in (docs.repartition(5), odd):
        rows = [(r.doc_id, r.text or "") for r in given.select("doc_id", "text").collect()]
        got = fingerprint.beside_edits(given).collect()
        assert len(got) == len(rows)
        prints = defaultdict(set)
        for i, t in rows:
            prints[i].add(fingerprint.packed(fingerprint._of(t, fingerprint.WordHashes())))
        assert all(r.fingerprint in prints[r.doc_id] for r in got)
        if given is odd:
            continue
        order = sorted(rows, reverse=True)
        want = {}
        for k, (i, t) in enumerate(order):
            h = len(t) // 2
            want[i] = hashlib.sha256((t[: len(t) - h] + order[(k + 1) % len(order)][1][:h]).encode()).hexdigest()
        assert {r.doc_id: r.edited_sha256 for r in got} == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        long = [r for r in got if r.n_chars > 2000]
        assert abs(np.mean([r.near_edited for r in long]) - 1 / 3) < 0.08 and np.median([r.near_next for r in long]) < 0.05
    assert fingerprint.beside_edits(empty).count() == 0


def test_densification():
    """Every empty bin draws by itself: sources are spread evenly over few bins, and follow the plain definition."""
    for k in (1, 2, 5, 10, 60):
        held = np.random.default_rng(k).permutation(fingerprint.BINS)[:k].astype(np.uint64)
        shingles = (held << np.uint64(56)) | np.arange(k, dtype=np.uint64)
        got = fingerprint.fingerprint(shingles)
        values = (fingerprint.mix(np.arange(k, dtype=np.uint64)) & np.uint64(15)).astype(int)
        by_bin = dict(zip(held.tolist(), values.tolist()))
        for b in range(fingerprint.BINS):
            at = attempt = b if b in by_bin else None
            attempt = 0
            while at is None:
                with np.errstate(over="ignore"):
                    probe = int(fingerprint.mix(np.array([attempt * fingerprint.BINS + b], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))[0] % np.uint64(256))
                at, attempt = (probe if probe in by_bin else None), attempt + 1
            assert got[b] == by_bin[at]


def test_fingerprint_likeness():
    rng = np.random.default_rng(1)
    for share in (0.0, 0.3, 0.8, 1.0):
        a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
        both = int(share * 3000)
        b = np.concatenate((a[:both], rng.integers(0, 2**63, 3000 - both, dtype=np.uint64)))
        got = fingerprint.likeness(*(fingerprint.fingerprint(np.unique(fingerprint.mix(x))) for x in (a, b)))
        assert abs(got - both / (6000 - both)) < 0.12


def test_quality_probabilities(spark):
    # the joins against a direct Kneser-Ney recursion
    top = quality.ORDER
    texts = ["the cat sat", "the dog sat on the mat", "a cat and a dog"]
    count = Counter(int(g) for t in texts for g in quality.grams(t.encode()))
    seen = {top: count}
    for k in range(top - 1, 0, -1):
        seen[k] = Counter(g & quality._mask(k) for g in seen[k + 1])
    d = {}
    for k in range(1, top + 1):
        n = Counter(seen[k].values())
        y = n[1] / (n[1] + 2 * n[2])
        d[k] = [min(i, max(0.0, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else 0.5 for i in (1, 2, 3)]

    def p(g, k):
        if k == 0:
            return 1 / 256
        g &= quality._mask(k)
        own = {x: c for x, c in seen[k].items() if x >> 8 == g >> 8}
        below = p(g, k - 1)
        if not own:
            return below
        freed = sum(d[k][min(c, 3) - 1] for c in own.values())
        c = seen[k].get(g, 0)
        return ((max(0.0, c - d[k][min(c, 3) - 1]) if c else 0.0) + freed * below) / sum(own.values())

    wanted = {int(g) for g in quality.grams(b"the cat on a zebra")}
    counts = spark.createDataFrame([("en", g, n) for g, n in count.items()], "lang string, gram long, n long")
    asked = spark.createDataFrame([("en", g) for g in wanted], "lang string, gram long")
    got = {r.gram: r.logp for r in quality.probabilities(counts, asked).collect()}
    assert got.keys() == wanted
    assert all(abs(got[g] - np.log(p(g, top))) < 1e-9 for g in wanted)


def test_quality(spark, docs, odd, empty):
    trusted = spark.read.parquet(f"{DIR}/labels.parquet").where("quality = 1 and toxic = 0")
    got = quality.perplexities(docs, trusted).collect()
    one = quality.perplexities(docs, trusted, block_bytes=1 << 14).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: round(r.perplexity, 6) for r in got if r.perplexity} == {r.doc_id: round(r.perplexity, 6) for r in one if r.perplexity}
    known = {r.doc_id for r in trusted.collect()}
    # thresholds are quantiles of trusted documents that were held out
    held = known & {r.doc_id for r in docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(quality.FOLDS)) == 0).collect()}
    by_lang = defaultdict(list)
    for r in got:
        if r.doc_id in held and r.perplexity:
            by_lang[r.lang].append(r)
    assert by_lang
    for rows in by_lang.values():
        logs = sorted(np.floor(np.log(r.perplexity) * 100) for r in rows)
        assert abs(np.log(rows[0].threshold) * 100 - (logs[int(np.ceil(0.95 * len(logs))) - 1] + 1)) < 1e-6
    # the perplexity of documents, from the probabilities of their n-grams by the direct recursion
    learned = Counter(int(g) for r in docs.collect() if r.doc_id in known - held and r.lang == "en" and r.text for g in quality.grams(r.text.encode()))
    one_doc = min((r for r in docs.collect() if r.lang == "en" and r.text), key=lambda r: len(r.text))
    counts = spark.createDataFrame([("en", g, n) for g, n in learned.items()], "lang string, gram long, n long")
    asked = [int(g) for g in quality.grams(one_doc.text.encode())]
    logp = {r.gram: r.logp for r in quality.probabilities(counts, spark.createDataFrame([("en", g) for g in set(asked)], "lang string, gram long")).collect()}
    found = next(r for r in got if r.doc_id == one_doc.doc_id)
    assert abs(found.perplexity - np.exp(-np.mean([logp[g] for g in asked]))) < 1e-6
    assert np.mean([r.kept for r in got if r.doc_id in known]) >= 0.95
    strange = quality.perplexities(odd, trusted).collect()
    assert len(strange) == len(ODD) and all((r.perplexity is None) == (not r.n_bytes) or r.threshold is None for r in strange)
    assert all(not r.kept for r in strange if not r.n_bytes)
    assert quality.perplexities(empty, trusted).count() == 0
    assert quality.perplexities(docs, trusted.limit(0)).where("kept").count() == docs.where("length(text) > 0").count()


def test_language_id(spark, docs, odd, empty):
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    right = [got[r.doc_id].lang_pred == r.lang for r in docs.collect() if got[r.doc_id].held_out]
    assert len(right) > 20 and np.mean(right) > 0.95
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
    # what is held out is not learnt from
    other = docs.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert {r.doc_id: r.lang_pred for r in langid.identify(other).collect()} == {i: r.lang_pred for i, r in got.items()}
    assert queries.op8_language_id(spark, DIR).columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = langid.identify(odd).collect()
    assert len(rows) == len(ODD) and {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 5, 11}
    assert langid.identify(empty).count() == 0


def test_language_letters_have_own_vectors():
    enc = langid.Encoder(5)
    points = [*range(0x4E00, 0x4E00 + 3000), *range(97, 123), 0x3B1, 0x430]
    assert len({enc.letter(p).tobytes() for p in points}) == len(points)
    # the cosine against a plain sum of bound vectors
    text = "Été 東京 abc"
    grams, counts = enc.grams(text)
    folded = [0] + [ord(c.lower()) if c.isalpha() else 0 for c in text] + [0]
    want = sum(np.roll(enc.letter(a), 2) * np.roll(enc.letter(b), 1) * enc.letter(c).astype(int) for a, b, c in zip(folded, folded[1:], folded[2:]))
    assert (enc.document(grams, counts) == want).all()
    small = langid.Encoder(5, most=50)  # what is kept is bounded, and changes nothing
    for t in ("the cat sat on the mat", "der Hund und die Katze " * 5, "the cat sat on the mat"):
        assert (small.document(*small.grams(t)) == enc.document(*enc.grams(t))).all()


def test_language_dimensions(docs, monkeypatch):
    """Accuracy on held-out documents by dimension: 1024 is enough for these languages."""
    rows = [r for r in docs.collect() if r.text]
    held = [zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows]
    right = {}
    for dim in (64, 1024):
        enc, sums = langid.Encoder(5, dim), {}
        made = [(enc.document(*g) if len((g := enc.grams(r.text))[0]) else None) for r in rows]
        for r, v, h in zip(rows, made, held):
            if not h and v is not None and r.lang:
                sums[r.lang] = sums.get(r.lang, 0) + v / np.abs(v).sum()
        p = {k: v / np.linalg.norm(v) for k, v in sums.items()}
        right[dim] = np.mean([max(p, key=lambda k: p[k] @ v) == r.lang for r, v, h in zip(rows, made, held) if h and v is not None and r.lang])
    assert right[1024] > 0.95 and right[1024] >= right[64]


def test_packing(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    vocabulary = queries.vocabulary("byte_bpe_50k.json")
    exact = Tokenizer.from_file(vocabulary)
    spaced = spark.createDataFrame(
        [(1, "a  b   c \n d\n\n e\t f "), (2, " lead"), (3, "x² ½ 3\x1c4 it's WE'LL"), (4, "a \n \n b"), (5, "  two"), (6, "<|endoftext|> end"), (7, "x <|endoftext|> y"), (8, " <|endoftext|><|endoftext|>  a <|endoftext"), (9, "<|endoftext|>")],
        "doc_id long, text string",
    )
    for given in (docs.repartition(5), odd.dropDuplicates(["doc_id"]), spaced):
        rows = packing.pack(given, vocabulary).collect()
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for r in rows:
            by_doc[r.doc_id].append(r)
            by_sequence[r.sequence_id].append(r)
        total = 0
        for r in given.select("doc_id", "text").collect():
            ids = np.array([*exact.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
            total += len(ids)
            own = sorted(by_doc[r.doc_id], key=lambda p: p.piece)
            assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]] and sum(p.length for p in own) == len(ids)
            assert all(p.length == 1024 for p in own[1:]) and 0 < own[0].length <= 1024
            assert [p.ids_crc32 for p in own] == [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own]
        for own in by_sequence.values():
            own.sort(key=lambda p: p.offset)
            assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]] and sum(p.length for p in own) <= 1024
        assert len(by_sequence) <= -(-total // 1024) + 1 + 0.02 * len(by_sequence)
    assert packing.pack(empty, vocabulary).count() == 0
    assert packing.pack(odd, vocabulary).count() >= len(ODD)


def test_packing_special_as_text():
    from tokenizers import Tokenizer

    vocabulary = queries.vocabulary("byte_bpe_50k.json")
    exact = Tokenizer.from_file(vocabulary)
    exact.encode_special_tokens = True
    text = "x <|endoftext|> y"
    assert np.frombuffer(packing.Encoder(vocabulary, special_as_text=True).ids(text), "<u4").tolist() == exact.encode(text, add_special_tokens=False).ids
    assert 50256 in np.frombuffer(packing.Encoder(vocabulary).ids(text), "<u4").tolist()


def test_packing_op(spark, docs):
    got = queries.op9_packing(spark, DIR)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    counts = Counter(r.length for r in got.collect())
    used = got.select("sequence_id").distinct().count()
    full = counts.pop(1024, 0)
    assert used - full <= packing.least_sequences(counts, 1024) * 1.002 + 1


def test_packing_repeats(spark, docs):
    """Rows that repeat, doc_ids too, each get their pieces."""
    given = docs.limit(20).unionByName(docs.limit(20)).withColumn("rank", F.lit("x")).withColumn("pid", F.lit("y"))
    once = packing.pack(docs.limit(20), queries.vocabulary("byte_bpe_50k.json")).collect()
    twice = packing.pack(given, queries.vocabulary("byte_bpe_50k.json")).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, twice)) == Counter({k: 2 * n for k, n in Counter(map(key, once)).items()})
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice)


def _optimum(items, size):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + items[i] <= size:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        bins.append(items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_packing_plan_is_optimal_for_few_pieces():
    rng = np.random.default_rng(0)
    for k in range(120):
        items = (rng.integers(1, 100, 12) if k % 2 else rng.integers(20, 70, 12)).tolist()
        best = _optimum(items, 100)
        found = packing.plan(Counter(items), 100)
        used = Counter(s for times, fill in found for s in fill for _ in range(times))
        assert used == Counter(items) and all(sum(fill) <= 100 for _, fill in found)
        assert sum(times for times, _ in found) == best and packing.least_sequences(Counter(items), 100) <= best


def test_packing_fillings():
    """Fillings come by falling sum, none dominated, and none that is undominated is left out."""
    from itertools import combinations

    rng = np.random.default_rng(1)
    for _ in range(60):
        items, room = rng.integers(1, 30, 7).tolist(), 40
        got = [tuple(f) for f in packing.fillings(Counter(items), room)]
        sums = [sum(f) for f in got]
        assert sums == sorted(sums, reverse=True) and len(set(got)) == len(got)
        every = {tuple(sorted((items[i] for i in c), reverse=True)) for k in range(8) for c in combinations(range(7), k) if sum(items[i] for i in c) <= room}
        assert set(got) <= every

        def dominated(fill):
            spare = Counter(items) - Counter(fill)
            for x in spare:
                for k in range(1, len(fill) + 1):
                    for c in combinations(fill, k):
                        if max(c) < x and sum(c) <= x and sum(fill) - sum(c) + x <= room:
                            return True
            return False

        # a filling that could take one piece more is dominated too, but its sum is not the largest: it may be given
        assert {f for f in every if not dominated(f)} <= set(got)


def test_packing_bound():
    rng = np.random.default_rng(2)
    for lengths in (rng.integers(1, 1024, 20_000), np.clip(rng.lognormal(5.5, 0.9, 20_000), 2, 1023).astype(int)):
        counts = Counter(lengths.tolist())
        assert sum(times for times, _ in packing.plan(counts, 1024)) <= 1.003 * packing.least_sequences(counts, 1024)


def test_packing_plan():
    counts = {700: 3, 400: 2, 324: 5, 300: 4, 24: 6, 1: 2}
    used = Counter()
    patterns = packing.plan(counts, 1024)
    for times, fill in patterns:
        assert sum(fill) <= 1024
        for s in fill:
            used[s] += times
    assert used == counts
    assert packing.plan({600: 10, 424: 10}, 1024) == [(10, [600, 424])]


def test_pii_base_spans():
    plain = (
        re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    )

    def brute(t):
        out = []
        for k, pattern in enumerate(plain):
            for m in pattern.finditer(t):
                d = re.sub("[^0-9]", "", m[0])
                ok = (lambda: True, lambda: all(int(x) <= 255 for x in m[0].split(".")), lambda: 13 <= len(d) <= 19 and pii._luhn(d), lambda: 9 <= len(d) <= 15)
                if ok[k]():
                    out.append((k, *m.span()))
        return out

    rng = np.random.default_rng(2)
    for _ in range(3000):
        t = "".join(rng.choice(list("ab1290.@+-() é"), 40))
        assert pii.base_spans(t) == brute(t), t
    t = "mail a.b@c-d.example.org@x.y, 1.2.3.4.5, 256.1.1.1, 4111 1111 1111 1111, +1 (743) 555-3824 and 0000012.1.1.1"
    assert pii.base_spans(t) == brute(t) and len(brute(t)) > 4
    for big in ("1" * 100_000, "a" * 100_000 + "@", "a@" * 50_000, "1 " * 50_000, "+1" * 50_000, "1." * 50_000, "(a" * 50_000):
        assert isinstance(pii.base_spans(big), list) and isinstance(pii.candidates(big), list)


def test_pii(spark, docs, odd, empty):
    model = pii.fit(docs)
    for given in (docs, odd, empty):
        rows = pii.detect(given, model).collect()
        assert len(rows) == given.count()
        for r in rows:
            base = pii.base_spans(r.text or "")
            assert r.base == pii.spelled(base)
            assert {*r.base.split(",")} <= {*r.spans.split(",")} or not r.base
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
            if r.text is not None:
                assert not pii.base_spans(r.redacted) or not base
    assert pii.redacted("call +1 555 now", [(3, 5, 11), (2, 6, 11)]) == "call <PHONE> now"


def test_pii_adds_loose_shapes(spark):
    """Personal data in shapes that base patterns miss is found and redacted; the same shapes, broken, are not."""
    rng = np.random.default_rng(5)

    def card():
        d = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        return next(d + c for c in "0123456789" if pii._luhn(d + c))

    texts = []
    for i in range(120):
        ip = ".".join(map(str, rng.integers(0, 256, 4)))
        phone = "+1 ({}{:02d}) {}{:02d}-{:04d}".format(*(int(rng.integers(*r)) for r in ((2, 10), (0, 100), (2, 10), (0, 100), (0, 10_000))))
        texts += [f"the note of day {i} says user{i}@host{i}.example.org is here", f"words and {ip} and more", f"he gave {card()} then left", f"reach us under {phone} soon"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = pii.fit(docs)
    loose = [
        "jane.doe [at] example [dot] com", "jane(at)mail(dot)example(dot)org", "2001:db8:85a3:1:2:8a2e:370:7334", "fe80:1:2::7334",
        "(212) 555-0143", "212.555.0143", "4111.1111.1111.1111", "4111_1111_1111_1111",
    ]
    broken = ["jane (at) 5 (dot) 30", "12:34:56:78", "(112) 555-0143", "03.04.1999", "4111.1111.1111.1112", "4111_1111_1111_1113", "300,400,1,2", "1,234,123,200"]
    given = spark.createDataFrame([(i, f"some words then {s} and the end") for i, s in enumerate(loose + broken)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.detect(given, model).collect()}
    assert [s for i, s in enumerate(loose) if s in got[i].redacted or got[i].base] == []
    assert [s for i, s in enumerate(broken, len(loose)) if got[i].spans] == []


def _planted(spark, rows, seed):
    """Base spans behind words that announce them, other numbers behind words that never do."""
    rng = np.random.default_rng(seed)
    texts = []
    for i in range(rows):
        ip = ".".join(map(str, rng.integers(0, 256, 4)))
        phone = "+1 ({}{:02d}) {}{:02d}-{:04d}".format(*(int(rng.integers(*r)) for r in ((2, 10), (0, 100), (2, 10), (0, 100), (0, 10_000))))
        texts += [f"day {i}: write to user{i}@host{i}.example.org soon", f"the server {ip} is down", f"please call {phone} soon", f"version 4.{i} is out, the ratio {i} to {i + 1}", f"see part number {i * 37} of the list"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_pii_trees_beat_the_rule(spark):
    """Shapes that keep every rule, behind words that announce personal data or other numbers: no one-line rule tells them apart."""
    model = pii.fit(_planted(spark, 150, 7))
    rng = np.random.default_rng(8)
    good, bad = [], []
    for i in range(60):
        ip = ",".join(map(str, rng.integers(0, 256, 4)))
        phone = "{}{:02d}-{}{:02d}-{:04d}".format(*(int(rng.integers(*r)) for r in ((2, 10), (0, 100), (2, 10), (0, 100), (0, 10_000))))
        away = "0{} {:03d} {:04d}".format(*(int(rng.integers(*r)) for r in ((20, 99), (0, 1000), (0, 10_000))))
        good += [f"now the server {ip} is up", f"or call {phone} today", f"or call {away} today", f"so write to jane{i} at mail{i} dot org today"]
        bad += [f"the ratio {ip} holds", f"version {ip} came", f"see part number {phone} below", f"see part number {away} below"]
    rule = lambda t: any(pii.proper(k, t[a:b]) for k, a, b in pii.candidates(t))
    assert all(map(rule, good)) and all(map(rule, bad))
    tree = lambda t: bool(model.added(t, pii.base_spans(t)))
    recall, wrong = sum(map(tree, good)) / len(good), sum(map(tree, bad)) / len(bad)
    assert recall >= 0.9 and wrong <= 0.05, (recall, wrong)
    # without contexts the trees are left with the format, and cannot do it
    blind = pii.Model(model.trees, model.thresholds)
    kept = sum(bool(blind.added(t, [])) for t in bad) / len(bad)
    assert kept > wrong or sum(bool(blind.added(t, [])) for t in good) / len(good) < recall


def test_pii_proposals():
    """Foreign numbers, addresses in words and runs of any length are proposed; long runs take linear time."""
    found = lambda t: {t[a:b] for _, a, b in pii.candidates(t)}
    for t in ("030 1234 5678", "01 42 68 53 00", "(089) 636-48018", "john at example dot com", "a" * 90 + " [at] " + "b" * 80 + " [dot] c [dot] d [dot] e [dot] f [dot] g [dot] h [dot] org"):
        assert t in found(f"so {t} then"), t
    for big in ("0 " * 50_000, "01 " * 50_000, "a at " * 40_000, "a dot " * 40_000, "a-" * 60_000 + " at b", "01/" * 40_000):
        assert isinstance(pii.candidates(big), list)


def test_pii_sample_takes_copies_once(spark, monkeypatch):
    """Copies of one text do not fill the sample of the trees."""
    seen = []
    real = pii.Boosted.fit
    monkeypatch.setattr(pii.Boosted, "fit", lambda self, x, y: seen.append(len(x)) or real(self, x, y))
    texts = ["mail a@b.org and c@d.org and e@f.org and 10.0.0.7"] * 500 + [f"mail u{i}@h{i}.org" for i in range(40)]
    pii.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    contexts = pii.contexts_of(spark.createDataFrame([(t,) for t in texts], "text string"))
    distinct = {(e[0], e[1], tuple(e[2])) for t in texts for e in pii.examples(t, contexts) if e[0] % 2 == 0}
    assert seen == [len(distinct)] and len(distinct) < 1000


def test_pii_sample_is_of_bounded_size(spark, monkeypatch):
    """The driver gets little more than the sample, whatever the number of tasks."""
    texts = [f"mail user{i}@host{i}.org or 10.0.{i % 200}.{i % 250}" for i in range(3000)]
    seen = []
    real = pii.Boosted.fit
    monkeypatch.setattr(pii.Boosted, "fit", lambda self, x, y: seen.append(len(x)) or real(self, x[:200], y[:200]))
    pii.fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(16), most=300)
    assert seen == [300]


def test_pii_op(spark, docs):
    got = {r.doc_id: r for r in queries.op10_pii(spark, DIR).collect()}
    for r in docs.collect():
        base = pii.spelled(pii.base_spans(r.text or ""))
        assert got[r.doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert {*filter(None, base.split(","))} <= {*got[r.doc_id].spans.split(",")}


def test_other_ops(spark, docs):
    """The digest columns of the queries on whole tables, and their columns."""
    marks = {r.doc_id: r for r in decontaminate(docs, spark.read.parquet(f"{DIR}/benchmark.parquet")).collect()}
    for r in queries.op5_decontamination(spark, DIR).collect():
        m = marks[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (m.n_words, m.n_hit, len(m.item_ids), m.n_hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(m.item_ids).encode()).hexdigest()
    n = docs.count()
    assert queries.op4_minhash_neardup(spark, DIR).columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]
    prints = queries.op6_fingerprints(spark, DIR)
    assert prints.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert prints.count() == n == queries.op2_token_counts(spark, DIR).count() == queries.op7_quality(spark, DIR).count()


def test_pii_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0) & (x[:, 3] < 0.5)).astype(float)
    score = pii.Boosted().fit(x[:400], y[:400]).score(x[400:])
    assert ((score > 0.5) == y[400:]).mean() > 0.95
