"""What must not grow faster than the input: nothing that outnumbers its rows is broadcast, and hot keys meet in bounded work."""

from pyspark.sql import functions as F

from rostrum.operators import dictionary as D
from rostrum.operators import variants


def spread_and_broadcast(df):
    """Broadcasts of a plan that hold exploded rows, which the planner takes for as few as the rows they come from."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-*()0123456789")) for x in lines]
    found = []
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            under = []
            for j in range(k + 1, len(lines)):
                if depth[j] <= depth[k] or "Exchange hash" in lines[j]:  # what was counted before is known
                    break
                under.append(lines[j])
            found += [x for x in under if "Generate explode" in x]
    return found


def some_names(spark, tmp_path, n=200):
    """Names read from a small file, as tables are."""
    path = str(tmp_path / "names")
    spark.range(n).select(F.col("id").alias("load"), F.concat(F.lit("name "), F.md5(F.col("id").cast("string").cast("binary"))).alias("canonical")).write.parquet(path)
    return spark.read.parquet(path).withColumn("key", F.lower("canonical"))


def test_contained_key_broadcasts_no_parts(spark, tmp_path):
    names = some_names(spark, tmp_path)
    asked = names.select(F.col("load").alias("span_id"), F.concat(F.lit("a "), "canonical").alias("span"))
    out = variants.contained_key(asked.unionByName(asked.withColumn("span_id", F.col("span_id") + 1000)), names)
    assert not spread_and_broadcast(out)
    assert {(r.span_id % 1000, r.canonical) for r in out.collect()} == {(r["load"], r.canonical) for r in names.collect()} and out.count() == 400


def test_near_keys_broadcast_no_pieces(spark, tmp_path):
    names = some_names(spark, tmp_path)
    asked = names.select(F.col("load").alias("span_id"), F.concat("canonical", F.lit("xy")).alias("span"))
    out = D.near_keys(asked, names)
    assert not spread_and_broadcast(out)
    assert {(r.span_id, r.key, r.d) for r in out.collect()} == {(r["load"], r.key, 2) for r in names.collect()}


def test_words_meet_chunks_as_texts(spark, tmp_path):
    """No word is a row before its text has met the chunks; blanks, nulls and repeated ids lose and add nothing."""
    from rostrum import plans, registry  # noqa: F401

    docs = [(1, "a bb  ccc a"), (1, "bb d"), (2, None), (3, ""), (4, "x y"), (None, "a")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    chunks = [(1, 2, "xbbx a"), (1, 1, "ccc"), (1, 3, "bb"), (2, 0, "a"), (3, 0, " "), (4, 0, None), (None, 0, "a")]
    spark.createDataFrame(chunks, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = registry.QUERIES["j17_first_chunk_with"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", 2), (1, "bb", 2), (1, "ccc", 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")


def test_far_edits_meet_few(spark):
    """Of names without likeness each meets a few at four edits, not a share of all."""
    n = 2000
    names = spark.range(n).select(F.col("id").alias("load"), F.translate(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 14), "0123456789", "ghijklmnop").alias("key"))
    names = names.withColumn("canonical", F.col("key")).localCheckpoint()
    asked = names.select(F.concat(F.lit("z"), F.substring("key", 2, 5), F.lit("qq"), F.substring("key", 9, 5), F.lit("z")).alias("low"), F.lit(4).alias("most"))
    met = D._met(asked, names).localCheckpoint()
    near = {(r.low, r.key) for r in met.where(F.levenshtein("low", "key") <= 4).collect()}
    assert {(r.low, r.low[1:6]) for r in asked.collect()} == {(low, key[1:6]) for low, key in near if low[1:6] == key[1:6]}
    assert met.count() < 100 * n


def test_retiming_holds_few_transcripts():
    """Of a large batch a few transcripts at a time become Python objects; none is lost."""
    import pyarrow as pa

    from rostrum.operators import alignment as A

    one = [{"word": w, "start": k + 0.0, "end": k + 0.5, "speaker": None} for k, w in enumerate("abc")]
    batch = pa.RecordBatch.from_pylist([{"id": k, "text": "a x c" if k % 2 else None, "words": one if k % 3 else None} for k in range(101)])
    made = list(A._retiming("id")([batch]))
    assert len(made) == -(-101 // A.AT_ONCE)
    rows = [tuple(r.values()) for b in made for r in b.to_pylist()]
    want = [(k, i, w, i + 0.0, i + 0.5, None) for k in range(101) if k % 2 and k % 3 for i, w in enumerate("axc")]
    assert rows == want


def test_hot_citations_need_no_exchange(spark):
    """Most citations name one text or none: those that few texts resolve are not dealt by the text's id."""
    from rostrum.plans.retrieval import resolved

    texts = spark.range(2_000_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("excerpt"))
    cited = spark.range(1000).select(F.col("id").alias("answer"), F.when(F.col("id") % 2 == 0, 7).otherwise(999999999).cast("long").alias("doc_id"))
    out = resolved(cited, texts, "doc_id")
    assert {(r.answer, r.doc_id, r.excerpt) for r in out.collect()} == {(k, 7, "text 7") for k in range(0, 1000, 2)}
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_index_builds_only_the_kinds_asked_for(spark, tmp_path):
    """A query that looks up one kind of key neither makes nor writes the others; each kind is written once."""
    from rostrum.plans import matching as M

    spark.range(40).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    one = M.index_of(spark, str(tmp_path), "initials")
    assert {r.key_kind for r in one.select("key_kind").distinct().collect()} == {"initials"}
    assert len(one.inputFiles()) and all("key_kind=initials" in f for f in one.inputFiles())
    both = M.index_of(spark, str(tmp_path), "initials", "text")
    assert set(one.inputFiles()) < set(both.inputFiles())
    whole = M.built_index(spark, str(tmp_path))
    assert M.index_of(spark, str(tmp_path)).select(whole.columns).exceptAll(whole).isEmpty() and whole.exceptAll(M.index_of(spark, str(tmp_path)).select(whole.columns)).isEmpty()


def test_substring_broadcasts_no_parts(spark, tmp_path):
    """The parts of all names outnumber the file that they come from."""
    names = some_names(spark, tmp_path).withColumns({"key_kind": F.lit("text"), "place": F.lit(0), "kind": F.lit("person"), "type": F.lit("person"), "abbreviation": F.lit(None).cast("string"), "fanout": F.lit(1)})
    out = D.substring(names.select(F.col("load").alias("span_id"), F.substring("canonical", 9, 20).alias("span")), names)
    assert not spread_and_broadcast(out)
    assert {(r.span_id, r.canonical) for r in out.collect()} == {(r["load"], r.canonical) for r in names.collect()}


def test_nearest_moves_no_more_than_decides(spark, tmp_path):
    """What a name is does not travel with each of its pieces."""
    names = some_names(spark, tmp_path).withColumns({"place": F.lit(0), "kind": F.lit("person"), "type": F.lit("person"), "abbreviation": F.lit(None).cast("string")})
    seen, met = [], D._met

    def watched(texts, keys):
        seen.append(set(keys.columns))
        return met(texts, keys)

    D._met = watched
    try:
        got = D.nearest(names.select(F.col("load").alias("span_id"), F.concat("canonical", F.lit("x")).alias("span")), names, D.distance_ceiling, 3).collect()
    finally:
        D._met = met
    assert all(columns == {"load", "place", "key"} for columns in seen)
    assert {(r.span_id, r.b.d, r.b.canonical, r.b.kind) for r in got} == {(r["load"], 1, r.canonical, "person") for r in names.collect()}
