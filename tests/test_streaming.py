"""Streaming jobs on small file streams."""

import pytest
from pyspark.sql import functions as F

from rostrum.streaming import jobs


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def drain(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_replace_and_append_once(spark, tmp_path):
    schema = "record_id long, version long, chunk string"
    source = str(tmp_path / "in")
    put(spark, source, [(1, 1, "a"), (1, 1, "b"), (2, 5, "c")], schema)
    table = jobs.VersionedTable(spark, str(tmp_path / "chunks"), schema)

    def run():
        stream = jobs.file_stream(spark, source, schema, 1)
        drain(jobs.replace_stream(stream, table, "record_id", "version", str(tmp_path / "c1")))
        return sorted(map(tuple, table.read().collect()))

    assert run() == [(1, 1, "a"), (1, 1, "b"), (2, 5, "c")]
    put(spark, source, [(1, 2, "d"), (2, 4, "stale"), (3, 1, "e")], schema)
    assert run() == [(1, 2, "d"), (2, 5, "c"), (3, 1, "e")]
    once = jobs.VersionedTable(spark, str(tmp_path / "evidence"), schema)
    drain(jobs.append_once_stream(jobs.file_stream(spark, source, schema, 1), once, ["record_id", "version"], str(tmp_path / "c2")))
    assert once.read().groupBy("record_id", "version").count().where("count > 1").count() == 0
    assert once.read().count() == 5


def test_append_and_push(spark, tmp_path):
    schema = "id long, topic string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, source, [(1, "record:new"), (2, "record:old"), (3, "user")], schema)
    drain(jobs.append_history(jobs.file_stream(spark, source, schema), out, str(tmp_path / "c1")))
    assert spark.read.parquet(out).count() == 3
    got = []
    drain(jobs.push_sink(jobs.file_stream(spark, source, schema), ["record:*"], "topic", lambda rows, _: got.extend(r.id for r in rows.collect()), str(tmp_path / "c2")))
    assert sorted(got) == [1, 2]


@pytest.mark.parametrize("split", [2])
def test_attempts_and_breaker(spark, tmp_path, split):
    schema = "ip long, at double, ok boolean"
    source = str(tmp_path / "in")
    rows = [(7, float(t), False) for t in range(12)] + [(7, 700.0, True), (8, 0.0, True)] + [(8, float(t), False) for t in range(1, 9)] + [(8, 50.0, True), (8, 51.0, True)]
    for k in range(split):
        put(spark, source, rows[k * len(rows) // split : (k + 1) * len(rows) // split], schema)
    drain(
        jobs.limit_attempts(jobs.file_stream(spark, source, schema), "ip").writeStream.format("memory").queryName(f"tries{split}").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    )
    allowed = {(r.ip, r["at"]): r.allowed for r in spark.table(f"tries{split}").collect()}
    assert len(allowed) == len(rows) and allowed[7, 9.0] and not allowed[7, 10.0] and not allowed[7, 11.0] and allowed[7, 700.0]
    drain(
        jobs.circuit_states(jobs.file_stream(spark, source, schema), "ip").writeStream.format("memory").queryName(f"calls{split}").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    )
    state = {(r.ip, r["at"]): r.state for r in spark.table(f"calls{split}").collect()}
    assert state[8, 5.0] == "closed" and state[8, 6.0] == "open" and state[8, 50.0] == "half-open" and state[8, 51.0] == "closed"


def test_event_time_extension(spark, tmp_path):
    schema = "event_type string, ts timestamp"
    source = str(tmp_path / "in")
    spark.sql("select 'a' as event_type, timestamp'2024-01-01 00:10:00' as ts union all select 'a', timestamp'2024-01-01 00:20:00' union all select 'b', timestamp'2024-01-01 03:00:00'").write.parquet(source)
    drain(
        jobs.hourly_turns(jobs.file_stream(spark, source, schema), "ts").writeStream.format("memory").queryName("hours").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    rows = spark.table("hours").select(F.hour("hour.start").alias("h"), "event_type", "n").collect()
    assert [tuple(r) for r in rows if r.event_type == "a"] == [(0, "a", 2)]


def test_snapshot_keeps_the_last_good_state(spark):
    now, good = [0.0], [True]

    def load():
        if not good[0]:
            raise OSError("gone")
        return spark.createDataFrame([(1, f"at {now[0]:.0f}")], "id long, name string")

    held = jobs.Snapshot(load, every_s=300, clock=lambda: now[0])
    assert held.current().first().name == "at 0"
    now[0] = 299
    assert held.current().first().name == "at 0"
    now[0], good[0] = 300, False
    assert held.current().first().name == "at 0" and held.failures == 1
    now[0], good[0] = 600, True
    assert held.current().first().name == "at 600" and held.failures == 0
    with pytest.raises(OSError):
        good[0] = False
        jobs.Snapshot(load).current()


def test_enriched_stream_and_retention(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    put(spark, source, [(1, 5.0), (2, 5.0)], "id long, now double")
    names = jobs.Snapshot(lambda: spark.createDataFrame([(1, "one")], "id long, name string"))
    drain(jobs.enriched_stream(jobs.file_stream(spark, source, "id long, now double"), names, "id", lambda rows, _: seen.extend(rows.collect()), str(tmp_path / "c1")))
    assert {(r.id, r.name) for r in seen} == {(1, "one"), (2, None)}
    table = jobs.VersionedTable(spark, str(tmp_path / "log"), "id long, at double")
    table.write(spark.createDataFrame([(k, float(k)) for k in range(6)], "id long, at double"), -1)
    drain(jobs.retention_loop(jobs.file_stream(spark, source, "id long, now double"), table, "at", 1.0, 3, str(tmp_path / "c2")))
    assert sorted(r.id for r in table.read().collect()) == [3, 4, 5]


def test_retried(spark, tmp_path):
    """Waits double, the third failure ends it, success resets, and a timer asks again."""
    source, out = str(tmp_path / "in"), []
    schema = "id long, at double, ok boolean, seen timestamp"
    rows = [(1, 10.0, False), (2, 10.0, False), (2, 11.0, False), (2, 13.0, False), (3, 10.0, False), (3, 11.0, True)]
    put(spark, source, [(*r, None) for r in rows], schema)
    spark.read.schema(schema).parquet(source).withColumn("seen", F.col("at").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "a"))
    put(spark, str(tmp_path / "a2"), [(9, 900.0, True)], "id long, at double, ok boolean")
    spark.read.parquet(str(tmp_path / "a2")).withColumn("seen", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
    stream = jobs.file_stream(spark, str(tmp_path / "a"), schema, 1).withWatermark("seen", "1 second")
    query = jobs.retried(stream, "id").writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    drain(query)
    got = {}
    for r in out:
        got.setdefault(r.id, []).append((r.attempt, r.what, r.due))
    assert got[2] == [(1, "retry", 11.0), (2, "retry", 13.0), (3, "given up", -1.0)]
    assert got[3] == [(1, "retry", 11.0), (1, "done", -1.0)][:1] + [(0 + 1, "done", -1.0)]
    assert got[1] == [(1, "retry", 11.0), (2, "due", 11.0)] and got[9] == [(1, "done", -1.0)]


def test_refined(spark):
    def call(t):
        import time

        if t == "bad":
            raise ValueError(t)
        time.sleep(5 if t == "slow" else 0)
        return t.upper()

    given = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, "slow"), (4, None)], "id long, t string").coalesce(1)
    got = {r.id: (r.refined, r.status) for r in jobs.refined(given, "id", "t", call, at_once=4, timeout_s=1.0).collect()}
    assert got == {1: ("FINE", "ok"), 2: ("bad", "failed"), 3: ("slow", "timeout"), 4: (None, "ok")}
