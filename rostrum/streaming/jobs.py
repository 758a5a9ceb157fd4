"""Incremental maintenance on Structured Streaming: queues, appends, versioned replacement, attempt rules."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.upserts import append_missing, replace_generation


def file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A bounded queue: at most so many new files a micro-batch, so a burst waits instead of being dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated_queue(stream: DataFrame, key: str, at: str, keep: str = "1 hour") -> DataFrame:
    """Each id once; state older than ``keep`` behind the watermark is dropped."""
    return stream.withWatermark(at, keep).dropDuplicatesWithinWatermark([key])


def append_history(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only log; the file sink's manifest makes each row land once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class VersionedTable:
    """A small table whose every state is a folder named by its batch; readers take the newest complete one."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def _states(self) -> list[int]:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return []
        out = []
        for status in fs.listStatus(fs_path):
            name = status.getPath().getName()
            done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
            if name.startswith("batch=") and fs.exists(done):
                out.append(int(name[6:]))
        return sorted(out)

    def read(self, before: int | None = None) -> DataFrame:
        states = [s for s in self._states() if before is None or s < before]
        if not states:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch={states[-1]}")

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


def replace_stream(stream: DataFrame, table: VersionedTable, key: str, version: str, checkpoint: str) -> StreamingQuery:
    """One generation of chunks per record: newer versions replace, stale ones change nothing.

    A batch starts from the state before it, so running it again after a failure gives the same state.
    """

    def apply(rows: DataFrame, batch: int) -> None:
        newest = rows.groupBy(key).agg(F.max(version).alias("_top"))
        rows = rows.join(newest, key).where(F.col(version) == F.col("_top")).drop("_top")
        table.write(replace_generation(table.read(before=batch), rows.select(*table.read(before=batch).columns), key, version), batch)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once_stream(stream: DataFrame, table: VersionedTable, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Evidence rows of a (transcript, version) are appended once, whatever is sent again."""

    def apply(rows: DataFrame, batch: int) -> None:
        have = table.read(before=batch)
        table.write(append_missing(have, rows.select(*have.columns).dropDuplicates(keys), keys), batch)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def push_sink(stream: DataFrame, patterns: list[str], topic: str, deliver, checkpoint: str) -> StreamingQuery:
    """Rows whose topic is subscribed (exact, or prefix with *) go to ``deliver(rows, batch)``."""
    hit = F.lit(not patterns)
    for p in patterns:
        hit = hit | (F.col(topic).startswith(p[:-1]) if p.endswith("*") else F.col(topic) == p)
    return stream.where(hit).writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def limit_attempts(stream: DataFrame, key: str, most: int = 20, window_s: float = 900.0, lock_after: int = 10, lock_s: float = 600.0) -> DataFrame:
    """Attempts (key, at seconds, ok) with whether each is allowed.

    An attempt is refused beyond ``most`` in the sliding window, or for ``lock_s`` after ``lock_after`` failures
    in a row; a success resets the row. State holds the window's times only, and expires when idle.
    """

    def walk(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, fails, until = state.get if state.exists else ("", 0, 0.0)
        recent = [float(x) for x in times.split(",") if x]
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        out = []
        for at, ok in zip(rows["at"], rows["ok"]):
            recent = [x for x in recent if at - x < window_s]
            allowed = at >= until and len(recent) < most
            recent.append(at)
            fails = 0 if ok and allowed else fails + 1
            if fails >= lock_after and at >= until:
                until, fails = at + lock_s, 0
            out.append((group[0], at, bool(allowed)))
        state.update((",".join(map(repr, recent)), fails, until))
        state.setTimeoutDuration(int(1000 * max(window_s, lock_s)))
        yield pd.DataFrame(out, columns=[key, "at", "allowed"])

    return stream.select(key, "at", "ok").groupBy(key).applyInPandasWithState(
        walk, f"{key} long, at double, allowed boolean", "times string, fails int, until double", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def circuit_states(stream: DataFrame, key: str, open_after: int = 5, open_s: float = 30.0) -> DataFrame:
    """Calls (key, at, ok) with the breaker's state at each: closed, open, or half-open (one trial call)."""

    def walk(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fails, opened = state.get if state.exists else (0, -1.0)
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        out = []
        for at, ok in zip(rows["at"], rows["ok"]):
            now = "closed" if opened < 0 else "open" if at - opened < open_s else "half-open"
            out.append((group[0], at, now))
            if now == "open":
                continue
            fails = 0 if ok else fails + 1
            if ok:
                opened = -1.0
            elif now == "half-open" or fails >= open_after:
                opened = at
        state.update((fails, opened))
        yield pd.DataFrame(out, columns=[key, "at", "state"])

    return stream.select(key, "at", "ok").groupBy(key).applyInPandasWithState(
        walk, f"{key} long, at double, state string", "fails int, opened double", "append", GroupStateTimeout.NoTimeout
    )


def hourly_turns(stream: DataFrame, at: str, late: str = "10 minutes") -> DataFrame:
    """Extension: event-time counts per hour with a watermark for late rows."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 hour").alias("hour"), "event_type").agg(F.count("*").alias("n"))


class Snapshot:
    """The last good state of a static side, read anew at most every ``every_s`` seconds; a failed read keeps it.

    ``load`` gives a DataFrame; it is tried by running it, and what it gave last stands until it works again.
    """

    def __init__(self, load: Callable[[], DataFrame], every_s: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.load, self.every_s, self.clock = load, every_s, clock
        self.good: DataFrame | None = None
        self.at, self.failures = float("-inf"), 0

    def current(self) -> DataFrame:
        if self.clock() - self.at >= self.every_s:
            self.at = self.clock()
            try:
                fresh = self.load()
                fresh.limit(1).collect()
                self.good, self.failures = fresh, 0
            except Exception:
                self.failures += 1
                if self.good is None:
                    raise
        return self.good


def enriched_stream(stream: DataFrame, snapshot: Snapshot, key: str, deliver, checkpoint: str) -> StreamingQuery:
    """Each micro-batch joined to the snapshot that is current then goes to ``deliver(rows, batch)``."""
    apply = lambda rows, batch: deliver(rows.join(snapshot.current(), key, "left"), batch)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retention_loop(ticks: DataFrame, table: VersionedTable, at: str, keep_s: float, most: int, checkpoint: str) -> StreamingQuery:
    """At every tick (column now, seconds) drops the oldest rows that are older than ``keep_s``, at most ``most`` of them."""

    def apply(rows: DataFrame, batch: int) -> None:
        now = rows.agg(F.max("now")).first()[0]
        have = table.read(before=batch)
        if now is not None:
            ids = have.columns
            gone = have.where(F.col(at) < now - keep_s).orderBy(at, *ids).limit(most)
            have = have.join(gone, ids, "left_anti")
        table.write(have, batch)

    return ticks.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retried(stream: DataFrame, key: str, most: int = 3, first_s: float = 1.0) -> DataFrame:
    """Outcomes (key, at seconds, ok) of attempts to what comes next: done, retry (at due) or given up.

    The wait doubles with each failure. A timer on event time fires once a retry is due and emits it, so an
    attempt is asked for again even when nothing more arrives for its key. ``stream`` has a watermark on
    the timestamp column ``seen``.
    """

    def walk(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            fails, due = state.get
            state.update((fails, -1.0))  # asked for; the state stays for the next outcome
            yield pd.DataFrame([(group[0], fails + 1, "due", due)], columns=[key, "attempt", "what", "due"])
            return
        fails, due = state.get if state.exists else (0, -1.0)
        out = []
        for at, ok in pd.concat(list(frames)).sort_values("at", kind="stable")[["at", "ok"]].itertuples(index=False):
            fails = 0 if ok else fails + 1
            what = "done" if ok else "retry" if fails < most else "given up"
            due = at + first_s * 2 ** (fails - 1) if what == "retry" else -1.0
            out.append((group[0], fails + (what == "done"), what, due))
        if due < 0:
            state.remove()
        else:
            state.update((fails, due))
            state.setTimeoutTimestamp(max(int(1000 * due), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "attempt", "what", "due"])

    return stream.groupBy(key).applyInPandasWithState(
        walk, f"{key} long, attempt int, what string, due double", "fails int, due double", "append", GroupStateTimeout.EventTimeTimeout
    )


def refined(chunks: DataFrame, key: str, text: str, call: Callable[[str], str], at_once: int = 4, timeout_s: float = 30.0) -> DataFrame:
    """key, refined text and status (ok, failed or timeout) of each chunk by an outside model.

    A task has at most ``at_once`` calls under way. A call that fails or is late leaves its chunk as it is; late
    ones are not waited for. Null texts are not sent.
    """
    names = [key, "refined", "status"]

    def run(frames):
        from concurrent.futures import ThreadPoolExecutor, TimeoutError

        for f in frames:
            pool = ThreadPoolExecutor(at_once)
            waiting = [pool.submit(call, t) if t is not None else None for t in f[text]]
            out = []
            for k, t, job in zip(f[key], f[text], waiting):
                try:
                    out.append((k, job.result(timeout_s) if job else None, "ok"))
                except TimeoutError:
                    job.cancel()
                    out.append((k, t, "timeout"))
                except Exception:
                    out.append((k, t, "failed"))
            pool.shutdown(wait=False, cancel_futures=True)
            yield pd.DataFrame(out, columns=names)

    return chunks.select(F.col(key).cast("long").alias(key), text).mapInPandas(run, f"{key} long, refined string, status string")
