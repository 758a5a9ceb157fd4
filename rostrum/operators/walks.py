"""Walks whose every decision depends on the ones before."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def balanced_batches(bundles: DataFrame, key: str, most: int) -> DataFrame:
    """Ordered bundles (key, pos, duration) of each key to at most ``most`` contiguous batches.

    A batch closes once it holds its share of what was left when it began, but never so late that fewer
    bundles than batches remain. Returns key, pos, batch (from 0).
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos").reset_index(drop=True)
        left, batch, held, out = float(rows["duration"].sum()), 0, 0.0, []
        share = left / most
        for i, d in enumerate(rows["duration"]):
            out.append(batch)
            held += d
            after, batches = len(rows) - i - 1, most - batch - 1
            if after and batches and (held >= share or after <= batches):
                left -= held
                share, held, batch = left / batches, 0.0, batch + 1
        return pd.DataFrame({key: rows[key], "pos": rows["pos"], "batch": out})

    return bundles.select(key, "pos", "duration").groupBy(key).applyInPandas(walk, f"{key} long, pos long, batch int")


def turn_chunks(words: DataFrame, key: str, order: list[str], least: int = 100, most: int = 200, pause: float = 2.0) -> DataFrame:
    """Words (key, order, word, speaker, start, end, and entity if there is one) to chunks of one speaker turn each.

    A turn longer than ``most`` words splits at the first longest pause of at least ``pause`` seconds between
    its words ``least`` and ``most``, else after ``most`` words; the rest splits again, the tail may be short.
    A chunk lists the distinct entities of its words. Turns are numbered by windows and dealt out by
    transcript and turn; a task streams sorted words and holds one chunk's.
    """
    per = Window.partitionBy(key).orderBy(*order)
    entity = F.col("entity") if "entity" in words.columns else F.lit(None)
    first = (F.row_number().over(per) == 1) | ~F.col("speaker").eqNullSafe(F.lag("speaker").over(per))
    rows = words.select(
        F.col(key).cast("long").alias(key), F.sum(first.cast("long")).over(per).alias("turn"), F.row_number().over(per).alias("at"), F.col("word").cast("string").alias("word"),
        F.col("speaker").cast("string").alias("speaker"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), entity.cast("string").alias("entity"),
    )
    schema = f"{key} long, turn long, part int, speaker string, n_words int, start double, end double, text string, entities array<string>"

    def cut(held: list) -> int:
        best, at = None, most
        for j in range(least, most):
            gap = held[j][4] - held[j - 1][5]
            if gap >= pause and (best is None or gap > best):
                best, at = gap, j
        return at

    def stream(batches):
        held, part, made = [], 0, []

        def chunk(n: int) -> None:
            nonlocal held, part
            own, held = held[:n], held[n:]
            names = sorted({w[6] for w in own if w[6] is not None})
            made.append((own[0][0], own[0][1], part, own[0][3], len(own), own[0][4], own[-1][5], " ".join(w[2] for w in own if w[2] is not None), names))
            part += 1

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in (key, "turn", "word", "speaker", "start", "end", "entity"))):
                if held and held[0][:2] != row[:2]:
                    chunk(len(held))
                    part = 0
                held.append(row)
                if len(held) > most:
                    chunk(cut(held))
            if made:
                yield out(made)
                made.clear()
        if held:
            chunk(len(held))
            yield out(made)

    names_ = [key, "turn", "part", "speaker", "n_words", "start", "end", "text", "entities"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.list_(pa.string())]

    def out(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*made), kinds)], names=names_)

    dealt = rows.repartition(key, "turn").sortWithinPartitions(key, "turn", "at").drop("at")
    chunks = dealt.mapInArrow(stream, schema)
    ordinal = (F.row_number().over(Window.partitionBy(key).orderBy("turn", "part")) - 1).alias("ordinal")
    return chunks.select(key, ordinal, "speaker", "n_words", "start", "end", "text", "entities")
