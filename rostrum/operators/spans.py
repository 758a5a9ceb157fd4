"""Runs of words: windows over a stream, and the choice of non-overlapping runs from left to right."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType


def ahead(rows: DataFrame, key: str, order: list[str], columns: list[str], widest: int) -> DataFrame:
    """``rows`` with at (from 1) and, for each of ``columns``, an array next_<column> of its values here and in the rows that follow."""
    per = Window.partitionBy(key).orderBy(*order)
    kinds = dict(rows.dtypes)
    here = F.struct(*((F.coalesce(F.col(c), F.lit("")) if kinds[c] == "string" else F.col(c)).alias(c) for c in columns))
    rows = rows.withColumns({"at": F.row_number().over(per), "_next": F.collect_list(here).over(per.rowsBetween(0, widest - 1))})
    return rows.withColumns({f"next_{c}": F.col("_next")[c] for c in columns}).drop("_next")


def _settling(names: list[str], key: str, changed: str | None, skip: str | None):
    """Streams rows in the order of (key, at); between two rows it keeps where the last run ends, and counts."""

    def run(batches):
        now, end, gone_to, left = None, 0, 0, 0
        for b in batches:
            column = lambda name: b.column(names.index(name)).to_pylist()
            sizes = column("n")
            change = column(changed) if changed else sizes
            more_words = column(skip) if skip else [0] * len(sizes)
            taken, covered, gone, pos = [], [], [], []
            for k, at, n, to_change, stays in zip(column(key), column("at"), sizes, change, more_words):
                if k != now:
                    now, end, gone_to, left = k, 0, 0, 0
                inside = at <= end
                take = n is not None and not inside
                if take:
                    end = at + n - 1
                taken.append(take)
                covered.append(inside)
                gone.append(inside and at <= gone_to)
                pos.append(left)
                left += not gone[-1]
                if take and to_change:
                    gone_to = end
                    left += stays
            made = [pa.array(taken), pa.array(covered)]
            if changed:
                made += [pa.array(gone), pa.array(pos, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*names, "taken", "covered", *(["gone", "pos"] if changed else [])])

    return run


def settled(rows: DataFrame, key: str, changed: str | None = None, skip: str | None = None) -> DataFrame:
    """``rows`` (key, at, n: words of the run that may begin here, or null) with taken and covered.

    From left to right, the first run is taken, then the first that begins after it, and so on; covered rows
    lie within a taken run that began before. The rows of a key stream by in order, so that neither a key
    nor a run of overlapping ones is ever held, and the time is linear. With ``changed`` (a boolean column
    that tells which runs become one word) also gone, the rows that such a run swallows, and pos, a count
    from 0 of the words that are left: the run's own, and ``skip`` more where a run's first words stay.
    """
    schema = StructType([*rows.schema.fields]).add("taken", BooleanType()).add("covered", BooleanType())
    if changed:
        schema = schema.add("gone", BooleanType()).add("pos", LongType())
    dealt = rows.repartition(F.col(key)).sortWithinPartitions(key, "at")
    return dealt.mapInArrow(_settling(rows.columns, key, changed, skip), schema)
