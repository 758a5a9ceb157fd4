"""Exports of the entity dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame


def export_dictionary(names: DataFrame, csv_path: str, json_path: str) -> None:
    """The same rows as CSV with a header and as JSON lines; nested columns only go to JSON."""
    flat = [f.name for f in names.schema if f.dataType.typeName() not in ("array", "map", "struct")]
    names.select(*flat).write.mode("overwrite").option("header", True).csv(csv_path)
    names.write.mode("overwrite").json(json_path)
