"""Steps of a long plan as written tables, so that what several later steps read is made once and survives lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where none is named and there is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not hasattr(spark, "_rostrum_steps"):
        spark._rostrum_steps = "file://" + tempfile.mkdtemp(prefix="rostrum-")
    return spark._rostrum_steps


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet (parted by a column) to the shared folder and read again; the files go when Python ends, or by ``forget``."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/rostrum-step-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget() -> None:
    """Delete the tables of all steps so far; results that still read them are lost."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _at_exit() -> None:
    try:
        forget()
    except Exception:  # the session may be gone by now
        return
