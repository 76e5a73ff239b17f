"""Writers of tables, gap metrics and reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aquatally.operators.reshape import unpack
from aquatally.schema import DAY, VEC


def replacing(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let ``write`` make a table beside ``path``, then put it in the place of what is there.

    The old table stays until the new one is whole: a job that fails leaves it as it was, and it can be read while
    the new one is made from it.  The swap renames folders, which is a short step on a file system and a
    copy on an object store.
    """
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    place, new, old = (files.Path(p) for p in (path, staged, f"{staged}.old"))
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        write(staged)
    except BaseException:
        system.delete(new, True)
        raise
    there = system.exists(place)
    if there and not system.rename(place, old):
        raise OSError(f"{path} could not be moved aside; the new table is {staged}")
    if not system.rename(new, place):
        if there:
            system.rename(old, place)
        raise OSError(f"{staged} could not be moved to {path}")
    if there:
        system.delete(old, True)


def write_readings(df: DataFrame, path: str, fmt: str = "parquet", by_month: bool | None = None) -> None:
    """Write a table of days in the wide layout, replacing what is there once it is whole.

    Parquet is laid out by month, so a date filter prunes folders at the next read;
    rows of a month share files, hence one shuffle before the write.
    """
    wide = unpack(df) if VEC in df.columns else df
    if by_month is None:
        by_month = fmt == "parquet"

    def write(to: str) -> None:
        out = wide.write
        if by_month:
            out = wide.withColumn("month", F.date_format(DAY, "yyyy-MM")).hint("rebalance", "month").write.partitionBy("month")
        if fmt == "csv":
            out.csv(to, header=True)
        else:
            out.format(fmt).save(to)

    replacing(df.sparkSession, path, write)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    replacing(df.sparkSession, path, df.write.json)


def write_lines(report: DataFrame, path: str) -> None:
    """Report rows (``seq``, ``line``) as text, in order.

    A report has a fixed number of rows, so one file is bounded.
    """
    replacing(report.sparkSession, path, report.orderBy("seq").coalesce(1).select("line").write.text)
