"""Row selection: meters, thresholds, previews and thinned series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aquatally.operators.reshape import explode_hours, to_long
from aquatally.operators.timeline import with_ordinal
from aquatally.schema import DAY, METER, VEC, day_width
from aquatally.sources.scratch import settle


def one_meter(df: DataFrame, meter) -> DataFrame:
    """Rows of one meter; the identifier is compared as text."""
    return df.filter(F.col(METER).cast("string") == str(meter))


def meters_containing(df: DataFrame, text: str) -> DataFrame:
    """Rows of the meters whose identifier contains a text."""
    return df.filter(F.col(METER).contains(text))


def first_meter_containing(df: DataFrame, text: str) -> DataFrame:
    """Rows of the first such meter."""
    first = meters_containing(df, text).agg(F.min(METER).alias(METER))
    return df.join(F.broadcast(first), METER, "left_semi")  # one row


def distinct_meters(df: DataFrame) -> DataFrame:
    return df.select(METER).distinct()


def preview(df: DataFrame, n: int = 50) -> DataFrame:
    """The first rows by meter and day."""
    return df.orderBy(METER, DAY).limit(n)


def imputed_cells(pairs: DataFrame, original: str, imputed: str) -> DataFrame:
    """One row per hour with ``is_imputed``: no original reading, but an imputed one."""
    zipped = F.arrays_zip(F.col(original), F.col(imputed))
    long = explode_hours(pairs, zipped, ("hour", "_pair"), METER, DAY)
    cells = long.select(
        METER,
        DAY,
        "hour",
        F.col(f"_pair.{original}").alias("val_orig"),
        F.col(f"_pair.{imputed}").alias("val_imp"),
    )
    return cells.withColumn("is_imputed", F.col("val_orig").isNull() & F.col("val_imp").isNotNull())


def count_above(df: DataFrame, thresholds: Sequence[float], vec: str = VEC) -> DataFrame:
    """Readings above each threshold, per meter: a sum over days, nothing is exploded."""
    counts = [
        F.sum(F.expr(f"size(filter({vec}, x -> x > {float(t)}D))")).alias(f"above_{t:g}") for t in thresholds
    ]
    return df.groupBy(METER).agg(*counts)


def sample_above(df: DataFrame, threshold: float, n: int = 20, vec: str = VEC) -> DataFrame:
    """The first readings above a threshold, in timeline order."""
    hot = df.filter(F.exists(vec, lambda x: x > threshold)).orderBy(METER, DAY).limit(n)
    cells = to_long(hot.select(METER, DAY, vec), vec).filter(F.col("reading") > threshold)
    return cells.orderBy(METER, DAY, "hour").limit(n)


def every_nth_hour(df: DataFrame, n: int, vec: str = VEC, hours: int | None = None) -> DataFrame:
    """Every n-th cell of each meter's timeline, starting with its first."""
    numbered = with_ordinal(df)
    cells = to_long(numbered, vec)
    position = F.col("_ordinal").cast("bigint") * day_width(df, vec, hours) + F.col("hour")
    return cells.filter(position % n == 0).drop("_ordinal")


def every_nth_point(series: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """Every n-th point of one aggregated series, which is as long as the calendar only."""
    order = Window.partitionBy(F.lit(0)).orderBy(*order_by)
    return series.withColumn("_rn", F.row_number().over(order)).filter((F.col("_rn") - 1) % n == 0).drop("_rn")


def first_points(series: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first n points of a series: points, not days."""
    return series.orderBy(*order_by).limit(n)


def with_position(df: DataFrame, order_by: Sequence[str], into: str = "position", keys: Sequence[str] = (METER,)) -> DataFrame:
    """0-based row number per meter by an explicit order, for a table without dates.

    Rows are range-partitioned by meter and order, so a long meter spans partitions;
    each partition numbers its own rows and adds the rows of those before it.
    """
    spread = df.repartitionByRange(*keys, *order_by).withColumn("_part", F.spark_partition_id())
    rows = settle(spread)
    groups = [*keys, "_part"]
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    number = F.row_number().over(Window.partitionBy(*groups).orderBy(*order_by)) - 1
    return rows.join(counts, groups).withColumn(into, number + F.col("_before")).drop("_part", "_before")
