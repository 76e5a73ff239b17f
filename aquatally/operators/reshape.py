"""Between the wide table, packed days and one row per hour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aquatally.schema import DAY, METER, PREFIX, VEC, WIDTH, day_width, fitting, require, value_columns


def not_nan(c: Column) -> Column:
    """NaN becomes null: windows and aggregates rank NaN as the largest value."""
    return F.nanvl(c, F.lit(None).cast("double"))


def pack(df: DataFrame, columns: Sequence[str] | None = None, into: str = VEC) -> DataFrame:
    """Gather the hour columns of each row into one array; other columns stay."""
    columns = list(columns or value_columns(df.columns))
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.array(*[not_nan(F.col(c).cast("double")) for c in columns]).alias(into, metadata={WIDTH: len(columns)}))


def unpack(df: DataFrame, vec: str = VEC, hours: int | None = None, prefix: str = PREFIX) -> DataFrame:
    """Spread the array back into one column per hour."""
    rest = [c for c in df.columns if c != vec]
    hours = day_width(df, vec, hours)
    return df.select(*rest, *[F.get(fitting(vec, hours), F.lit(h)).alias(f"{prefix}{h}") for h in range(hours)])


def hour_ts(day: Column, hour: Column) -> Column:
    """Timestamp of an hour of a day, without a time zone."""
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour)


def explode_hours(df: DataFrame, vec: Column | str, names: tuple[str, str], *keep: str) -> DataFrame:
    """One row per element of an array, with its position.

    The outer form and a filter, since for the plain form Spark infers a filter on the
    array's size and thereby computes the array twice.
    """
    long = df.select(*keep, F.posexplode_outer(vec).alias(*names))
    return long.filter(F.col(names[0]).isNotNull())


def to_long(df: DataFrame, vec: str = VEC, value: str = "reading") -> DataFrame:
    """One row per meter, day and hour; filters on the keys still reach the scan."""
    require(df, DAY, vec)
    rest = [c for c in df.columns if c != vec]
    long = explode_hours(df, vec, ("hour", value), *rest)
    return long.withColumn("ts", hour_ts(F.col(DAY), F.col("hour")))


def to_wide(
    long: DataFrame, value: str = "reading", hours: int | None = None, prefix: str = PREFIX
) -> DataFrame:
    """One row per meter and day; without ``hours`` a job looks for the last one."""
    require(long, METER, DAY, "hour", value)
    if hours is None:
        hours = (long.agg(F.max("hour")).first()[0] or 0) + 1
    cells = [F.max(F.when(F.col("hour") == h, F.col(value))).alias(f"{prefix}{h}") for h in range(hours)]
    return long.groupBy(METER, DAY).agg(*cells)
