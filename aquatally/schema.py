"""Names, types and schema rules of the readings tables.

A readings table is *wide*: one row per meter and day, with one column per hour
of cumulative reading.  Inside the engine the hours of a row are packed into one
array column, so a day travels through joins and shuffles as a single row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

METER = "id"
DAY = "data"
VEC = "v"
PREFIX = "index_"
WIDTH = "hours"  # key in the metadata of a day column: its cells per day


def value_columns(columns: Iterable[str], prefix: str = PREFIX) -> list[str]:
    """Reading columns in hour order; it is an error to have none, to lack an hour between
    others, or to have a column with the prefix that names no hour."""
    numbered = {}
    for name in columns:
        if not name.startswith(prefix):
            continue
        if not re.fullmatch(r"\d+", name[len(prefix) :]):
            raise ValueError(f"{name} names no hour")
        hour = int(name[len(prefix) :])
        if hour in numbered:
            raise ValueError(f"{name} and {numbered[hour]} name the same hour")
        numbered[hour] = name
    if not numbered:
        raise ValueError(f"no reading columns named {prefix}<hour>")
    first, last = min(numbered), max(numbered)
    if absent := [h for h in range(first, last) if h not in numbered]:
        raise ValueError(f"no column {prefix}{absent[0]} between {prefix}{first} and {prefix}{last}")
    return [numbered[h] for h in sorted(numbered)]


def day_width(df: DataFrame, vec: str = VEC, hours: int | None = None) -> int:
    """Cells per day: as given, as the column's metadata say, or else as the longest day has.

    The last way runs a job, so the operators pass the metadata on.
    """
    if hours is None:
        hours = df.schema[vec].metadata.get(WIDTH)
    if hours is None:
        hours = df.agg(F.max(F.size(vec))).first()[0] or 0
    return hours


def with_day(df: DataFrame, vec: str, value: Column) -> DataFrame:
    """Replace the day column; its width stays known."""
    return df.withColumn(vec, value.alias(vec, metadata=df.schema[vec].metadata))


def fitting(vec: str, hours: int) -> Column:
    """The day column; a day with more cells than ``hours`` is an error, never cut."""
    longer = F.raise_error(F.concat(F.lit(f"a day has more than {hours} cells: "), F.size(vec).cast("string")))
    return F.when(F.size(vec) > hours, longer.cast("array<double>")).otherwise(F.col(vec))


def whole_day(c: str, hours: int) -> Column:
    """The day column with exactly ``hours`` cells: a shorter or absent day ends in missing cells."""
    day = fitting(c, hours)
    missing = lambda n: F.array_repeat(F.lit(None).cast("double"), n)
    lacking = F.greatest(hours - F.size(day), F.lit(0))
    return F.when(F.size(day) == hours, day).otherwise(F.concat(F.coalesce(day, missing(0)), F.when(day.isNull(), missing(hours)).otherwise(missing(lacking))))


def readings_schema(hours: int) -> T.StructType:
    """Explicit schema of the wide input, so no scan has to infer types."""
    fields = [
        T.StructField(METER, T.StringType()),
        T.StructField(DAY, T.DateType()),
        T.StructField("contact_id", T.StringType()),
        T.StructField("calibre", T.IntegerType()),
    ]
    fields += [T.StructField(f"{PREFIX}{h}", T.DoubleType()) for h in range(hours)]
    return T.StructType(fields)


def require(df: DataFrame, *names: str) -> DataFrame:
    """Fail while planning when a needed column is absent."""
    absent = [name for name in names if name not in df.columns]
    if absent:
        raise ValueError(f"missing column(s) {', '.join(absent)}; have {', '.join(df.columns)}")
    return df
