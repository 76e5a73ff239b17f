"""Scans of readings tables and a generator of synthetic ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aquatally.operators.reshape import not_nan, pack
from aquatally.schema import DAY, METER, PREFIX, VEC, readings_schema, require, value_columns


def read_readings(
    spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | None = None
) -> DataFrame:
    """Scan a wide readings table; missing readings are null whatever the file wrote.

    CSV is read by an explicit schema, never by inference, and in input splits, so a
    file larger than memory needs nothing special.  Without a ``schema`` the header line
    alone tells how many hours a day has.
    """
    if fmt == "csv":
        if schema is None:
            header = spark.read.csv(path, header=True, inferSchema=False).columns
            schema = readings_schema(len(value_columns(header)))
        df = spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    else:
        df = spark.read.format(fmt).load(path)
    require(df, METER, DAY)
    cells = set(value_columns(df.columns))
    return df.select(
        *[not_nan(F.col(c).cast("double")).alias(c) if c in cells else F.col(c) for c in df.columns]
    )


def read_days(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """As ``read_readings``, with each day packed into one array."""
    return pack(read_readings(spark, path, fmt))


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_pair(
    spark: SparkSession, original: str, imputed: str, fmt: str = "csv"
) -> tuple[DataFrame, DataFrame] | None:
    """The original and the imputed table, or None when there is no imputed one yet."""
    if not path_exists(spark, imputed):
        return None
    return read_days(spark, original, fmt), read_days(spark, imputed, fmt)


def synthetic_readings(
    spark: SparkSession, meters: int, days: int, null_share: float = 0.2, seed: int = 42, hours: int = 24
) -> DataFrame:
    """Rising readings of made-up meters, a share of them missing; a day is one array."""
    grid = spark.range(meters * days).select(
        (F.col("id") % meters).alias("m"), F.floor(F.col("id") / meters).cast("int").alias("d")
    )
    cells = [
        F.when(
            F.rand(seed + 2 * h) >= null_share,
            100.0 + 400.0 * F.col("m") + 10.0 * F.col("d") + h + 5.0 * F.rand(seed + 2 * h + 1),
        )
        for h in range(hours)
    ]
    return grid.select(
        F.concat(F.lit("METER_"), F.lpad((F.col("m") + 1).cast("string"), 6, "0")).alias(METER),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).alias(DAY),
        F.array(*cells).alias(VEC),
    )


def parse_day(df: DataFrame, column: str = DAY, pattern: str = "yyyy-MM-dd") -> DataFrame:
    """Text to date; what is no date becomes null."""
    return df.withColumn(column, F.try_to_timestamp(F.col(column).cast("string"), F.lit(pattern)).cast("date"))


__all__ = ["PREFIX", "parse_day", "path_exists", "read_days", "read_pair", "read_readings", "synthetic_readings"]
