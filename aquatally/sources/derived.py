"""Readings tables that Spark derives from the ``events`` table.

Ten users form a meter and the event values are its consumption, so the running
total is a cumulative reading.  Gaps, errors and duplicates follow fixed rules of
the meter number, the day and the hour.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aquatally.schema import DAY, METER, VEC, WIDTH

# The hours of a day, and the gap, error and duplicate rules.
HOURS = 24
CALIBRES = (15, 20, 30, 40, 80)


def _calendar(events: DataFrame) -> tuple[datetime.date, int]:
    """First day and number of days of the events."""
    first, last = events.agg(F.min("ts").cast("date"), F.max("ts").cast("date")).first()
    return (first, (last - first).days + 1) if first else (datetime.date(1970, 1, 1), 0)


def _day_totals(events: DataFrame, first: datetime.date) -> DataFrame:
    """Consumption in cents per meter, day and hour; null in an hour without events.

    A sum combines before the shuffle, so a meter with most of the events is no
    hot group: at most one row per task, meter and day leaves the map side.
    """
    cents = F.round(F.col("value") * 100).cast("bigint")
    day = F.datediff(F.col("ts").cast("date"), F.lit(first))
    hourly = events.select(
        F.expr("user_id div 10").alias("mno"), day.alias("d"), F.hour("ts").alias("h"), cents.alias("cents")
    )
    return hourly.groupBy("mno", "d").agg(
        F.expr(f"array({', '.join(f'sum(if(h = {h}, cents, null))' for h in range(HOURS))})").alias("used")
    )


def _running() -> Column:
    """Running total at each hour, null before the meter's first event."""
    return F.expr(
        """transform(used, (u, hour) -> if(
               before is not null or exists(sequence(0, hour), i -> get(used, i) is not null),
               aggregate(sequence(0, hour), coalesce(before, 0L), (a, i) -> a + coalesce(get(used, i), 0L)),
               null))"""
    )


def _is_outage() -> Column:
    return F.expr(
        "mno % 15 = 14 or (mno % 7 = 3 and d between 12 and 16)"
        " or (mno % 13 = 5 and d between 3 and 11) or (mno * 7 + d) % 11 = 0"
    )


def _numbered_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every meter and day with its readings, and the numbers the rules refer to.

    Consumption is never negative, so the largest running total of an hour is the
    one at its end.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "value")
    first, n_days = _calendar(events)
    used = F.array_compact("used")
    seen = _day_totals(events, first).withColumn("sum", F.aggregate(used, F.lit(0).cast("bigint"), lambda a, x: a + x))
    along = Window.partitionBy("mno").orderBy("d")  # a meter has one row per day here
    seen = seen.select(
        "mno",
        F.col("d").alias("seen"),
        "used",
        "sum",
        F.sum("sum").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.when(F.row_number().over(along) == 1, F.lit(0)).otherwise(F.col("d")).alias("from"),
        (F.coalesce(F.lead("d").over(along), F.lit(n_days)) - 1).alias("to"),
    )
    # a day without events follows the last one that had some
    days = seen.withColumn("d", F.explode(F.sequence("from", "to")))
    nothing = F.expr(f"array_repeat(cast(null as bigint), {HOURS})")
    after = F.coalesce("before", F.lit(0)) + F.col("sum")
    days = days.select(
        "mno",
        "d",
        F.date_add(F.lit(first), F.col("d")).alias(DAY),
        F.when(F.col("d") == F.col("seen"), F.col("used")).otherwise(nothing).alias("used"),
        F.when(F.col("d") <= F.col("seen"), F.col("before")).otherwise(after).alias("before"),
    )
    carried = (F.col("mno") + F.col("d")) % 5 == 0
    shown = F.zip_with(_running(), F.col("used"), lambda t, u: F.when(carried | u.isNotNull(), t / 100.0))
    missing = F.expr(f"array_repeat(cast(null as double), {HOURS})")
    return days.withColumn(VEC, F.when(_is_outage(), missing).otherwise(shown)).drop("used", "before")


def _as_days(numbered: DataFrame, *more: str) -> DataFrame:
    return numbered.select(
        F.concat(F.lit("M"), F.lpad(F.col("mno").cast("string"), 5, "0")).alias(METER),
        DAY,
        F.concat(F.lit("C"), F.col("mno").cast("string")).alias("contact_id"),
        F.get(F.array(*[F.lit(c) for c in CALIBRES]), (F.col("mno") % 5).cast("int")).alias("calibre"),
        *more,
        F.col(VEC).alias(VEC, metadata={WIDTH: HOURS}),
    )


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with gaps: one row per meter and day."""
    return _as_days(_numbered_days(spark, sf_dir))


def dirty_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with injected zeros, spikes and drops."""
    numbered = _numbered_days(spark, sf_dir)

    def spoil(x: Column, hour: Column) -> Column:
        k = F.col("mno") * 31 + F.col("d") * 24 + hour
        return (
            F.when(x.isNull(), x)
            .when(k % 97 == 0, F.lit(0.0))
            .when(k % 101 == 0, x * 1.6)
            .when(k % 103 == 0, x * 0.7)
            .otherwise(x)
        )

    return _as_days(numbered.withColumn(VEC, F.transform(VEC, spoil)))


def loaded_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings plus a second, differing load of some days; ``load_seq`` is the load order."""
    numbered = _numbered_days(spark, sf_dir)
    loads = F.when((F.col("mno") * 3 + F.col("d")) % 17 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    copies = numbered.withColumn("load_seq", F.explode(loads))
    return _as_days(
        copies.withColumn(VEC, F.transform(VEC, lambda x: x + F.col("load_seq").cast("double"))), "load_seq"
    )
