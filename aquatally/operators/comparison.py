"""Original against imputed or smoothed readings, and dashboard figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aquatally.functions import dayvec
from aquatally.operators.pairing import attach_original, join_meters, meters_in_both, pair_days, rows_of_meters
from aquatally.operators.reshape import explode_hours, hour_ts, to_long
from aquatally.operators.select import imputed_cells
from aquatally.schema import DAY, METER, VEC


def _cells(df: DataFrame, vec: str) -> DataFrame:
    """Readings of a meter, one per row: an explode feeds partial aggregates, no shuffle."""
    return explode_hours(df, vec, ("hour", "x"), METER)


def series_stats(df: DataFrame, vec: str = VEC) -> DataFrame:
    """Mean, extremes and population deviation of each meter's readings."""
    return _cells(df, vec).groupBy(METER).agg(
        F.avg("x").alias("mean"),
        F.max("x").alias("max"),
        F.min("x").alias("min"),
        F.stddev_pop("x").alias("std"),
    )


def value_ranges(df: DataFrame, vec: str = VEC) -> DataFrame:
    """Smallest, largest and mean reading and the null count of each meter."""
    return _cells(df, vec).groupBy(METER).agg(
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.avg("x").alias("mean"),
        F.count_if(F.col("x").isNull()).alias("nulls"),
    )


def network_heatmap(df: DataFrame, rows: int = 100, vec: str = VEC) -> DataFrame:
    """Readings of the first rows of the table."""
    return to_long(df.select(METER, DAY, vec).orderBy(METER, DAY).limit(rows), vec)


def meter_comparison(imputed: DataFrame, original: DataFrame) -> DataFrame:
    """Original and imputed reading of every hour of the meters both tables have."""
    shared = rows_of_meters(imputed, meters_in_both(imputed, original))
    pairs = attach_original(shared, original).select(METER, DAY, VEC, "v_orig")
    nothing = F.transform(VEC, lambda x: F.lit(None).cast("double"))
    pairs = pairs.withColumn("v_orig", F.coalesce("v_orig", nothing))
    cells = imputed_cells(pairs, "v_orig", VEC)
    return cells.withColumn("ts", hour_ts(F.col(DAY), F.col("hour")))


def imputation_stats(original: DataFrame, vec: str = VEC) -> DataFrame:
    """Points to impute, their share and all points, per meter."""
    missing = F.sum(dayvec.missing_count(F.col(vec)))
    total = F.sum(F.size(vec))
    return original.groupBy(METER).agg(
        missing.alias("points_imputed"), F.try_divide(F.lit(100.0) * missing, total).alias("pct_imputed"), total.alias("total_points")
    )


def rows_per_meter(df: DataFrame, at_least: int = 10) -> DataFrame:
    """Meters with enough rows."""
    return df.groupBy(METER).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") >= at_least)


def comparison_meters(
    original: DataFrame,
    at_least_rows: int = 10,
    first: int = 150,
    at_least_missing: int = 20,
    n: int = 4,
    vec: str = VEC,
) -> DataFrame:
    """The meters to show: among those with most rows, the first ones with enough gaps."""
    per_meter = original.groupBy(METER).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(dayvec.missing_count(F.col(vec))).alias("n_missing")
    )
    rank = [F.col("n_rows").desc(), F.col(METER)]
    longest = per_meter.filter(F.col("n_rows") >= at_least_rows).orderBy(*rank).limit(first)
    return longest.filter(F.col("n_missing") >= at_least_missing).orderBy(*rank).limit(n)


def comparison_points(original: DataFrame, imputed: DataFrame, meters: DataFrame) -> DataFrame:
    """Every hour of the chosen meters: original, imputed and whether it was imputed."""
    pairs = pair_days(rows_of_meters(original, meters), imputed, ("val_orig", "val_imp"))
    cells = imputed_cells(pairs, "val_orig", "val_imp")
    return cells.withColumn("is_imputed", F.col("val_orig").isNull()).withColumn(
        "ts", hour_ts(F.col(DAY), F.col("hour"))
    )


def comparison_totals(original: DataFrame, meters: DataFrame, vec: str = VEC) -> DataFrame:
    """Points, missing points and days of each chosen meter."""
    return rows_of_meters(original, meters).groupBy(METER).agg(
        F.sum(F.size(vec)).alias("n_total"),
        F.sum(dayvec.missing_count(F.col(vec))).alias("n_missing"),
        F.count(F.lit(1)).alias("n_dates"),
    )


def dashboard(df: DataFrame, columns: int) -> DataFrame:
    """Distinct meters, rows and columns of a table."""
    return df.agg(
        F.countDistinct(METER).alias("meters"),
        F.count(F.lit(1)).alias("rows"),
        F.lit(columns).cast("bigint").alias("columns"),
    )


def workload(df: DataFrame) -> DataFrame:
    """Rows, meters and rows per meter, null in an empty table."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(METER).alias("meters"),
        F.try_divide(F.count(F.lit(1)), F.countDistinct(METER)).alias("rows_per_meter"),
    )


def smoothing_difference(
    imputed: DataFrame, smoothed: DataFrame, changed_above: float = 0.01, idle_below: float = 0.001
) -> DataFrame:
    """How far smoothing moved the readings, and whether it did anything at all."""
    pairs = pair_days(imputed, smoothed, ("_a", "_b"))
    return smoothing_difference_rows(pairs, "_a", "_b", changed_above, idle_below)


def smoothing_difference_rows(
    df: DataFrame, imputed: str, smoothed: str = VEC, changed_above: float = 0.01, idle_below: float = 0.001
) -> DataFrame:
    """``smoothing_difference`` of rows that carry the readings before and after: the fill runs once, nothing is joined."""
    moved = explode_hours(df, F.zip_with(imputed, smoothed, lambda a, b: F.abs(a - b)), ("hour", "d"))
    figures = moved.agg(
        F.avg("d").alias("mean_abs_diff"),
        F.max("d").alias("max_abs_diff"),
        F.count_if(F.col("d") > changed_above).alias("changed"),
        F.count(F.lit(1)).alias("cells"),
    )
    applied = F.when(F.col("max_abs_diff") < idle_below, "not applied").otherwise("applied")
    return figures.withColumn("verdict", applied)


def quality_violations(result: DataFrame, original: DataFrame, vec: str = VEC) -> DataFrame:
    """Per meter: nulls left, and readings outside the range observed for the meter.

    A meter without any observation has no range; its readings are expected to be 0.
    """
    seen = original.groupBy(METER).agg(
        F.min(F.array_min(vec)).alias("_lo"), F.max(F.array_max(vec)).alias("_hi")
    )

    def outside(x: Column) -> Column:
        return F.when(F.col("_lo").isNull(), x != 0).otherwise((x < F.col("_lo")) | (x > F.col("_hi")))

    rows = join_meters(result.select(METER, DAY, vec), seen, "left")
    return rows.groupBy(METER).agg(
        F.sum(dayvec.missing_count(F.col(vec))).alias("nulls_left"),
        F.sum(F.size(F.filter(vec, outside))).alias("out_of_range"),
    )
