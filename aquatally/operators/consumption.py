"""Hourly consumption of meters and of the network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aquatally.functions import dayvec
from aquatally.operators.pairing import KEYS, pair_series
from aquatally.operators.reshape import explode_hours, hour_ts, to_long
from aquatally.operators.timeline import with_previous_day
from aquatally.schema import DAY, METER, VEC, day_width, fitting, with_day


def day_consumption(df: DataFrame, into: str = "used", vec: str = VEC) -> DataFrame:
    """Consumption inside each day: 23 steps of 24 readings, none across midnight."""
    return df.withColumn(into, dayvec.steps(F.col(vec)))


def valid_consumption(df: DataFrame, used: str = "used") -> DataFrame:
    """One row per hour whose consumption is known and not negative."""
    cells = to_long(df.select(METER, DAY, used), used, "used")
    return cells.filter(F.col("used") >= 0)


def network_mean(df: DataFrame, into: str = "mean_m3h", vec: str = VEC, hours: int | None = None) -> DataFrame:
    """Mean consumption over all meters per day and hour; 0 when no meter has a valid one."""
    return network_means(df, {into: vec}, hours)


def network_means(df: DataFrame, series: dict[str, str], hours: int | None = None) -> DataFrame:
    """``network_mean`` of several columns of readings at once: ``series`` names the column behind each mean.

    Each day row feeds an average per step that combine before the shuffle by date, so the
    readings are never exploded and a crowded date is no hot group.  If days differ in width
    from column to column, the hours that all have are compared.
    """
    widths = []
    for vec in series.values():
        widths.append(day_width(df, vec, hours))
        df = with_day(df, vec, fitting(vec, widths[-1]))

    def mean(into: str, vec: str, h: int) -> str:
        step = f"get({vec}, {h + 1}) - get({vec}, {h})"
        return f"coalesce(avg(if({step} >= 0, {step}, null)), 0D) as {into}"

    def point(h: int) -> str:
        return f"struct({', '.join(mean(into, vec, h) for into, vec in series.items())})"

    means = F.expr(f"array({', '.join(point(h) for h in range(min(widths) - 1))})")
    by_date = df.groupBy(DAY).agg(means.alias("_means"))
    return by_date.select(DAY, F.posexplode("_means").alias("hour", "_point")).select(DAY, "hour", "_point.*")


def compare_network(original: DataFrame, imputed: DataFrame) -> DataFrame:
    """Network consumption before and after imputation on the dates both tables have."""
    both = pair_series(network_mean(original, "orig_m3h"), network_mean(imputed, "imp_m3h"))
    return compare_series(both).withColumn("ts", hour_ts(F.col(DAY), F.col("hour")))


def compare_network_rows(df: DataFrame, original: str, imputed: str = VEC, hours: int | None = None) -> DataFrame:
    """``compare_network`` of rows that carry both readings: one scan and one shuffle by date, no join.

    Rows without a day have no date to compare on.
    """
    both = network_means(df.filter(F.col(DAY).isNotNull()), {"orig_m3h": original, "imp_m3h": imputed}, hours)
    return compare_series(both).withColumn("ts", hour_ts(F.col(DAY), F.col("hour")))


def compare_series(both: DataFrame) -> DataFrame:
    """Difference and relative difference; the divisor is kept off zero."""
    difference = F.col("imp_m3h") - F.col("orig_m3h")
    return both.withColumn("diff_m3h", difference).withColumn(
        "diff_percent", difference / (F.col("orig_m3h") + 1e-10) * 100
    )


def weekly_profile(series: DataFrame) -> DataFrame:
    """Mean by weekday, Monday being 0."""
    return series.groupBy(F.weekday("ts").alias("weekday")).agg(
        F.avg("orig_m3h").alias("orig_m3h"), F.avg("imp_m3h").alias("imp_m3h")
    )


def agreement(series: DataFrame) -> DataFrame:
    """Means, correlation and mean absolute relative difference of the two series."""
    return series.agg(
        F.avg("orig_m3h").alias("orig_mean"),
        F.avg("imp_m3h").alias("imp_mean"),
        F.corr("orig_m3h", "imp_m3h").alias("correlation"),
        F.avg(F.abs("diff_percent")).alias("mean_abs_pct"),
        F.count(F.lit(1)).alias("points"),
    )


def histogram(series: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins; values outside are left out, ``high`` is in the last bin."""
    x = F.col(column)
    inside = series.filter(x.between(low, high))
    slot = F.least(F.width_bucket(x, F.lit(low), F.lit(high), F.lit(bins)).cast("int"), F.lit(bins)) - 1
    counts = inside.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = series.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (high - low) / bins
    return every.join(counts, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"), F.coalesce("n", F.lit(0)).alias("n")
    )


def density(series: DataFrame, columns: list[str], bins: int = 30) -> DataFrame:
    """Density histogram of each column between its own smallest and largest value.

    A constant series has all points in the first bin, and no density.
    """
    values = series.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).alias("x")) for c in columns])).alias("p")
    ).select("p.series", "p.x")
    ends = values.groupBy("series").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n")
    )
    placed = values.join(ends, "series")
    width = (F.col("hi") - F.col("lo")) / bins
    part = F.coalesce(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    slot = F.least(F.floor(part * bins), F.lit(bins - 1))
    counts = placed.groupBy("series", slot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, ["series", "bin"], "left").select(
        "series",
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("low"),
        F.try_divide(F.coalesce("c", F.lit(0)), F.col("n") * width).alias("density"),
    )


def meter_consumption(df: DataFrame, into: str = "used", vec: str = VEC) -> DataFrame:
    """Consumption along each meter's timeline, one array per day.

    Each reading less the strictly preceding one, also across midnight; the first one
    is 0, a reset counts as 0 and a missing reading makes both its steps null.
    """
    rows = with_previous_day(df, "_previous", vec)
    last = F.get("_previous", F.size("_previous") - 1)

    def step(x: Column, hour: Column) -> Column:
        inside = F.get(vec, hour - 1)
        before = F.when(hour > 0, inside).when(F.col("_first"), x).otherwise(F.col("_last"))
        return F.when(x < before, F.lit(0.0)).otherwise(x - before)

    rows = rows.withColumn("_first", F.col("_previous").isNull()).withColumn("_last", last)
    return rows.withColumn(into, F.transform(vec, step)).drop("_previous", "_first", "_last")


def consumption_pair(imputed: DataFrame, original: DataFrame) -> DataFrame:
    """Consumption of both tables side by side, one row per hour of the imputed one."""
    ours = meter_consumption(imputed.select(*KEYS, VEC)).select(*KEYS, F.col("used").alias("used_imp"))
    theirs = meter_consumption(original.select(*KEYS, VEC)).select(*KEYS, F.col("used").alias("used_orig"))
    pairs = ours.join(theirs, KEYS, "left")
    cells = explode_hours(pairs, "used_imp", ("hour", "used_imp"), *KEYS, "used_orig")
    return cells.select(
        *KEYS,
        "hour",
        hour_ts(F.col(DAY), F.col("hour")).alias("ts"),
        "used_imp",
        F.get("used_orig", F.col("hour")).alias("used_orig"),
    )


__all__ = [
    "agreement",
    "compare_network",
    "compare_series",
    "consumption_pair",
    "day_consumption",
    "density",
    "histogram",
    "meter_consumption",
    "network_mean",
    "valid_consumption",
    "weekly_profile",
]
