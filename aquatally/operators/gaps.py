"""Gap statistics: per table, per day, per meter and along the timeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aquatally.functions import dayvec
from aquatally.operators.reshape import explode_hours, hour_ts
from aquatally.operators.timeline import BLOCK, BLOCK_KEYS, by_block, with_ordinal
from aquatally.operators.pairing import pair_days
from aquatally.schema import DAY, METER, VEC, day_width


def _pct(part: Column, whole: Column) -> Column:
    return F.lit(100.0) * part / whole


def _count_if(condition: Column) -> Column:
    return F.count_if(condition)


def global_stats(df: DataFrame, vec: str = VEC) -> DataFrame:
    """Rows, hours, cells and missing cells of the whole table, in one row."""
    return df.agg(*_totals(vec))


def _totals(vec: str) -> list[Column]:
    missing = F.sum(dayvec.missing_count(F.col(vec)))
    cells = F.sum(F.size(vec))
    return [
        F.count(F.lit(1)).alias("total_meters"),
        F.max(F.size(vec)).alias("total_timestamps"),
        cells.alias("total_values"),
        missing.alias("missing_count"),
        _pct(missing, cells).alias("missing_pct"),
    ]


def day_gaps(df: DataFrame, vec: str = VEC) -> DataFrame:
    """One row per run of missing hours inside a day, the run at its end included."""
    runs = explode_hours(df, dayvec.gap_runs(F.col(vec)), ("_n", "g"), METER, DAY)
    return runs.select(
        METER,
        DAY,
        F.col("g.start").alias("gap_start"),
        F.col("g.len").alias("gap_len"),
        F.col("g.trailing").alias("is_trailing"),
    )


def stats_by_day(df: DataFrame, vec: str = VEC) -> DataFrame:
    """Missing cells and gap sizes of every meter and day; zero where there is no gap.

    Everything is in the row, so this is a projection without a shuffle.
    """
    rows = df.select(METER, DAY, F.size(vec).alias("_cells"), dayvec.gap_runs(F.col(vec)).alias("_runs"))
    rows = rows.withColumn("_lens", F.transform("_runs", lambda r: r["len"]))
    total = F.aggregate("_lens", F.lit(0), lambda a, n: a + n)
    rows = rows.withColumn("missing_count", total.cast("bigint")).withColumn("num_gaps", F.size("_lens").cast("bigint"))
    none = F.col("num_gaps") == 0
    return rows.select(
        METER,
        DAY,
        "missing_count",
        _pct(F.col("missing_count"), F.col("_cells")).alias("missing_pct"),
        "num_gaps",
        F.coalesce(F.array_max("_lens"), F.lit(0)).cast("bigint").alias("max_gap_size"),
        F.when(none, F.lit(0.0)).otherwise(F.col("missing_count") / F.col("num_gaps")).alias("avg_gap_size"),
        F.when(none, F.lit(0.0)).otherwise(dayvec.median_of(F.col("_lens"))).alias("median_gap_size"),
    )


def _day_parts(df: DataFrame, vec: str) -> DataFrame:
    """Every row as a part of its timeline: its number of cells and its runs of missing ones."""
    runs = F.transform(
        dayvec.gap_runs(F.col(vec)),
        lambda g: F.struct(
            hour_ts(F.col(DAY), g["start"]).alias("begin"),
            g["len"].cast("bigint").alias("len"),
            (g["start"] == 0).alias("head"),
            g["trailing"].alias("tail"),
        ),
    )
    keys = [c for c in (METER, DAY, BLOCK) if c in df.columns]
    return by_block(df.select(*keys, F.coalesce(F.size(vec), F.lit(0)).cast("bigint").alias("_cells"), runs.alias("_runs")))


def _merged(parts: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Runs that go on from part to part become one, kept by the part they start in.

    A part has ``_cells`` and ``_runs``; of a run, ``head`` and ``tail`` say whether it touches the ends of its part, and in the
    result whether it touches the ends of all parts with the same keys.  A run at the end of a part goes on as far as
    the next part with a reading: to that part's first one.
    """
    line = Window.partitionBy(*keys).orderBy(order)

    def length(end: str) -> Column:
        own = F.filter("_runs", lambda r: r[end])
        return F.coalesce(F.aggregate(own, F.lit(0).cast("bigint"), lambda s, r: s + r["len"]), F.lit(0).cast("bigint"))

    some = F.col("_cells") > 0
    rows = parts.withColumn("_head", length("head")).withColumn("_tail", length("tail"))
    rows = rows.withColumn("_upto", F.sum("_cells").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    reading = F.when(some & (F.col("_head") < F.col("_cells")), F.col("_upto") - F.col("_cells") + F.col("_head"))
    rows = rows.withColumn("_reading", reading)
    rows = rows.select(
        *parts.columns,
        "_upto",
        F.last(F.when(some, F.col("_tail") > 0), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("_open"),
        F.first("_reading", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("_next"),
        F.sum("_cells").over(Window.partitionBy(*keys)).alias("_all"),
    )
    goes_on = F.coalesce("_next", "_all") - F.col("_upto")
    own = F.filter("_runs", lambda r: ~(r["head"] & F.coalesce("_open", F.lit(False))))
    runs = F.transform(
        own,
        lambda r: F.struct(
            r["begin"].alias("begin"),
            F.when(r["tail"], r["len"] + goes_on).otherwise(r["len"]).alias("len"),
            (r["head"] & F.col("_open").isNull()).alias("head"),
            (r["tail"] & F.col("_next").isNull()).alias("tail"),
        ),
    )
    return rows.select(*[runs.alias(c) if c == "_runs" else F.col(c) for c in parts.columns])


def _line_parts(df: DataFrame, vec: str) -> DataFrame:
    """One row per meter and block with ``_cells`` and the runs along the timeline that start in it.

    Only runs move, not readings: once to their block, and as one row per block to their meter, of
    which a calendar has few.
    """
    days = _merged(_day_parts(df, vec), BLOCK_KEYS, DAY)
    blocks = days.groupBy(*BLOCK_KEYS).agg(F.sum("_cells").alias("_cells"), F.flatten(F.collect_list("_runs")).alias("_runs"))
    return _merged(blocks, [METER], BLOCK)


def timeline_gaps(df: DataFrame, vec: str = VEC) -> DataFrame:
    """One row per run of missing hours along each meter's timeline, across days."""
    runs = explode_hours(_line_parts(df, vec), "_runs", ("_n", "g"), METER)
    return runs.select(
        METER, F.col("g.begin").alias("gap_start"), F.col("g.len").alias("gap_len"), F.col("g.tail").alias("is_trailing")
    )


def stats_by_meter(df: DataFrame, vec: str = VEC) -> DataFrame:
    """The same statistics per meter, over gaps that may span days."""
    runs = _line_parts(df, vec).select(METER, "_cells", F.posexplode_outer("_runs").alias("_n", "g"))
    size = F.col("g.len")
    figures = runs.groupBy(METER).agg(
        F.sum(F.when(F.coalesce("_n", F.lit(0)) == 0, F.col("_cells"))).alias("_cells"),  # once per block
        F.coalesce(F.sum(size), F.lit(0)).alias("missing_count"),
        F.count("g").alias("num_gaps"),
        F.coalesce(F.max(size), F.lit(0)).alias("max_gap_size"),
        F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_gap_size"),
        F.coalesce(F.percentile(size, F.lit(0.5)), F.lit(0.0)).alias("median_gap_size"),
    )
    return figures.select(
        METER,
        "missing_count",
        _pct(F.col("missing_count"), F.col("_cells")).alias("missing_pct"),
        "num_gaps",
        "max_gap_size",
        "avg_gap_size",
        "median_gap_size",
    )


def large_gap_blocks(df: DataFrame, threshold_hours: int = 72, vec: str = VEC) -> DataFrame:
    """Every block of every meter, with ``large``: whether the meter has a closed gap above the threshold, in any block."""
    large = F.exists("_runs", lambda r: ~r["tail"] & (r["len"] > threshold_hours))
    return _line_parts(df, vec).select(*BLOCK_KEYS, F.bool_or(large).over(Window.partitionBy(METER)).alias("large"))


def distribution(stats: DataFrame) -> DataFrame:
    """How many rows miss nothing, up to 10 %, up to 50 %, more, and everything.

    A fully empty row is also counted among those above 50 %.
    """
    pct = F.col("missing_pct")
    return stats.agg(
        _count_if(pct == 0).alias("none_missing"),
        _count_if((pct > 0) & (pct <= 10)).alias("up_to_10"),
        _count_if((pct > 10) & (pct <= 50)).alias("up_to_50"),
        _count_if(pct > 50).alias("above_50"),
        _count_if(pct == 100).alias("all_missing"),
    )


def summary(stats: DataFrame) -> DataFrame:
    """Largest gap, mean of the means and median of the medians."""
    return stats.agg(
        F.max("max_gap_size").alias("max_gap"),
        F.avg("avg_gap_size").alias("mean_avg_gap"),
        F.percentile("median_gap_size", F.lit(0.5)).alias("median_median_gap"),
    )


def worst(stats: DataFrame, n: int = 10) -> DataFrame:
    """The rows with the largest missing share; ties by key."""
    keys = [c for c in (METER, DAY) if c in stats.columns]
    return stats.orderBy(F.col("missing_pct").desc(), *keys).limit(n)


def mean_missing_pct(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count(F.lit(1)).alias("n"), F.avg("missing_pct").alias("avg_missing_pct"))


# The shares of missing cells and the gap length the advice turns on.
EXCELLENT_BELOW_PCT = 5
GOOD_BELOW_PCT = 20
LONG_GAP_HOURS = 168


def recommendation(df: DataFrame, stats: DataFrame, vec: str = VEC) -> DataFrame:
    """Quality class by the table's missing share, and a warning about long gaps.

    ``stats`` gives the gap sizes, per day or per meter: a day can never hold a gap
    above a week, a meter can.
    """
    share = _pct(F.sum(dayvec.missing_count(F.col(vec))), F.sum(F.size(vec)))
    table = df.agg(share.alias("missing_pct"), F.lit(1).alias("_one"))
    longest = stats.agg(F.max("max_gap_size").alias("max_gap"), F.lit(1).alias("_one"))
    one = table.join(longest, "_one")  # one row each
    return one.select("missing_pct", "max_gap", *_advice())


def _advice() -> list[Column]:
    quality = (
        F.when(F.col("missing_pct") < EXCELLENT_BELOW_PCT, "excellent")
        .when(F.col("missing_pct") < GOOD_BELOW_PCT, "good")
        .otherwise("moderate")
    )
    return [quality.alias("quality"), (F.col("max_gap") > LONG_GAP_HOURS).alias("long_gaps")]


def totals_and_advice(df: DataFrame, vec: str = VEC) -> DataFrame:
    """``global_stats`` and the ``recommendation`` by day in one row, from one aggregate."""
    longest = F.coalesce(F.array_max(F.transform(dayvec.gap_runs(F.col(vec)), lambda r: r["len"])), F.lit(0))
    table = df.agg(*_totals(vec), F.max(longest).cast("bigint").alias("max_gap"))
    return table.select("*", *_advice())


def heatmap(df: DataFrame, sample_size: int = 500, vec: str = VEC, hours: int | None = None) -> DataFrame:
    """Availability map of a sample of rows: 1 where the hour is missing.

    The sample is the rows with the smallest hashes, the same at every run; long
    rows are thinned to about 200 columns.
    """
    step = max(1, day_width(df, vec, hours) // 200)
    mark = F.md5(F.concat(F.col(METER), F.col(DAY).cast("string")))
    sample = df.select(METER, DAY, vec, mark.alias("_mark")).orderBy("_mark").limit(sample_size)
    cells = explode_hours(sample, vec, ("hour", "_x"), METER, DAY)
    return cells.filter(F.col("hour") % step == 0).select(
        METER, DAY, "hour", F.col("_x").isNull().cast("int").alias("is_missing")
    )


def day_completeness(df: DataFrame, vec: str = VEC) -> DataFrame:
    """Empty, partial and complete days per meter."""
    missing, cells = dayvec.missing_count(F.col(vec)), F.size(vec)
    return df.groupBy(METER).agg(
        F.count(F.lit(1)).alias("days"),
        _count_if(missing == cells).alias("empty_days"),
        _count_if((missing > 0) & (missing < cells)).alias("partial_days"),
        _count_if(missing == 0).alias("complete_days"),
    )


def first_days_check(original: DataFrame, imputed: DataFrame, days: int = 10) -> DataFrame:
    """Missing originals and imputed zeros on the first days of each meter, and
    whether an empty day was filled with zeros."""
    first = with_ordinal(original.select(METER, DAY, VEC)).filter(F.col("_ordinal") < days)
    pairs = pair_days(first, imputed, ("_orig", "_imp"))
    rows = pairs.select(
        METER,
        DAY,
        dayvec.missing_count(F.col("_orig")).alias("missing_orig"),
        F.size(F.filter("_imp", lambda x: x == 0)).alias("zeros_imp"),
        F.size("_orig").alias("_cells"),
    )
    zeroed = (F.col("zeros_imp") > 0) & (F.col("missing_orig") == F.col("_cells"))
    return rows.withColumn("empty_filled_with_zero", zeroed).drop("_cells")


def _classes(gaps: DataFrame, threshold_hours: int) -> list[Column]:
    closed, small = ~F.col("is_trailing"), F.col("gap_len") <= threshold_hours
    return [_count_if(closed & small).alias("small_gaps"), _count_if(closed & ~small).alias("large_gaps")]


def gap_classes(df: DataFrame, threshold_hours: int = 72, along: str = "day", vec: str = VEC) -> DataFrame:
    """Small and large gaps of the whole table; a gap counts once a reading closes it."""
    gaps = day_gaps(df, vec) if along == "day" else timeline_gaps(df, vec)
    return gaps.agg(*_classes(gaps, threshold_hours))


def gap_classes_by_meter(df: DataFrame, threshold_hours: int = 72, vec: str = VEC) -> DataFrame:
    """The same per meter along the timeline, for meters that have any gap."""
    gaps = timeline_gaps(df, vec)
    return gaps.groupBy(METER).agg(*_classes(gaps, threshold_hours))
