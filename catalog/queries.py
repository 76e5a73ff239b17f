"""One registered query per operator, over the readings derived from ``events``.

Results are shown in a plain form, dates as text and readings to six digits, so that
another engine can be compared with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aquatally.functions import dayvec
from aquatally.operators import (
    cleaning,
    comparison,
    consumption,
    filling,
    gaps,
    lowrank,
    pairing,
    reshape,
    select,
    smoothing,
)
from aquatally.operators.timeline import with_previous_day
from aquatally.plans import fast, reports, scientific
from aquatally.schema import DAY, METER, VEC
from aquatally.sources import derived, readings, scratch, sinks

Query = Callable[[SparkSession, str], DataFrame]


def r6(c: Column | str) -> Column:
    """Six digits, nudged off the half so that both engines round the same way."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6)


def s9(c: str) -> Column:
    """Ten significant digits, for ratios of any size."""
    return F.format_string("%.9e", F.col(c)).cast("double")


def shown(df: DataFrame, *rounded: str) -> DataFrame:
    out = []
    for name, kind in df.dtypes:
        if name in rounded:
            out.append(r6(name).alias(name))
        elif kind in ("date", "timestamp_ntz"):
            out.append(F.col(name).cast("string").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def cells(df: DataFrame, vec: str = VEC, name: str = "reading") -> DataFrame:
    long = reshape.to_long(df.select(METER, DAY, vec), vec, name)
    return shown(long.select(METER, DAY, "hour", name), name)


def wide(df: DataFrame) -> DataFrame:
    return shown(df, *[c for c in df.columns if c.startswith("index_")])


def core(df: DataFrame) -> DataFrame:
    """The readings without the columns that are only carried along."""
    return df.select(METER, DAY, VEC)


def days(spark, sf):
    return core(derived.days(spark, sf))


def dirty(spark, sf):
    return core(derived.dirty_days(spark, sf))


def filled(spark, sf):
    return fast.impute_fast(days(spark, sf))


def with_original(spark, sf) -> DataFrame:
    """Filled readings beside their originals."""
    return with_filled(days(spark, sf))


def with_filled(original: DataFrame) -> DataFrame:
    """Fast imputation that keeps the readings it started from."""
    return fast.impute_fast(core(original).withColumn("orig", F.col(VEC)))


def smoothed(spark, sf) -> DataFrame:
    return fast.impute_and_smooth(days(spark, sf).withColumn("orig", F.col(VEC)), original="orig")


def mask(pairs: DataFrame) -> DataFrame:
    return shown(select.imputed_cells(pairs, "val_orig", "val_imp"), "val_orig", "val_imp")


def valued(pairs: DataFrame, names: dict[str, str]) -> DataFrame:
    """Cells of several arrays of a row, one column each."""
    zipped = F.arrays_zip(*[F.col(c) for c in names])
    long = reshape.explode_hours(pairs, zipped, ("hour", "_z"), METER, DAY)
    out = long.select(METER, DAY, "hour", *[F.col(f"_z.{c}").alias(n) for c, n in names.items()])
    return shown(out, *names.values())


# sources and sinks


def scan_csv(spark, sf):
    path = scratch.new_path(spark, "readings-csv")
    sinks.write_readings(derived.days(spark, sf), path, "csv")
    return wide(readings.read_readings(spark, path))


def scan_pair(spark, sf):
    original, imputed = scratch.new_path(spark, "original"), scratch.new_path(spark, "imputed")
    sinks.write_readings(days(spark, sf), original, by_month=False)
    sinks.write_readings(filled(spark, sf), imputed, by_month=False)
    pair = readings.read_pair(spark, original, imputed, "parquet")
    return mask(pairing.pair_days(*pair, ("val_orig", "val_imp")))


def write_imputed(spark, sf):
    path = scratch.new_path(spark, "imputed")
    sinks.write_readings(filled(spark, sf), path)
    return cells(readings.read_days(spark, path, "parquet"))


def write_smoothed(spark, sf):
    path = scratch.new_path(spark, "smoothed")
    sinks.write_readings(smoothed(spark, sf).drop("orig"), path)
    return cells(readings.read_days(spark, path, "parquet"))


def write_gap_metrics(spark, sf):
    path = scratch.new_path(spark, "gap-metrics")
    metrics = reports.gap_metrics(days(spark, sf))
    sinks.write_json(metrics, path)
    return gap_rows(spark.read.schema(metrics.schema).json(path))


def write_gap_document(spark, sf):
    path = scratch.new_path(spark, "gap-document")
    reports.write_gap_document(days(spark, sf), path)
    back = spark.read.json(f"{path}/global")
    return shown(back.select("global.*", "shape"), "missing_pct")


def write_gap_report(spark, sf):
    path = scratch.new_path(spark, "gap-report")
    sinks.write_lines(reports.gap_report(days(spark, sf)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


# reshape


def wide_to_long(spark, sf):
    long = reshape.to_long(days(spark, sf))
    return shown(long.select(METER, DAY, "hour", "ts", "reading"), "reading")


def long_to_wide(spark, sf):
    return wide(reshape.to_wide(reshape.to_long(days(spark, sf))))


def day_vectors(spark, sf):
    unpacked = reshape.unpack(days(spark, sf))
    return wide(reshape.unpack(reshape.pack(unpacked)))


def row_positions(spark, sf):
    rows = derived.days(spark, sf).select(METER, "calibre", DAY)
    return shown(select.with_position(rows, [DAY])).withColumn("position", F.col("position").cast("bigint"))


# filters


def sample_above(spark, sf):
    return shown(select.sample_above(days(spark, sf), 10000).select(METER, DAY, "hour", "reading"), "reading")


def parse_dates(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type"
    )
    parsed = readings.parse_day(readings.parse_day(events, "day"), "event_type")
    return shown(parsed.select("event_id", "day", F.col("event_type").isNull().alias("type_is_no_date")))


def network_pair(spark, sf) -> DataFrame:
    """Network series of the originals and the filled readings, to six digits."""
    rows = with_original(spark, sf).filter(F.col(DAY).isNotNull())
    both = consumption.network_means(rows, {"orig_m3h": "orig", "imp_m3h": VEC})
    both = both.withColumn("orig_m3h", r6("orig_m3h")).withColumn("imp_m3h", r6("imp_m3h"))
    return consumption.compare_series(both).withColumn("ts", reshape.hour_ts(F.col(DAY), F.col("hour")))


def points(series: DataFrame) -> DataFrame:
    return shown(series.select(DAY, "hour", "orig_m3h", "imp_m3h"), "orig_m3h", "imp_m3h")


# joins and sets


def attach_original(spark, sf):
    original = pairing.first_load(derived.loaded_twice(spark, sf), "load_seq")
    pairs = pairing.attach_original(filled(spark, sf), original)
    return valued(pairs, {VEC: "val_imp", "v_orig": "val_orig"})


def common_dates(spark, sf):
    both = consumption.compare_network_rows(with_original(spark, sf), "orig")
    return points(both)


def chosen(spark, sf):
    return comparison.comparison_meters(days(spark, sf))


def observed(spark, sf):
    return days(spark, sf).filter(~dayvec.is_empty_day(F.col(VEC)))


# imputation


def low_rank(spark, sf) -> DataFrame:
    """Refined readings beside the cleaned ones."""
    clean = cleaning.clean(dirty(spark, sf)).withColumn("known", F.col(VEC))
    start = filling.carry_whole_days(filling.interpolate_day(clean))
    return lowrank.refine_by_meter(start, "known")


def r4_cells(df: DataFrame) -> DataFrame:
    """Four digits: the two engines reach an eigenvector on different ways."""
    long = reshape.to_long(df.select(METER, DAY, VEC))
    return shown(long.select(METER, DAY, "hour", F.round(F.col("reading") + 1e-9, 4).alias("reading")))


#: Two rounds at rank one, which SQL can state as well.
RANK_ONE = {"n_components": 1, "max_iterations": 2}


def refine_rank_one(spark, sf):
    clean = cleaning.clean(dirty(spark, sf)).withColumn("known", F.col(VEC))
    start = filling.carry_whole_days(filling.interpolate_day(clean))
    return r4_cells(lowrank.refine_by_meter(start, "known", tolerance=0.0, **RANK_ONE))


def refine_rank_three(spark, sf):
    clean = cleaning.clean(dirty(spark, sf)).withColumn("known", F.col(VEC))
    start = filling.carry_whole_days(filling.interpolate_day(clean))
    return r4_cells(lowrank.refine_by_meter(start, "known", 3, 2, 0.0))


def refine_whole_rank_one(spark, sf):
    clean = cleaning.clean(dirty(spark, sf)).withColumn("known", F.col(VEC))
    start = filling.zero_fill(filling.carry_whole_days(filling.interpolate_day(clean)))
    return r4_cells(lowrank.refine_whole_table(start, "known", tolerance=0.0, **RANK_ONE))


def impute_scientific_averaged(spark, sf):
    return r4_cells(
        scientific.impute_scientific(
            dirty(spark, sf),
            apply_smoothing=True,
            smoothing_method="moving_avg",
            restore_from="clean",
            clamp_timeline=False,
            **RANK_ONE,
        )
    )


def refine_low_rank_facts(spark, sf):
    changed = F.size(
        F.filter(F.arrays_zip("known", VEC), lambda p: p["known"].isNotNull() & (p["known"] != p[VEC]))
    )
    return low_rank(spark, sf).groupBy(METER).agg(
        F.sum(F.size(VEC)).alias("cells"),
        F.sum(dayvec.missing_count(F.col(VEC))).alias("nulls_left"),
        F.sum(changed).alias("known_changed"),
    )


def refine_whole_table(spark, sf):
    clean = cleaning.clean(dirty(spark, sf)).withColumn("known", F.col(VEC))
    start = filling.zero_fill(filling.carry_whole_days(filling.interpolate_day(clean)))
    return cells(lowrank.refine_whole_table(start, "known"))


def impute_scientific(spark, sf):
    return cells(scientific.impute_scientific(derived.dirty_days(spark, sf)))


def scientific_facts(spark, sf):
    result = scientific.impute_scientific(dirty(spark, sf))
    known = cleaning.clean(dirty(spark, sf)).withColumnRenamed(VEC, "known")
    rows = with_previous_day(result, "_previous").join(known, [METER, DAY])
    last = F.get("_previous", F.lit(24 - 1))
    line = F.concat(F.array(last), F.col(VEC))
    falls = F.size(F.filter(F.zip_with(F.slice(line, 1, 24), VEC, lambda a, b: b < a), lambda f: f))
    below = F.size(F.filter(F.zip_with("known", VEC, lambda k, x: x < k), lambda f: f))
    return rows.groupBy(METER).agg(
        F.sum(F.size(VEC)).alias("cells"),
        F.sum(dayvec.missing_count(F.col(VEC))).alias("nulls_left"),
        F.sum(falls).alias("falls"),
        F.sum(F.size(F.filter(VEC, lambda x: x < 0))).alias("negatives"),
        F.sum(below).alias("below_known"),
    )


def hybrid_routing(spark, sf):
    rows = days(spark, sf)
    large = gaps.gap_classes_by_meter(rows).filter(F.col("large_gaps") > 0)
    large = large.select(METER, F.lit(True).alias("hard"))
    result = scientific.impute_hybrid(rows, force_lowrank=False)
    means = comparison.series_stats(result).select(METER, "mean").join(large, METER, "left")
    hard = F.coalesce("hard", F.lit(False))
    return means.select(METER, hard.alias("hard"), F.when(~hard, r6("mean")).alias("easy_mean"))


def clip_negative(spark, sf):
    lowered = days(spark, sf).withColumn(VEC, F.transform(VEC, lambda x: x - 500))
    return cells(filling.clip_negative(lowered))


def restore_known(spark, sf):
    known = cleaning.clean(dirty(spark, sf)).withColumnRenamed(VEC, "known")
    refilled = core(fast.impute_fast(dirty(spark, sf)))
    return cells(filling.restore_known(refilled.join(known, [METER, DAY]), "known"))


def impute_fast_rows(spark, sf):
    return cells(fast.impute_fast_rows(days(spark, sf), [DAY, METER]))


def impute_scientific_rows(spark, sf):
    return cells(scientific.impute_scientific_rows(dirty(spark, sf), [DAY, METER]))


# smoothing


def write_back(spark, sf):
    averaged = smoothing.average_day(with_original(spark, sf).withColumn("s", F.col(VEC)), 11, "s")
    return cells(smoothing.write_back(averaged, "orig", "s"))


def clamp_gap_days(spark, sf):
    paired = pairing.attach_original(dirty(spark, sf), days(spark, sf))
    return cells(smoothing.clamp_gap_days(paired, "v_orig"))


def align_and_smooth(spark, sf):
    return cells(scientific.align_and_smooth(filled(spark, sf), derived.loaded_twice(spark, sf), "load_seq"))


# gaps


def gap_rows(stats: DataFrame) -> DataFrame:
    return shown(stats, "missing_pct", "avg_gap_size", "median_gap_size")


def day_stats(spark, sf):
    return gaps.stats_by_day(days(spark, sf))


def advice(spark, sf, stats):
    return shown(gaps.recommendation(days(spark, sf), stats), "missing_pct")


def totals(df: DataFrame) -> DataFrame:
    return shown(gaps.global_stats(df), "missing_pct")


# consumption and comparison


def compare_network(spark, sf):
    series = network_pair(spark, sf)
    return shown(
        series.select("ts", "orig_m3h", "imp_m3h", "diff_m3h", s9("diff_percent").alias("diff_percent")), "diff_m3h"
    )


def agreement(spark, sf):
    figures = consumption.agreement(network_pair(spark, sf))
    figures = figures.withColumn("mean_abs_pct", s9("mean_abs_pct"))
    return shown(figures, "orig_mean", "imp_mean", "correlation")


def difference_histogram(spark, sf):
    series = network_pair(spark, sf).withColumn("diff_percent", r6("diff_percent"))
    return shown(consumption.histogram(series, "diff_percent", -20.0, 20.0, 50), "low")


def consumption_pair(spark, sf):
    pairs = consumption.consumption_pair(filled(spark, sf), days(spark, sf))
    return shown(pairs, "used_imp", "used_orig")


def compared(points: DataFrame) -> DataFrame:
    return shown(points, "val_orig", "val_imp")


def comparison_points(spark, sf):
    return compared(comparison.comparison_points(days(spark, sf), filled(spark, sf), chosen(spark, sf)))


def dashboard(table: DataFrame) -> DataFrame:
    wide_columns = reshape.unpack(table).columns
    return comparison.dashboard(table, len(wide_columns))


def smoothing_difference(spark, sf, changed_above=0.01, idle_below=0.001):
    table = days(spark, sf).withColumn("orig", F.col(VEC))
    rows = fast.impute_and_smooth(table, original="orig", filled="filled")
    figures = comparison.smoothing_difference_rows(rows, "filled", VEC, changed_above, idle_below)
    return shown(figures, "mean_abs_diff", "max_abs_diff")


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "scan_csv": scan_csv,
        "scan_pair": scan_pair,
        "write_imputed": write_imputed,
        "write_smoothed": write_smoothed,
        "write_gap_metrics": write_gap_metrics,
        "write_gap_document": write_gap_document,
        "write_gap_report": write_gap_report,
        "wide_to_long": wide_to_long,
        "long_to_wide": long_to_wide,
        "day_vectors": day_vectors,
        "row_positions": row_positions,
        "one_meter": lambda s, d: cells(select.one_meter(days(s, d), "M00001")),
        "meters_by_text": lambda s, d: cells(select.meters_containing(days(s, d), "01")),
        "first_meter_by_text": lambda s, d: cells(select.first_meter_containing(days(s, d), "1")),
        "imputed_mask": lambda s, d: mask(
            pairing.pair_days(days(s, d), filled(s, d), ("val_orig", "val_imp"))
        ),
        "valid_consumption": lambda s, d: shown(
            consumption.valid_consumption(consumption.day_consumption(days(s, d))).drop("ts"), "used"
        ),
        "count_above": lambda s, d: select.count_above(days(s, d), [1000, 10000]),
        "sample_above": sample_above,
        "distinct_meters": lambda s, d: select.distinct_meters(days(s, d)),
        "preview": lambda s, d: wide(reshape.unpack(core(select.preview(days(s, d))))),
        "parse_dates": parse_dates,
        "every_nth_point": lambda s, d: points(select.every_nth_point(network_pair(s, d), 6, ["ts"])),
        "every_nth_hour": lambda s, d: shown(
            select.every_nth_hour(days(s, d), 72).select(METER, DAY, "hour", "reading"), "reading"
        ),
        "first_points": lambda s, d: points(select.first_points(network_pair(s, d), 45 * 24, ["ts"])),
        "attach_original": attach_original,
        "common_dates": common_dates,
        "pair_days": lambda s, d: valued(
            pairing.pair_days(days(s, d), filled(s, d), ("orig", "imp")), {"orig": "orig", "imp": "imp"}
        ),
        "rows_of_meters": lambda s, d: cells(pairing.rows_of_meters(days(s, d), chosen(s, d))),
        "meters_in_both": lambda s, d: pairing.meters_in_both(days(s, d), observed(s, d)),
        "meters_missing": lambda s, d: pairing.meters_missing_from(days(s, d), observed(s, d)),
        "union_parts": lambda s, d: cells(pairing.union_all(days(s, d), filled(s, d))),
        "first_load": lambda s, d: cells(pairing.first_load(derived.loaded_twice(s, d), "load_seq")),
        "null_zeros": lambda s, d: cells(cleaning.null_zeros(dirty(s, d))),
        "null_spikes": lambda s, d: cells(cleaning.null_spikes(cleaning.null_zeros(dirty(s, d)))),
        "null_drops": lambda s, d: cells(cleaning.clean(dirty(s, d))),
        "interpolate_day": lambda s, d: cells(filling.interpolate_day(days(s, d))),
        "fill_day": lambda s, d: cells(filling.fill_day(days(s, d))),
        "carry_days": lambda s, d: cells(filling.carry_days(days(s, d))),
        "carry_whole_days": lambda s, d: cells(filling.carry_whole_days(filling.interpolate_day(days(s, d)))),
        "zero_fill": lambda s, d: cells(filling.zero_fill(days(s, d))),
        "clamp_day": lambda s, d: cells(filling.clamp_day(dirty(s, d))),
        "impute_fast": lambda s, d: cells(filled(s, d)),
        "impute_fast_clamped": lambda s, d: cells(fast.impute_fast(days(s, d), clamp_timeline=True)),
        "impute_fast_rows": impute_fast_rows,
        "clamp_timeline": lambda s, d: cells(filling.clamp_timeline(dirty(s, d))),
        "refine_low_rank": lambda s, d: cells(low_rank(s, d)),
        "refine_low_rank_facts": refine_low_rank_facts,
        "refine_rank_one": refine_rank_one,
        "refine_whole_rank_one": refine_whole_rank_one,
        "refine_rank_three": refine_rank_three,
        "impute_scientific_fitted": lambda s, d: r4_cells(
            scientific.impute_scientific(dirty(s, d), apply_smoothing=True, **RANK_ONE)
        ),
        "impute_scientific_rows_rank_one": lambda s, d: r4_cells(
            scientific.impute_scientific_rows(dirty(s, d), [DAY, METER], tolerance=0.0, **RANK_ONE)
        ),
        "impute_scientific_rank_one": lambda s, d: r4_cells(scientific.impute_scientific(dirty(s, d), **RANK_ONE)),
        "impute_scientific_averaged": impute_scientific_averaged,
        "impute_hybrid_default": lambda s, d: r4_cells(scientific.impute_hybrid(days(s, d), **RANK_ONE)),
        "impute_hybrid_by_gaps": lambda s, d: r4_cells(
            scientific.impute_hybrid(days(s, d), force_lowrank=False, **RANK_ONE)
        ),
        "refine_whole_table": refine_whole_table,
        "restore_known": restore_known,
        "clip_negative": clip_negative,
        "impute_scientific": impute_scientific,
        "impute_scientific_smoothed": lambda s, d: cells(
            scientific.impute_scientific(dirty(s, d), apply_smoothing=True)
        ),
        "impute_scientific_rows": impute_scientific_rows,
        "scientific_facts": scientific_facts,
        "impute_hybrid": lambda s, d: cells(scientific.impute_hybrid(days(s, d), force_lowrank=False)),
        "hybrid_routing": hybrid_routing,
        "empty_days_null": lambda s, d: cells(fast.impute_fast(days(s, d), empty_days="null")),
        "empty_days_dropped": lambda s, d: cells(fast.impute_fast(days(s, d), empty_days="drop")),
        "empty_days_interpolated": lambda s, d: cells(
            filling.apply_empty_day_policy(days(s, d), "interpolate")
        ),
        "average_day": lambda s, d: cells(smoothing.average_day(filled(s, d), 11)),
        "fit_day": lambda s, d: cells(smoothing.fit_day(filled(s, d), 11)),
        "spline_day": lambda s, d: r4_cells(smoothing.spline_day(filled(s, d))),
        "write_back": write_back,
        "clamp_gap_days": clamp_gap_days,
        "smooth_imputed_average": lambda s, d: cells(
            smoothing.smooth_imputed(with_original(s, d), "orig", "moving_avg")
        ),
        "smooth_imputed_fit": lambda s, d: cells(smoothing.smooth_imputed(with_original(s, d), "orig", "savgol")),
        "smooth_imputed_spline": lambda s, d: r4_cells(
            smoothing.smooth_imputed(with_original(s, d), "orig", "spline")
        ),
        "smooth_timeline": lambda s, d: cells(fast.impute_and_smooth(days(s, d))),
        "smooth_day_keep_observed": lambda s, d: cells(
            smoothing.smooth_day_keep_observed(with_original(s, d), "orig")
        ),
        "smooth_timeline_keep_observed": lambda s, d: cells(smoothed(s, d)),
        "align_and_smooth": align_and_smooth,
        "gap_totals": lambda s, d: totals(days(s, d)),
        "day_gaps": lambda s, d: shown(gaps.day_gaps(days(s, d))),
        "timeline_gaps": lambda s, d: shown(gaps.timeline_gaps(days(s, d))),
        "gap_stats_by_day": lambda s, d: gap_rows(day_stats(s, d)),
        "gap_stats_by_meter": lambda s, d: gap_rows(gaps.stats_by_meter(days(s, d))),
        "gap_distribution": lambda s, d: gaps.distribution(day_stats(s, d)),
        "gap_summary": lambda s, d: shown(gaps.summary(day_stats(s, d)), "mean_avg_gap"),
        "worst_days": lambda s, d: gap_rows(gaps.worst(day_stats(s, d), 10)),
        "worst_forty_days": lambda s, d: gap_rows(gaps.worst(day_stats(s, d), 40)),
        "worst_thousand_days": lambda s, d: gap_rows(gaps.worst(day_stats(s, d), 1000)),
        "mean_missing_pct": lambda s, d: shown(gaps.mean_missing_pct(day_stats(s, d)), "avg_missing_pct"),
        "recommendation_by_day": lambda s, d: advice(s, d, day_stats(s, d)),
        "recommendation_by_meter": lambda s, d: advice(s, d, gaps.stats_by_meter(days(s, d))),
        "gap_report": lambda s, d: reports.gap_report(days(s, d)),
        "gap_heatmap_sample": lambda s, d: shown(gaps.heatmap(days(s, d), sample_size=25)),
        "gap_heatmap": lambda s, d: shown(gaps.heatmap(days(s, d))),
        "day_completeness": lambda s, d: gaps.day_completeness(days(s, d)),
        "first_days_check": lambda s, d: shown(gaps.first_days_check(days(s, d), filled(s, d))),
        "gap_classes_by_day": lambda s, d: gaps.gap_classes(days(s, d)),
        "gap_classes_on_timeline": lambda s, d: gaps.gap_classes(days(s, d), along="timeline"),
        "gap_classes_by_meter": lambda s, d: gaps.gap_classes_by_meter(days(s, d)),
        "day_consumption": lambda s, d: cells(consumption.day_consumption(days(s, d)), "used", "used"),
        "network_mean": lambda s, d: shown(consumption.network_mean(days(s, d)), "mean_m3h"),
        "network_mean_filled": lambda s, d: shown(consumption.network_mean(filled(s, d)), "mean_m3h"),
        "compare_network": compare_network,
        "weekly_profile": lambda s, d: shown(
            consumption.weekly_profile(network_pair(s, d)), "orig_m3h", "imp_m3h"
        ),
        "agreement": agreement,
        "difference_histogram": difference_histogram,
        "consumption_density": lambda s, d: shown(
            consumption.density(network_pair(s, d), ["orig_m3h", "imp_m3h"]), "low", "density"
        ),
        "meter_consumption": lambda s, d: cells(consumption.meter_consumption(days(s, d)), "used", "used"),
        "consumption_pair": consumption_pair,
        "series_stats": lambda s, d: shown(
            comparison.series_stats(filled(s, d)), "mean", "max", "min", "std"
        ),
        "network_heatmap": lambda s, d: shown(
            comparison.network_heatmap(filled(s, d)).select(METER, DAY, "hour", "reading"), "reading"
        ),
        "meter_comparison": lambda s, d: compared(comparison.meter_comparison(filled(s, d), days(s, d))),
        "imputation_stats": lambda s, d: shown(comparison.imputation_stats(days(s, d)), "pct_imputed"),
        "rows_per_meter": lambda s, d: comparison.rows_per_meter(days(s, d)),
        "comparison_meters": chosen,
        "comparison_meters_few": lambda s, d: comparison.comparison_meters(days(s, d), first=3, n=2),
        "comparison_points": comparison_points,
        "comparison_totals": lambda s, d: comparison.comparison_totals(days(s, d), chosen(s, d)),
        "dashboard": lambda s, d: dashboard(derived.days(s, d)),
        "smoothing_difference": smoothing_difference,
        "smoothing_difference_strict": lambda s, d: smoothing_difference(s, d, 0.1, 0.01),
        "value_ranges": lambda s, d: shown(comparison.value_ranges(days(s, d)), "min", "max", "mean"),
        "workload": lambda s, d: shown(comparison.workload(days(s, d)), "rows_per_meter"),
        "quality_violations": lambda s, d: comparison.quality_violations(filled(s, d), days(s, d)),
    }
    return q
