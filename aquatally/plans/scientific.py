"""Scientific imputation: clean, fill, refine by low rank, clamp, smooth."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aquatally.functions import dayvec
from aquatally.operators import cleaning, filling, lowrank, smoothing
from aquatally.operators.gaps import large_gap_blocks
from aquatally.operators.pairing import KEYS, attach_original, first_load
from aquatally.operators.timeline import BLOCK, BLOCK_KEYS, by_block
from aquatally.plans.fast import impute_days, impute_timelines
from aquatally.schema import DAY, METER, VEC, day_width, require, with_day
from aquatally.sources.scratch import settle


def on_readings(df: DataFrame, step: Callable[[DataFrame], DataFrame], vec: str = VEC) -> DataFrame:
    """Run a chain of timeline steps on rows whose other columns travel as one.

    So nothing is joined back, and a day that is there twice stays there twice.
    """
    rest = [c for c in df.columns if c not in (*KEYS, vec)]
    if not rest:
        return step(df.select(*KEYS, vec))
    done = step(df.select(*KEYS, vec, F.struct(*rest).alias("_rest")))
    return done.select(*[F.col(c) if c in (*KEYS, vec) else F.col(f"_rest.{c}").alias(c) for c in df.columns])


def impute_scientific(
    df: DataFrame,
    n_components: int = 20,
    max_iterations: int = 3,
    tolerance: float = 1e-4,
    enforce_monotonicity: bool = True,
    apply_smoothing: bool = False,
    smoothing_method: str = "savgol",
    smoothing_window: int = 11,
    clamp_timeline: bool = True,
    restore_from: str = "raw",
    vec: str = VEC,
    hours: int | None = None,
) -> DataFrame:
    """Clean, fill and refine every meter, one row per meter and day.

    ``restore_from`` names the originals that smoothing puts back: the ``raw`` readings
    or the ``clean`` ones.  A meter without any reading stays empty.  Rows without a meter or
    a day belong to no timeline: the in-day steps alone apply to them.
    """
    require(df, METER, DAY, vec)
    hours = day_width(df, vec, hours)

    def readings(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_raw", F.col(vec)).withColumn("_clean", F.col(vec))
        rows = cleaning.null_spikes(cleaning.null_zeros(rows, "_clean"), vec="_clean")
        rows = cleaning.null_drops(rows, vec="_clean")
        rows = filling.interpolate_day(with_day(rows, vec, F.col("_clean")), vec)
        rows = filling.carry_whole_days(rows, vec)
        rows = lowrank.refine_by_meter(rows, "_clean", n_components, max_iterations, tolerance, vec, hours)
        rows = filling.restore_known(rows, "_clean", vec)
        if enforce_monotonicity:
            rows = filling.clamp_day(rows, vec)
        if apply_smoothing:
            original = {"raw": "_raw", "clean": "_clean"}[restore_from]
            rows = smoothing.smooth_imputed(
                rows, original, smoothing_method, smoothing_window, enforce_monotonicity, vec, hours
            )
        rows = filling.clip_negative(rows.drop("_raw", "_clean"), vec)
        return filling.clamp_timeline(rows, vec) if clamp_timeline else rows

    def unplaced(rows: DataFrame) -> DataFrame:
        rows = cleaning.null_spikes(cleaning.null_zeros(rows, vec), vec=vec)
        rows = filling.interpolate_day(rows, vec)
        if enforce_monotonicity:
            rows = filling.clamp_day(rows, vec)
        return filling.clip_negative(rows, vec)

    placed = F.col(METER).isNotNull() & F.col(DAY).isNotNull()
    done = on_readings(df.filter(placed), readings, vec)
    return done.unionByName(unplaced(df.filter(~placed)).select(*done.columns))


def impute_scientific_rows(
    df: DataFrame,
    order_by: Sequence[str],
    n_components: int = 50,
    max_iterations: int = 10,
    tolerance: float = 1e-4,
    enforce_monotonicity: bool = True,
    vec: str = VEC,
    hours: int | None = None,
) -> DataFrame:
    """The same for a table without meters: all rows are one matrix, in the given order.

    The drop filter looks at the row before, so each partition of the ordered table
    also needs the last row of the one before it.
    """
    require(df, vec, *order_by)
    hours = day_width(df, vec, hours)
    rows = df.withColumn("_clean", F.col(vec))
    rows = cleaning.null_spikes(cleaning.null_zeros(rows, "_clean"), vec="_clean")
    rows = filling.with_previous_row(rows, order_by, "_previous", "_clean")
    rows = rows.withColumn("_clean", dayvec.drop_decreases(F.col("_clean"), F.col("_previous"))).drop("_previous")
    rows = with_day(rows, vec, dayvec.interpolate(F.col("_clean")))
    rows = filling.carry_rows(rows, order_by, vec, hours)
    rows = lowrank.refine_whole_table(rows, "_clean", n_components, max_iterations, tolerance, vec, hours)
    rows = filling.restore_known(rows, "_clean", vec).drop("_clean")
    if enforce_monotonicity:
        rows = filling.clamp_day(rows, vec)
    return filling.clip_negative(rows, vec)


def impute_hybrid(
    df: DataFrame,
    gap_threshold_hours: int = 72,
    force_lowrank: bool = True,
    n_components: int = 20,
    max_iterations: int = 3,
    apply_smoothing: bool = False,
    smoothing_method: str = "savgol",
    smoothing_window: int = 11,
    vec: str = VEC,
) -> DataFrame:
    """Scientific imputation for meters with a large gap, fast imputation for the others.

    By default every meter goes the scientific way; ``force_lowrank=False`` lets the
    gaps along each meter's timeline decide.
    """

    def scientific(rows: DataFrame) -> DataFrame:
        return impute_scientific(
            rows,
            n_components,
            max_iterations,
            apply_smoothing=apply_smoothing,
            smoothing_method=smoothing_method,
            smoothing_window=smoothing_window,
            vec=vec,
        )

    if force_lowrank:
        return scientific(df)
    # settled, since both halves ask it: one row per meter and block instead of the gap search twice; joined by
    # block, so that a meter with very many rows is no task of its own
    routes = settle(large_gap_blocks(df, gap_threshold_hours, vec))
    placed = by_block(df).join(routes, list(BLOCK_KEYS))
    easy = impute_timelines(placed.filter(~F.col("large")).select(*df.columns, BLOCK), vec=vec)
    hard = scientific(placed.filter("large").select(*df.columns))
    unplaced = impute_days(df.filter(F.col(METER).isNull() | F.col(DAY).isNull()), vec=vec)
    return easy.select(*df.columns).unionByName(hard.select(*df.columns)).unionByName(unplaced.select(*df.columns))


def align_and_smooth(
    imputed: DataFrame, original_loads: DataFrame, load_order: str, width: int = 25, vec: str = VEC
) -> DataFrame:
    """Smooth an imputed table against the originals it came from.

    The originals are reduced to their first load, attached by meter and day, and the
    timeline is averaged with the observed cells put back.
    """
    original = first_load(original_loads.select(*KEYS, load_order, VEC), load_order)

    def readings(rows: DataFrame) -> DataFrame:
        paired = attach_original(rows, original, "_orig")
        nothing = F.transform(vec, lambda x: F.lit(None).cast("double"))
        paired = paired.withColumn("_orig", F.coalesce("_orig", nothing))
        return smoothing.smooth_timeline_keep_observed(paired, "_orig", width, vec).drop("_orig")

    return on_readings(imputed, readings, vec)


__all__ = [
    "align_and_smooth",
    "impute_hybrid",
    "impute_scientific",
    "impute_scientific_rows",
    "on_readings",
]
