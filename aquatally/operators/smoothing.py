"""Smoothing of filled readings, inside a day or along a meter's timeline."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aquatally.functions import blocks, dayvec, kernels
from aquatally.operators.timeline import BLOCK, BLOCK_KEYS, block_window, by_block, closed, whole_row
from aquatally.schema import DAY, METER, VEC, day_width, fitting, require, whole_day, with_day


def average_day(df: DataFrame, width: int = 11, vec: str = VEC) -> DataFrame:
    """Centred moving average inside each day."""
    return with_day(df, vec, dayvec.moving_average(F.col(vec), width))


def fit_day(df: DataFrame, width: int = 11, vec: str = VEC, hours: int | None = None) -> DataFrame:
    """Moving cubic fit inside each day.

    For a given width the fit is a fixed linear map, so its weights are computed
    once, while planning.  An even width grows by one, a width beyond the day shrinks
    to it, and below five hours there is nothing to fit.
    """
    hours = day_width(df, vec, hours)
    width = min(width + 1 - width % 2, hours)
    width -= 1 - width % 2
    if width < 5:
        return df
    filled = dayvec.interpolate(fitting(vec, hours))
    return with_day(df, vec, dayvec.banded_map(filled, *kernels.polynomial_band(hours, width)))


def spline_day(df: DataFrame, vec: str = VEC, hours: int | None = None, slack: float = 0.1) -> DataFrame:
    """Smoothing cubic spline inside each day: the least curvature whose squared
    residual stays within ``slack`` per hour.  Needs more than three known cells."""
    hours = day_width(df, vec, hours)
    allowed = slack * hours
    schema = T.StructType([f for f in df.schema if f.name != vec] + [df.schema[vec]])

    def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(vec)
            if batch.column(at).null_count or not (batch.column(at).value_lengths().to_numpy() == hours).all():
                raise ValueError(f"every day must be an array of {hours} cells")
            days = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, hours)
            complete = ~np.isnan(days).any(axis=1)
            out = days.copy()
            if complete.any():
                out[complete] = kernels.smooth_spline(days[complete], allowed)
            cells = pa.array(out.ravel(), from_pandas=True)
            offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * hours)
            smoothed = pa.ListArray.from_arrays(offsets, cells)
            columns = [smoothed if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    known = F.size(F.array_compact(vec))
    rest = [c for c in df.columns if c != vec]
    ready = df.select(*rest, F.when(known > 3, dayvec.interpolate(F.col(vec))).otherwise(F.col(vec)).alias(vec))
    return ready.mapInArrow(smooth, schema).select(*df.columns)


def write_back(df: DataFrame, original: str, smoothed: str, vec: str = VEC) -> DataFrame:
    """Take smoothed cells only where the original is null; complete days are untouched."""
    merged = dayvec.overlay(F.col(original), F.col(smoothed))
    has_gap = dayvec.missing_count(F.col(original)) > 0
    return with_day(df, vec, F.when(has_gap, merged).otherwise(F.col(vec)))


def clamp_gap_days(df: DataFrame, original: str, vec: str = VEC) -> DataFrame:
    """Clamp the days that had gaps."""
    has_gap = dayvec.missing_count(F.col(original)) > 0
    return with_day(df, vec, F.when(has_gap, dayvec.running_max(F.col(vec))).otherwise(F.col(vec)))


def smooth_imputed(
    df: DataFrame,
    original: str,
    method: str = "savgol",
    width: int = 11,
    preserve_monotonicity: bool = True,
    vec: str = VEC,
    hours: int | None = None,
) -> DataFrame:
    """Smooth only the imputed cells of each day by ``savgol``, ``moving_avg`` or ``spline``."""
    hours = day_width(df, vec, hours)
    work = df.withColumn("_smooth", F.col(vec))
    if method == "savgol":
        work = fit_day(work, width, "_smooth", hours)
    elif method == "moving_avg":
        work = average_day(work, width, "_smooth")
    elif method == "spline":
        work = spline_day(work, "_smooth", hours)
    else:
        raise ValueError(f"unknown smoothing method {method!r}")
    work = write_back(work, original, "_smooth", vec).drop("_smooth")
    return clamp_gap_days(work, original, vec) if preserve_monotonicity else work


ENDS = f"{METER} string, {BLOCK} date, _size long, _head array<double>, _tail array<double>, _inside double"
MARGINS = f"{METER} string, {BLOCK} date, _left array<double>, _right array<double>, _floor double, _short boolean"


def _ends(rows: DataFrame, width: int, hours: int) -> DataFrame:
    """One row per block: its number of cells, its first and last ones that windows of other blocks
    reach, and the greatest mean of a window that stays inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in blocks.whole_blocks(batches, BLOCK_KEYS):
            size, heads, tails, lengths, inside = blocks.block_ends(blocks.cells(table.column("_cells"), hours), starts, width)
            keys = [table.column(k).combine_chunks().take(pa.array(starts)) for k in BLOCK_KEYS]
            lists = [blocks.as_lists(x, lengths) for x in (heads, tails)]
            arrays = [*keys, pa.array(size.astype(np.int64)), *lists, pa.array(inside)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*BLOCK_KEYS, "_size", "_head", "_tail", "_inside"])

    return rows.select(*BLOCK_KEYS, "_cells", "_rn", whole_row(rows).alias("_row")).mapInArrow(run, ENDS)


def _margins(ends: DataFrame, width: int) -> DataFrame:
    """What each block needs of the others; a meter has one row per calendar block here."""
    before, after = dayvec.frame(width)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(BLOCK)
        columns = [table.column(c).to_pylist() for c in ("_size", "_head", "_tail", "_inside")]
        lefts, rights, floors, short = blocks.meter_margins(*columns, before, after)
        n = table.num_rows
        lists = [blocks.as_lists(np.concatenate(x), np.full(n, k)) for x, k in ((lefts, before), (rights, after))]
        arrays = [table.column(METER), table.column(BLOCK), *lists, pa.array(floors, pa.float64()), pa.array([short] * n, pa.bool_())]
        return pa.Table.from_arrays(arrays, names=[*BLOCK_KEYS, "_left", "_right", "_floor", "_short"])

    return ends.groupBy(METER).applyInArrow(run, MARGINS)


def smooth_timeline(
    df: DataFrame,
    width: int = 25,
    preserve_monotonicity: bool = True,
    vec: str = VEC,
    hours: int | None = None,
) -> DataFrame:
    """Moving average along each meter's timeline; observed cells are averaged too.

    A meter with fewer cells than the window stays as it is.  Rows are spread by block once.  One summary per
    block carries both what the windows of its neighbours reach and the greatest mean so far, so the means
    and the clamp are one pass over whole blocks.  A day shorter than the others ends in missing cells.
    """
    require(df, METER, DAY, vec)
    hours = day_width(df, vec, hours)
    before, after = dayvec.frame(width)
    rows = by_block(df).withColumn("_cells", whole_day(vec, hours)).withColumn("_rn", F.row_number().over(block_window()))
    margins = _margins(_ends(rows, width, hours), width)
    # a window again, so that the rows come in blocks and in order whatever the join does with them
    joined = rows.join(margins, list(BLOCK_KEYS)).withColumn("_rn", F.row_number().over(block_window()))
    kept = [c for c in joined.columns if c not in ("_cells", "_left", "_right", "_floor", "_short", "_rn", vec)]
    joined = joined.select(*kept, F.size(vec).alias("_size"), "_cells", "_left", "_right", "_floor", "_short", "_rn")
    schema = T.StructType([*[joined.schema[c] for c in kept], T.StructField("_size", T.IntegerType()), T.StructField("_cells", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in blocks.whole_blocks(batches, BLOCK_KEYS):
            days = blocks.cells(table.column("_cells"), hours)
            first = table.select(["_left", "_right", "_floor"]).take(pa.array(starts))
            lefts, rights = blocks.cells(first.column("_left"), before), blocks.cells(first.column("_right"), after)
            floors = first.column("_floor").to_numpy()
            out = blocks.smoothed(days, starts, lefts, rights, floors, preserve_monotonicity)
            short = table.column("_short").to_numpy()
            out[short] = days[short]
            done = table.select([*kept, "_size"]).append_column("_cells", blocks.as_days(out))
            yield from done.to_batches()

    out = joined.mapInArrow(run, schema)
    whole = F.when(F.col("_size") == hours, F.col("_cells")).when(F.col("_size") >= 0, F.slice("_cells", F.lit(1), F.col("_size")))
    out = out.withColumn(vec, whole.alias(vec, metadata=df.schema[vec].metadata))
    return closed(out, df, "_cells", "_size").select(*df.columns)


def smooth_day_keep_observed(df: DataFrame, original: str, width: int = 25, vec: str = VEC, hours: int | None = None) -> DataFrame:
    """Moving average inside each day, observed cells put back, then every day clamped."""
    rows = average_day(df, min(width, day_width(df, vec, hours)), vec)
    rows = with_day(rows, vec, dayvec.overlay(F.col(original), F.col(vec)))
    return with_day(rows, vec, dayvec.running_max(F.col(vec)))


def smooth_timeline_keep_observed(
    df: DataFrame, original: str, width: int = 25, vec: str = VEC, hours: int | None = None
) -> DataFrame:
    """Moving average along the timeline, raised to be monotone, observed cells put back.

    The cells put back are not clamped again, so a smoothed cell may lie above them.
    """
    rows = smooth_timeline(df.withColumn("_kept", F.col(original)), width, True, vec, hours)
    return with_day(rows, vec, dayvec.overlay(F.col("_kept"), F.col(vec))).drop("_kept")
