"""Fast imputation: interpolate, carry, zero-fill and clamp."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aquatally.functions import dayvec
from aquatally.operators import filling, smoothing
from aquatally.operators.timeline import BLOCK, by_block
from aquatally.schema import DAY, METER, VEC, day_width, require, with_day


def impute_fast(
    df: DataFrame,
    enforce_monotonicity: bool = True,
    clamp_timeline: bool = False,
    empty_days: str = "carry",
    vec: str = VEC,
    hours: int | None = None,
) -> DataFrame:
    """Fill every gap of every meter; other columns stay.

    The in-day steps are one projection, and one spread by (meter, month) serves the
    fill across days.  Rows without a meter or a day belong to no timeline: the in-day
    steps alone apply to them.
    """
    require(df, METER, DAY, vec)
    hours = day_width(df, vec, hours)
    placed = F.col(METER).isNotNull() & F.col(DAY).isNotNull()
    rest = impute_days(df.filter(~placed), enforce_monotonicity, empty_days, vec)
    rows = impute_timelines(df.filter(placed), enforce_monotonicity, clamp_timeline, empty_days, vec, hours)
    return rows.unionByName(rest.select(*rows.columns))


def impute_timelines(
    rows: DataFrame,
    enforce_monotonicity: bool = True,
    clamp_timeline: bool = False,
    empty_days: str = "carry",
    vec: str = VEC,
    hours: int | None = None,
) -> DataFrame:
    """``impute_fast`` for rows that all have a meter and a day; rows spread by block stay so."""
    if empty_days in ("drop", "interpolate"):
        rows = filling.apply_empty_day_policy(rows, empty_days, vec, hours)
    rows = filling.interpolate_day(rows, vec)
    if empty_days == "carry":
        rows = filling.carry_whole_days(rows, vec)
    if empty_days != "null":
        rows = filling.zero_fill(rows, vec)
    if enforce_monotonicity:
        rows = filling.clamp_day(rows, vec)
    return filling.clamp_timeline(rows, vec) if clamp_timeline else rows


def impute_and_smooth(
    df: DataFrame,
    width: int = 25,
    original: str | None = None,
    vec: str = VEC,
    hours: int | None = None,
    filled: str | None = None,
) -> DataFrame:
    """Fast imputation, then the moving average along each timeline, on rows spread once.

    With ``original`` its observed cells are put back over the smoothed ones; ``filled`` names a column
    that keeps the readings as they were before smoothing.  Rows without a meter or a day
    belong to no timeline and are left out, as ``smooth_timeline`` does.
    """
    require(df, METER, DAY, vec)
    hours = day_width(df, vec, hours)
    rows = impute_timelines(by_block(df), vec=vec, hours=hours)
    if filled is not None:
        rows = rows.withColumn(filled, F.col(vec))
    if original is None:
        return smoothing.smooth_timeline(rows, width, True, vec, hours).drop(BLOCK)
    return smoothing.smooth_timeline_keep_observed(rows, original, width, vec, hours).drop(BLOCK)


def impute_days(
    df: DataFrame, enforce_monotonicity: bool = True, empty_days: str = "carry", vec: str = VEC
) -> DataFrame:
    """The in-day steps of ``impute_fast`` alone, for rows that belong to no timeline."""
    if empty_days == "drop":
        df = filling.apply_empty_day_policy(df, empty_days, vec)
    df = filling.interpolate_day(df, vec)
    if empty_days != "null":
        df = filling.zero_fill(df, vec)
    return filling.clamp_day(df, vec) if enforce_monotonicity else df


def impute_fast_rows(
    df: DataFrame,
    order_by: Sequence[str],
    enforce_monotonicity: bool = True,
    vec: str = VEC,
    hours: int | None = None,
) -> DataFrame:
    """The same for a table without meters: all rows, in the given order, are one series."""
    require(df, vec, *order_by)
    hours = day_width(df, vec, hours)
    rows = filling.carry_rows(filling.interpolate_day(df, vec), order_by, vec, hours)
    rows = with_day(rows, vec, dayvec.nulls_to_zero(F.col(vec)))
    return filling.clamp_day(rows, vec) if enforce_monotonicity else rows
