"""Cleaning of raw readings: zeros, spikes and invalid drops become null."""

from __future__ import annotations

from pyspark.sql import DataFrame

from aquatally.functions import dayvec
from aquatally.operators.timeline import with_previous_day
from aquatally.schema import VEC, with_day
from pyspark.sql import functions as F


def null_zeros(df: DataFrame, vec: str = VEC) -> DataFrame:
    """A zero in a cumulative series is a sensor error."""
    return with_day(df, vec, dayvec.zero_to_null(F.col(vec)))


def null_spikes(
    df: DataFrame, width: int = 5, factor: float = 1.25, floor: float = 10.0, vec: str = VEC
) -> DataFrame:
    """Null readings far above the median of the hours around them, in one pass."""
    return with_day(df, vec, dayvec.drop_spikes(F.col(vec), width, factor, floor))


def null_drops(df: DataFrame, reset_ratio: float = 0.1, vec: str = VEC) -> DataFrame:
    """Null readings below the same hour of the meter's preceding day.

    All cells are judged against the readings as they came in; a fall to
    ``reset_ratio`` of the earlier reading or less is a meter reset and stays.
    """
    rows = with_previous_day(df, "_previous", vec)
    return rows.withColumn(
        vec, dayvec.drop_decreases(F.col(vec), F.col("_previous"), reset_ratio)
    ).drop("_previous")


def clean(df: DataFrame, vec: str = VEC) -> DataFrame:
    """Zeros, then spikes, then drops."""
    return null_drops(null_spikes(null_zeros(df, vec), vec=vec), vec=vec)
