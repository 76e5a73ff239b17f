"""Joins and set operations between readings tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aquatally.schema import DAY, METER, VEC, require

KEYS = [METER, DAY]


def attach_original(imputed: DataFrame, original: DataFrame, into: str = "v_orig") -> DataFrame:
    """Keep every imputed day and add the original one, null where there is none."""
    require(original, *KEYS, VEC)
    return imputed.join(original.select(*KEYS, F.col(VEC).alias(into)), KEYS, "left")


def pair_days(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Days that both tables have, side by side: paired by key, never by position."""
    a = left.select(*KEYS, F.col(VEC).alias(names[0]))
    return a.join(right.select(*KEYS, F.col(VEC).alias(names[1])), KEYS)


def pair_series(left: DataFrame, right: DataFrame, on: Sequence[str] = (DAY, "hour")) -> DataFrame:
    """The points two aggregated series share."""
    return left.join(right, list(on), "inner")


SPREAD = 16  # parts into which the rows of a meter go where they meet what is known of the meter


def join_meters(df: DataFrame, meters: DataFrame, how: str = "inner") -> DataFrame:
    """Join of rows with a table of one row per meter, or of a few.

    A meter's rows go to ``SPREAD`` parts by their day, and the thin table to each of them: so a meter
    with very many rows is no task of its own.
    """
    part = F.pmod(F.xxhash64(*([DAY] if DAY in df.columns else df.columns)), F.lit(SPREAD)).cast("int")
    spread = meters.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return df.withColumn("_part", part).join(spread, [METER, "_part"], how).drop("_part")


def rows_of_meters(df: DataFrame, meters: DataFrame) -> DataFrame:
    """Rows of the chosen meters."""
    return join_meters(df, meters.select(METER).distinct(), "left_semi").select(*df.columns)


def meters_in_both(df: DataFrame, other: DataFrame) -> DataFrame:
    """Meters of one table that the other has as well."""
    return df.select(METER).distinct().join(other.select(METER).distinct(), METER, "left_semi")


def meters_missing_from(df: DataFrame, other: DataFrame) -> DataFrame:
    """Meters of one table that the other lacks."""
    return df.select(METER).distinct().join(other.select(METER).distinct(), METER, "left_anti")


def union_all(*parts: DataFrame) -> DataFrame:
    """Stack results by column name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def first_load(df: DataFrame, load_order: str) -> DataFrame:
    """One row per meter and day, the one loaded first.

    An aggregate instead of a ranking: copies combine before the shuffle, so a day
    loaded any number of times is one row per task.
    """
    require(df, *KEYS, load_order)
    rest = [c for c in df.columns if c not in KEYS]
    # the order leads the struct, so ties end the same way whatever the task order
    first = F.min_by(F.struct(*rest), F.struct(load_order, F.xxhash64(*rest))).alias("_row")
    rows = df.groupBy(*KEYS).agg(first)
    return rows.select(*[F.col(c) if c in KEYS else F.col(f"_row.{c}").alias(c) for c in df.columns])
