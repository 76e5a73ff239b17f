"""Gap filling and monotone clamping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aquatally.functions import dayvec
from aquatally.operators.timeline import (
    BLOCK,
    Carry,
    block_window,
    by_block,
    closed,
    earliest,
    latest,
    with_carry,
    with_ordinal,
)
from aquatally.schema import DAY, VEC, day_width, fitting, with_day
from aquatally.sources.scratch import settle


def interpolate_day(df: DataFrame, vec: str = VEC) -> DataFrame:
    """Linear interpolation inside each day; an empty day stays empty."""
    return with_day(df, vec, dayvec.interpolate(F.col(vec)))


def fill_day(df: DataFrame, vec: str = VEC) -> DataFrame:
    """Forward, then backward fill inside each day."""
    return with_day(df, vec, dayvec.fill_forward_back(F.col(vec)))


def zero_fill(df: DataFrame, vec: str = VEC) -> DataFrame:
    return with_day(df, vec, dayvec.nulls_to_zero(F.col(vec)))


def clamp_day(df: DataFrame, vec: str = VEC) -> DataFrame:
    """No reading below an earlier one of the same day."""
    return with_day(df, vec, dayvec.running_max(F.col(vec)))


def clip_negative(df: DataFrame, vec: str = VEC) -> DataFrame:
    return with_day(df, vec, dayvec.clip_negative(F.col(vec)))


def restore_known(df: DataFrame, known: str, vec: str = VEC) -> DataFrame:
    """Put the known readings back over refined ones."""
    return with_day(df, vec, dayvec.overlay(F.col(known), F.col(vec)))


def _cell(vec: str, hour: int) -> Column:
    return F.get(F.col(vec), F.lit(hour))


def _when_known(vec: str, hour: int) -> Column:
    return F.when(_cell(vec, hour).isNotNull(), F.col(DAY))


def carry_days(df: DataFrame, vec: str = VEC, hours: int | None = None) -> DataFrame:
    """Fill each hour from the meter's last earlier day that has it, else its first later one.

    Only the first known reading of a meter can ever be needed backwards, so the
    backward fill is a carry too and no second pass over the rows is made.
    """
    hours = day_width(df, vec, hours)
    df = with_day(df, vec, fitting(vec, hours))
    carries = {}
    for h in range(hours):
        cell, day = _cell(vec, h), _when_known(vec, h)
        carries[f"_last{h}"] = Carry(F.max_by(cell, day), latest)
        carries[f"_first{h}"] = Carry(F.min_by(cell, day), earliest, "all")
    rows = with_carry(by_block(df), carries)
    so_far = block_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = [
        F.coalesce(latest(_cell(vec, h)).over(so_far), F.col(f"_last{h}"), F.col(f"_first{h}"))
        for h in range(hours)
    ]
    return with_day(rows, vec, F.array(*filled)).drop(BLOCK, *carries)


def carry_whole_days(df: DataFrame, vec: str = VEC) -> DataFrame:
    """The same where every day is either complete or empty, as it is after interpolation:
    the day travels as one value instead of one per hour."""
    known = ~dayvec.is_empty_day(F.col(vec))
    day = F.when(known, F.col(DAY))
    rows = with_carry(
        by_block(df),
        {
            "_last": Carry(F.max_by(vec, day), latest),
            "_first": Carry(F.min_by(vec, day), earliest, "all"),
        },
    )
    so_far = block_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = latest(F.when(known, F.col(vec))).over(so_far)
    # a meter without any reading keeps its empty days
    return closed(with_day(rows, vec, F.coalesce(here, "_last", "_first", vec)), df, "_last", "_first")


def clamp_timeline(df: DataFrame, vec: str = VEC) -> DataFrame:
    """No reading below any earlier one of the same meter; null cells stay null.

    One number per day, its maximum, is enough to carry between days and blocks.
    """
    rows = by_block(df).withColumn("_top", F.array_max(vec))
    rows = with_carry(rows, {"_carried": Carry(F.max("_top"), F.max)})
    earlier = block_window().rowsBetween(Window.unboundedPreceding, -1)
    floor = F.greatest(F.max("_top").over(earlier), F.col("_carried"))
    raised = dayvec.raise_to(dayvec.running_max(F.col(vec)), F.col("_floor"))
    return closed(with_day(rows.withColumn("_floor", floor), vec, raised), df, "_top", "_carried", "_floor")


def interpolate_timeline(df: DataFrame, vec: str = VEC, hours: int | None = None) -> DataFrame:
    """Linear interpolation along the meter's whole timeline, across days.

    Inside a day the known cells beside a gap are in the row.  At its ends they are
    the last known cell of the earlier days and the first one of the later days.
    """
    hours = day_width(df, vec, hours)
    rows = with_ordinal(df)

    def point(hour: Column, x: Column) -> Column:
        at = F.col("_ordinal").cast("bigint") * hours + hour
        return F.struct(at.alias("at"), x.alias("x"))

    known = F.filter(F.sequence(F.lit(0), F.size(vec) - 1), lambda i: F.get(vec, i).isNotNull())
    rows = rows.withColumn("_known", known)

    def end(hour: Column) -> Column:
        return F.when(hour.isNotNull(), point(hour, F.get(vec, hour)))

    rows = rows.withColumn("_head", end(F.get("_known", F.lit(0))))
    rows = rows.withColumn("_tail", end(F.get("_known", F.size("_known") - 1))).drop("_known")
    rows = with_carry(
        by_block(rows),
        {
            "_tail_before": Carry(F.max("_tail"), F.max),
            "_head_after": Carry(F.min("_head"), F.min, "after"),
        },
    )
    inside = block_window()
    earlier = F.max("_tail").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    later = F.min("_head").over(inside.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("_left", F.coalesce(earlier, F.col("_tail_before")))
    rows = rows.withColumn("_right", F.coalesce(later, F.col("_head_after")))
    start = F.col("_ordinal").cast("bigint") * hours
    filled = dayvec.interpolate_between(
        F.col(vec),
        (F.col("_left.at") - start, F.col("_left.x")),
        (F.col("_right.at") - start, F.col("_right.x")),
    )
    scratch = [BLOCK, "_head", "_tail", "_left", "_right", "_tail_before", "_head_after", "_ordinal"]
    return with_day(rows, vec, filled).drop(*scratch)


def apply_empty_day_policy(
    df: DataFrame, policy: str = "carry", vec: str = VEC, hours: int | None = None
) -> DataFrame:
    """What becomes of a day without any reading, before the in-day steps.

    ``carry`` copies the day before (or after), ``null`` keeps the day empty, ``drop``
    removes it and ``interpolate`` draws a line across it.
    """
    if policy == "carry":
        return carry_days(df, vec, hours)
    if policy == "null":
        return df
    if policy == "drop":
        return df.filter(~dayvec.is_empty_day(F.col(vec)))
    if policy == "interpolate":
        return interpolate_timeline(df, vec, hours)
    raise ValueError(f"unknown empty-day policy {policy!r}")


def _ordered_parts(df: DataFrame, order_by: Sequence[str], partitions: int | None) -> DataFrame:
    """Range-partition a table without meters by its row order and number the parts.

    Settled once, so that a part keeps its number and rows whatever reads it.
    """
    if not order_by:
        raise ValueError("a table without meters needs an explicit row order")
    spread = df.repartitionByRange(*([partitions] if partitions else []), *order_by)
    return settle(spread.withColumn("_part", F.spark_partition_id()))


def with_previous_row(
    df: DataFrame, order_by: Sequence[str], into: str, vec: str = VEC, partitions: int | None = None
) -> DataFrame:
    """Add the array of the preceding row of the whole table, null on its first row."""
    rows = _ordered_parts(df, order_by, partitions)
    ends = rows.groupBy("_part").agg(F.max_by(vec, F.struct(*order_by)).alias("_end"))
    # at most one row per range partition, so a single ordered pass over it is bounded
    ends = ends.withColumn("_end", F.lag("_end").over(Window.partitionBy(F.lit(0)).orderBy("_part")))
    inside = Window.partitionBy("_part").orderBy(*order_by)
    first = F.row_number().over(inside) == 1
    before = F.when(first, F.col("_end")).otherwise(F.lag(vec).over(inside))
    return rows.join(ends, "_part").withColumn(into, before).drop("_part", "_end")


def carry_rows(
    df: DataFrame, order_by: Sequence[str], vec: str = VEC, hours: int | None = None, partitions: int | None = None
) -> DataFrame:
    """The carry fill without a meter column: the whole table is one series.

    ``order_by`` must order the rows fully.  Rows are range-partitioned by it and
    settled once, so that a partition keeps its number; the last and first known
    reading of each partition, one row per partition, carry between partitions.
    """
    hours = day_width(df, vec, hours)
    rows = _ordered_parts(with_day(df, vec, fitting(vec, hours)), order_by, partitions)
    by_order = F.struct(*order_by)
    ends = []
    for h in range(hours):
        cell = _cell(vec, h)
        here = F.when(cell.isNotNull(), by_order)
        ends += [F.max_by(cell, here).alias(f"_last{h}"), F.min_by(cell, here).alias(f"_first{h}")]
    # at most one row per range partition, so a single ordered pass over it is bounded
    order = Window.partitionBy(F.lit(0)).orderBy("_part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = rows.groupBy("_part").agg(*ends)
    moved = moved.select(
        "_part",
        *[F.last(f"_last{h}", ignorenulls=True).over(before).alias(f"_last{h}") for h in range(hours)],
        *[F.first(f"_first{h}", ignorenulls=True).over(whole).alias(f"_first{h}") for h in range(hours)],
    )
    inside = Window.partitionBy("_part").orderBy(*order_by)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = [
        F.coalesce(
            F.last(_cell(vec, h), ignorenulls=True).over(so_far), F.col(f"_last{h}"), F.col(f"_first{h}")
        )
        for h in range(hours)
    ]
    names = [f"{end}{h}" for h in range(hours) for end in ("_last", "_first")]
    return with_day(rows.join(moved, "_part"), vec, F.array(*filled)).drop("_part", *names)
