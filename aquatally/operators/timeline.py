"""Work along a meter's whole timeline, without a task per meter.

A single meter may own a large share of the table, so nothing here partitions
rows by meter alone.  A timeline is cut into calendar blocks; rows are spread by
(meter, block) and each block is worked on its own.  What a block needs from the
others is carried by a summary with one row per block, small enough to be ordered
per meter because a calendar has few blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aquatally.schema import DAY, METER, VEC, require

BLOCK = "_block"
BLOCK_KEYS = (METER, BLOCK)


class Carry(NamedTuple):
    """How a value travels between blocks.

    ``per_block`` aggregates one block, ``combine`` merges blocks in time order and
    ``side`` tells which blocks count: those ``before``, those ``after`` or ``all``.
    """

    per_block: Column
    combine: Callable[[Column], Column]
    side: str = "before"


def latest(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


def earliest(c: Column) -> Column:
    return F.first(c, ignorenulls=True)


def by_block(df: DataFrame, period: str = "month") -> DataFrame:
    """Spread rows by meter and calendar block.

    A row without meter or day belongs to no timeline and is left out.  Saying so here
    also gives every reader of the blocks the same filter, hence the same shuffle.  A table
    that has its block column is spread already: a chain of steps spreads its rows once.
    """
    require(df, METER, DAY)
    if BLOCK in df.columns:
        return df
    rows = df.withColumn(BLOCK, F.trunc(DAY, period))
    placed = F.col(METER).isNotNull() & F.col(DAY).isNotNull() & F.col(BLOCK).isNotNull()
    return rows.filter(placed).repartition(METER, BLOCK)


def block_window() -> "Window":
    return Window.partitionBy(*BLOCK_KEYS).orderBy(DAY)


def closed(rows: DataFrame, df: DataFrame, *scratch: str) -> DataFrame:
    """``rows`` without the scratch columns, and without the block unless ``df`` came with it."""
    return rows.drop(*scratch) if BLOCK in df.columns else rows.drop(BLOCK, *scratch)


def whole_row(rows: DataFrame) -> Column:
    """A value that needs every column of the row.

    A summary and the rows it goes back to come from one blocked table.  If the summary
    read fewer columns, Spark would prune the others below its shuffle and then run the
    two as separate shuffles, each from the source.  Reading the whole row keeps them one.
    """
    return F.xxhash64(*rows.columns)


def with_carry(rows: DataFrame, carries: Mapping[str, Carry]) -> DataFrame:
    """Add, to each row of a blocked table, what the other blocks of its meter carry."""
    summary = rows.groupBy(*BLOCK_KEYS).agg(
        *[c.per_block.alias(n) for n, c in carries.items()], F.max(whole_row(rows)).alias("_row")
    )
    summary = summary.filter(F.col("_row").isNotNull())  # true of every group
    order = Window.partitionBy(METER).orderBy(BLOCK)
    sides = {
        "before": order.rowsBetween(Window.unboundedPreceding, -1),
        "after": order.rowsBetween(1, Window.unboundedFollowing),
        "all": order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing),
    }
    moved = summary.select(
        *BLOCK_KEYS, *[c.combine(F.col(n)).over(sides[c.side]).alias(n) for n, c in carries.items()]
    )
    # every block has its summary; an inner join puts the same conditions on both sides
    return rows.join(moved, list(BLOCK_KEYS))


def with_ordinal(df: DataFrame, into: str = "_ordinal") -> DataFrame:
    """0-based number of each row along its meter's timeline."""
    rows = with_carry(by_block(df), {"_rows_before": Carry(F.count(F.lit(1)), F.sum)})
    number = F.row_number().over(block_window()) - 1 + F.coalesce("_rows_before", F.lit(0))
    return rows.withColumn(into, number).drop(BLOCK, "_rows_before")


def with_neighbours(df: DataFrame, reach: int = 1, after: bool = True, vec: str = VEC) -> DataFrame:
    """Add the days beside each row: ``_before`` and ``_after`` hold up to ``reach``
    arrays, nearest first, and ``_days`` the number of rows of the meter.

    A block sees its own rows through a window.  The first and last ``reach`` rows
    of every block form a thin table in which the neighbours across a cut are
    adjacent, so only that table is ordered per meter.
    """
    inside = block_window()
    rows = by_block(df)
    every = whole_row(rows).alias("_row")
    rows = rows.withColumn("_rn", F.row_number().over(inside))
    rows = rows.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*BLOCK_KEYS)))
    rows = rows.withColumn("_back", F.col("_size") - F.col("_rn") + 1)

    near = range(1, reach + 1)
    along = Window.partitionBy(METER).orderBy(DAY)
    rim = rows.filter((F.col("_rn") <= reach) | (F.col("_back") <= reach)).select(
        *BLOCK_KEYS, "_rn", "_back", "_size", DAY, vec, every
    )
    first, last = F.col("_rn") == 1, F.col("_back") == 1
    beside = rim.select(
        *BLOCK_KEYS,
        "_row",
        F.when(first, F.array(*[F.lag(vec, k).over(along) for k in near])).alias("_left"),
        F.when(last, F.array(*[F.lead(vec, k).over(along) for k in near])).alias("_right"),
        F.sum(F.when(first, F.col("_size"))).over(Window.partitionBy(METER)).alias("_days"),
    )
    halo = beside.groupBy(*BLOCK_KEYS).agg(
        F.max("_left").alias("_left"),
        F.max("_right").alias("_right"),
        F.max("_days").alias("_days"),
        F.max("_row").alias("_row"),
    )
    halo = halo.filter(F.col("_row").isNotNull()).drop("_row")
    joined = rows.join(halo, list(BLOCK_KEYS))

    def before(k: int) -> Column:
        outside = F.get("_left", F.lit(k) - F.col("_rn"))
        return F.when(F.col("_rn") > k, F.lag(vec, k).over(inside)).otherwise(outside)

    def behind(k: int) -> Column:
        outside = F.get("_right", (F.lit(k) - F.col("_back")).cast("int"))
        return F.when(F.col("_back") > k, F.lead(vec, k).over(inside)).otherwise(outside)

    out = joined.withColumn("_before", F.array(*[before(k) for k in near]))
    if after:
        out = out.withColumn("_after", F.array(*[behind(k) for k in near]))
    return out.drop("_rn", "_size", "_back", "_left", "_right", BLOCK)


def with_previous_day(df: DataFrame, into: str, vec: str = VEC) -> DataFrame:
    """Add the array of the meter's preceding row, null on its first row."""
    rows = with_neighbours(df, 1, after=False, vec=vec)
    return rows.withColumn(into, F.get("_before", F.lit(0))).drop("_before", "_days")
