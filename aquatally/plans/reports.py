"""The gap report: one table of lines, and the metrics as one JSON document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aquatally.operators import gaps
from aquatally.schema import DAY, METER, VEC
from aquatally.sources import sinks


def gap_report(df: DataFrame, top: int = 10, vec: str = VEC) -> DataFrame:
    """Totals, the worst days and the recommendation as numbered lines.

    The table is read twice: for one aggregate with all its figures, and for the worst days.
    """
    present = F.col("total_values") - F.col("missing_count")
    advice = F.format_string("quality: %s, gaps above a week: %s", F.col("quality"), F.col("long_gaps").cast("string"))
    figures = gaps.totals_and_advice(df, vec).select(
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("seq"), F.format_string("rows: %d", "total_meters").alias("line")),
                F.struct(F.lit(2).alias("seq"), F.format_string("hours per row: %d", "total_timestamps").alias("line")),
                F.struct(F.lit(3).alias("seq"), F.format_string("present: %d", present).alias("line")),
                F.struct(F.lit(4).alias("seq"), F.format_string("missing: %d", "missing_count").alias("line")),
                F.struct(
                    F.lit(5).alias("seq"), F.format_string("missing pct: %.2f", "missing_pct").alias("line")
                ),
                F.struct(F.lit(top + 6).alias("seq"), advice.alias("line")),
            )
        ).alias("r")
    ).select("r.seq", "r.line")
    # the worst days are at most ``top`` rows, numbered by their order
    ranked = gaps.worst(gaps.stats_by_day(df, vec), top).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    (-F.col("missing_pct")).alias("rank"), METER, DAY, "missing_pct", "num_gaps", "max_gap_size"
                )
            )
        ).alias("rows")
    )
    worst = ranked.select(F.posexplode("rows").alias("n", "w")).select(
        (F.col("n") + 6).alias("seq"),
        F.format_string(
            "%s %s: %.1f pct missing, %d gaps, longest %d h",
            F.col("w.id"),
            F.col("w.data").cast("string"),
            F.col("w.missing_pct"),
            F.col("w.num_gaps"),
            F.col("w.max_gap_size"),
        ).alias("line"),
    )
    return figures.unionByName(worst)


def gap_metrics(df: DataFrame, vec: str = VEC) -> DataFrame:
    """Per-day metrics, one row each, ready to be written as JSON lines."""
    return gaps.stats_by_day(df, vec)


def write_gap_document(df: DataFrame, path: str, vec: str = VEC) -> None:
    """Gap metrics as JSON: under ``global`` one document with the figures of the whole table and
    its shape, under ``rows`` one object per meter and day.

    The rows stay apart from the document, so that no task has to write them all.
    """
    figures = ["total_meters", "total_timestamps", "total_values", "missing_count", "missing_pct"]
    document = gaps.global_stats(df, vec).select(
        F.struct(*figures).alias("global"),
        F.array(F.col("total_meters"), F.col("total_timestamps").cast("bigint")).alias("shape"),
    )
    sinks.write_json(document, f"{path}/global")
    sinks.write_json(gap_metrics(df, vec), f"{path}/rows")
