"""Low-rank refinement of filled readings.

The days of a meter form a matrix (days x hours).  Its unknown cells are replaced,
again and again, by those of its best low-rank approximation.  The truncated SVD of a
matrix is its projection on the leading eigenvectors of its hours x hours Gram matrix,
which is a sum over rows: it combines before the shuffle, and only one small row per
meter is worked on as a whole.  The days of a meter and month lie in one row of a columnar table,
so a round is one read of that table and one matrix product per block, and a meter of any
length is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aquatally.functions import kernels
from aquatally.operators.timeline import BLOCK, BLOCK_KEYS
from aquatally.schema import DAY, METER, VEC, day_width, fitting, whole_day, with_day
from aquatally.sources.scratch import settle, written

SUMS = f"{METER} string, _gram binary, _change double, _size double, _days long, _holes boolean, _found array<binary>"
FOUND = f"{METER} string, _found array<binary>, _moving boolean"


def refine_by_meter(
    df: DataFrame,
    known: str,
    n_components: int = 20,
    max_iterations: int = 3,
    tolerance: float = 1e-4,
    vec: str = VEC,
    hours: int | None = None,
) -> DataFrame:
    """Refine the cells that are null in ``known``, starting from the filled ``vec``,
    which has the known cells as they are.

    Meters are independent.  The rows are packed by block and written once; a round reads them, applies all
    projections found so far and leaves the sums for the next one, per meter.  A meter stops
    when its relative change falls below the tolerance.  A meter of one day, or with
    a cell that nothing could fill, stays as it is, and so do rows without a meter.
    """
    hours = day_width(df, vec, hours)
    if max_iterations < 1:
        return df
    if BLOCK in df.columns:
        placed, rest = df, None  # a chain of timeline steps has left out the rows without meter or day
    else:
        blocks = df.withColumn(BLOCK, F.trunc(DAY, "month"))
        whole = F.col(METER).isNotNull() & F.trunc(DAY, "month").isNotNull()
        placed, rest = blocks.filter(whole), df.filter(~whole)
    start = written(_packed(placed, known, vec, hours), "refine")
    found: DataFrame | None = None  # per meter: its projections, and whether it still moves
    for turn in range(max_iterations):
        days = start.select(METER, "_cells", "_known")
        if found is None:
            active = days.withColumn("_found", F.array().cast("array<binary>"))
        else:
            active = days.join(found.filter("_moving").select(METER, "_found"), METER)
        sums = active.mapInArrow(_summed(hours), SUMS)
        now = written(sums.groupBy(METER).applyInArrow(_next(hours, n_components, tolerance, turn), FOUND), "refine-found")
        found = now if found is None else written(now.unionByName(found.filter(~F.col("_moving"))), "refine-found")
        if found.filter("_moving").isEmpty():
            break
    done = start.join(found.select(METER, "_found"), METER, "left").select(*BLOCK_KEYS, "_cells", "_known", "_sizes", "_others", "_found")
    schema = done.select(*BLOCK_KEYS, "_sizes", "_others").schema.add("_days", T.ArrayType(T.ArrayType(T.DoubleType())))
    refined = done.mapInArrow(_refined(hours), schema)
    row = F.explode(F.arrays_zip("_others", "_days", "_sizes")).alias("_row")
    rows = refined.select(*BLOCK_KEYS, row)
    day = F.when(F.col("_row._sizes") == hours, F.col("_row._days")).when(
        F.col("_row._sizes") >= 0, F.slice("_row._days", F.lit(1), F.col("_row._sizes"))
    )
    own = {METER: F.col(METER), BLOCK: F.col(BLOCK), vec: day.alias(vec, metadata=df.schema[vec].metadata)}
    out = rows.select(*[own.get(c, F.col(f"_row._others.`{c}`").alias(c, metadata=df.schema[c].metadata)) for c in df.columns])
    return out if rest is None else out.unionByName(rest)


def _packed(rows: DataFrame, known: str, vec: str, hours: int) -> DataFrame:
    """One row per block: the cells of its days end to end, those known before, and what else its rows hold."""
    others = [c for c in rows.columns if c not in (METER, BLOCK, vec)]
    day = F.struct(
        F.struct(*others).alias("others"), F.size(vec).alias("size"), whole_day(vec, hours).alias("cells"), whole_day(known, hours).alias("known")
    )
    blocks = rows.groupBy(*BLOCK_KEYS).agg(F.collect_list(day).alias("_rows"))
    return blocks.select(
        *BLOCK_KEYS,
        F.flatten("_rows.cells").alias("_cells"),
        F.flatten("_rows.known").alias("_known"),
        F.col("_rows.size").alias("_sizes"),
        F.col("_rows.others").alias("_others"),
    )


def _matrices(column: pa.Array, hours: int) -> list[np.ndarray]:
    """The days of each block as a matrix, NaN where a cell is missing."""
    cells = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, hours)
    return np.split(cells, np.cumsum(column.value_lengths().to_numpy() // hours)[:-1])


def _projections(found: list[bytes] | None, hours: int) -> list[np.ndarray]:
    return [np.frombuffer(p, float).reshape(hours, hours) for p in found or []]


def _step(days: np.ndarray, known: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """One round: project, then put the known cells back."""
    return np.where(np.isnan(known), days @ projection, known)


def _figures(days: np.ndarray, known: np.ndarray, projections: list[np.ndarray]) -> tuple[np.ndarray, float, float, int, bool]:
    """(Gram matrix, squared change of the last round, squared size, days, whether cells are missing) after the rounds so far."""
    before = days
    for projection in projections:
        before, days = days, _step(days, known, projection)
    return days.T @ days, float(((days - before) ** 2).sum()), float((days**2).sum()), len(days), bool(np.isnan(days).any())


def _summed(hours: int):
    """The figures of each meter, added up over the blocks of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meters, found = batch.column(0).to_pylist(), batch.column(3)
            sums: dict[str, list] = {}
            rounds: dict[str, list[np.ndarray]] = {}
            for i, (meter, days, known) in enumerate(zip(meters, _matrices(batch.column(1), hours), _matrices(batch.column(2), hours))):
                if meter not in sums:
                    own = found[i].as_py()
                    rounds[meter] = _projections(own, hours)
                    sums[meter] = [np.zeros((hours, hours)), 0.0, 0.0, 0, False, own]
                own = sums[meter]
                for k, figure in enumerate(_figures(days, known, rounds[meter])):
                    own[k] = own[k] | figure if k == 4 else own[k] + figure
            columns = list(zip(*sums.values())) or [()] * 6
            arrays = [pa.array(sums, pa.string()), pa.array([g.tobytes() for g in columns[0]], pa.binary())]
            kinds = (pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.list_(pa.binary()))
            arrays += [pa.array(c, k) for c, k in zip(columns[1:], kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=[METER, "_gram", "_change", "_size", "_days", "_holes", "_found"])

    return run


def _next(hours: int, n_components: int, tolerance: float, turn: int):
    """The projections of one meter with the next one, if it still moves, from the sums of its last round."""

    def run(table: pa.Table) -> pa.Table:
        grams = [np.frombuffer(g, float) for g in table.column("_gram").to_pylist()]
        change, size, days = (sum(table.column(c).to_pylist()) for c in ("_change", "_size", "_days"))
        found = table.column("_found")[0].as_py() or []
        moving = days > 1 and not any(table.column("_holes").to_pylist())
        moving = moving and (turn < 2 or change**0.5 >= tolerance * size**0.5)
        if moving:
            rank = np.array([min(n_components, hours - 1, days - 1)])
            gram = np.sum(grams, axis=0).reshape(1, hours, hours)
            found = [*found, kernels.leading_projection(gram, rank)[0].tobytes()]
        columns = [table.column(METER).slice(0, 1), pa.array([found], pa.list_(pa.binary())), pa.array([moving])]
        return pa.Table.from_arrays(columns, names=[METER, "_found", "_moving"])

    return run


def _refined(hours: int):
    """Each block with its days after all rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            days, known = (_matrices(batch.column(c), hours) for c in ("_cells", "_known"))
            last, rounds = None, []
            for i, meter in enumerate(batch.column(METER).to_pylist()):
                if meter != last:
                    last, rounds = meter, _projections(batch.column("_found")[i].as_py(), hours)
                for projection in rounds:
                    days[i] = _step(days[i], known[i], projection)
            cells = pa.array(np.concatenate(days).ravel(), from_pandas=True)
            sizes = np.array([len(d) for d in days])
            lines = pa.ListArray.from_arrays(pa.array(np.arange(sizes.sum() + 1, dtype=np.int32) * hours), cells)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), lines)
            kept = [*BLOCK_KEYS, "_sizes", "_others"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [lists], names=[*kept, "_days"])

    return run


def refine_whole_table(
    df: DataFrame,
    known: str,
    n_components: int = 50,
    max_iterations: int = 10,
    tolerance: float = 1e-4,
    vec: str = VEC,
    hours: int | None = None,
) -> DataFrame:
    """Refine all rows as one matrix, for a table without meters.

    Each round brings one set of sums to the driver, the Gram matrix, and sends its
    projection back; the rows are settled once and stay where they are.
    """
    hours = day_width(df, vec, hours)
    start = settle(with_day(df, vec, fitting(vec, hours)))
    count = start.count()
    rank = min(n_components, min(count, hours) - 1)
    if rank < 1 or not start.filter(F.size(F.array_compact(vec)) < hours).isEmpty():
        return start
    cells = start.select(whole_day(vec, hours).alias("_cells"), whole_day(known, hours).alias("_known"))
    found: list[np.ndarray] = []
    for turn in range(max_iterations):
        sums = cells.mapInArrow(_table_sums(hours, list(found)), "at int, figure double")
        # as many rows as figures, whatever the size of the table
        figures = [r[1] for r in sums.groupBy("at").agg(F.sum("figure")).orderBy("at").collect()]
        change, size = figures[:2]
        if turn > 1 and change**0.5 < tolerance * size**0.5:
            break
        gram = np.array(figures[2:]).reshape(1, hours, hours)
        found.append(kernels.leading_projection(gram, np.array([rank]))[0])

    at = start.columns.index(vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            days, fixed = (_one_matrix(batch.column(c), hours) for c in (vec, "_fixed"))
            for projection in found:
                days = _step(days, fixed, projection)
            offsets = pa.array(np.arange(len(days) + 1, dtype=np.int32) * hours)
            arrays = list(batch.columns[:-1])
            arrays[at] = pa.ListArray.from_arrays(offsets, pa.array(days.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names[:-1])

    return start.withColumn("_fixed", whole_day(known, hours)).mapInArrow(run, start.schema)


def _one_matrix(column: pa.Array, hours: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, hours)


def _table_sums(hours: int, found: list[np.ndarray]):
    """Squared change, squared size and Gram matrix of a task's rows, one figure a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 + hours * hours)
        for batch in batches:
            gram, change, size, *_ = _figures(*(_one_matrix(c, hours) for c in batch.columns), found)
            sums += np.concatenate([[change, size], gram.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], names=["at", "figure"])

    return run
