"""Numeric work on whole blocks of a timeline, many blocks at a time in Arrow batches.

Rows arrive sorted by block and day; a block that a batch cuts waits for its rest.  All
functions work on the cells of many blocks laid end to end, NaN where a reading is missing.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])


def _changes(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Rows at which a new block begins, the first one included."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for key in keys:
        column = table.column(key).combine_chunks()
        differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
        new[1:] |= differs.to_numpy(zero_copy_only=False).astype(bool)
    return np.flatnonzero(new)


def whole_blocks(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], least: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, starts of their blocks): tables of at least ``least`` rows that end where a block ends."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = _changes(table, keys)
        cut = int(starts[-1])
        if cut:
            yield table.slice(0, cut), starts[:-1]
        rest = table.slice(cut)
        held, size = rest.to_batches(), rest.num_rows
        least = max(least, 2 * size)  # a long block is not put together again for every batch
    if size:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _changes(table, keys)


def cells(column: pa.ChunkedArray, hours: int) -> np.ndarray:
    """A column of days as a matrix, NaN where a reading is missing."""
    days = column.combine_chunks()
    if days.null_count or not (days.value_lengths().to_numpy() == hours).all():
        raise ValueError(f"every day must be an array of {hours} cells")
    return days.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(days), hours)


def as_days(matrix: np.ndarray) -> pa.Array:
    """A matrix as a column of days, null where it has NaN."""
    offsets = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel(), from_pandas=True))


def as_lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Lists of the given lengths from values laid end to end, null for NaN."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, from_pandas=True))


def means(padded: np.ndarray, width: int) -> np.ndarray:
    """Mean of the known cells in the window that begins at each cell but the last ``width - 1``; NaN without any.

    Sums over 2, 4, 8 ... cells make up the window, so no error of a long running sum comes in.
    """
    n = len(padded) - width + 1
    if n <= 0:
        return np.zeros(0)
    known = ~np.isnan(padded)

    def sums(level: np.ndarray) -> np.ndarray:
        total, taken, span = np.zeros(n), 0, 1
        while True:
            if width & span:
                total += level[taken : taken + n]
                taken += span
            if 2 * span > width:
                return total
            level = level[:-span] + level[span:]
            span *= 2

    total, count = sums(np.where(known, padded, 0.0)), sums(known.astype(float))
    return np.divide(total, count, out=np.full(n, np.nan), where=count > 0)


def running_top(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The largest value so far within each block; a block starts at each of ``starts``."""
    out = np.where(np.isnan(values), -np.inf, values)
    place = np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))
    step, longest = 1, int(place.max(initial=0))
    while step <= longest:
        inside = place[step:] >= step
        out[step:] = np.where(inside, np.maximum(out[step:], out[:-step]), out[step:])
        step *= 2
    return out


def block_ends(days: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(cells, heads, tails, lengths of both, greatest mean of a window inside) of each block."""
    hours = days.shape[1]
    flat = days.ravel()
    first = starts * hours
    size = np.diff(np.append(first, len(flat)))
    short = np.minimum(size, width - 1)
    own = np.repeat(np.arange(len(starts)), short)
    place = np.arange(len(own)) - np.repeat(np.cumsum(short) - short, short)
    heads = flat[first[own] + place]
    tails = flat[(first + size - short)[own] + place]
    inside = np.full(len(flat), -np.inf)
    mean = means(flat, width)
    inside[: len(mean)] = np.where(np.isnan(mean), -np.inf, mean)
    # a window that leaves its block is none of the inner ones
    left = np.arange(len(flat)) - np.repeat(first, size)
    inside[left > np.repeat(size, size) - width] = -np.inf
    return size, heads, tails, short, np.maximum.reduceat(inside, first) if len(first) else inside


def meter_margins(
    size: list[int], heads: list[list], tails: list[list], inside: list[float], before: int, after: int
) -> tuple[list, list, list, bool]:
    """(left margins, right margins, floors, whether the timeline is shorter than the window) of a meter's blocks in order.

    The floor of a block is the greatest mean of all windows centred in earlier blocks.
    """
    width = before + after + 1
    ends = [np.array([np.nan if x is None else x for x in t]) for t in tails]
    begins = [np.array([np.nan if x is None else x for x in h]) for h in heads]
    lefts, left = [], np.full(before, np.nan)
    for end in ends:
        lefts.append(left)
        left = np.concatenate([left, end])[len(end) :][-before:] if before else left
    rights, right = [], np.full(after, np.nan)
    for begin in reversed(begins):
        rights.append(right)
        right = np.concatenate([begin, right])[:after]
    rights.reverse()
    floors, floor = [], -np.inf
    for n, begin, end, left, right, top in zip(size, begins, ends, lefts, rights, inside):
        floors.append(floor)
        if n < width - 1:
            edges = means(np.concatenate([left, begin, right]), width)
        else:
            edges = np.concatenate([means(np.concatenate([left, begin]), width), means(np.concatenate([end, right]), width)])
        floor = max([floor, top, *edges[~np.isnan(edges)].tolist()])
    return lefts, rights, floors, sum(size) < width


def smoothed(
    days: np.ndarray, starts: np.ndarray, lefts: np.ndarray, rights: np.ndarray, floors: np.ndarray, monotone: bool
) -> np.ndarray:
    """Window means of all days of whole blocks with their margins, raised to be monotone if asked."""
    hours, before, after = days.shape[1], lefts.shape[1], rights.shape[1]
    width = before + after + 1
    sizes = np.diff(np.append(starts, len(days))) * hours
    number = np.arange(len(starts))
    first = starts * hours + number * (width - 1)  # of each block's left margin in the padded cells
    padded = np.empty(len(days) * hours + len(starts) * (width - 1))
    padded[(first[:, None] + np.arange(before)).ravel()] = lefts.ravel()
    padded[((first + before + sizes)[:, None] + np.arange(after)).ravel()] = rights.ravel()
    own = np.repeat(number, sizes)
    place = np.arange(len(own)) + own * (width - 1)  # the window of a cell begins where the cell would be without margins
    padded[place + before] = days.ravel()
    out = means(padded, width)[place]
    if monotone:
        top = np.maximum(running_top(out, starts * hours), np.repeat(floors, sizes))
        out = np.where(np.isnan(out), np.nan, top)
    return out.reshape(days.shape)
