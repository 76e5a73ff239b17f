"""Column functions over one day held as an array of hourly readings.

Each takes and returns a Column, so an in-day step costs no shuffle: it is a
projection over the row.  Null is the only missing marker.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = 62  # positions in one bit mask


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and name it inside ``body``.

    Spark re-evaluates whatever a lambda refers to for each element, so anything
    but a plain column has to be bound before a loop over the hours uses it.
    """
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def missing_count(v: Column) -> Column:
    return F.size(v) - F.size(F.array_compact(v))


def is_empty_day(v: Column) -> Column:
    return F.size(F.array_compact(v)) == 0


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position)


def _known_hours(cells: Column) -> Column:
    """Positions of the non-null cells of a bound array."""
    hours = F.sequence(F.lit(0), F.size(cells) - 1)
    return F.filter(hours, lambda i: F.get(cells, i).isNotNull())


def _with_neighbours(
    v: Column, fill: Callable[..., Column], left: tuple | None = None, right: tuple | None = None
) -> Column:
    """Replace each null by ``fill(hour, before, after)``.

    ``before`` and ``after`` are (position, value) of the nearest known cells, or
    ``left`` and ``right`` beyond the day.  The known positions are packed into bit masks
    of 62 cells each; the number of known cells ahead of an hour is then one ``bit_count``
    and what the masks before hold.
    """

    def over_cells(cells: Column) -> Column:
        def over_known(known: Column) -> Column:
            def mask(word: Column) -> Column:
                own = F.filter(known, lambda p: F.floor(p / _WORD) == word)
                bits = F.aggregate(own, F.lit(0).cast("bigint"), lambda m, p: m.bitwiseOR(_bit(p % _WORD)))
                return F.struct(bits.alias("bits"), F.size(F.filter(known, lambda p: p < word * _WORD)).alias("ahead"))

            masks = F.transform(F.sequence(F.lit(0), F.floor(F.size(cells) / _WORD).cast("int")), mask)

            def over_masks(masks: Column) -> Column:
                def cell(x: Column, hour: Column) -> Column:
                    word = F.get(masks, F.floor(hour / _WORD).cast("int"))
                    lower = _bit(hour % _WORD) - F.lit(1).cast("bigint")
                    ahead = word["ahead"] + F.bit_count(word["bits"].bitwiseAND(lower))
                    h0, h1 = F.get(known, ahead - 1), F.get(known, ahead)
                    before, after = (h0, F.get(cells, h0)), (h1, F.get(cells, h1))
                    if left is not None:
                        before = tuple(F.coalesce(a, b) for a, b in zip(before, left))
                    if right is not None:
                        after = tuple(F.coalesce(a, b) for a, b in zip(after, right))
                    return F.coalesce(x, fill(hour, before, after))

                return F.transform(cells, cell)

            full = F.size(known) == F.size(cells)
            return F.when(full, cells).otherwise(bind(masks, over_masks))

        return bind(_known_hours(cells), over_known)

    return bind(v, over_cells)


def _line(hour, before, after):
    (h0, v0), (h1, v1) = before, after
    return F.coalesce(v0 + (v1 - v0) * (hour - h0) / (h1 - h0), v0, v1)


def interpolate(v: Column) -> Column:
    """Linear in the hour between known cells; the nearest known cell outside them."""
    return _with_neighbours(v, _line)


def interpolate_between(v: Column, left: tuple[Column, Column], right: tuple[Column, Column]) -> Column:
    """As ``interpolate``, with the (position, value) of a known cell beyond either end."""
    return _with_neighbours(v, _line, left, right)


def fill_forward_back(v: Column) -> Column:
    """Last known cell of the day, or the next one at the start of the day."""
    return _with_neighbours(v, lambda hour, before, after: F.coalesce(before[1], after[1]))


def _no_cells(n: Column | int) -> Column:
    return F.array_repeat(F.lit(None).cast("double"), n)


def running_max(v: Column) -> Column:
    """Non-decreasing day: each cell raised to the largest cell so far; nulls stay.

    Most days already rise, which one native sort shows.  In the others every pass
    doubles the cells that a cell knows of, so there are as many passes as the width has
    binary digits.  Cells are fetched by position throughout, because ``slice`` copies
    the whole array each time.
    """

    def over_cells(cells: Column) -> Column:
        def widen(level: Column, turn: Column) -> Column:
            distance = F.call_function("shiftleft", F.lit(1), turn)
            return F.transform(level, lambda x, i: F.greatest(x, F.get(level, i - distance)))

        turns = F.sequence(F.lit(0), F.length(F.bin(F.size(cells).cast("bigint"))).cast("int") - 1)

        def known_only(top: Column, x: Column) -> Column:
            return F.when(x.isNotNull(), top)

        rises = bind(F.array_compact(cells), lambda known: F.sort_array(known) == known)
        return F.when(rises, cells).otherwise(F.zip_with(F.aggregate(turns, cells, widen), cells, known_only))

    return bind(v, over_cells)


def frame(width: int) -> tuple[int, int]:
    """Cells before and after the centre of a centred window; even windows lean back."""
    return width // 2, (width - 1) // 2


def _window_sums(cells: Column, width: int, n: Column) -> Column:
    """Sums of ``width`` neighbouring cells, for the first ``n`` starting cells.

    Sums over 2, 4, 8 ... cells come from the ones before; those in the binary form of
    the width make up the window, so no cell is added once per window.
    """

    def step(level: Column, span: int, parts: list[tuple[Column, int]], taken: int) -> Column:
        if width & span:
            parts, taken = [*parts, (level, taken)], taken + span
        if 2 * span > width:

            def total(i: Column) -> Column:
                terms = [F.get(part, i + at) for part, at in parts]
                out = terms[0]
                for term in terms[1:]:
                    out = out + term
                return out

            return F.transform(F.sequence(F.lit(0), n - 1), total)
        doubled = F.transform(level, lambda a, i: a + F.coalesce(F.get(level, i + span), F.lit(0.0)))
        return bind(doubled, lambda wider: step(wider, 2 * span, parts, taken))

    return bind(cells, lambda bound: step(bound, 1, [], 0))


def window_means(padded: Column, width: int) -> Column:
    """Mean of the known cells in each window of ``width`` cells, null where there are none.

    The array carries its margins: one window starts at each cell but the last
    ``width - 1``, and a null cell counts for nothing.
    """

    def over_cells(cells: Column) -> Column:
        n = F.size(cells) - (width - 1)
        sums = _window_sums(F.transform(cells, lambda x: F.coalesce(x, F.lit(0.0))), width, n)
        marks = F.transform(cells, lambda x: F.when(x.isNull(), F.lit(0.0)).otherwise(F.lit(1.0)))
        counts = _window_sums(marks, width, n)
        full = F.size(F.array_compact(cells)) == F.size(cells)
        by_width = F.transform(sums, lambda s: s / width)
        by_count = F.zip_with(sums, counts, lambda s, c: F.when(c > 0, s / c))
        return F.when(full, by_width).otherwise(by_count)

    return bind(padded, over_cells)


def moving_average(v: Column, width: int) -> Column:
    """Centred mean over ``width`` hours of the day, one known cell being enough."""
    before, after = frame(width)
    return window_means(F.concat(_no_cells(before), v, _no_cells(after)), width)


def median_of(values: Column) -> Column:
    """Median of the non-null elements of an array, null when there are none."""

    def over(known: Column) -> Column:
        n = F.size(known)
        low = F.get(known, F.floor((n - 1) / 2).cast("int"))
        high = F.get(known, F.floor(n / 2).cast("int"))
        return (low + high) / 2

    return bind(F.sort_array(F.array_compact(values)), over)


def zero_to_null(v: Column) -> Column:
    return F.transform(v, lambda x: F.nullif(x, F.lit(0.0)))


def drop_spikes(
    v: Column, width: int = 5, factor: float = 1.25, floor: float = 10.0
) -> Column:
    """Null a cell that exceeds ``factor`` times the centred median, when that exceeds ``floor``."""

    before, after = frame(width)

    def over_cells(cells: Column) -> Column:
        def judge(x: Column, hour: Column) -> Column:
            around = [F.get(cells, hour + k) for k in range(-before, after + 1)]

            def against(median: Column) -> Column:
                spike = (x > median * factor) & (median > floor)
                return F.when(~F.coalesce(spike, F.lit(False)), x)

            # no median is below the smallest cell, so most cells need no median at all
            return F.when(
                x > F.least(*around) * factor, bind(median_of(F.array(*around)), against)
            ).otherwise(x)

        return F.transform(cells, judge)

    return bind(v, over_cells)


def drop_decreases(v: Column, previous: Column, reset_ratio: float = 0.1) -> Column:
    """Null a cell below the same hour of the previous day, unless it fell so far
    (to ``reset_ratio`` or less) that the meter must have been reset."""

    def judge(x: Column, before: Column) -> Column:
        ratio = F.when(before > 0, x / before).otherwise(F.lit(1.0))
        invalid = (x < before) & (ratio > reset_ratio)
        return F.when(~F.coalesce(invalid, F.lit(False)), x)

    return F.when(previous.isNull(), v).otherwise(F.zip_with(v, previous, judge))


def clip_negative(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(x < 0, F.lit(0.0)).otherwise(x))


def nulls_to_zero(v: Column) -> Column:
    return F.transform(v, lambda x: F.coalesce(x, F.lit(0.0)))


def overlay(known: Column, fallback: Column) -> Column:
    """Known cells, with the fallback where they are null."""
    return F.zip_with(known, fallback, lambda k, f: F.coalesce(k, f))


def raise_to(v: Column, floor: Column) -> Column:
    """Raise every non-null cell to at least ``floor`` (a null floor changes nothing)."""
    return F.transform(v, lambda x: F.when(x.isNotNull(), F.greatest(x, floor)))


def steps(v: Column) -> Column:
    """Difference of each hour to the next one: one cell fewer, null beside a null."""
    return bind(
        v,
        lambda cells: F.transform(
            F.sequence(F.lit(0), F.size(cells) - 2), lambda i: F.get(cells, i + 1) - F.get(cells, i)
        ),
    )


def gap_runs(v: Column) -> Column:
    """Runs of nulls as ``array<struct<start,len,trailing>>``."""

    def over_cells(cells: Column) -> Column:
        n = F.size(cells)
        fence = F.concat(F.array(F.lit(-1)), _known_hours(cells), F.array(n))

        def over_fence(fence: Column) -> Column:
            spans = F.transform(
                F.slice(fence, F.lit(1), F.size(fence) - 1),
                lambda left, k: F.struct(
                    (left + 1).alias("start"),
                    (F.get(fence, k + 1) - left - 1).alias("len"),
                    (F.get(fence, k + 1) == n).alias("trailing"),
                ),
            )
            return F.filter(spans, lambda s: s["len"] > 0)

        return bind(fence, over_fence)

    return bind(v, over_cells)


def banded_map(v: Column, starts: Sequence[int], rows: Sequence[Sequence[float]]) -> Column:
    """Fixed linear map given by a band: cell i = rows[i] . v[starts[i] : starts[i]+len(rows[i])]."""
    band = F.array(
        *[
            F.struct(F.lit(int(s)).alias("s"), F.array(*[F.lit(float(w)) for w in r]).alias("w"))
            for s, r in zip(starts, rows)
        ]
    )

    def over_cells(cells: Column) -> Column:
        def dot(line: Column) -> Column:
            products = F.transform(line["w"], lambda w, j: w * F.get(cells, line["s"] + j))
            return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)

        return F.transform(band, dot)

    return bind(v, over_cells)
