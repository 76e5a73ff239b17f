"""Periodic runs of words in documents, from minimizers at several scales and short lag scans."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aquatally.llm.util import add_columns, as_bytes

SHORT = 16  # periods below are found by comparing every word with the one a lag before it
RUNS = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def minimizers(grams: np.ndarray, window: int) -> np.ndarray:
    """Places that hold the least value, the first of equal ones, of some ``window`` (a power of two) neighbours."""
    place, reach = np.arange(len(grams)), 1
    while reach < window:
        left, right = place[:-reach], place[reach:]
        place = np.where(grams[right] < grams[left], right, left)
        reach *= 2
    return place[np.concatenate(([True], place[1:] != place[:-1]))]


def _seeds(grams: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of pairs of equal minimizers ``2 window`` to ``4 window`` apart.

    Within a run of a period in that range the chosen places repeat at period distance.  A
    gram that overlaps itself by half is in a chain, and chains are stood for by their starts,
    which repeat as well and are more than half a window apart: a start has few partners.
    """
    places = minimizers(grams, window)
    order = places[np.argsort(grams[places], kind="stable")]
    value = grams[order]
    head = np.ones(len(order), bool)
    head[1:] = (value[1:] != value[:-1]) | (order[1:] - order[:-1] > window // 2)
    order, value = order[head], value[head]
    at, lags = [], []
    for step in range(1, 9):
        if step >= len(order):
            break
        lag = order[step:] - order[:-step]
        good = (value[step:] == value[:-step]) & (lag >= 2 * window) & (lag < 4 * window)
        at.append(order[:-step][good])
        lags.append(lag[good])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(at), np.concatenate(lags)


def _reach(own: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The stretch of places around ``at`` that equal the place ``lag`` behind them."""
    n = len(own) - lag
    end, step = at, 64
    while end < n:
        part = own[end : min(n, end + step)] == own[end + lag : min(n, end + step) + lag]
        if not part.all():
            end += int(part.argmin())
            break
        end += len(part)
        step *= 2
    start, step = at, 64
    while start > 0:
        low = max(0, start - step)
        part = (own[low:start] == own[low + lag : start + lag])[::-1]
        if not part.all():
            start -= int(part.argmin())
            break
        start = low
        step *= 2
    return start, end


def find_runs(own: np.ndarray, longest: int, min_length: int = 6, repeats: int = 4) -> np.ndarray:
    """Rows (start, length, period) of the maximal runs in numbers ``own``, by start.

    ``longest`` is the length of the longest document in ``own``: documents must share no number.
    """
    found: list[np.ndarray] = []
    top = longest // repeats  # no longer period repeats often enough
    for lag in range(1, min(SHORT - 1, top) + 1):
        start, end = _stretches(own[lag:] == own[:-lag])
        long = end - start + lag >= max(min_length, repeats * lag)
        if long.any():
            found.append(np.stack([start[long], (end - start + lag)[long], np.full(long.sum(), lag)], axis=1))
    if top >= SHORT:
        grams, width = _mixed(own.astype(np.uint64)), 1
        while 2 * width <= top:
            if 2 * width >= SHORT:
                found.extend(_at_scale(own, grams, width, min_length, repeats))
            grams = _mixed(grams[:-width] * np.uint64(0x9E3779B97F4A7C15) + grams[width:])
            width *= 2
    if not found:
        return np.zeros((0, 3), np.int64)
    runs = np.concatenate(found)
    # a stretch found at a multiple of its period is the same stretch
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    same = (runs[1:, 0] == runs[:-1, 0]) & (runs[1:, 1] == runs[:-1, 1])
    runs = runs[np.concatenate(([True], ~same))]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _at_scale(own: np.ndarray, grams: np.ndarray, width: int, min_length: int, repeats: int) -> list[np.ndarray]:
    if len(grams) < width:
        return []
    at, lags = _seeds(grams, width)
    found, order = [], np.lexsort((at, lags))
    last, done = -1, -1
    for i in order.tolist():
        place, lag = int(at[i]), int(lags[i])
        if lag == last and place < done:
            continue  # inside the stretch that the seed before gave
        start, end = _reach(own, place, lag)
        last, done = lag, end
        if end - start + lag >= max(min_length, repeats * lag):
            found.append(np.array([[start, end - start + lag, lag]], np.int64))
    return found


def _numbered(words: Sequence[bytes], first: int) -> np.ndarray:
    """Equal words get equal numbers, from ``first`` on."""
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(w, first + len(numbers)) for w in words], np.int64)


def with_runs(df: DataFrame, text_col: str = "text", min_length: int = 6, repeats: int = 4) -> DataFrame:
    """``df`` with n_words, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    Words are cut at ASCII white space and numbered from 0.  A run is a stretch with smallest
    period q, of ``min_length`` words and ``repeats`` periods at least (four or more), that no
    neighbouring word extends.  Short periods are found by scans at each lag; longer ones by minimizers of
    grams of 8, 16, 32 ... words, each scale for the periods of twice to four times its width.
    Seeds only propose: words decide.  ``collapsed`` joins by one space the words that no
    run holds behind its first period.

    Null or empty text has no words, no runs and an empty ``collapsed``.  Rows are judged one by
    one: repeated rows and rows without an id are like any other.  Columns with the new
    names are replaced, others pass unchanged.  An empty table gives no rows.
    """

    if repeats < 4:
        raise ValueError("seeds cover runs of four periods or more")

    def step(texts: pa.Array) -> Sequence:
        words: list[list[bytes]] = [(t or b"").split() for t in as_bytes(texts)]
        numbers, first = [], 0
        for one in words:
            numbers.append(_numbered(one, first))
            first += len(one)
        sizes = np.array([len(x) for x in words], np.int64)
        own = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        runs = find_runs(own, int(sizes.max(initial=0)), min_length, repeats)
        begins = np.concatenate(([0], np.cumsum(sizes)))
        doc = np.searchsorted(begins, runs[:, 0], "right") - 1
        edge = np.zeros(len(own) + 1, np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
        gone = np.cumsum(edge) > 0
        offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(words))))).astype(np.int32)
        columns = [runs[:, 0] - begins[doc], runs[:, 1], runs[:, 2]]
        listed = pa.ListArray.from_arrays(
            pa.array(offsets), pa.StructArray.from_arrays([pa.array(c) for c in columns], ["start", "length", "period"])
        )
        held = np.flatnonzero(np.bincount(doc, minlength=len(words)))
        left = [b" ".join(w) for w in words]
        for i in held.tolist():
            drop = gone[begins[i] : begins[i + 1]].tolist()
            left[i] = b" ".join([w for w, d in zip(words[i], drop) if not d])
        return sizes, listed, pa.array(left, pa.binary()).cast(pa.string())

    return add_columns(df, [text_col], RUNS, step)


def collapse_runs(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``df`` with the text of each row that holds a run replaced by its collapsed words."""
    renamed = df.toDF(*[f"own{i}" for i in range(len(df.columns))])
    own = f"own{df.columns.index(text_col)}"
    out = with_runs(renamed, own, **options)
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col(own)).alias(own)
    return out.select(*[text if c == own else c for c in renamed.columns]).toDF(*df.columns)
