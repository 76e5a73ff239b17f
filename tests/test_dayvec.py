"""In-day column functions against pandas and numpy, on random days."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aquatally.functions import dayvec, kernels
from tests.util import in_day, listed, rolling_mean, running_max


def days(seed, hours):
    rng = np.random.default_rng(seed)
    m = np.round(rng.random((250, hours)) * 50, 2)
    share = rng.random((250, 1))
    m[rng.random(m.shape) < share] = np.nan
    m[0], m[1] = np.nan, np.arange(hours)
    return m


def apply(spark, matrix, expression):
    rows = [(i, row) for i, row in enumerate(listed(matrix))]
    df = spark.createDataFrame(rows, "i int, v array<double>")
    out = df.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()
    return np.array([[np.nan if x is None else x for x in row["r"]] for row in out], dtype=float)


@pytest.mark.parametrize("hours", [24, 10, 62, 63, 96, 288])
def test_against_pandas(spark, hours):
    m = days(hours, hours)
    frame = pd.DataFrame(m)
    cases = {
        "interpolate": (dayvec.interpolate, in_day(m)),
        "fill": (dayvec.fill_forward_back, frame.ffill(axis=1).bfill(axis=1).to_numpy()),
        "running_max": (dayvec.running_max, np.array([running_max(r) for r in m])),
        "steps": (dayvec.steps, np.diff(m, axis=1)),
    }
    for width in (1, 2, 5, 11, 24, 25):
        expected = np.array([rolling_mean(r, width) for r in m])
        cases[f"average {width}"] = (lambda v, w=width: dayvec.moving_average(v, w), expected)
    median = np.array([pd.Series(r).rolling(5, center=True, min_periods=1).median() for r in m])
    spiked = np.where((m > 1.25 * median) & (median > 10), np.nan, m)
    cases["spikes"] = (lambda v: dayvec.drop_spikes(v), spiked)
    for name, (function, expected) in cases.items():
        ours = apply(spark, m, function)
        np.testing.assert_allclose(ours, expected, rtol=0, atol=1e-9, err_msg=name)


def test_gap_runs(spark):
    m = days(3, 24)
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(listed(m))], "i int, v array<double>")
    out = rows.select("i", dayvec.gap_runs(F.col("v")).alias("g")).orderBy("i").collect()
    for row, cells in zip(out, m):
        expected, start = [], None
        for hour, missing in enumerate([*np.isnan(cells), False]):
            if missing and start is None:
                start = hour
            elif not missing and start is not None:
                expected.append((start, hour - start, hour == 24))
                start = None
        assert [tuple(g) for g in row["g"]] == expected


def test_drops_and_zeros(spark):
    rows = [([5.0, 8.0, 0.4, None, 0.0], [6.0, 8.0, 9.0, 3.0, -1.0])]
    df = spark.createDataFrame(rows, "v array<double>, p array<double>")
    kept = df.select(dayvec.drop_decreases(F.col("v"), F.col("p"))).first()[0]
    assert kept == [None, 8.0, 0.4, None, 0.0]
    assert df.select(dayvec.zero_to_null(F.col("v"))).first()[0] == [5.0, 8.0, 0.4, None, None]


def test_staircase_fit(spark):
    """Ten hours, window 5: only the cells of the gaps change."""
    steps = [1050.0, 1050.0, 1050.0, 1055.0, 1055.0, 1060.0, 1060.0, 1065.0, 1065.0, 1070.0]
    ours = apply(spark, np.array([steps]), lambda v: dayvec.banded_map(v, *kernels.polynomial_band(10, 5)))[0]
    np.testing.assert_allclose(
        ours[[2, 3, 6, 7, 8]], [1051.285714, 1053.285714, 1061.714286, 1063.285714, 1066.142857], atol=1e-6
    )


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=4, max_size=4), st.sampled_from([5, 7, 11, 23]))
def test_fit_reproduces_cubics(coefficients, width):
    x = np.arange(24) / 24
    y = np.polyval(coefficients, x)
    starts, rows = kernels.polynomial_band(24, width)
    fitted = [np.dot(r, y[s : s + width]) for s, r in zip(starts, rows)]
    np.testing.assert_allclose(fitted, y, atol=1e-8)


def curvature(y):
    """Integral of the squared second derivative of the natural cubic spline through y.

    Its second derivative is linear between the knots, 0 at both ends, and solves
    m[k-1] + 4 m[k] + m[k+1] = 6 (y[k-1] - 2 y[k] + y[k+1]).
    """
    n = len(y) - 2
    system = 4 * np.eye(n) + np.eye(n, k=1) + np.eye(n, k=-1)
    m = np.concatenate([[0.0], np.linalg.solve(system, 6 * np.diff(y, 2)), [0.0]])
    return ((m[:-1] ** 2 + m[:-1] * m[1:] + m[1:] ** 2) / 3).sum()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(0, 100), min_size=24, max_size=24))
def test_spline_keeps_to_its_residual(values):
    """Within the residual, and bending no more than any mix of the data and its fitted
    line that is within it too."""
    y = np.array(values)
    smooth = kernels.smooth_spline(y[None, :], 2.4)[0]
    assert ((smooth - y) ** 2).sum() <= 2.4 * (1 + 1e-6)
    x = np.arange(24)
    line = np.polyval(np.polyfit(x, y, 1), x)
    away = ((line - y) ** 2).sum()
    share = 1.0 if away <= 2.4 else np.sqrt(2.4 / away)
    rival = y + share * (line - y)
    assert curvature(smooth) <= curvature(rival) * (1 + 1e-6) + 1e-6


def test_spline_keeps_lines():
    line = 3.0 + 2.0 * np.arange(24)[None, :]
    np.testing.assert_allclose(kernels.smooth_spline(line, 2.4), line, atol=1e-8)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000))
def test_running_max_is_idempotent(seed):
    flat = np.random.default_rng(seed).random(24)
    once = running_max(flat)
    assert (once >= flat).all() and (running_max(once) == once).all()
