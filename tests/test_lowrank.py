"""Low-rank refinement: the numpy statement of it, and rows spread over tasks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aquatally.functions import kernels
from aquatally.operators import filling, lowrank
from tests.util import between_days, in_day, matrix_of, per_meter, to_days


def low_rank_days(seed=1, meters=3, days=90, rank=3):
    rng = np.random.default_rng(seed)
    parts = []
    for m in range(meters):
        full = 50 + rng.random((days, rank)) @ rng.random((rank, 24)) * 10
        holes = rng.random(full.shape) < 0.25
        dates = pd.date_range("2024-01-10", periods=days).date
        parts.append(
            pd.DataFrame(
                {"id": f"M{m}", "data": dates, "v": list(np.where(holes, np.nan, full)), "full": list(full)}
            )
        )
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def frame():
    return low_rank_days()


def refined(frame, n, iterations, tolerance):
    def step(m):
        start = between_days(in_day(m))
        current, previous = start.copy(), None
        rank = min(n, min(m.shape) - 1)
        for _ in range(iterations):
            u, s, vt = np.linalg.svd(current, full_matrices=False)
            s[rank:] = 0
            current = np.where(np.isnan(m), (u * s) @ vt, m)
            if previous is not None:
                if np.linalg.norm(current - previous) / np.linalg.norm(current) < tolerance:
                    break
            previous = current
        return current

    return per_meter(frame, step)


@pytest.mark.parametrize("tolerance", [0.0, 1e-4])
def test_matches_numpy(spark, frame, tolerance):
    days = to_days(spark, frame)
    start = filling.carry_days(filling.interpolate_day(days.withColumn("known", F.col("v"))))
    ours = lowrank.refine_by_meter(start, "known", 4, 4, tolerance)
    keys, cells = matrix_of(ours)
    expected = refined(frame, 4, 4, tolerance).sort_values(["id", "data"])
    assert keys == list(zip(expected["id"], expected["data"]))
    np.testing.assert_allclose(cells, np.vstack(expected["v"]), atol=1e-5)


def test_lowers_the_error(frame):
    for _, part in frame.groupby("id"):
        m, full = np.vstack(part["v"]), np.vstack(part["full"])
        start = between_days(in_day(m))
        out = kernels.refine_low_rank(start, ~np.isnan(m), 4, 10, 0.0)
        assert np.linalg.norm(out - full) < np.linalg.norm(start - full)


def test_one_day_and_empty_meters_stay():
    one = np.arange(24.0)[None, :]
    assert kernels.refine_low_rank(one, one > 3, 20, 3, 1e-4) is one
    empty = np.full((5, 24), np.nan)
    assert kernels.refine_low_rank(empty, ~np.isnan(empty), 20, 3, 1e-4) is empty


def test_whole_table(spark, frame):
    days = to_days(spark, frame)
    start = filling.carry_days(filling.interpolate_day(days.withColumn("known", F.col("v"))))
    keys, before = matrix_of(start)
    known = ~np.isnan(matrix_of(start, "known")[1])
    expected = kernels.refine_low_rank(before, known, 4, 3, 1e-4)
    ours = matrix_of(lowrank.refine_whole_table(start, "known", 4, 3, 1e-4))
    assert ours[0] == keys
    np.testing.assert_allclose(ours[1], expected, atol=1e-5)


@pytest.mark.parametrize("hours", [10, 96])
def test_any_width_short_meters_and_holes(spark, hours):
    rng = np.random.default_rng(3)
    parts = []
    for name, days in (("one", 1), ("two", 2), ("few", 9), ("many", 70), ("hole", 5)):
        full = 50 + np.cumsum(rng.random((days, hours)), axis=1)
        full[rng.random(full.shape) < 0.2] = np.nan
        dates = pd.date_range("2024-01-10", periods=days).date
        parts.append(pd.DataFrame({"id": name, "data": dates, "v": list(full)}))
    table = pd.concat(parts, ignore_index=True)
    days = to_days(spark, table).withColumn("known", F.col("v"))
    start = filling.zero_fill(filling.interpolate_day(days))
    start = start.withColumn("v", F.when(F.col("id") == "hole", F.transform("v", lambda x, i: F.when(i > 0, x))).otherwise(F.col("v")))
    keys, before = matrix_of(start)
    known = ~np.isnan(matrix_of(start, "known")[1])
    ours = matrix_of(lowrank.refine_by_meter(start, "known", 4, 3, 0.0))[1]
    for name in ("one", "two", "few", "many", "hole"):
        rows = [i for i, k in enumerate(keys) if k[0] == name]
        want = kernels.refine_low_rank(before[rows], known[rows], 4, 3, 0.0)
        np.testing.assert_allclose(ours[rows], want, atol=1e-5)
