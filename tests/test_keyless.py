"""Tables without a meter or date column: one series in an explicit row order."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aquatally.operators import filling, select
from aquatally.plans import fast, scientific
from tests.util import between_days, in_day, listed, running_max


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    m = np.round(100 + np.cumsum(rng.random((400, 24)), axis=0), 2)
    m[rng.random(m.shape) < 0.4] = np.nan
    m[:30] = np.nan
    m[100:180] = np.nan
    rows = [(i, r) for i, r in enumerate(listed(m))]
    return m, spark.createDataFrame(rows, "n int, v array<double>").repartition(7)


def matrix(df):
    rows = df.orderBy("n").collect()
    return np.array([[np.nan if x is None else x for x in r["v"]] for r in rows], dtype=float)


def test_carry_over_parts(table):
    m, df = table
    np.testing.assert_allclose(matrix(filling.carry_rows(df, ["n"], partitions=9)), between_days(m))


def test_previous_row(table):
    m, df = table
    ours = matrix(filling.with_previous_row(df, ["n"], "b", partitions=9).select("n", F.col("b").alias("v")).filter("n > 0"))
    np.testing.assert_allclose(ours, m[:-1])


def test_fast(table):
    m, df = table
    expected = np.array([running_max(r) for r in between_days(in_day(m))])
    np.testing.assert_allclose(matrix(fast.impute_fast_rows(df, ["n"])), expected)


def test_scientific(table):
    _, df = table
    out = matrix(scientific.impute_scientific_rows(df, ["n"]))
    assert out.shape == (400, 24) and not np.isnan(out).any() and (np.diff(out, axis=1) >= 0).all()


def test_needs_an_order(table):
    with pytest.raises(ValueError, match="row order"):
        filling.carry_rows(table[1], [])


def test_positions(spark):
    frame = pd.DataFrame({"id": ["A"] * 300 + ["B"] * 40, "k": list(range(300)) + list(range(40))})
    df = spark.createDataFrame(frame).repartition(6)
    rows = select.with_position(df, ["k"]).collect()
    assert all(r["position"] == r["k"] for r in rows) and len(rows) == 340
