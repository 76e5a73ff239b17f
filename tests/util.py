"""Small tables and plain pandas statements of what the operators should do."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

SCHEMA = "id string, data date, v array<double>"


def listed(matrix):
    return [[None if np.isnan(x) else float(x) for x in row] for row in matrix]


def to_days(spark, frame):
    """Frame with id, data and a matrix row per day as column v."""
    rows = list(zip(frame["id"], frame["data"], listed(np.vstack(frame["v"]))))
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def random_days(seed=0, meters=4, days=150, hours=24, null_share=0.3, empty_share=0.15, skip_share=0.05):
    """Meters over several months, with missing cells, empty days and absent dates.

    The first meter has a third of all rows or more.
    """
    rng = np.random.default_rng(seed)
    parts = []
    for m in range(meters):
        n = days * 2 if m == 0 else days
        dates = pd.date_range("2023-11-20", periods=n).date
        values = 100.0 * (m + 1) + np.cumsum(rng.random(n * hours)).reshape(n, hours)
        values = np.round(values, 2)
        values[rng.random(values.shape) < null_share] = np.nan
        values[rng.random(n) < empty_share] = np.nan
        if m == 1:
            values[:40] = np.nan  # starts with an outage longer than a month
        if m == 2:
            values[30:110] = np.nan  # an outage over whole months
        if m == 3:
            values[:] = np.nan
        keep = rng.random(n) >= skip_share
        parts.append(
            pd.DataFrame({"id": f"M{m}", "data": dates[keep], "v": list(values[keep])})
        )
    return pd.concat(parts, ignore_index=True)


def per_meter(frame, step):
    """Apply ``step`` to the matrix of each meter in date order."""
    out = []
    for _, part in frame.groupby("id"):
        part = part.sort_values("data").copy()
        part["v"] = list(step(np.vstack(part["v"])))
        out.append(part)
    return pd.concat(out, ignore_index=True)


def matrix_of(df, column="v"):
    """Keys and matrix of a Spark table of days, in key order."""
    rows = sorted(df.select("id", "data", column).collect(), key=lambda r: (r[0], r[1]))
    return [(r[0], r[1]) for r in rows], np.array(
        [[np.nan if x is None else x for x in r[2]] for r in rows], dtype=float
    )


def same_days(df, expected, column="v", tolerance=1e-9):
    keys, ours = matrix_of(df, column)
    frame = expected.sort_values(["id", "data"])
    assert keys == list(zip(frame["id"], frame["data"]))
    np.testing.assert_allclose(ours, np.vstack(frame["v"]), rtol=0, atol=tolerance)


def rolling_mean(flat, width):
    return pd.Series(flat).rolling(width, center=True, min_periods=1).mean().to_numpy()


def running_max(flat):
    top = np.fmax.accumulate(flat)
    return np.where(np.isnan(flat), np.nan, top)


def in_day(matrix):
    return pd.DataFrame(matrix).interpolate(axis=1, limit_direction="both").to_numpy()


def between_days(matrix):
    return pd.DataFrame(matrix).ffill().bfill().to_numpy()


def plan(df):
    """Physical plan before execution, one operator per line."""
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    """Shuffles of a plan as it runs, without those that reuse another."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    text = plan(df).split("== Initial Plan ==")[0]
    lines = [line.lstrip(" :+-*()0123456789") for line in text.split("\n")]
    return sum(line.startswith("Exchange ") for line in lines), sum(
        line.startswith("ReusedExchange") for line in lines
    )


def total(df, column):
    return df.agg(F.sum(column)).first()[0]
