"""Days of any width, rows without a day, and days that are there twice."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aquatally.operators import comparison, consumption, filling, pairing, reshape, smoothing
from aquatally.plans import fast, scientific
from aquatally.schema import day_width
from aquatally.sources import readings, sinks
from tests.util import between_days, in_day, matrix_of, per_meter, random_days, rolling_mean, running_max, same_days, to_days

WIDTHS = [10, 62, 96]


@pytest.mark.parametrize("hours", WIDTHS)
def test_timeline_steps(spark, hours):
    frame = random_days(seed=hours, meters=3, days=40, hours=hours)
    days = to_days(spark, frame)
    same_days(filling.carry_days(days), per_meter(frame, between_days))
    filled = per_meter(frame, lambda m: np.array([running_max(r) for r in np.nan_to_num(between_days(in_day(m)))]))
    same_days(fast.impute_fast(days), filled)
    smooth = per_meter(frame, lambda m: running_max(rolling_mean(m.ravel(), 25)).reshape(m.shape))
    same_days(smoothing.smooth_timeline(days, 25), smooth)
    steps = np.diff(np.vstack(frame["v"]), axis=1)
    mean = pd.DataFrame(np.where(steps >= 0, steps, np.nan)).groupby(frame["data"].to_numpy()).mean().fillna(0.0)
    got = {(r["data"], r["hour"]): r["mean_m3h"] for r in consumption.network_mean(days).collect()}
    assert len(got) == mean.size
    assert all(abs(got[d, h] - mean.loc[d, h]) < 1e-6 for d in mean.index for h in mean.columns)


@pytest.mark.parametrize("hours", WIDTHS)
def test_round_trips(spark, tmp_path, hours):
    frame = random_days(seed=hours, meters=2, days=12, hours=hours)
    days = to_days(spark, frame)
    sinks.write_readings(days, str(tmp_path / "t"))
    back = readings.read_days(spark, str(tmp_path / "t"), "parquet").drop("month")
    assert day_width(back) == hours
    same_days(back, frame)
    wide = reshape.to_wide(reshape.to_long(days))
    same_days(reshape.pack(wide), frame)
    sinks.write_readings(days.withColumn("contact_id", F.lit("c")).withColumn("calibre", F.lit(15)).select("id", "data", "contact_id", "calibre", "v"), str(tmp_path / "c"), "csv")
    same_days(readings.read_days(spark, str(tmp_path / "c")), frame)


def test_width_stays_known_and_longer_days_fail(spark):
    days = to_days(spark, random_days(meters=1, days=5))
    packed = reshape.pack(reshape.unpack(days))
    for step in (filling.interpolate_day, filling.carry_days, fast.impute_fast, filling.clamp_day):
        assert step(packed).schema["v"].metadata == {"hours": 24}
    with pytest.raises(Exception, match="more than 10 cells"):
        reshape.unpack(days, hours=10).collect()


@pytest.fixture(scope="module")
def odd(spark):
    """A meter with a day three times, rows without a day and rows without a meter."""
    day = datetime.date(2024, 1, 5)
    cells = [None if i % 5 == 2 else 100.0 + i for i in range(24)]
    rows = [("A", day, "x", cells)] * 3 + [("A", day + datetime.timedelta(days=k), "y", cells) for k in range(1, 60)]
    rows += [("A", None, "z", cells), (None, day, "z", cells), (None, None, None, cells), ("B", None, "z", [None] * 24)]
    return spark.createDataFrame(rows, "id string, data date, contact_id string, v array<double>").repartition(3)


@pytest.mark.parametrize("step", [fast.impute_fast, scientific.impute_scientific])
def test_no_row_is_lost_or_multiplied(odd, step):
    out = step(odd)
    assert out.columns == odd.columns
    before, after = ([(str(r["id"]), str(r["data"]), str(r["contact_id"])) for r in df.collect()] for df in (odd, out))
    assert sorted(before) == sorted(after)
    loose = [r["v"] for r in out.where("data is null and id = 'A'").collect()]
    assert loose == [[100.0 + i for i in range(24)]]


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert comparison.workload(none).first()["rows_per_meter"] is None
    assert fast.impute_fast(none).count() == 0
    assert pairing.meters_in_both(odd, odd).count() == 2


def test_constant_series_has_no_density(spark):
    series = spark.createDataFrame([(1.0,), (1.0,)], "a double")
    rows = consumption.density(series, ["a"], 3).collect()
    assert len(rows) == 3 and all(r["density"] is None for r in rows)
