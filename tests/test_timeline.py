"""Operators along the timeline, over months, outages and one dominant meter."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aquatally.operators import cleaning, comparison, consumption, filling, gaps, pairing, select, smoothing
from aquatally.operators.timeline import BLOCK, by_block, with_ordinal
from aquatally.plans import fast, scientific
from aquatally.schema import VEC
from aquatally.sources import derived
from tests.util import (
    between_days,
    exchanges,
    in_day,
    matrix_of,
    per_meter,
    plan,
    random_days,
    rolling_mean,
    running_max,
    same_days,
    to_days,
)


@pytest.fixture(scope="module")
def frame():
    return random_days()


@pytest.fixture(scope="module")
def days(spark, frame):
    return to_days(spark, frame).cache()


def flat(step):
    return lambda m: step(m.ravel()).reshape(m.shape)


def test_carry(days, frame):
    same_days(filling.carry_days(days), per_meter(frame, between_days))


def test_carry_whole_days(days, frame):
    expected = per_meter(frame, lambda m: between_days(in_day(m)))
    same_days(filling.carry_whole_days(filling.interpolate_day(days)), expected)


def test_clamp(days, frame):
    shuffled = frame.copy()
    shuffled["v"] = [np.roll(v, 7) for v in frame["v"]]
    same_days(filling.clamp_timeline(to_days(days.sparkSession, shuffled)), per_meter(shuffled, flat(running_max)))


def test_fast(days, frame):
    def steps(m):
        return np.array([running_max(r) for r in np.nan_to_num(between_days(in_day(m)))])

    same_days(fast.impute_fast(days), per_meter(frame, steps))


def test_ordinal(days, frame):
    rows = with_ordinal(days).select("id", "data", "_ordinal").collect()
    expected = frame.sort_values(["id", "data"]).groupby("id").cumcount()
    ranked = dict(zip(zip(frame.loc[expected.index, "id"], frame.loc[expected.index, "data"]), expected))
    assert {(r[0], r[1]): r[2] for r in rows} == ranked


@pytest.mark.parametrize("width", [5, 25, 49, 100])
def test_timeline_average(days, frame, width):
    def steps(m):
        return running_max(rolling_mean(m.ravel(), width)).reshape(m.shape)

    same_days(smoothing.smooth_timeline(days, width), per_meter(frame, steps))


def test_timeline_average_keeps_observed(days, frame):
    def steps(m):
        start = np.nan_to_num(between_days(in_day(m)))
        start = np.array([running_max(r) for r in start])
        smooth = running_max(rolling_mean(start.ravel(), 25)).reshape(m.shape)
        return np.where(np.isnan(m), smooth, m)

    filled = fast.impute_fast(days.withColumn("orig", F.col(VEC)))
    same_days(smoothing.smooth_timeline_keep_observed(filled, "orig"), per_meter(frame, steps))


def test_short_series_stay(spark):
    one = pd.DataFrame({"id": ["A"], "data": [pd.Timestamp("2024-01-01").date()], "v": [np.arange(24.0)[::-1]]})
    same_days(smoothing.smooth_timeline(to_days(spark, one), 25), one)


def test_drops(days, frame):
    shuffled = frame.copy()
    shuffled["v"] = [v if i % 3 else v * 0.8 for i, v in enumerate(frame["v"])]

    def steps(m):
        out = m.copy()
        for i in range(1, len(m)):
            before = m[i - 1]
            with np.errstate(invalid="ignore", divide="ignore"):
                ratio = np.where(before > 0, m[i] / before, 1.0)
                out[i][(m[i] < before) & (ratio > 0.1)] = np.nan
        return out

    same_days(cleaning.null_drops(to_days(days.sparkSession, shuffled)), per_meter(shuffled, steps))


def test_consumption(days, frame):
    def steps(m):
        cells = m.ravel()
        used = np.diff(cells, prepend=cells[0])
        used[used < 0] = 0
        return used.reshape(m.shape)

    same_days(consumption.meter_consumption(days), per_meter(frame, steps), "used")


def test_interpolation_along_the_timeline(days, frame):
    def steps(m):
        line = pd.Series(m.ravel()).interpolate(limit_direction="both")
        return line.to_numpy().reshape(m.shape)

    same_days(filling.interpolate_timeline(days), per_meter(frame, steps), tolerance=1e-6)


def test_timeline_gaps(days, frame):
    expected = set()
    for meter, part in frame.groupby("id"):
        part = part.sort_values("data")
        cells = np.isnan(np.vstack(part["v"]).ravel())
        hours = [pd.Timestamp(d) + pd.Timedelta(hours=h) for d in part["data"] for h in range(24)]
        start = None
        for i, missing in enumerate([*cells, False]):
            if missing and start is None:
                start = i
            elif not missing and start is not None:
                expected.add((meter, hours[start].to_pydatetime(), i - start, i == len(cells)))
                start = None
    rows = gaps.timeline_gaps(days).select("id", "gap_start", "gap_len", "is_trailing").collect()
    assert {tuple(r) for r in rows} == expected
    assert len(rows) == len(expected)


def runs_of(line):
    """(position, length, reaches the end) of the missing cells' runs."""
    out, start = [], None
    for i, missing in enumerate([*line, False]):
        if missing and start is None:
            start = i
        elif not missing and start is not None:
            out.append((start, i - start, i == len(line)))
            start = None
    return out


def test_gaps_over_whole_months_and_days_without_cells(spark):
    """Outages of months, meters that begin or end in one, days without an array or with an empty one."""
    rng = np.random.default_rng(11)
    rows, lines = [], {}
    for m in range(12):
        line, at = [], []
        for d in pd.date_range("2024-01-20", periods=130).date:
            kind = rng.random()
            cells = np.where(rng.random(4) < 0.3, None, 1.0).tolist()
            if m % 3 == 0 and d.month in (3, 4) or m % 4 == 1 and d.month in (1, 5) or m == 11:
                cells = [None] * 4
            if kind < 0.1:
                cells = [] if kind < 0.05 else None
            elif kind < 0.2:
                continue
            rows.append((f"M{m}", d, cells))
            for h, x in enumerate(cells or []):
                line.append(x is None)
                at.append(pd.Timestamp(d) + pd.Timedelta(hours=h))
        lines[f"M{m}"] = line, at
    rows.append((None, rows[0][1], [None]))
    table = spark.createDataFrame(rows, "id string, data date, v array<double>").repartition(5)
    want = {(m, at[s].to_pydatetime(), n, end) for m, (line, at) in lines.items() for s, n, end in runs_of(line)}
    got = [tuple(r) for r in gaps.timeline_gaps(table).select("id", "gap_start", "gap_len", "is_trailing").collect()]
    assert set(got) == want and len(got) == len(want)
    for r in gaps.stats_by_meter(table).collect():
        line = lines[r["id"]][0]
        sizes = [n for _, n, _ in runs_of(line)]
        assert (r["missing_count"], r["num_gaps"], r["max_gap_size"]) == (sum(line), len(sizes), max(sizes))
        assert r["avg_gap_size"] == pytest.approx(np.mean(sizes)) and r["median_gap_size"] == np.median(sizes)
        assert r["missing_pct"] == pytest.approx(100 * np.mean(line))
    large = {m for m, (line, _) in lines.items() if any(n > 72 and not end for _, n, end in runs_of(line))}
    routes = gaps.large_gap_blocks(table).collect()
    assert {r["id"] for r in routes if r["large"]} == large and len(large) > 2
    assert {r["id"] for r in routes if not r["large"]} == set(lines) - large
    assert gaps.timeline_gaps(table.limit(0)).count() == 0


def test_gap_summaries_merge(spark):
    """Runs move to their block, and one row per block to its meter: no piece of a run is moved again."""
    days = derived.days(spark, "/root/testdata/sf0.001").select("id", "data", "v")
    made = exchanges(days)[0]
    assert exchanges(gaps.timeline_gaps(days))[0] - made == 2
    assert exchanges(gaps.stats_by_meter(days))[0] - made == 2
    assert exchanges(gaps.gap_classes_by_meter(days))[0] - made == 2
    assert exchanges(gaps.gap_classes(days, along="timeline"))[0] - made == 3


def test_rows_meet_meters_by_parts(spark):
    """Half of the rows are of one meter, and no join deals them by the meter alone."""
    rows = [("A" if i % 2 else f"M{i % 40}", pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=i), [float(i), None]) for i in range(600)]
    table = spark.createDataFrame(rows, "id string, data date, v array<double>")
    chosen = spark.createDataFrame([("A",), ("M2",), ("M2",), (None,)], "id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = pairing.rows_of_meters(table, chosen)
        assert met.columns == table.columns
        assert met.count() == sum(r[0] in ("A", "M2") for r in rows)
        part = F.pmod(F.xxhash64("data"), F.lit(pairing.SPREAD))
        assert table.filter("id = 'A'").groupBy(part).count().agg(F.max("count")).first()[0] < 60
        for result in (met, comparison.quality_violations(table, table)):
            joins = [line for line in plan(result).split("\n") if "SortMergeJoin" in line]
            assert joins and all("_part" in line for line in joins)
        routed = scientific.impute_hybrid(table, force_lowrank=False)
        joins = [line for line in plan(routed).split("\n") if "SortMergeJoin" in line]
        # the low rank joins one row per block by meter; rows of days meet their route by block
        assert any("_block" in line for line in joins) and not any("LeftAnti" in x or "LeftSemi" in x for x in joins)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hybrid_keeps_rows_of_no_timeline(spark):
    table = spark.createDataFrame([(None, None, [5.0, None, 3.0]), ("A", None, [None, 2.0, 1.0])], "id string, data date, v array<double>")
    table = table.withColumn("data", F.col("data").cast("date"))
    rows = {r["id"]: r["v"] for r in scientific.impute_hybrid(table, force_lowrank=False).collect()}
    fast_rows = {r["id"]: r["v"] for r in fast.impute_fast(table).collect()}
    assert rows == fast_rows and len(rows) == 2


def test_every_nth_hour(days, frame):
    rows = select.every_nth_hour(days, 72).select("id", "data", "hour").collect()
    expected = set()
    for meter, part in frame.groupby("id"):
        part = part.sort_values("data")
        for at in range(0, len(part) * 24, 72):
            expected.add((meter, part["data"].iloc[at // 24], at % 24))
    assert {tuple(r) for r in rows} == expected


def test_dominant_meter_is_spread(days):
    """No task holds a dominant meter: its rows lie in as many groups as it has months."""
    groups = by_block(days).filter(F.col("id") == "M0").groupBy(BLOCK).count()
    assert groups.count() >= 9 and groups.agg(F.max("count")).first()[0] <= 31


def test_summaries_share_the_row_shuffle(spark):
    """The fast plan shuffles rows once; the carry's summary reads the same shuffle.

    Two more shuffles make the table, one moves the summary, one row per block.
    """
    days = derived.days(spark, "/root/testdata/sf0.001").select("id", "data", "v")
    assert exchanges(fast.impute_fast(days)) == (4, 1)


def test_smoothing_uses_the_spread_of_the_fill(spark):
    """After the fill one summary moves to its meter and back; no row is moved again."""
    days = derived.days(spark, "/root/testdata/sf0.001").select("id", "data", "v")
    for original in (None, "orig"):
        table = days.withColumn("orig", F.col("v"))
        new = exchanges(fast.impute_and_smooth(table, original=original))[0] - exchanges(fast.impute_fast(table))[0]
        assert new <= 2, (original, new)


@pytest.mark.parametrize("width", [1, 2, 25, 60, 200])
def test_chained_smoothing_equals_its_steps(spark, frame, width):
    """Blocks of one row, windows over several blocks, duplicate days' columns and missing cells."""
    thin = frame[[d.day in (1, 28) or i % 2 == 0 for i, d in enumerate(frame["data"])]].reset_index(drop=True)
    days = to_days(spark, thin).withColumn("calibre", F.lit(15))

    def steps(m):
        mean = rolling_mean(m.ravel(), width) if m.size >= width else m.ravel()
        top = running_max(mean).reshape(m.shape) if m.size >= width else m
        return np.where(np.isnan(mean.reshape(m.shape)), np.nan, top)

    got = smoothing.smooth_timeline(days, width)
    assert got.columns == days.columns
    same_days(got, per_meter(thin, steps))
    chained = fast.impute_and_smooth(days, width)
    filled = smoothing.smooth_timeline(fast.impute_fast(days), width)
    ours, theirs = matrix_of(chained), matrix_of(filled)
    assert ours[0] == theirs[0]
    np.testing.assert_allclose(ours[1], theirs[1])


def test_in_day_steps_do_not_shuffle(spark):
    days = derived.days(spark, "/root/testdata/sf0.001").select("id", "data", "v")
    made = exchanges(days)[0]
    for step in (
        filling.interpolate_day,
        filling.clamp_day,
        cleaning.null_spikes,
        smoothing.average_day,
        smoothing.fit_day,
        gaps.stats_by_day,
        gaps.day_gaps,
    ):
        assert exchanges(step(days)) == (made, 0), step.__name__


def test_scientific_clamps_and_keeps_columns(spark, days, frame):
    table = days.withColumn("calibre", F.lit(15))
    result = scientific.impute_scientific(table)
    assert result.columns == table.columns and result.count() == len(frame)
    keys, cells = matrix_of(result)
    meters = np.array([k[0] for k in keys])
    for meter in ("M0", "M1", "M2"):
        line = cells[meters == meter].ravel()
        assert not np.isnan(line).any() and (np.diff(line) >= 0).all()
    assert np.isnan(cells[meters == "M3"]).all()


def test_hybrid_routes_by_timeline_gaps(days):
    large = gaps.gap_classes_by_meter(days).filter("large_gaps > 0").select("id").collect()
    assert {r[0] for r in large} >= {"M1", "M2"}
    routed = scientific.impute_hybrid(days, force_lowrank=False)
    easy = {r[0] for r in days.select("id").distinct().collect()} - {r[0] for r in large}
    ours = matrix_of(routed.filter(F.col("id").isin(*easy)))
    theirs = matrix_of(fast.impute_fast(days).filter(F.col("id").isin(*easy)))
    assert ours[0] == theirs[0]
    np.testing.assert_allclose(ours[1], theirs[1])


def test_row_forms_equal_the_forms_of_two_tables(spark, frame):
    """Rows that carry both readings give what two tables paired by key give, gaps and lone rows included."""
    odd = spark.createDataFrame([(None, None), ("M9", None)], "id string, data date")
    width = len([c for c in frame.columns if c.startswith("h")]) or 24
    odd = odd.withColumn("v", F.array(*[F.lit(float(i)) for i in range(width)]))
    table = to_days(spark, frame).select("id", "data", "v").unionByName(odd).withColumn("orig", F.col("v"))
    filled = fast.impute_fast(table)

    def network(df):
        rows = df.select("ts", "orig_m3h", "imp_m3h", "diff_m3h").orderBy("ts").collect()
        return [r.ts for r in rows], np.array([r[1:] for r in rows], float)

    ours = network(consumption.compare_network_rows(filled, "orig"))
    theirs = network(consumption.compare_network(table, filled.drop("orig")))
    assert ours[0] == theirs[0] and len(ours[0]) > 0
    np.testing.assert_allclose(ours[1], theirs[1])

    chained = fast.impute_and_smooth(table, original="orig", filled="before")
    moved = comparison.smoothing_difference_rows(chained, "before").first()
    pair = comparison.smoothing_difference(filled, fast.impute_and_smooth(table, original="orig")).first()
    assert (moved.changed, moved.cells, moved.verdict) == (pair.changed, pair.cells, pair.verdict)
    assert moved.changed > 0
    np.testing.assert_allclose([moved[0], moved[1]], [pair[0], pair[1]])


def test_report_figures_come_from_one_aggregate(spark, days):
    one = gaps.totals_and_advice(days).first().asDict()
    apart = {**gaps.global_stats(days).first().asDict(), **gaps.recommendation(days, gaps.stats_by_day(days)).first().asDict()}
    assert one == apart
    nothing = gaps.totals_and_advice(days.limit(0)).first()
    assert nothing.total_meters == 0 and nothing.missing_pct is None and nothing.max_gap is None


def test_comparisons_shuffle_once_after_the_fill(spark):
    """Network means move by date, and what smoothing moved is one aggregate over the rows as they lie."""
    days = derived.days(spark, "/root/testdata/sf0.001").select("id", "data", "v").withColumn("orig", F.col("v"))
    filled = fast.impute_fast(days)
    assert exchanges(consumption.compare_network_rows(filled, "orig"))[0] == exchanges(filled)[0] + 1
    chained = fast.impute_and_smooth(days, original="orig", filled="before")
    assert exchanges(comparison.smoothing_difference_rows(chained, "before"))[0] <= exchanges(chained)[0] + 1
