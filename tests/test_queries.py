"""Every registered query runs, and equals its SQL where it has some."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from aquatally.operators import lowrank, smoothing
from check import database, difference

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def db():
    return database(SF)


def test_names():
    assert set(SQL) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 30 * 23


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name):
    result = queries()[name](spark, SF)
    if name in SQL:
        assert difference(result, db, SQL[name]) is None
    else:
        assert result.count() > 0


@pytest.mark.parametrize(
    "name",
    [
        "refine_rank_one", "refine_rank_three", "refine_whole_rank_one", "impute_scientific_rank_one",
        "impute_scientific_fitted", "impute_scientific_rows_rank_one", "impute_hybrid_by_gaps",
    ],
)
def test_no_refinement_is_noticed(spark, db, monkeypatch, name):
    """These oracles fail if the refinement does nothing."""
    monkeypatch.setattr(lowrank, "refine_by_meter", lambda df, *args, **options: df)
    monkeypatch.setattr(lowrank, "refine_whole_table", lambda df, *args, **options: df)
    if name == "impute_hybrid_by_gaps":  # no meter of the smallest table has a large gap
        db, table = database("/root/testdata/sf0.01"), "/root/testdata/sf0.01"
    else:
        table = SF
    assert difference(queries()[name](spark, table), db, SQL[name]) is not None


@pytest.mark.parametrize("rank", [2, 4])
def test_another_rank_is_noticed(spark, db, monkeypatch, rank):
    whole = lowrank.refine_by_meter
    monkeypatch.setattr(lowrank, "refine_by_meter", lambda df, known, n, *args, **options: whole(df, known, rank, *args, **options))
    assert difference(queries()["refine_rank_three"](spark, SF), db, SQL["refine_rank_three"]) is not None


@pytest.mark.parametrize("name", ["spline_day", "smooth_imputed_spline"])
def test_another_spline_is_noticed(spark, db, monkeypatch, name):
    whole = smoothing.spline_day
    monkeypatch.setattr(smoothing, "spline_day", lambda df, *args, **options: whole(df, *args, slack=0.2, **options))
    assert difference(queries()[name](spark, SF), db, SQL[name]) is not None


@pytest.mark.parametrize("method", ["moving_avg", "spline"])
def test_another_smoothing_is_noticed(spark, db, monkeypatch, method):
    whole = smoothing.smooth_imputed
    monkeypatch.setattr(smoothing, "smooth_imputed", lambda df, original, _, *args: whole(df, original, method, *args))
    assert difference(queries()["impute_scientific_fitted"](spark, SF), db, SQL["impute_scientific_fitted"]) is not None
