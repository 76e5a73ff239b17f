"""Scans, sinks, schema rules and the derived tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from aquatally import schema
from aquatally.operators import pairing, reshape, select
from aquatally.plans import fast, reports
from aquatally.sources import derived, readings, sinks
from tests.util import plan

ROOT = "/root/testdata"

# Counts of the derived tables per scale.
COUNTS = {
    "0.001": (60, 707, 6, 44, 10),
    "0.01": (450, 4853, 85, 293, 72),
    "0.1": (4500, 48168, 863, 2913, 724),
}


def test_value_columns_in_hour_order():
    assert schema.value_columns(["id", "index_10", "index_9", "index_8"]) == ["index_8", "index_9", "index_10"]
    for wrong in (["index_0", "index_x"], ["index_2", "index_10"], ["index_1", "index_01"]):
        with pytest.raises(ValueError):
            schema.value_columns(["id", *wrong])
    with pytest.raises(ValueError):
        schema.value_columns(["id", "data"])


@pytest.mark.parametrize("sf", list(COUNTS))
def test_derived_counts(spark, sf):
    days = derived.days(spark, f"{ROOT}/sf{sf}")
    known = F.size(F.array_compact("v"))
    row = days.agg(
        F.count("*"),
        F.sum(24 - known),
        F.count_if(known == 0),
        F.count_if((known > 0) & (known < 24)),
        F.count_if(known == 24),
    ).first()
    rows, missing, *rest = COUNTS[sf]
    assert (row[0], *row[2:]) == (rows, *rest)
    assert abs(row[1] / (rows * 24) - missing / (rows * 24)) < 5e-4


def test_calendar_comes_from_the_events(spark, tmp_path):
    rows = [(u, f"2023-11-{1 + u % 3:02d} 05:00:00", 1.0) for u in range(20)] + [(3, "2024-01-09 23:00:00", 2.0), (15, "2023-12-25 00:00:00", 3.0)]
    events = spark.createDataFrame(rows, "user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    days = derived.days(spark, str(tmp_path))
    keys = [(r["id"], str(r["data"])) for r in days.collect()]
    assert len(keys) == len(set(keys)) == 2 * 70
    assert min(k[1] for k in keys) == "2023-11-01" and max(k[1] for k in keys) == "2024-01-09"


def test_csv_blank_and_nan(spark, tmp_path):
    names = [f.name for f in schema.readings_schema(24).fields]
    values = ["NaN", "", "3.5"] + ["1"] * 21
    (tmp_path / "r.csv").write_text(",".join(names) + "\nA,2024-01-01,c,15," + ",".join(values) + "\n")
    row = readings.read_days(spark, str(tmp_path / "r.csv")).first()
    assert row["v"][:3] == [None, None, 3.5]


def test_missing_key_column_fails(spark, tmp_path):
    spark.createDataFrame([("A", 1.0)], "id string, index_0 double").write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="data"):
        readings.read_readings(spark, str(tmp_path / "t"), "parquet")


def test_months_are_pruned_and_filters_pushed(spark, tmp_path):
    days = derived.days(spark, f"{ROOT}/sf0.001")
    path = str(tmp_path / "months")
    sinks.write_readings(days, path)
    assert os.path.isdir(f"{path}/month=2024-01")
    back = readings.read_readings(spark, path, "parquet").filter("month = '2024-01' and id = 'M00001'")
    text = plan(reshape.to_long(reshape.pack(back.select("id", "data", "index_0", "index_1"))))
    assert "PartitionFilters: [isnotnull(month" in text and "EqualTo(id,M00001)" in text
    assert "index_5" not in text


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    days = derived.days(spark, f"{ROOT}/sf0.001")
    path = str(tmp_path / "kept")
    sinks.write_readings(days, path)
    before = sorted(map(str, readings.read_days(spark, path, "parquet").collect()))
    broken = days.withColumn("v", F.transform("v", lambda x: F.when(F.col("id") == "M00001", F.raise_error(F.lit("broken")).cast("double")).otherwise(x)))
    for by_month in (True, False):
        with pytest.raises(Exception, match="broken"):
            sinks.write_readings(broken, path, by_month=by_month)
        assert sorted(map(str, readings.read_days(spark, path, "parquet").collect())) == before
    assert os.listdir(tmp_path) == ["kept"]
    # a table can be replaced by what is made from it
    again = readings.read_days(spark, path, "parquet").filter("id = 'M00001'")
    left = again.count()
    sinks.write_readings(again.drop("month"), path)
    assert 0 < readings.read_days(spark, path, "parquet").count() == left < len(before)
    sinks.write_readings(days, str(tmp_path / "c"), "csv")
    sinks.write_readings(days.limit(3), str(tmp_path / "c"), "csv")
    assert readings.read_days(spark, str(tmp_path / "c")).count() == 3 and sorted(os.listdir(tmp_path)) == ["c", "kept"]


def test_pair_needs_both(spark, tmp_path):
    assert readings.read_pair(spark, "/nowhere/a", str(tmp_path / "absent"), "parquet") is None


def test_round_trip(spark):
    days = derived.days(spark, f"{ROOT}/sf0.001").select("id", "data", "v")
    back = reshape.pack(reshape.to_wide(reshape.to_long(days)))
    assert days.exceptAll(back.select(days.columns)).isEmpty() and back.count() == days.count()


def test_json_and_text(spark, tmp_path):
    days = derived.days(spark, f"{ROOT}/sf0.001")
    reports.write_gap_document(days, str(tmp_path / "j"))
    document = json.loads(spark.read.text(str(tmp_path / "j/global")).first()[0])
    assert document["global"]["total_meters"] == 60 and document["shape"] == [60, 24]
    rows = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "j/rows")).collect()]
    assert len(rows) == 60 and sum(r["missing_count"] for r in rows) == document["global"]["missing_count"]
    sinks.write_lines(reports.gap_report(days), str(tmp_path / "t"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert lines[0] == "rows: 60" and lines[-1].startswith("quality: moderate")


def test_parse_day(spark):
    df = spark.createDataFrame([("2024-02-29",), ("2023-02-29",), ("x",)], "data string")
    assert [str(r[0]) for r in readings.parse_day(df).collect()] == ["2024-02-29", "None", "None"]


def test_first_load_is_an_aggregate(spark):
    """Copies of a day combine before the shuffle, however many there are."""
    loads = derived.loaded_twice(spark, f"{ROOT}/sf0.001")
    first = pairing.first_load(loads, "load_seq")
    assert first.count() == 60 and first.agg(F.max("load_seq")).first()[0] == 0
    assert "partial_min_by" in plan(first)


def test_synthetic_meters_do_not_mix(spark):
    """Two meters with distant ranges, 30 % missing: no reading wanders, none is left out."""
    days = readings.synthetic_readings(spark, 2, 10, 0.3)
    result = fast.impute_fast(days)
    span = result.groupBy("id").agg(
        F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi"),
        F.sum(24 - F.size(F.array_compact("v"))).alias("nulls"),
    ).orderBy("id").collect()
    assert span[0]["hi"] <= 400 and span[1]["lo"] >= 300
    assert [r["nulls"] for r in span] == [0, 0]


def test_text_identifiers(spark):
    df = spark.createDataFrame([(7, 1.0), (70, 2.0)], "id int, x double")
    assert select.one_meter(df, "7").count() == 1
