"""The backfill job on payload documents: resume, fallback, audit."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hazeline.plans.backfill import Archives, run_backfill

START = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def documents(spark, with_sensors):
    times = [f"2026-01-01T{h:02d}:00" for h in range(24)]
    weather = {"latitude": 1.0, "longitude": 2.0, "hourly": {
        "time": times, "temperature_2m": [20.0 + h for h in range(24)], "relative_humidity_2m": [50] * 24, "surface_pressure": [1000] * 24,
        "wind_speed_10m": [3] * 24, "wind_direction_10m": [90] * 24, "cloud_cover": [10] * 24, "weather_code": [0] * 24}}
    model = {"hourly": {"time": times[:20], "us_aqi": [120] * 20, "pm2_5": [25.0] * 20, "pm10": [7.0] * 20}}
    catalog = {"results": [{"id": 1, "sensors": [
        {"id": 11, "parameter": {"name": "pm25"}}, {"id": 12, "parameter": {"name": "co"}}, {"id": 13, "parameter": {"name": "bc"}}]}] if with_sensors else []}

    def reading(sensor, name, unit, hour, value):
        period = {"datetimeFrom": {"utc": f"2026-01-01T{hour:02d}:00:00Z"}}
        return (sensor, json.dumps({"results": [{"value": value, "parameter": {"name": name, "units": unit}, "period": period}]}))

    measured = [reading(11, "pm25", "µg/m³", h, 35.0) for h in (0, 1, 2)] + [reading(12, "co", "µg/m³", 1, 11460.0)]
    day = START.date()
    dated = "city string, date date, payload string"
    return Archives(
        spark.createDataFrame([("Old Town", day, json.dumps(weather))], dated),
        spark.createDataFrame([("Old Town", json.dumps(catalog))], "city string, payload string"),
        spark.createDataFrame(measured, "sensor_id long, payload string"),
        spark.createDataFrame([("Old Town", day, json.dumps(model))], dated),
    )


@pytest.fixture()
def run(spark, tmp_path):
    def go(first, last, with_sensors=False, force=False):
        places = spark.createDataFrame([("Old Town",)], "city string")
        return run_backfill(
            places, documents(spark, with_sensors), f"2026-01-01T{first:02d}:00:00", f"2026-01-01T{last:02d}:00:00",
            str(tmp_path / "store"), str(tmp_path / "bronze"), str(tmp_path / "audit"), force=force,
        ).first()

    go.store = str(tmp_path / "store")
    go.bronze = str(tmp_path / "bronze")
    return go


def test_rerun_and_overlap(spark, run):
    first = run(0, 3)
    assert (first.total_requested_steps, first.successful_records, first.skipped_duplicates, first.status) == (4, 4, 0, "SUCCESS")
    again = run(0, 3)
    assert (again.successful_records, again.skipped_duplicates, again.weather_source) == (0, 4, "Unknown")
    overlap = run(3, 9)
    assert (overlap.successful_records, overlap.skipped_duplicates) == (6, 1)
    rows = spark.read.parquet(run.store)
    assert rows.count() == 10 and rows.select("city", "collection_timestamp").distinct().count() == 10
    assert run(0, 3, force=True).successful_records == 4 and spark.read.parquet(run.store).count() == 14
    assert spark.read.json(run.bronze).filter("city_slug = 'old_town'").count() == 14


def test_model_serves_without_sensors(spark, run):
    run(0, 6)
    row = spark.read.parquet(run.store).filter(F.hour("collection_timestamp") == 5).first()
    assert (row.aqi, row.pm2_5, row.aqi_source, row.weather_source) == (120.0, 25.0, "OpenMeteo-AirQuality", "Open-Meteo Archive")
    assert (row.pm10, row.co, row.so2, row.no2, row.o3) == (None,) * 5 and (row.temperature, row.weather) == (25.0, "clear sky")


def test_sensors_outrank_the_model_and_missing_hours_are_errors(spark, run):
    audit = run(0, 23, with_sensors=True)
    # readings of hours 0..2 serve requests up to six hours later, the model ends at hour 19
    assert (audit.successful_records, audit.error_count, audit.status) == (20, 4, "PARTIAL")
    assert audit.aqi_source == "OpenAQ-v3, OpenMeteo-AirQuality" and audit.errors[0].startswith("[2026-01-01T20:00:00]")
    rows = {r.collection_timestamp.hour: r for r in spark.read.parquet(run.store).collect()}
    assert [rows[h].aqi_source for h in (8, 9)] == ["OpenAQ-v3", "OpenMeteo-AirQuality"]
    assert rows[1].aqi == 109 and rows[1].co == 11460.0  # 10 ppm for the index, stored value unchanged
    assert rows[8].aqi == 99 and rows[8].co is None


def test_documents_are_parsed_once_and_pruned_by_day(spark):
    from hazeline.plans import backfill

    archives = documents(spark, True)
    wanted = spark.createDataFrame([("Old Town", START + dt.timedelta(hours=h)) for h in (1, 2, 30)] + [("New Town", START)], "city string, collection_timestamp timestamp")
    rows = backfill._model(wanted, archives.model)
    assert {(r.collection_timestamp.hour, r.aqi, r.problem) for r in rows.collect()} == {(1, 120.0, None), (2, 120.0, None)}
    text = rows._jdf.queryExecution().optimizedPlan().toString()
    above, below = text.split("from_json")[0], text.split("from_json")[-1]
    # One parse, below the join with the hours that were asked for.
    assert text.count("Generate posexplode") == 1 and "Join" in above and "Join" not in below.split("LogicalRDD")[0]
    late = backfill._model(wanted.withColumn("collection_timestamp", F.col("collection_timestamp") + F.expr("INTERVAL 20 HOURS")), archives.model)
    assert {(r.collection_timestamp.hour, r.problem) for r in late.collect()} == {(21, "missing matching hour"), (22, "missing matching hour")}


def test_archives_are_cut_to_the_span(spark):
    from hazeline.functions.calendar import day_end, to_utc
    from hazeline.plans import backfill

    day = lambda n: (START + dt.timedelta(days=n)).date()
    dated = spark.createDataFrame([("x", day(n), "{}") for n in range(-2, 4)], "city string, date date, payload string")
    catalog = spark.createDataFrame([("x", "{}")], "city string, payload string")
    at = lambda h: START + dt.timedelta(hours=h)
    windows = [(-30, -7), (-30, -6), (10, 20), (29, 60), (30, 60), (None, None)]
    measured = spark.createDataFrame(
        [(i, "{}", None if a is None else at(a), None if b is None else at(b)) for i, (a, b) in enumerate(windows)],
        "sensor_id long, payload string, window_from timestamp, window_to timestamp",
    )
    cut = backfill._within(Archives(dated, catalog, measured, dated), to_utc(F.lit("2026-01-01")), day_end(F.lit("2026-01-01")))
    assert [r.date for r in cut.weather.collect()] == [r.date for r in cut.model.collect()] == [START.date()]
    assert sorted(r.sensor_id for r in cut.measurements.collect()) == [1, 2, 3, 5]
