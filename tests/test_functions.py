"""Goldens of indices, units, calendar, rules and normalisers."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from hazeline.functions import calendar, indices, noise
from hazeline.operators import joins, validate
from hazeline.sources import payloads

NOW = dt.datetime(2026, 1, 10, tzinfo=dt.timezone.utc)


def value(spark, column, **inputs):
    df = spark.range(1).select(*[F.lit(v).cast("double" if not isinstance(v, str) else "string").alias(k) for k, v in inputs.items()], F.lit(1).alias("one"))
    return df.select(column.alias("v")).first()["v"]


def test_overall_index_of_three_pollutants(spark):
    c = {k: F.col(k) for k in ("pm2_5", "pm10", "co")}
    assert value(spark, indices.epa_aqi(**c), pm2_5=35.0, pm10=85.0, co=5.0) == 99


@pytest.mark.parametrize(
    "pollutant, concentration, expected",
    [("pm2_5", 12.0, 50), ("pm2_5", 12.05, None), ("pm2_5", 500.4, 500), ("pm2_5", 500.5, None), ("o3", 200.0, 300),
     ("o3", 201.0, None), ("pm10", 0.0, 0), ("no2", 53.5, None), ("pm10", 54.0, 50), ("co", 10.0, 109)],
)
def test_subindex_edges(spark, pollutant, concentration, expected):
    assert value(spark, indices.epa_subindex(F.col("c"), pollutant), c=concentration) == expected


def test_units(spark):
    assert value(spark, indices.unit_conversion(F.col("c"), F.lit("µg/m³"), "co"), c=11460.0) == pytest.approx(10.0)
    assert value(spark, indices.unit_conversion(F.col("c"), F.lit("ppm"), "co"), c=7.0) == 7.0
    assert value(spark, indices.unit_conversion(F.col("c"), F.lit(None).cast("string"), "o3"), c=7.0) == 7.0


@pytest.mark.parametrize("aqi, label, alert", [(50.0, "Good", None), (149.0, "Unhealthy for sensitive groups", None),
                                               (150.0, "Unhealthy for sensitive groups", "Unhealthy for sensitive groups"),
                                               (151.0, "Unhealthy", "Unhealthy"), (900.0, "Hazardous", "Hazardous")])
def test_bands_and_alerts(spark, aqi, label, alert):
    assert value(spark, indices.aqi_category(F.col("a")), a=aqi) == label
    assert value(spark, indices.alert_level(F.col("a")), a=aqi) == alert


@pytest.mark.parametrize("now, base, direction", [(101.0, 100.0, "Stable"), (120.0, 100.0, "Increasing"), (98.0, 100.0, "Decreasing")])
def test_trend(spark, now, base, direction):
    assert value(spark, indices.trend_delta(F.col("a"), F.col("b")), a=now, b=base) == direction


def test_pollution_index_needs_two_columns(spark):
    df = spark.createDataFrame([(35.4, None), (None, 154.0), (35.4, 308.0), (None, None)], "pm2_5 double, pm10 double")
    both = df.select(indices.pollution_index(indices.available_pollutants(df)).alias("v")).collect()
    assert [r.v for r in both] == [1.0, 1.0, 1.5, None]
    single = df.filter("pm10 is null")
    assert single.select(indices.pollution_index(indices.available_pollutants(single)).alias("v")).first().v is None


def test_grid_is_inclusive_and_checked(spark):
    span = spark.sql("select 'x' city, timestamp'2026-01-01 00:30:00Z' a, timestamp'2026-01-01 06:00:00Z' b")
    assert calendar.interval_grid(span, "a", "b", 1).count() == 7
    with pytest.raises(Exception, match="start is after end"):
        calendar.interval_grid(span, "b", "a", 1).collect()
    ends = spark.sql("select '2026-01-01' d union all select '2026-01-01T05:00:00Z'").select(calendar.day_end(F.col("d")).cast("string").alias("e"))
    assert sorted(r.e for r in ends.collect()) == ["2026-01-01 05:00:00", "2026-01-01 23:59:59"]


def test_resume_fetches_only_what_is_missing(spark):
    def grid(a, b):
        return calendar.interval_grid(spark.sql(f"select 'x' city, timestamp'2026-01-01 {a}Z' a, timestamp'2026-01-01 {b}Z' b"), "a", "b", 1)

    stored = grid("00:00:00", "03:00:00")
    assert joins.incremental_anti(stored, stored).count() == 0
    assert joins.incremental_anti(grid("03:00:00", "09:00:00"), stored).count() == 6
    assert joins.incremental_anti(stored.union(stored), stored, force=True).count() == 4


VALID = {
    "timestamp": "2026-01-10T00:00:00+00:00", "collection_timestamp": "2026-01-10T00:00:00+00:00", "city": "x", "latitude": "27.7052",
    "longitude": "68.8574", "temperature": "34.2", "humidity": "40", "pressure": "1008", "wind_speed": "3.1", "visibility": "10000",
    "weather": "clear sky", "aqi": "152", "pm2_5": "90", "pm10": "120", "co": "4", "so2": "2", "no2": "10", "o3": "15",
}


@pytest.mark.parametrize(
    "change, reason",
    [({}, None), ({"pm10": None, "o3": None}, None), ({"city": None}, "required:city"), ({"aqi": "high"}, "numeric:aqi"),
     ({"temperature": "true"}, "numeric:temperature"), ({"aqi": "-1"}, "negative:aqi"), ({"humidity": "-0.1"}, "negative:humidity"),
     ({"latitude": "90.5"}, "range:latitude"), ({"latitude": "90"}, None), ({"longitude": "-181"}, "range:longitude"),
     ({"timestamp": "yesterday"}, "format:timestamp"), ({"timestamp": "2026-01-11T00:00:00Z"}, None),
     ({"timestamp": "2026-01-11T00:00:01Z"}, "future:timestamp")],
)
def test_record_rules(spark, change, reason):
    record = {**VALID, **change}
    df = spark.createDataFrame([tuple(record.values())], ", ".join(f"{k} string" for k in record))
    valid, quarantine = validate.validate_records(df, F.lit(NOW))
    found = quarantine.first()
    assert (found.violations if found else None) == ([reason] if reason else None)
    assert valid.count() == (0 if reason else 1)


def test_absent_pollutant_column_is_an_error(spark):
    with pytest.raises(ValueError, match="o3"):
        validate.validate_records(spark.createDataFrame([("1",)], "pm10 string"), F.lit(NOW))


def payload(spark, document, **extra):
    df = spark.createDataFrame([(json.dumps(document),)], "payload string")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def test_station_error_form_is_refused(spark):
    row = payloads.norm_aq_station(payload(spark, {"status": "error", "data": "Unknown station"})).first()
    assert row.problem == "missing status ok" and row.aqi is None


def test_station_without_geo_uses_the_request(spark):
    document = {"status": "ok", "data": {"aqi": 80, "city": {"name": "x"}, "iaqi": {"pm25": {"v": 20.5}}}}
    row = payloads.norm_aq_station(payload(spark, document, latitude=1.5, longitude=2.5)).first()
    assert (row.latitude, row.longitude, row.aqi, row.pm2_5, row.pm10, row.problem) == (1.5, 2.5, 80.0, 20.5, None, None)


def test_hourly_weather_with_short_and_absent_arrays(spark):
    hours = {
        "time": ["2026-01-01T00:00", "2026-01-01T01:00"], "temperature_2m": [1.0, 2.0], "relative_humidity_2m": [50, 51],
        "surface_pressure": [1000, 1001], "wind_speed_10m": [3, 4], "wind_direction_10m": [10, 20], "cloud_cover": [5, 6],
        "visibility": [9000], "weather_code": [3, 42],
    }
    rows = payloads.norm_weather_hourly(payload(spark, {"latitude": 1.0, "hourly": hours}, city="x")).orderBy("seq").collect()
    assert [(r.temperature, r.visibility, r.feels_like, r.weather) for r in rows] == [
        (1.0, 9000.0, None, "overcast"), (2.0, None, None, "Unknown")]
    del hours["temperature_2m"]
    assert payloads.norm_weather_hourly(payload(spark, {"hourly": hours}, city="x")).first().problem == "missing temperature_2m"


def test_model_estimate_keeps_two_values_only(spark):
    hours = {"time": ["2026-01-01T00:00", "2026-01-01T01:00"], "us_aqi": [100, 120], "pm2_5": [20, 25], "pm10": [1, 2]}
    at = lambda h: payload(spark, {"hourly": hours}).withColumn("requested", F.lit(f"2026-01-01 {h}:30:00Z").cast("timestamp"))
    row = payloads.norm_aq_model_hourly(at("01")).first()
    assert (row.aqi, row.pm2_5, row.pm10, row.co, row.problem) == (120.0, 25.0, None, None, None)
    assert payloads.norm_aq_model_hourly(at("05")).first().problem == "missing matching hour"


def test_sensor_row_without_index_still_outranks_the_model(spark):
    readings = spark.createDataFrame([("x", 1, "pm25", 12.05, "µg/m³")], "city string, collection_timestamp int, parameter string, value double, unit string")
    ground = payloads.sensor_observations(readings).withColumns({"problem": F.lit(None).cast("string"), "ingest_seq": F.lit(1)})
    model = ground.withColumns({"aqi": F.lit(120), "pm2_5": F.lit(25.0)})
    chosen, rejected = joins.source_fallback([("ground", ground), ("model", model)])
    row = chosen.first()
    assert (row.aqi_source, row.aqi, row.pm2_5) == ("ground", None, 12.05) and rejected.isEmpty()


def test_undated_reading_serves_the_window_of_its_response_alone(spark):
    at = "timestamp'2026-01-01 {:02d}:00:00Z'"
    requests = spark.sql(" union all ".join(f"select 's' sensor, {at.format(h)} collection_timestamp, {h} request" for h in (0, 5, 13, 20))
                         + " union all select 's', timestamp'2026-02-11 16:00:00Z', 99")
    rows = [("null", 5, 1.0, 0, 12), ("null", 4, 2.0, 0, 12), ("null", 6, 2.5, 1, 13), (at.format(19), 1, 3.0, 12, 23), ("null", 7, 4.0, None, None)]
    window = lambda h: "cast(null as timestamp)" if h is None else at.format(h)
    measured = spark.sql(" union all ".join(
        f"select 's' sensor, cast({t} as timestamp) collection_timestamp, {seq} seq, {v} value, {window(a)} window_from, {window(b)} window_to" for t, seq, v, a, b in rows
    ))
    got = {r.request: r.hit and (r.hit.seq, r.hit.collection_timestamp is None) for r in joins.nearest_measurement(requests, measured, ["sensor"]).collect()}
    # At 13 a dated reading lies within six hours; at 0 and 5 the window with the nearest middle counts, then the first reading.
    assert got == {0: (4, True), 5: (4, True), 13: (1, False), 20: (1, False), 99: None}
    bare = joins.nearest_measurement(requests, measured.drop("window_from", "window_to"), ["sensor"]).collect()
    assert {r.request: r.hit and r.hit.seq for r in bare} == {0: None, 5: None, 13: 1, 20: 1, 99: None}


def test_weather_codes(spark):
    got = spark.sql("select explode(array(0, 99, 4, null)) c").select(joins.wmo_lookup(F.col("c")).alias("w")).collect()
    assert [r.w for r in got] == ["clear sky", "thunderstorm with heavy hail", "Unknown", "N/A"]


def test_future_day_without_weather_is_an_error(spark):
    anchors = spark.sql("select 'x' city, date'2026-01-01' anchor")
    rows = spark.sql("select 'x' city, timestamp'2026-01-02 01:00:00Z' collection_timestamp, 1.0 wind_speed, 2.0 humidity, 3.0 temperature, 4.0 clouds, 5.0 pressure")
    forecast = spark.sql("select 'x' city, date'2026-01-03' date, 1.0 wind, 2.0 humid, 3.0 temp, 4.0 clouds, 5.0 pressure")
    with pytest.raises(Exception, match="2026-01-04"):
        joins.future_weather(anchors, rows, forecast).collect()
    assert joins.future_weather(anchors, rows, forecast, strict=False).count() == 3


def test_noise_is_reproducible_and_normal(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20000).select(F.lit("x").alias("city"), F.timestamp_seconds(F.col("id") * 86400).alias("collection_timestamp"),
                                     *[F.lit(50.0).alias(f"fw_{v}{h}") for v in noise.FORECAST_NOISE for h in (1, 2, 3)])
    once = noise.forecast_noise(rows, 3)
    again = noise.forecast_noise(rows.repartition(7), 3)
    assert once.exceptAll(again).isEmpty()
    stats = once.agg(*[f(F.col(c)).alias(f"{n}_{c}") for c in ("fw_temp1", "fw_temp3", "fw_humid2") for n, f in (("m", F.avg), ("s", F.stddev))]).first()
    assert stats.m_fw_temp1 == pytest.approx(50, abs=0.05) and stats.s_fw_temp1 == pytest.approx(1.0, rel=0.03)
    assert stats.s_fw_temp3 == pytest.approx(2.0, rel=0.03) and stats.s_fw_humid2 == pytest.approx(8.0, rel=0.03)
    clipped = noise.forecast_noise(rows.withColumn("fw_clouds1", F.lit(99.0)), 3).agg(F.max("fw_clouds1"), F.min("fw_clouds1")).first()
    assert clipped[0] == 100.0 and clipped[1] < 99.0


def test_cycles(spark):
    row = spark.sql("select timestamp'2026-12-06 18:00:00Z' collection_timestamp").transform(calendar.time_fields).transform(calendar.cyclical).first()
    assert (row.hour, row.day_of_week, row.day_of_month, row.month) == (18, 6, 6, 12)
    assert row.hour_sin == pytest.approx(-1.0) and row.month_cos == pytest.approx(1.0) and row.day_of_week_cos == pytest.approx(math.cos(12 * math.pi / 7))


def test_exact_ks_pvalue_counts_all_orders(spark):
    from itertools import combinations

    from hazeline.operators.ranks import exact_pvalue

    for n, m in ((1, 1), (3, 3), (4, 6), (5, 7), (2, 9), (6, 6)):
        worst = []
        for first in combinations(range(n + m), n):
            at = [sum(p <= t for p in first) for t in range(n + m)]
            worst.append(max(abs(i * m - (t + 1 - i) * n) for t, i in enumerate(at)))
        for k in range(n * m + 1):
            assert exact_pvalue(k / (n * m), n, m) == pytest.approx(sum(w >= k for w in worst) / len(worst), abs=1e-12)
    # Published values: the largest distance of 5 and 5 has 2 orders of 252; the two-sided 5 % point of 10 and 10 is 7/10.
    assert exact_pvalue(1.0, 5, 5) == pytest.approx(2 / 252)
    assert exact_pvalue(0.7, 10, 10) == pytest.approx(0.0123, abs=1e-4) and exact_pvalue(0.6, 10, 10) == pytest.approx(0.0524, abs=1e-4)


def test_ks_takes_the_limit_for_large_samples_only(spark):
    from hazeline.operators import ranks

    def pvalue(n, m):
        rows = spark.range(n + m).select(F.lit("c").alias("column"), (F.col("id") % 50).cast("double").alias("value"), (F.col("id") < n).alias("first"))
        return ranks.ks_two_sample(rows, "column", F.col("first"), ~F.col("first")).first()

    small, large = pvalue(30, 41), pvalue(30, 10_001)
    assert small.ks_pvalue == pytest.approx(ranks.exact_pvalue(small.ks_stat, 30, 41))
    assert abs(large.ks_pvalue - ranks.exact_pvalue(large.ks_stat, 30, 10_001)) > 1e-5
