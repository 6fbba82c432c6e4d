"""Queries over sources, sinks and payload normalisers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from hazeline.operators.features import series_features
from hazeline.operators.joins import bronze_records
from hazeline.operators.metrics import persistence_model
from hazeline.schemas import KEY, OBSERVATION_FIELDS, OBSERVATIONS
from hazeline.session import scratch_path
from hazeline.sources import audit, payloads, registry, tables
from suite.bindings import SENSOR, STATION, Suite, rounded, sensor, station, table

suite = Suite()
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
PLAIN = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def untidy_time():
    """Mixed timestamp formats, stray blanks and some text that is no time."""
    ts = F.col("collection_timestamp")
    return (
        F.when(F.col("ingest_seq") % 50 == 7, "not recorded")
        .when(F.col("ingest_seq") % 2 == 0, F.date_format(ts, ISO))
        .otherwise(F.concat(F.lit("  "), F.date_format(ts, PLAIN), F.lit(" ")))
    )


@suite.query(
    "scan_observations",
    f"WITH {SENSOR} SELECT city, collection_timestamp, {rounded('aqi', 'pm2_5', 'pm10', 'temperature', 'humidity')} "
    "FROM sensor WHERE ingest_seq % 50 <> 7",
)
def scan_observations(spark, sf_dir):
    rows = sensor(spark, sf_dir).withColumn("collection_timestamp", untidy_time())
    known = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in OBSERVATION_FIELDS]
    path = scratch_path(spark, "observations-csv")
    rows.select(*known).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    return tables.scan_observations(spark, path, OBSERVATIONS).select(
        "city", "collection_timestamp", "aqi", "pm2_5", "pm10", "temperature", "humidity"
    )


@suite.query(
    "scan_features",
    f"WITH {SENSOR} SELECT city, collection_timestamp, {rounded('aqi', 'pm2_5', 'pm10')}, "
    f"{rounded('aqi_lag_1')} FROM (SELECT *, lag(aqi) OVER (PARTITION BY city ORDER BY collection_timestamp) AS aqi_lag_1 FROM sensor)",
)
def scan_features(spark, sf_dir):
    features = series_features(sensor(spark, sf_dir)).select("city", *["collection_timestamp", "aqi", "pm2_5", "pm10", "aqi_lag_1"])
    path = scratch_path(spark, "features-csv")
    features.withColumn("collection_timestamp", F.date_format("collection_timestamp", ISO)).write.option("header", True).csv(path)
    return tables.scan_features(spark, "local", path)


@suite.query(
    "scan_csv_strings",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_orderpriority FROM orders",
)
def scan_csv_strings(spark, sf_dir):
    path = scratch_path(spark, "orders-csv")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    table(spark, sf_dir, "orders").select(*columns).write.option("header", True).csv(path)
    return tables.scan_csv_strings(spark, path)


@suite.query(
    "sink_append",
    f"WITH {SENSOR} SELECT city, count(*) AS n, round(sum(aqi) + 3.7e-10, 6) AS aqi_sum "
    "FROM (SELECT * FROM sensor UNION ALL SELECT * FROM sensor WHERE aqi >= 100) GROUP BY city",
)
def sink_append(spark, sf_dir):
    rows = sensor(spark, sf_dir).select("city", "collection_timestamp", "aqi")
    path = scratch_path(spark, "append")
    tables.sink_append(rows, path)
    tables.sink_append(rows.filter(F.col("aqi") >= 100).select("aqi", "city", "collection_timestamp"), path)
    return spark.read.parquet(path).groupBy("city").agg(F.count("*").alias("n"), F.sum("aqi").alias("aqi_sum"))


def daily_documents(spark, sf_dir):
    """One JSON run document per event type and day; each tenth day is cut off."""
    day = F.to_date("collection_timestamp").alias("day")
    runs = sensor(spark, sf_dir).groupBy("city", day).agg(F.count("*").alias("records"), F.max("ingest_seq").alias("last_seq"))
    body = F.to_json(F.struct("city", F.col("day").cast("string").alias("day"), "records", "last_seq"))
    name = F.concat_ws("_", F.lit("run"), F.date_format("day", "yyyyMMdd"), "city")
    text = F.when(F.dayofmonth("day") % 10 == 0, F.substring(body, 1, 12)).otherwise(body)
    path = scratch_path(spark, "documents")
    # the folder column gives every document a file of its own
    runs.select(name.alias("doc"), text.alias("value")).repartition("doc").write.partitionBy("doc").text(path)
    return path


DOC_SCHEMA = "city string, day string, records bigint, last_seq bigint"
DOCS = f"""{SENSOR}, runs AS (
  SELECT city, strftime(collection_timestamp, '%Y-%m-%d') AS day, count(*) AS records, max(ingest_seq) AS last_seq
  FROM sensor GROUP BY ALL), docs AS (SELECT * FROM runs WHERE CAST(substr(day, 9, 2) AS INT) % 10 <> 0)"""


@suite.query("scan_json_docs", f"WITH {DOCS} SELECT city, day, records, last_seq FROM docs")
def scan_json_docs(spark, sf_dir):
    path = daily_documents(spark, sf_dir)
    return tables.scan_json_docs(spark, f"{path}/*/*.txt", DOC_SCHEMA).select("city", "day", "records", "last_seq")


@suite.query(
    "latest_run_audit",
    f"WITH {DOCS} SELECT city, day, records, last_seq FROM docs "
    "ORDER BY concat('run_', replace(day, '-', ''), '_', city) DESC LIMIT 1",
)
def latest_run_audit(spark, sf_dir):
    path = daily_documents(spark, sf_dir)
    docs = tables.scan_json_docs(spark, f"{path}/*/*.txt", DOC_SCHEMA)
    folder = F.concat_ws("_", F.lit("run"), F.replace("day", F.lit("-"), F.lit("")), "city")
    return audit.latest_run_audit(docs.withColumn("file_name", folder)).drop("file_name")


def sides(spark, sf_dir):
    """Weather and pollutant halves of the sensor table."""
    rows = sensor(spark, sf_dir)
    weather = rows.select(
        *KEY, F.lit(27.7).alias("latitude"), F.lit(68.8).alias("longitude"), "temperature", "humidity", "pressure",
        "wind_speed", "clouds", F.lit("clear sky").alias("weather"), F.lit("weather side").alias("source"),
    )
    nothing = F.lit(None).cast("double")
    aqi = rows.select(
        *KEY, "aqi", "pm2_5", "pm10", *[nothing.alias(c) for c in ("co", "so2", "no2", "o3")], F.lit("aq side").alias("source")
    )
    return weather, aqi


@suite.query(
    "sink_bronze_json",
    f"WITH {SENSOR} SELECT city AS city_slug, CAST(CAST(collection_timestamp AS DATE) AS VARCHAR) AS date, count(*) AS n, "
    "round(avg(temperature) + 3.7e-10, 6) AS temperature, round(avg(aqi) + 3.7e-10, 6) AS aqi FROM sensor GROUP BY ALL",
)
def sink_bronze_json(spark, sf_dir):
    path = scratch_path(spark, "bronze")
    tables.sink_bronze_json(bronze_records(*sides(spark, sf_dir)), path)
    schema = (
        "city string, weather_raw struct<temperature:double>, aqi_raw struct<aqi:double>, "
        "merged struct<temperature:double,aqi:double>, city_slug string, date string"
    )
    stored = spark.read.schema(schema).json(path)
    return stored.groupBy("city_slug", "date").agg(
        F.count("*").alias("n"), F.avg("weather_raw.temperature").alias("temperature"), F.avg("merged.aqi").alias("aqi")
    )


def backfill_steps(spark, sf_dir):
    status = (
        F.when(F.col("ingest_seq") % 7 == 0, "skipped").when(F.col("ingest_seq") % 11 == 0, "error").otherwise("new")
    )
    return station(spark, sf_dir).select(
        "city", "collection_timestamp", status.alias("status"), F.lit("Open-Meteo Archive").alias("weather_source"),
        "aqi_source", F.concat(F.lit("no data for "), F.col("ingest_seq").cast("string")).alias("error"),
    )


AUDIT = f"""{STATION}, steps AS (SELECT *,
    CASE WHEN ingest_seq % 7 = 0 THEN 'skipped' WHEN ingest_seq % 11 = 0 THEN 'error' ELSE 'new' END AS status,
    'no data for ' || CAST(ingest_seq AS VARCHAR) AS error FROM station),
  errs AS (SELECT city, string_agg(e, ';' ORDER BY n) AS errors FROM (
    SELECT city, row_number() OVER (PARTITION BY city ORDER BY collection_timestamp, error) AS n,
      '[' || strftime(collection_timestamp, '%Y-%m-%dT%H:%M:%S') || '] ' || error AS e
    FROM steps WHERE status = 'error') WHERE n <= 20 GROUP BY city)"""


@suite.query(
    "sink_run_audit",
    f"""WITH {AUDIT} SELECT '2002-01-01T06:00:00' AS run_start, '2002-01-01T06:02:01' AS run_end,
    121.0::DOUBLE AS execution_time_seconds, 'historical' AS pipeline_type, 1 AS interval_hours, '1995-01-01' AS start_date,
    '2001-08-01' AS end_date, false AS force_mode, s.city, 'Open-Meteo Archive' AS weather_source,
    string_agg(DISTINCT aqi_source, ', ' ORDER BY aqi_source) FILTER (WHERE status = 'new') AS aqi_source,
    count(*) AS total_requested_steps, count(*) FILTER (WHERE status = 'new') AS successful_records,
    count(*) FILTER (WHERE status = 'skipped') AS skipped_duplicates, count(*) FILTER (WHERE status = 'error') AS error_count,
    any_value(errs.errors) AS errors, CASE WHEN count(*) FILTER (WHERE status = 'error') = 0 THEN 'SUCCESS' ELSE 'PARTIAL' END AS status
    FROM steps s JOIN errs ON s.city = errs.city GROUP BY s.city""",
)
def sink_run_audit(spark, sf_dir):
    run = {"started": dt.datetime(2002, 1, 1, 6), "ended": dt.datetime(2002, 1, 1, 6, 2, 1), "start_date": "1995-01-01", "end_date": "2001-08-01"}
    rows = audit.backfill_audit(backfill_steps(spark, sf_dir), **run)
    path = scratch_path(spark, "audit")
    audit.sink_run_audit(rows, path)
    stored = spark.read.schema(rows.schema).json(path)
    return stored.withColumn("errors", F.concat_ws(";", "errors"))


CURRENT_SQL = f"""WITH {SENSOR} SELECT ingest_seq, city, 27.7::DOUBLE AS latitude, 68.8::DOUBLE AS longitude,
  {rounded('temperature', 'feels_like', 'humidity', 'pressure')}, {rounded('wind_speed')},
  CASE WHEN ingest_seq % 4 = 0 THEN NULL ELSE clouds END AS clouds,
  CASE WHEN ingest_seq % 5 = 0 THEN NULL ELSE 'haze' END AS weather, 'OpenWeather' AS source
  FROM sensor WHERE ingest_seq % 20 <> 0"""


@suite.query("norm_weather_current", CURRENT_SQL)
def norm_weather_current(spark, sf_dir):
    rows = sensor(spark, sf_dir)
    seq = F.col("ingest_seq")
    described = F.array(F.struct(F.lit("haze").alias("description")), F.struct(F.lit("later").alias("description")))
    payload = F.to_json(
        F.struct(
            F.struct(F.lit(27.7).alias("lat"), F.lit(68.8).alias("lon")).alias("coord"),
            F.when(seq % 5 != 0, described).alias("weather"),
            F.struct(
                F.col("temperature").alias("temp"), "feels_like", F.when(seq % 20 != 0, F.col("humidity")).alias("humidity"), "pressure"
            ).alias("main"),
            F.struct(F.col("wind_speed").alias("speed")).alias("wind"),
            F.when(seq % 4 != 0, F.struct(F.col("clouds").alias("all"))).alias("clouds"),
            F.col("city").alias("name"),
        )
    )
    out = payloads.norm_weather_current(rows.select("ingest_seq", payload.alias("payload")))
    return out.filter(F.col("problem").isNull()).select(
        "ingest_seq", "city", "latitude", "longitude", "temperature", "feels_like", "humidity", "pressure", "wind_speed",
        "clouds", "weather", "source",
    )


def hourly(spark, sf_dir):
    """Hourly means, so a day has at most 24 entries per city."""
    return sensor(spark, sf_dir).groupBy("city", F.date_trunc("hour", "collection_timestamp").alias("hour")).agg(
        F.avg("temperature").alias("temperature"), F.avg("humidity").alias("humidity"), F.avg("pressure").alias("pressure"),
        F.avg("wind_speed").alias("wind_speed"), F.avg("wind_direction").alias("wind_direction"), F.avg("clouds").alias("clouds"),
        F.avg("aqi").alias("aqi"), F.avg("pm2_5").alias("pm2_5"), F.max("ingest_seq").alias("last_seq"),
    )


HOURLY = f"""{SENSOR}, hourly AS (SELECT city, date_trunc('hour', collection_timestamp) AS hour, avg(temperature) AS temperature,
  avg(humidity) AS humidity, avg(pressure) AS pressure, avg(wind_speed) AS wind_speed, avg(wind_direction) AS wind_direction,
  avg(clouds) AS clouds, avg(aqi) AS aqi, avg(pm2_5) AS pm2_5, max(ingest_seq) AS last_seq FROM sensor GROUP BY ALL)"""
WMO_SAMPLE = [0, 3, 45, 61, 12]


def day_arrays(spark, sf_dir, fields):
    """Parallel arrays per city and day, hours in order."""
    entry = F.struct(F.date_format("hour", "yyyy-MM-dd'T'HH:mm").alias("time"), *[c.alias(n) for n, c in fields.items()])
    listed = hourly(spark, sf_dir).groupBy("city", F.to_date("hour").alias("day")).agg(F.array_sort(F.collect_list(entry)).alias("h"))
    return listed.select("city", "day", *[F.col("h")[n].alias(n) for n in ("time", *fields)])


@suite.query(
    "norm_weather_hourly",
    f"""WITH {HOURLY}, codes AS (SELECT *, row_number() OVER (PARTITION BY city, CAST(hour AS DATE) ORDER BY hour) AS seq FROM hourly)
    SELECT city, hour AS collection_timestamp, {rounded('temperature', 'humidity', 'pressure', 'wind_speed', 'wind_direction', 'clouds')},
    CAST(NULL AS DOUBLE) AS feels_like,
    CASE last_seq % 5 WHEN 0 THEN 'clear sky' WHEN 1 THEN 'overcast' WHEN 2 THEN 'foggy' WHEN 3 THEN 'slight rain' ELSE 'Unknown' END AS weather
    FROM codes""",
)
def norm_weather_hourly(spark, sf_dir):
    codes = F.element_at(F.array(*[F.lit(c) for c in WMO_SAMPLE]), (F.col("last_seq") % 5 + 1).cast("int"))
    fields = {
        "temperature_2m": F.col("temperature"), "relative_humidity_2m": F.col("humidity"), "surface_pressure": F.col("pressure"),
        "wind_speed_10m": F.col("wind_speed"), "wind_direction_10m": F.col("wind_direction"), "cloud_cover": F.col("clouds"),
        "weather_code": codes,
    }
    days = day_arrays(spark, sf_dir, fields)
    payload = F.to_json(F.struct(F.lit(27.7).alias("latitude"), F.struct("time", *fields).alias("hourly")))
    out = payloads.norm_weather_hourly(days.select("city", payload.alias("payload")))
    return out.filter(F.col("problem").isNull()).select(
        "city", "collection_timestamp", "temperature", "humidity", "pressure", "wind_speed", "wind_direction", "clouds", "feels_like", "weather"
    )


def forecast_payloads(spark, sf_dir):
    """A forecast document per city and day: its hours as forecast entries."""
    seq = F.col("last_seq")
    entry = F.struct(
        F.unix_timestamp("hour").alias("dt"),
        F.struct(F.col("temperature").alias("temp"), "humidity", "pressure").alias("main"),
        F.struct(F.when(seq % 9 != 0, F.col("wind_speed")).alias("speed")).alias("wind"),
        F.struct(F.col("clouds").alias("all")).alias("clouds"),
    )
    place = F.struct(F.col("city").alias("name"), F.struct(F.lit(27.7).alias("lat"), F.lit(68.8).alias("lon")).alias("coord"))
    days = hourly(spark, sf_dir).groupBy("city", F.to_date("hour").alias("day")).agg(F.collect_list(entry).alias("list"))
    return days.select(F.to_json(F.struct(place.alias("city"), "list")).alias("payload"))


FORECAST = f"""{HOURLY}, forecast AS (SELECT city, hour AS collection_timestamp, CAST(hour AS DATE) AS date,
  CASE WHEN last_seq % 9 <> 0 THEN wind_speed END AS wind, humidity AS humid, temperature AS temp, clouds, pressure FROM hourly)"""


@suite.query(
    "norm_weather_forecast",
    f"WITH {FORECAST} SELECT city, collection_timestamp, date, {rounded('wind', 'humid', 'temp', 'clouds', 'pressure')} FROM forecast",
)
def norm_weather_forecast(spark, sf_dir):
    return payloads.norm_weather_forecast(forecast_payloads(spark, sf_dir)).drop("latitude", "longitude")


@suite.query(
    "norm_aq_station",
    f"""WITH {SENSOR} SELECT ingest_seq, city, 24.8::DOUBLE AS latitude, 67.0::DOUBLE AS longitude, {rounded('aqi', 'pm2_5', 'pm10')},
    CAST(NULL AS DOUBLE) AS co, 'AQICN-city' AS source FROM sensor WHERE ingest_seq % 13 <> 0 AND ingest_seq % 17 <> 0""",
)
def norm_aq_station(spark, sf_dir):
    seq = F.col("ingest_seq")
    reading = F.to_json(
        F.struct(
            F.lit("ok").alias("status"),
            F.struct(
                F.when(seq % 17 != 0, F.col("aqi")).alias("aqi"),
                F.struct(F.col("city").alias("name"), F.array(F.lit(24.8), F.lit(67.0)).alias("geo")).alias("city"),
                F.struct(
                    F.struct(F.col("pm2_5").alias("v")).alias("pm25"),
                    F.when(F.col("pm10").isNotNull(), F.struct(F.col("pm10").alias("v"))).alias("pm10"),
                ).alias("iaqi"),
            ).alias("data"),
        )
    )
    refused = F.to_json(F.struct(F.lit("error").alias("status"), F.lit("Unknown station").alias("data")))
    rows = sensor(spark, sf_dir).select("ingest_seq", F.when(seq % 13 == 0, refused).otherwise(reading).alias("payload"))
    out = payloads.norm_aq_station(rows)
    return out.filter(F.col("problem").isNull()).select(
        "ingest_seq", "city", "latitude", "longitude", "aqi", "pm2_5", "pm10", "co", "source"
    )


@suite.query(
    "norm_aq_components",
    f"""WITH {SENSOR} SELECT ingest_seq, city, CAST(ingest_seq % 5 + 1 AS DOUBLE) AS aqi, {rounded('pm2_5', 'pm10')},
    round(humidity + 3.7e-10, 6) AS co, CAST(NULL AS DOUBLE) AS o3, 'OpenWeather-AirPollution' AS source FROM sensor WHERE ingest_seq % 19 <> 0""",
)
def norm_aq_components(spark, sf_dir):
    seq = F.col("ingest_seq")
    entry = F.struct(
        F.struct((seq % 5 + 1).alias("aqi")).alias("main"),
        F.struct("pm2_5", "pm10", F.col("humidity").alias("co")).alias("components"),
    )
    listed = F.when(seq % 19 == 0, "[]").otherwise(F.to_json(F.array(entry)))
    payload = F.concat(F.lit('{"coord":{"lat":27.7,"lon":68.8},"list":'), listed, F.lit("}"))
    out = payloads.norm_aq_components(sensor(spark, sf_dir).select("city", "ingest_seq", payload.alias("payload")))
    return out.filter(F.col("problem").isNull()).select("ingest_seq", "city", "aqi", "pm2_5", "pm10", "co", "o3", "source")


@suite.query(
    "norm_aq_model_hourly",
    f"""WITH {HOURLY} SELECT city, hour AS requested, {rounded('aqi', 'pm2_5')}, CAST(NULL AS DOUBLE) AS pm10,
    CAST(NULL AS DOUBLE) AS o3, 'OpenMeteo-AirQuality' AS source FROM hourly""",
)
def norm_aq_model_hourly(spark, sf_dir):
    days = day_arrays(spark, sf_dir, {"us_aqi": F.col("aqi"), "pm2_5": F.col("pm2_5"), "pm10": F.col("pm2_5")})
    payload = F.to_json(F.struct(F.lit(27.7).alias("latitude"), F.struct("time", "us_aqi", "pm2_5", "pm10").alias("hourly")))
    start = F.col("day").cast("timestamp")
    hours = F.explode(F.sequence(start, start + F.make_dt_interval(hours=F.lit(23)), F.make_dt_interval(hours=F.lit(1))))
    requests = days.select("city", payload.alias("payload"), hours.alias("requested"))
    out = payloads.norm_aq_model_hourly(requests)
    return out.filter(F.col("problem").isNull()).select("city", "requested", "aqi", "pm2_5", "pm10", "o3", "source")


PARAMETERS = ("pm25", "o3", "bc")


def catalog_payloads(spark, sf_dir):
    """A catalog document per supplier with two stations of three sensors."""

    def location(place: int):
        base = F.col("s_suppkey") * 10 + place
        sensors = [
            F.struct(
                (base * 10 + i).alias("id"),
                F.struct(F.lit(i).cast("long").alias("id"), F.lit(p).alias("name"), F.lit("ppm").alias("units")).alias("parameter"),
            )
            for i, p in enumerate(PARAMETERS)
        ]
        return F.struct(base.alias("id"), F.array(*sensors).alias("sensors"))

    document = F.to_json(F.struct(F.array(location(0), location(1)).alias("results")))
    return table(spark, sf_dir, "supplier").select("s_nationkey", document.alias("payload"))


@suite.query(
    "norm_sensor_catalog",
    """SELECT s_nationkey, s_suppkey * 10 + p AS location_id, (s_suppkey * 10 + p) * 10 + i AS sensor_id,
    CASE i WHEN 0 THEN 'pm25' ELSE 'o3' END AS parameter, CAST(p AS BIGINT) * 2147483648 + i AS proximity
    FROM supplier, (VALUES (0), (1)) places(p), (VALUES (0), (1)) kinds(i)""",
)
def norm_sensor_catalog(spark, sf_dir):
    return payloads.norm_sensor_catalog(catalog_payloads(spark, sf_dir))


@suite.query(
    "norm_sensor_measurements",
    """SELECT l_orderkey, l_linenumber, s AS seq, CASE s WHEN 0 THEN 'pm25' ELSE 'co' END AS parameter,
    round(l_quantity + s + 3.7e-10, 6) AS value, CASE s WHEN 0 THEN 'µg/m³' ELSE 'ppm' END AS unit, l_shipdate AS collection_timestamp
    FROM lineitem, (VALUES (0), (1)) m(s)""",
)
def norm_sensor_measurements(spark, sf_dir):
    utc = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    as_object = F.struct(
        F.col("l_quantity").alias("value"),
        F.struct(F.lit("pm25").alias("name"), F.lit("µg/m³").alias("units")).alias("parameter"),
        F.struct(F.struct(utc.alias("utc"), F.lit("local").alias("local")).alias("datetimeFrom")).alias("period"),
    )
    as_text = F.struct(
        (F.col("l_quantity") + 1).alias("value"),
        F.struct(F.lit("co").alias("name"), F.lit("ppm").alias("units")).alias("parameter"),
        F.struct(utc.alias("datetimeFrom")).alias("period"),
    )
    results = F.concat(F.lit('{"results":['), F.to_json(as_object), F.lit(","), F.to_json(as_text), F.lit("]}"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", results.alias("payload"))
    return payloads.norm_sensor_measurements(rows)


@suite.query(
    "feature_table_prepare",
    f"WITH {SENSOR} SELECT city, collection_timestamp, {rounded('aqi', 'pm2_5')} FROM sensor",
)
def feature_table_prepare(spark, sf_dir):
    text = F.date_format("collection_timestamp", ISO)
    rows = sensor(spark, sf_dir).select("city", text.alias("timestamp"), text.alias("collection_timestamp"), "aqi", "pm2_5")
    return tables.feature_table_prepare(rows)


def upserted(spark, sf_dir):
    """All rows stored, then rows of every second arrival raised by one and
    rows of a new city added."""
    rows = sensor(spark, sf_dir).select("city", "collection_timestamp", "aqi", "ingest_seq")
    path = scratch_path(spark, "feature-table")
    tables.feature_table_upsert(rows, path, "ingest_seq")
    raised = rows.filter(F.col("ingest_seq") % 2 == 0).withColumn("aqi", F.col("aqi") + 1)
    added = rows.filter(F.col("aqi") > 100).withColumn("city", F.concat("city", F.lit("-new")))
    tables.feature_table_upsert(raised.unionByName(added), path, "ingest_seq")
    return path


UPSERTED = f"""WITH {SENSOR}, upserted AS (
  SELECT city, collection_timestamp, CASE WHEN ingest_seq % 2 = 0 THEN aqi + 1 ELSE aqi END AS aqi, ingest_seq FROM sensor
  UNION ALL SELECT city || '-new', collection_timestamp, aqi, ingest_seq FROM sensor WHERE aqi > 100)"""


@suite.query("feature_table_upsert", f"{UPSERTED} SELECT city, collection_timestamp, {rounded('aqi')}, ingest_seq FROM upserted")
def feature_table_upsert(spark, sf_dir):
    return tables.feature_table_read(spark, upserted(spark, sf_dir))


@suite.query(
    "feature_table_read",
    f"{UPSERTED} SELECT city, count(*) AS n, round(avg(aqi) + 3.7e-10, 6) AS aqi FROM upserted GROUP BY city",
)
def feature_table_read(spark, sf_dir):
    # The table holds one row per key, however many arrived for it.
    rows = sensor(spark, sf_dir)
    added = rows.filter(F.col("aqi") > 100).withColumn("city", F.concat("city", F.lit("-new")))
    expected = rows.select(*KEY).union(added.select(*KEY)).distinct().count()
    stored = tables.feature_table_read(spark, upserted(spark, sf_dir), expected)
    return stored.groupBy("city").agg(F.count("*").alias("n"), F.avg("aqi").alias("aqi"))


@suite.query(
    "sink_predictions",
    f"WITH {SENSOR} SELECT city, collection_timestamp, round(aqi + 3.7e-10, 6) AS aqi_forecast_72h FROM sensor",
)
def sink_predictions(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    tables.sink_predictions(persistence_model(sensor(spark, sf_dir)).select(*KEY, "prediction"), path)
    return spark.read.parquet(path)


def registry_rows(spark, sf_dir):
    """A run per customer segment and month with metrics from the orders."""
    orders = table(spark, sf_dir, "orders")
    month = F.date_trunc("month", "o_orderdate")
    runs = orders.groupBy("o_orderstatus", month.alias("month")).agg(
        F.count("*").alias("n"), F.avg(F.col("o_totalprice") / 1000).alias("rmse"),
        F.min(F.col("o_totalprice") / 1000).alias("mae"), F.max(F.col("o_totalprice") / 2000).alias("naive"),
    )
    version = F.when(F.col("o_orderstatus") == "F", "ridge_3day_dailyavg_v5").when(
        F.col("o_orderstatus") == "O", "ridge_3day_dailyavg_v6"
    ).otherwise("random_forest")
    run = F.concat_ws("_", version, F.date_format("month", "yyyyMMdd'T'HHmmss'Z'"))
    return runs.withColumn("run", run)


REGISTRY = """runs AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'ridge_3day_dailyavg_v5' WHEN 'O' THEN 'ridge_3day_dailyavg_v6'
    ELSE 'random_forest' END || '_' || strftime(month, '%Y%m%dT%H%M%SZ') AS run FROM (
  SELECT o_orderstatus, date_trunc('month', o_orderdate) AS month, count(*) AS n, avg(o_totalprice / 1000) AS rmse,
    min(o_totalprice / 1000) AS mae, max(o_totalprice / 2000) AS naive FROM orders GROUP BY ALL))"""


@suite.query(
    "registry_scan",
    f"""WITH {REGISTRY} SELECT run, 'day' || h || '_avg' AS horizon, 'mean AQI' AS target, h AS features,
    round(rmse + 3.7e-10, 6) AS rmse, round(mae + 3.7e-10, 6) AS mae, CAST(NULL AS DOUBLE) AS r2, rmse < naive AS beats_baseline
    FROM runs, (VALUES (1), (2), (3)) horizons(h)""",
)
def registry_scan(spark, sf_dir):
    def entry(h: int):
        names = F.array(*[F.lit(f"c{i}") for i in range(h)])
        return F.struct(
            F.lit("mean AQI").alias("target"), names.alias("feature_cols"), F.struct("rmse", "mae").alias("test_metrics"),
            F.struct(F.col("naive").alias("rmse")).alias("naive_baseline"),
        ).alias(f"day{h}_avg")

    documents = registry_rows(spark, sf_dir).select("run", F.to_json(F.struct(entry(1), entry(2), entry(3))).alias("document"))
    path = scratch_path(spark, "registry")
    # one folder per run, one document file in it
    documents.select("run", "document").repartition("run").write.partitionBy("run").text(path)
    stored = spark.read.option("wholetext", True).text(path).select("run", F.col("value").alias("document"))
    return registry.registry_scan(stored)


@suite.query(
    "registry_latest",
    f"""WITH {REGISTRY} SELECT max_by(run, strftime(month, '%Y%m%dT%H%M%SZ') || run) AS by_stamp,
    max(run) FILTER (WHERE run LIKE 'ridge_3day_dailyavg_v5%' OR run LIKE 'ridge_3day_dailyavg_v6%') AS by_name FROM runs""",
)
def registry_latest(spark, sf_dir):
    return registry.registry_latest(registry_rows(spark, sf_dir).select("run"))
