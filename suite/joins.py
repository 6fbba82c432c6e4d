"""Queries over joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.operators import daily, joins
from hazeline.plans.backfill import Archives, run_backfill
from hazeline.session import scratch_path
from hazeline.sources import payloads
from hazeline.sources.payloads import sensor_observations
from suite.bindings import NUDGE, SENSOR, STATION, Suite, rounded, sensor, station, table
from suite.rules import GRID, grid, subindex_sql
from suite.series import rnd
from suite.sources import FORECAST, HOURLY, day_arrays, forecast_payloads, hourly

suite = Suite()


def hour_sides(spark, sf_dir):
    """Hourly weather of every series, and hourly pollutants of those hours
    that have a reading of at least 20."""
    rows = hourly(spark, sf_dir).withColumnRenamed("hour", "collection_timestamp")
    weather = rows.select(
        *S.KEY, F.lit(27.7).alias("latitude"), F.lit(68.8).alias("longitude"), "temperature", "humidity", "pressure",
        "wind_speed", "clouds", F.lit("haze").alias("weather"), F.lit("weather side").alias("source"),
    )
    nothing = F.lit(None).cast("double")
    aqi = rows.filter(F.col("aqi") >= 20).select(
        *S.KEY, "aqi", "pm2_5", F.col("pressure").alias("pm10"), *[nothing.alias(c) for c in ("co", "so2", "no2", "o3")],
        F.lit("aq side").alias("source"),
    )
    return weather, aqi


@suite.query(
    "merge_weather_aqi",
    f"""WITH {HOURLY} SELECT strftime(hour, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, hour AS collection_timestamp, city,
    27.7::DOUBLE AS latitude, 68.8::DOUBLE AS longitude, {rounded('temperature')}, CAST(NULL AS DOUBLE) AS feels_like,
    {rounded('humidity', 'pressure', 'wind_speed')}, CAST(NULL AS DOUBLE) AS wind_direction, {rounded('clouds')},
    CAST(NULL AS DOUBLE) AS visibility, 'haze' AS weather, {rounded('aqi', 'pm2_5')}, round(pressure + {NUDGE}, 6) AS pm10,
    CAST(NULL AS DOUBLE) AS co, CAST(NULL AS DOUBLE) AS so2, CAST(NULL AS DOUBLE) AS no2, CAST(NULL AS DOUBLE) AS o3,
    'weather side' AS weather_source, 'aq side' AS aqi_source FROM hourly WHERE aqi >= 20""",
)
def merge_weather_aqi(spark, sf_dir):
    return joins.merge_weather_aqi(*hour_sides(spark, sf_dir))


@suite.query(
    "source_fallback",
    """WITH ground AS (SELECT l_shipdate AS d, min(l_orderkey * 10 + l_linenumber) AS seq,
      min_by(l_quantity, l_orderkey * 10 + l_linenumber) FILTER (WHERE l_quantity >= 25) AS q FROM lineitem GROUP BY 1),
    model AS (SELECT o_orderdate AS d, min_by(o_totalprice, o_orderkey) FILTER (WHERE o_orderpriority <> '5-LOW') AS q FROM orders GROUP BY 1),
    days AS (SELECT coalesce(g.d, m.d) AS d, g.d AS gd, m.d AS md, g.q AS gq, m.q AS mq FROM ground g FULL JOIN model m ON g.d = m.d)
    SELECT d AS collection_timestamp, CASE WHEN gq IS NOT NULL THEN 'OpenAQ-v3' WHEN mq IS NOT NULL THEN 'OpenMeteo-AirQuality' END AS aqi_source,
      round(coalesce(gq, mq) + 3.7e-10, 6) AS aqi,
      CASE WHEN coalesce(gq, mq) IS NULL THEN concat_ws(' | ', CASE WHEN gd IS NOT NULL THEN 'OpenAQ-v3: small' END,
        CASE WHEN md IS NOT NULL THEN 'OpenMeteo-AirQuality: low' END) END AS reasons FROM days""",
)
def source_fallback(spark, sf_dir):
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    ground = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("collection_timestamp"), seq.alias("ingest_seq"), F.col("l_quantity").alias("aqi"),
        F.when(F.col("l_quantity") < 25, "small").alias("problem"),
    )
    model = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("collection_timestamp"), F.col("o_orderkey").alias("ingest_seq"),
        F.col("o_totalprice").alias("aqi"), F.when(F.col("o_orderpriority") == "5-LOW", "low").alias("problem"),
    )
    chosen, rejected = joins.source_fallback(
        [(payloads.AQ_SENSORS, ground), (payloads.AQ_MODEL, model)], ["collection_timestamp"]
    )
    return chosen.withColumn("reasons", F.lit(None).cast("string")).unionByName(rejected, allowMissingColumns=True)


READINGS = """asked AS (SELECT user_id, event_id AS request, ts + to_hours(CAST(event_id % 3 * 500 AS INTEGER)) AS at FROM events),
  readings AS (SELECT user_id, event_id AS seq, value, CASE WHEN event_id % 4 <> 0 THEN ts + to_minutes(CAST(event_id % 90 AS INTEGER)) END AS at, ts AS middle FROM events)"""


@suite.query(
    "nearest_measurement",
    f"""WITH {READINGS}, dated AS (SELECT a.request, r.seq, r.value, 0 AS kind, abs(epoch_us(r.at) - epoch_us(a.at)) AS gap
      FROM asked a JOIN readings r ON a.user_id = r.user_id AND abs(epoch_us(r.at) - epoch_us(a.at)) <= 21600000000),
    undated AS (SELECT a.request, r.seq, r.value, 1 AS kind, abs(epoch_us(r.middle) - epoch_us(a.at)) AS gap
      FROM asked a JOIN readings r ON a.user_id = r.user_id AND r.at IS NULL AND abs(epoch_us(r.middle) - epoch_us(a.at)) <= 21600000000),
    best AS (SELECT * FROM (SELECT * FROM dated UNION ALL SELECT * FROM undated) QUALIFY row_number() OVER (PARTITION BY request ORDER BY kind, gap, seq) = 1)
    SELECT a.request, b.seq, round(b.value + {NUDGE}, 6) AS value, b.kind = 1 AS undated FROM asked a LEFT JOIN best b ON a.request = b.request""",
)
def nearest_measurement(spark, sf_dir):
    """Every event asks, some long after all readings; every fourth reading has no time but the window of its response."""
    events = table(spark, sf_dir, "events")
    seq, at = F.col("event_id"), F.col("ts")
    asked = events.select("user_id", (at + F.make_dt_interval(hours=(seq % 3 * 500).cast("int"))).alias("collection_timestamp"), seq.alias("request"))
    dated = F.when(seq % 4 != 0, at + F.make_dt_interval(mins=(seq % 90).cast("int")))
    half = F.expr("INTERVAL 6 HOURS")
    measured = events.select(
        "user_id", dated.alias("collection_timestamp"), F.col("value"), seq.alias("seq"), (at - half).alias("window_from"), (at + half).alias("window_to"),
    )
    found = joins.nearest_measurement(asked, measured, ["user_id"])
    return found.select("request", "hit.seq", "hit.value", F.when(F.col("hit").isNotNull(), F.col("hit.collection_timestamp").isNull()).alias("undated"))


@suite.query(
    "nearest_hour",
    f"""WITH {HOURLY}, wanted AS (SELECT city, ingest_seq, collection_timestamp AS ts FROM sensor),
    entries AS (SELECT city, hour, aqi, last_seq FROM hourly WHERE last_seq % 4 <> 0),
    ranked AS (SELECT w.ingest_seq, e.hour, e.aqi, row_number() OVER (PARTITION BY w.ingest_seq ORDER BY
        CASE WHEN date_trunc('minute', w.ts) = date_trunc('minute', e.hour) THEN 0 ELSE 1 END, abs(epoch_us(e.hour) - epoch_us(w.ts)), e.hour) AS rn
      FROM wanted w JOIN entries e ON w.city = e.city AND CAST(w.ts AS DATE) = CAST(e.hour AS DATE))
    SELECT w.ingest_seq, r.hour, round(r.aqi + {NUDGE}, 6) AS aqi FROM wanted w LEFT JOIN ranked r ON w.ingest_seq = r.ingest_seq AND rn = 1""",
)
def nearest_hour(spark, sf_dir):
    entries = hourly(spark, sf_dir).filter(F.col("last_seq") % 4 != 0).select(
        "city", F.col("hour").alias("collection_timestamp"), "aqi", F.unix_timestamp("hour").alias("seq")
    )
    found = joins.nearest_hour(sensor(spark, sf_dir).select("city", "collection_timestamp", "ingest_seq"), entries)
    return found.select("ingest_seq", F.col("hit.collection_timestamp").alias("hour"), F.col("hit.aqi").alias("aqi"))


CANDIDATES = """candidates AS (SELECT * FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS sensor_rank
  FROM supplier) WHERE sensor_rank <= 5)"""


def candidates(spark, sf_dir):
    return joins.sensor_candidates(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_suppkey", "s_acctbal")


@suite.query("sensor_candidates", f"WITH {CANDIDATES} SELECT s_nationkey, s_suppkey, CAST(sensor_rank AS INTEGER) AS sensor_rank FROM candidates")
def sensor_candidates(spark, sf_dir):
    return candidates(spark, sf_dir).select("s_nationkey", "s_suppkey", "sensor_rank")


@suite.query(
    "first_sensor_with_data",
    f"""WITH {CANDIDATES}, requests AS (SELECT c_custkey AS request, c_nationkey AS s_nationkey,
      TIMESTAMP '1996-01-01' + to_days(CAST(c_custkey % 1500 AS INTEGER)) AS ts FROM customer),
    hits AS (SELECT r.request, r.s_nationkey, c.s_suppkey, c.sensor_rank, l_quantity, l_orderkey * 10 + l_linenumber AS seq,
        abs(epoch_us(l_shipdate) - epoch_us(r.ts)) AS gap
      FROM requests r JOIN candidates c ON r.s_nationkey = c.s_nationkey JOIN lineitem l ON l.l_suppkey = c.s_suppkey
      WHERE abs(epoch_us(l_shipdate) - epoch_us(r.ts)) <= 21600000000)
    SELECT s_nationkey, request, s_suppkey, CAST(sensor_rank AS INTEGER) AS sensor_rank, seq, round(l_quantity + 3.7e-10, 6) AS value FROM hits
    QUALIFY row_number() OVER (PARTITION BY request ORDER BY sensor_rank, gap, seq) = 1""",
)
def first_sensor_with_data(spark, sf_dir):
    day = F.col("c_custkey") % 1500
    requests = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request"), F.col("c_nationkey").alias("s_nationkey"),
        (F.lit("1996-01-01").cast("timestamp") + F.make_dt_interval(days=day.cast("int"))).alias("collection_timestamp"),
    )
    measured = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("s_suppkey"), F.col("l_shipdate").alias("collection_timestamp"),
        F.col("l_quantity").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    found = joins.first_sensor_with_data(requests, candidates(spark, sf_dir), measured, ["s_nationkey"], "s_suppkey", "request")
    return found.select("s_nationkey", "request", "s_suppkey", "sensor_rank", "hit.seq", "hit.value")


@suite.query(
    "sensor_observations",
    f"""SELECT o_orderkey, o_custkey, greatest({subindex_sql('q', 'pm2_5')}, {subindex_sql('(c / 1146)', 'co')}) AS aqi, round(q + 3.7e-10, 6) AS pm2_5, round(c + 3.7e-10, 6) AS co
    FROM (SELECT l_orderkey AS o_orderkey, any_value(o_custkey) AS o_custkey, max(l_quantity) AS q, max(l_extendedprice) AS c
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey)""",
)
def sensor_observations_query(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )

    def as_parameter(name, value, unit):
        return lines.select("o_orderkey", "o_custkey", F.lit(name).alias("parameter"), F.col(value).alias("value"), F.lit(unit).alias("unit"))

    both = as_parameter("pm25", "l_quantity", "µg/m³").unionByName(as_parameter("co", "l_extendedprice", "µg/m³"))
    wide = sensor_observations(both, ("o_orderkey", "o_custkey"))
    return wide.select("o_orderkey", "o_custkey", "aqi", "pm2_5", "co")


@suite.query(
    "incremental_anti",
    f"WITH {GRID}, {HOURLY} SELECT city, collection_timestamp FROM grid g "
    "WHERE NOT EXISTS (SELECT 1 FROM hourly h WHERE h.city = g.city AND h.hour = g.collection_timestamp AND h.last_seq % 4 <> 0)",
)
def incremental_anti(spark, sf_dir):
    stored = hourly(spark, sf_dir).filter(F.col("last_seq") % 4 != 0).select("city", F.col("hour").alias("collection_timestamp"))
    return joins.incremental_anti(grid(spark, sf_dir), stored)


PARTED = f"""{STATION}, parted AS (SELECT city, collection_timestamp, ingest_seq, aqi, month(collection_timestamp) AS m,
  collection_timestamp < TIMESTAMP '2000-01-01' AS old FROM station)"""


@suite.query(
    "seasonal_lookup",
    f"""WITH {PARTED}, means AS (SELECT city, m, avg(aqi) AS seasonal_month FROM parted WHERE old GROUP BY ALL)
    SELECT p.city, p.ingest_seq, CAST(p.m AS INTEGER) AS month, {rounded('seasonal_month')} FROM parted p
    LEFT JOIN means s ON p.city = s.city AND p.m = s.m WHERE NOT old""",
)
def seasonal_lookup(spark, sf_dir):
    rows = station(spark, sf_dir).withColumn("month", F.month("collection_timestamp"))
    old = F.col("collection_timestamp") < F.lit("2000-01-01").cast("timestamp")
    return joins.seasonal_lookup(rows.filter(~old), rows.filter(old), "aqi").select("city", "ingest_seq", "month", "seasonal_month")


WMO = "CASE WHEN code IS NULL THEN 'N/A' " + " ".join(f"WHEN code = {c} THEN '{t}'" for c, t in joins.WMO_CODES.items()) + " ELSE 'Unknown' END"


@suite.query("wmo_lookup", f"SELECT p_partkey, {WMO} AS weather FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN p_size * 2 - 1 END AS code FROM part)")
def wmo_lookup(spark, sf_dir):
    code = F.when(F.col("p_partkey") % 9 != 0, F.col("p_size") * 2 - 1)
    return table(spark, sf_dir, "part").select("p_partkey", joins.wmo_lookup(code).alias("weather"))


@suite.query(
    "forecast_daily",
    f"WITH {FORECAST} SELECT city, date, " + ", ".join(rnd(f"avg({v})", v) for v in S.FUTURE_VARS) + " FROM forecast WHERE wind IS NOT NULL GROUP BY city, date",
)
def forecast_daily(spark, sf_dir):
    return joins.forecast_daily(payloads.norm_weather_forecast(forecast_payloads(spark, sf_dir)))


ARCHIVE = "archive AS (SELECT city, CAST(collection_timestamp AS DATE) AS date, " + ", ".join(
    f"avg({c}) AS {v}" for v, c in joins.OBSERVED_AS.items()
) + " FROM sensor GROUP BY ALL)"


@suite.query("archive_day_means", f"WITH {SENSOR}, {ARCHIVE} SELECT city, date, {rounded(*S.FUTURE_VARS)} FROM archive")
def archive_day_means(spark, sf_dir):
    return joins.archive_day_means(sensor(spark, sf_dir))


def anchors(spark, sf_dir):
    """Anchor days two days before each series ends."""
    last = F.date_sub(F.to_date(F.max("collection_timestamp")), 2)
    return sensor(spark, sf_dir).groupBy("city").agg(last.alias("anchor"))


def future(spark, sf_dir):
    """Two days come from the archive, the third only from a forecast that
    repeats the weather of the first week thirty days later."""
    forecast = joins.forecast_daily(payloads.norm_weather_forecast(forecast_payloads(spark, sf_dir)))
    later = forecast.withColumn("date", F.date_add("date", 30))
    return joins.future_weather(anchors(spark, sf_dir), sensor(spark, sf_dir), later)


FUTURE = f"""{FORECAST}, {ARCHIVE}, anchors AS (SELECT city, CAST(max(collection_timestamp) AS DATE) - 2 AS anchor FROM sensor GROUP BY city),
  predicted AS (SELECT city, date + 30 AS date, {', '.join(f'avg({v}) AS {v}' for v in S.FUTURE_VARS)} FROM forecast WHERE wind IS NOT NULL GROUP BY ALL),
  targets AS (SELECT city, anchor, anchor + h AS date, h FROM anchors, (VALUES (1), (2), (3)) x(h)),
  future AS (SELECT t.city, t.anchor, t.h, t.date, {', '.join(f'CASE WHEN a.date IS NOT NULL THEN a.{v} ELSE p.{v} END AS {v}' for v in S.FUTURE_VARS)}
    FROM targets t LEFT JOIN archive a ON t.city = a.city AND t.date = a.date LEFT JOIN predicted p ON t.city = p.city AND t.date = p.date)"""


@suite.query("future_weather", f"WITH {FUTURE} SELECT city, date, {rounded(*S.FUTURE_VARS)} FROM future")
def future_weather(spark, sf_dir):
    return future(spark, sf_dir)


@suite.query(
    "override_anchor",
    f"""WITH {FUTURE}, days AS (SELECT city, date, {', '.join(S.FUTURE_VARS)},
      max(date) OVER (PARTITION BY city) AS newest FROM archive),
    known AS (SELECT d.city, d.date, d.newest, {', '.join(f'coalesce(lead({v}, {h}) OVER (PARTITION BY d.city ORDER BY d.date), {v}) AS fw_{v}{h}' for h in (1, 2, 3) for v in S.FUTURE_VARS)} FROM days d)
    SELECT k.city, CAST(k.date AS TIMESTAMP) AS collection_timestamp, {', '.join(rnd(f'CASE WHEN k.date = k.newest AND f{h}.city IS NOT NULL THEN f{h}.{v} ELSE fw_{v}{h} END', f'fw_{v}{h}') for h in (1, 2, 3) for v in S.FUTURE_VARS)}
    FROM known k {' '.join(f'LEFT JOIN future f{h} ON f{h}.city = k.city AND f{h}.date = k.newest + {h}' for h in (1, 2, 3))}""",
)
def override_anchor(spark, sf_dir):
    rows = daily.future_weather_lead(daily.daily_resample(sensor(spark, sf_dir)))
    names = [f"fw_{v}{h}" for _, h in S.HORIZONS for v in S.FUTURE_VARS]
    return daily.override_anchor(rows, future(spark, sf_dir)).select("city", "collection_timestamp", *names)


def datasets(spark, sf_dir):
    """Three overlapping datasets: all rows, raised rows, and live rows."""
    rows = sensor(spark, sf_dir).select("city", "collection_timestamp", "aqi", "ingest_seq")
    engineered = rows.filter(F.col("aqi") > 50).withColumns({"aqi": F.col("aqi") + 1, "pm2_5": F.col("aqi") / 2})
    live = rows.filter(F.col("aqi") > 150).withColumn("aqi", F.col("aqi") + 2)
    return rows, engineered, live


@suite.query(
    "union_datasets",
    f"""WITH {SENSOR} SELECT city, collection_timestamp, ingest_seq,
    round(CASE WHEN aqi > 150 THEN aqi + 2 WHEN aqi > 50 THEN aqi + 1 ELSE aqi END + {NUDGE}, 6) AS aqi,
    round(CASE WHEN aqi > 50 AND aqi <= 150 THEN aqi / 2 END + {NUDGE}, 6) AS pm2_5,
    CASE WHEN aqi > 150 THEN 'live' WHEN aqi > 50 THEN 'engineered' ELSE 'historical' END AS source_file FROM sensor""",
)
def union_datasets(spark, sf_dir):
    rows, engineered, live = datasets(spark, sf_dir)
    return joins.union_datasets([("historical", rows), ("engineered", engineered), ("live", live)])


@suite.query(
    "append_live",
    f"""WITH {SENSOR} SELECT city, collection_timestamp, ingest_seq, round(CASE WHEN aqi > 150 THEN aqi + 2 ELSE aqi END + {NUDGE}, 6) AS aqi,
    CASE WHEN aqi > 150 THEN 'live' ELSE 'stored' END AS source_file FROM sensor""",
)
def append_live(spark, sf_dir):
    rows, _, live = datasets(spark, sf_dir)
    too_short = rows.filter(F.col("aqi") < 0)
    return joins.append_live(too_short, rows, live)


LAST_SENSOR_DAY = "2024-01-15"


def ground_readings(spark, sf_dir):
    """(catalog, measurements): two particle sensors per series, the nearer one silent. The farther one has
    every 25th event of the first days, one response a day that was asked for six hours around it."""
    rows = sensor(spark, sf_dir)
    number = F.crc32(F.col("city").cast("binary")) * 10
    parameter = F.struct(F.lit(2).alias("id"), F.lit("pm25").alias("name"), F.lit("µg/m³").alias("units"))
    stations = F.array(*[
        F.struct(F.lit(i).alias("id"), F.lit("place").alias("name"), F.array(F.struct((number + i).alias("id"), F.lit("s").alias("name"), parameter.alias("parameter"))).alias("sensors"))
        for i in (1, 2)
    ])
    catalog = rows.select("city").distinct().select("city", F.to_json(F.struct(stations.alias("results"))).alias("payload"))
    at = F.date_format("collection_timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    reading = F.struct(at.alias("at"), "ingest_seq", F.col("pm2_5").alias("value"))
    found = rows.filter(f"ingest_seq % 25 = 0 AND collection_timestamp < '{LAST_SENSOR_DAY}'").groupBy("city", F.to_date("collection_timestamp").alias("day"))
    listed = found.agg(F.array_sort(F.collect_list(reading)).alias("r"))
    result = F.transform("r", lambda r: F.struct(r["value"].alias("value"), parameter.alias("parameter"), F.struct(F.struct(r["at"].alias("utc")).alias("datetimeFrom")).alias("period")))
    start = F.col("day").cast("timestamp")
    measured = listed.select(
        (number + 2).alias("sensor_id"), F.to_json(F.struct(result.alias("results"))).alias("payload"),
        (start - F.expr("INTERVAL 6 HOURS")).alias("window_from"), (start + F.expr("INTERVAL 30 HOURS")).alias("window_to"),
    )
    return catalog, measured


def archives(spark, sf_dir):
    """Daily weather and model documents of the hours that have readings, and ground sensors in the first days."""
    weather = {
        "temperature_2m": F.col("temperature"), "relative_humidity_2m": F.col("humidity"), "surface_pressure": F.col("pressure"),
        "wind_speed_10m": F.col("wind_speed"), "wind_direction_10m": F.col("wind_direction"), "cloud_cover": F.col("clouds"),
    }
    model = {"us_aqi": F.col("aqi"), "pm2_5": F.col("pm2_5")}

    def documents(fields):
        body = F.struct(F.lit(27.7).alias("latitude"), F.lit(68.8).alias("longitude"), F.struct("time", *fields).alias("hourly"))
        return day_arrays(spark, sf_dir, fields).select("city", F.col("day").alias("date"), F.to_json(body).alias("payload"))

    return Archives(documents(weather), *ground_readings(spark, sf_dir), documents(model))


@suite.query(
    "backfill",
    f"""WITH {HOURLY}, places AS (SELECT DISTINCT city FROM sensor),
    steps AS (SELECT city, TIMESTAMP '2024-01-01' + to_hours(CAST(h AS INTEGER)) AS hour FROM places, range(720) hours(h)),
    ground AS (SELECT city, date_trunc('second', collection_timestamp) AS at, ingest_seq, pm2_5,
        row_number() OVER (PARTITION BY city, CAST(collection_timestamp AS DATE) ORDER BY date_trunc('second', collection_timestamp), ingest_seq) AS seq
      FROM sensor WHERE ingest_seq % 25 = 0 AND collection_timestamp < TIMESTAMP '{LAST_SENSOR_DAY}'),
    near AS (SELECT s.city, s.hour, g.pm2_5 FROM steps s JOIN ground g ON g.city = s.city AND abs(epoch(g.at) - epoch(s.hour)) <= 21600
      QUALIFY row_number() OVER (PARTITION BY s.city, s.hour ORDER BY abs(epoch(g.at) - epoch(s.hour)), g.seq, g.at) = 1),
    days AS (SELECT DISTINCT city, CAST(hour AS DATE) AS day FROM hourly),
    chosen AS (SELECT s.city, s.hour, d.day IS NOT NULL AS weather, CASE WHEN n.city IS NOT NULL THEN '{payloads.AQ_SENSORS}' WHEN h.city IS NOT NULL THEN '{payloads.AQ_MODEL}' END AS source,
        CASE WHEN n.city IS NOT NULL THEN {subindex_sql('n.pm2_5', 'pm2_5')} ELSE h.aqi END AS aqi
      FROM steps s LEFT JOIN near n ON n.city = s.city AND n.hour = s.hour LEFT JOIN hourly h ON h.city = s.city AND h.hour = s.hour
      LEFT JOIN days d ON d.city = s.city AND d.day = CAST(s.hour AS DATE)),
    good AS (SELECT city, source, aqi FROM chosen WHERE weather AND source IS NOT NULL AND aqi IS NOT NULL),
    per_city AS (SELECT city, count(*) AS n, avg(aqi) AS aqi, string_agg(DISTINCT source, ', ' ORDER BY source) AS sources FROM good GROUP BY city)
    SELECT city, CAST(720 AS BIGINT) AS total_requested_steps, n AS successful_records, CAST(0 AS BIGINT) AS skipped_duplicates,
      720 - n AS error_count, sources AS aqi_source, CASE WHEN n = 720 THEN 'SUCCESS' ELSE 'PARTIAL' END AS status,
      n AS stored, {rounded('aqi')} FROM per_city""",
)
def backfill(spark, sf_dir):
    places = sensor(spark, sf_dir).select("city").distinct()
    store, bronze, audits = (scratch_path(spark, n) for n in ("store", "bronze", "audits"))
    audit = run_backfill(places, archives(spark, sf_dir), "2024-01-01", "2024-01-30", store, bronze, audits)
    stored = spark.read.parquet(store).groupBy("city").agg(F.count("*").alias("stored"), F.avg("aqi").alias("aqi"))
    return audit.select(
        "city", "total_requested_steps", "successful_records", "skipped_duplicates", "error_count", "aqi_source", "status"
    ).join(stored, "city")
