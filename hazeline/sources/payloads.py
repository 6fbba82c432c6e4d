"""Provider payloads (JSON text) to standard columns.

Each function takes a frame with a `payload` column plus whatever identifies
the request (such as city, latitude, longitude, requested) and adds standard
columns and `problem`: null for a usable record, else why it was refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.functions.calendar import to_utc
from hazeline.functions.indices import epa_aqi, unit_conversion
from hazeline.operators.joins import wmo_lookup

# Provider labels kept with every record.
WEATHER_CURRENT = "OpenWeather"
WEATHER_HOURLY = "Open-Meteo Archive"
AQ_STATION_CITY = "AQICN-city"
AQ_STATION_GEO = "AQICN-geo"
AQ_COMPONENTS = "OpenWeather-AirPollution"
AQ_SENSORS = "OpenAQ-v3"
AQ_MODEL = "OpenMeteo-AirQuality"

# Payload shapes.
CURRENT_SCHEMA = (
    "coord struct<lat:double,lon:double>, weather array<struct<description:string>>,"
    "main struct<temp:double,feels_like:double,humidity:double,pressure:double>, visibility double,"
    "wind struct<speed:double,deg:double>, clouds struct<all:double>,"
    "sys struct<sunrise:bigint,sunset:bigint>, name string"
)
HOURLY_FIELDS = {
    "temperature_2m": "temperature", "apparent_temperature": "feels_like", "relative_humidity_2m": "humidity",
    "surface_pressure": "pressure", "wind_speed_10m": "wind_speed", "wind_direction_10m": "wind_direction",
    "cloud_cover": "clouds", "precipitation": "precipitation", "visibility": "visibility",
}
HOURLY_REQUIRED = (
    "temperature_2m", "relative_humidity_2m", "surface_pressure", "wind_speed_10m", "wind_direction_10m", "cloud_cover",
)
HOURLY_SCHEMA = (
    "latitude double, longitude double, hourly struct<time:array<string>,weather_code:array<int>,"
    + ",".join(f"{name}:array<double>" for name in HOURLY_FIELDS)
    + ">"
)
FORECAST_SCHEMA = (
    "city struct<name:string,coord:struct<lat:double,lon:double>>,"
    "list array<struct<dt:bigint,main:struct<temp:double,humidity:double,pressure:double>,"
    "wind:struct<speed:double>,clouds:struct<all:double>>>"
)
STATION_POLLUTANTS = {"pm25": "pm2_5", "pm10": "pm10", "co": "co", "so2": "so2", "no2": "no2", "o3": "o3"}
STATION_SCHEMA = (
    "status string, data struct<aqi:double,city:struct<name:string,geo:array<double>>,iaqi:struct<"
    + ",".join(f"{name}:struct<v:double>" for name in STATION_POLLUTANTS)
    + ">>"
)
COMPONENTS_SCHEMA = (
    "coord struct<lat:double,lon:double>, list array<struct<main:struct<aqi:double>,components:struct<"
    + ",".join(f"{name}:double" for name in STATION_POLLUTANTS.values())
    + ">>>"
)
MODEL_SCHEMA = (
    "latitude double, longitude double, hourly struct<time:array<string>,us_aqi:array<double>,pm2_5:array<double>>"
)
CATALOG_SCHEMA = (
    "results array<struct<id:bigint,name:string,sensors:array<struct<id:bigint,name:string,"
    "parameter:struct<id:bigint,name:string,units:string>>>>>"
)
MEASUREMENT_SCHEMA = (
    "results array<struct<value:double,parameter:struct<id:bigint,name:string,units:string>,"
    "period:struct<datetimeFrom:string>>>"
)


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    return raw.withColumn("_p", F.from_json("payload", schema)).drop("payload")


def _default(raw: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in raw.columns else F.lit(None).cast(kind)


def _finish(raw: DataFrame, parsed: DataFrame, columns: dict[str, Column], required: dict[str, Column]) -> DataFrame:
    kept = [c for c in raw.columns if c not in ("payload", *columns)]
    problem = F.coalesce(*[F.when(value.isNull(), f"missing {name}") for name, value in required.items()])
    return parsed.select(*kept, *[c.alias(n) for n, c in columns.items()], problem.alias("problem"))


def norm_weather_current(raw: DataFrame) -> DataFrame:
    """Nested current-weather object; the first weather description is used."""
    parsed = _parsed(raw, CURRENT_SCHEMA)
    p = F.col("_p")
    columns = {
        "city": F.coalesce(p["name"], _default(raw, "city", "string")),
        "latitude": p["coord"]["lat"],
        "longitude": p["coord"]["lon"],
        "temperature": p["main"]["temp"],
        "feels_like": p["main"]["feels_like"],
        "humidity": p["main"]["humidity"],
        "pressure": p["main"]["pressure"],
        "visibility": p["visibility"],
        "wind_speed": p["wind"]["speed"],
        "wind_direction": p["wind"]["deg"],
        "clouds": p["clouds"]["all"],
        "sunrise": p["sys"]["sunrise"],
        "sunset": p["sys"]["sunset"],
        "weather": F.get(p["weather"], F.lit(0))["description"],
        "source": F.lit(WEATHER_CURRENT),
    }
    needed = {n: columns[n] for n in ("latitude", "longitude", "temperature", "humidity", "pressure")}
    return _finish(raw, parsed, columns, needed)


def norm_weather_hourly(raw: DataFrame) -> DataFrame:
    """Parallel hourly arrays to one row per hour, in payload order (`seq`).

    Optional arrays may be absent or short; their values are then null.
    """
    parsed = _parsed(raw, HOURLY_SCHEMA)
    hourly = F.col("_p")["hourly"]
    whole = F.coalesce(*[F.when(hourly[f].isNull(), f"missing {f}") for f in ("time", *HOURLY_REQUIRED)])
    names = ["time", "weather_code", *HOURLY_FIELDS]
    empty = {"time": "array<string>", "weather_code": "array<int>"}
    zipped = F.arrays_zip(
        *[F.coalesce(hourly[n], F.array().cast(empty.get(n, "array<double>"))).alias(n) for n in names]
    )
    rows = parsed.select(
        *[c for c in parsed.columns if c != "_p"],
        F.coalesce(F.col("_p")["latitude"], _default(raw, "latitude", "double")).alias("_lat"),
        F.coalesce(F.col("_p")["longitude"], _default(raw, "longitude", "double")).alias("_lon"),
        whole.alias("_whole"),
        F.posexplode_outer(zipped).alias("seq", "_h"),
    )
    h = F.col("_h")
    columns = {
        S.TIME: to_utc(h["time"]),
        "latitude": F.col("_lat"),
        "longitude": F.col("_lon"),
        **{name: h[field] for field, name in HOURLY_FIELDS.items()},
        "weather": wmo_lookup(h["weather_code"]),
        "source": F.lit(WEATHER_HOURLY),
    }
    kept = [c for c in raw.columns if c not in ("payload", *columns)]
    late = F.when(columns[S.TIME].isNull(), "missing time")
    return rows.select(
        *kept, "seq", *[c.alias(n) for n, c in columns.items()], F.coalesce("_whole", late).alias("problem")
    )


def norm_weather_forecast(raw: DataFrame) -> DataFrame:
    """Three-hourly forecast entries with their UTC date."""
    parsed = _parsed(raw, FORECAST_SCHEMA)
    p = F.col("_p")
    return (
        parsed.select(
            F.coalesce(p["city"]["name"], _default(raw, "city", "string")).alias("city"),
            p["city"]["coord"]["lat"].alias("latitude"),
            p["city"]["coord"]["lon"].alias("longitude"),
            F.explode(p["list"]).alias("_e"),
        )
        .select(
            "city", "latitude", "longitude",
            F.timestamp_seconds("_e.dt").alias(S.TIME),
            F.to_date(F.timestamp_seconds("_e.dt")).alias("date"),
            F.col("_e.wind.speed").alias("wind"),
            F.col("_e.main.humidity").alias("humid"),
            F.col("_e.main.temp").alias("temp"),
            F.col("_e.clouds.all").alias("clouds"),
            F.col("_e.main.pressure").alias("pressure"),
        )
    )


def norm_aq_station(raw: DataFrame, label: str = AQ_STATION_CITY) -> DataFrame:
    """Station payload: status must be ok, pollutants sit under `iaqi.<name>.v`.

    In the error form `data` is text; it then parses to null.
    """
    parsed = _parsed(raw, STATION_SCHEMA)
    data = F.col("_p")["data"]
    geo = data["city"]["geo"]
    columns = {
        "city": F.coalesce(data["city"]["name"], _default(raw, "city", "string")),
        "latitude": F.coalesce(F.get(geo, F.lit(0)), _default(raw, "latitude", "double")),
        "longitude": F.coalesce(F.get(geo, F.lit(1)), _default(raw, "longitude", "double")),
        "aqi": data["aqi"],
        **{name: data["iaqi"][field]["v"] for field, name in STATION_POLLUTANTS.items()},
        "source": F.lit(label),
    }
    ok = F.when(F.col("_p")["status"] == "ok", True)
    return _finish(raw, parsed, columns, {"status ok": ok, "aqi": columns["aqi"]})


def norm_aq_components(raw: DataFrame) -> DataFrame:
    """First entry of a components payload; its 1-5 AQI is kept as it is."""
    parsed = _parsed(raw, COMPONENTS_SCHEMA)
    p = F.col("_p")
    entry = F.get(p["list"], F.lit(0))
    columns = {
        "city": _default(raw, "city", "string"),
        "latitude": F.coalesce(p["coord"]["lat"], _default(raw, "latitude", "double")),
        "longitude": F.coalesce(p["coord"]["lon"], _default(raw, "longitude", "double")),
        "aqi": entry["main"]["aqi"],
        **{name: entry["components"][name] for name in STATION_POLLUTANTS.values()},
        "source": F.lit(AQ_COMPONENTS),
    }
    return _finish(raw, parsed, columns, {"list": entry, "components": entry["components"], "aqi": columns["aqi"]})


def norm_aq_model_hourly(raw: DataFrame) -> DataFrame:
    """Model estimate at exactly the requested hour.

    Only AQI and PM2.5 are kept; the other pollutants are null so that their
    presence never stands in for the provider.
    """
    parsed = _parsed(raw, MODEL_SCHEMA)
    hourly = F.col("_p")["hourly"]
    wanted = F.date_format("requested", "yyyy-MM-dd'T'HH:'00'")
    place = F.nullif(F.array_position(hourly["time"], wanted), F.lit(0)).cast("int")

    def at(name: str) -> Column:
        return F.get(hourly[name], place - 1)

    columns = {
        "latitude": F.coalesce(F.col("_p")["latitude"], _default(raw, "latitude", "double")),
        "longitude": F.coalesce(F.col("_p")["longitude"], _default(raw, "longitude", "double")),
        "aqi": at("us_aqi"),
        "pm2_5": at("pm2_5"),
        **{name: F.lit(None).cast("double") for name in S.OPTIONAL_FIELDS},
        "source": F.lit(AQ_MODEL),
    }
    return _finish(raw, parsed, columns, {"matching hour": place})


def norm_aq_model_days(raw: DataFrame) -> DataFrame:
    """Model estimates of all hours of a document, in payload order (`seq`), each named by its text in `hour`.

    What `norm_aq_model_hourly` gives for one requested hour, the document parsed once for all.
    """
    parsed = _parsed(raw, MODEL_SCHEMA)
    hourly = F.col("_p")["hourly"]
    names = {"time": "string", "us_aqi": "double", "pm2_5": "double"}
    zipped = F.arrays_zip(*[F.coalesce(hourly[n], F.array().cast(f"array<{kind}>")).alias(n) for n, kind in names.items()])
    kept = [c for c in raw.columns if c not in ("payload", "latitude", "longitude")]
    rows = parsed.select(
        *kept, F.coalesce(F.col("_p")["latitude"], _default(raw, "latitude", "double")).alias("latitude"),
        F.coalesce(F.col("_p")["longitude"], _default(raw, "longitude", "double")).alias("longitude"), F.posexplode(zipped).alias("seq", "_h"),
    )
    return rows.filter(F.col("_h.time").isNotNull()).select(
        *kept, "seq", F.col("_h.time").alias("hour"), "latitude", "longitude", F.col("_h.us_aqi").alias("aqi"), F.col("_h.pm2_5").alias("pm2_5"),
        *[F.lit(None).cast("double").alias(n) for n in S.OPTIONAL_FIELDS], F.lit(AQ_MODEL).alias("source"),
    )


def norm_sensor_catalog(raw: DataFrame) -> DataFrame:
    """Stations to sensors of the target parameters, `proximity` = payload order."""
    stations = _parsed(raw, CATALOG_SCHEMA).select(
        *[c for c in raw.columns if c != "payload"], F.posexplode(F.col("_p")["results"]).alias("_i", "_s")
    )
    sensors = stations.select(
        *[c for c in raw.columns if c != "payload"], "_i", F.col("_s.id").alias("location_id"),
        F.posexplode("_s.sensors").alias("_j", "_x"),
    )
    order = F.col("_i").cast("long") * F.lit(2**31) + F.col("_j")
    return sensors.select(
        *[c for c in raw.columns if c != "payload"], "location_id",
        F.col("_x.id").alias("sensor_id"), F.col("_x.parameter.name").alias("parameter"),
        order.alias("proximity"),
    ).filter(F.col("parameter").isin(*STATION_POLLUTANTS))


def norm_sensor_measurements(raw: DataFrame) -> DataFrame:
    """Measurement rows; the period start is either text or an object with `utc`."""
    rows = _parsed(raw, MEASUREMENT_SCHEMA).select(
        *[c for c in raw.columns if c != "payload"], F.posexplode(F.col("_p")["results"]).alias("seq", "_r")
    )
    start = F.col("_r.period.datetimeFrom")
    text = F.when(F.startswith(F.trim(start), F.lit("{")), F.get_json_object(start, "$.utc")).otherwise(start)
    return rows.select(
        *[c for c in raw.columns if c != "payload"], "seq",
        F.col("_r.parameter.name").alias("parameter"),
        F.col("_r.value").alias("value"),
        F.coalesce(F.col("_r.parameter.units"), F.lit("")).alias("unit"),
        to_utc(text).alias(S.TIME),
    )


def sensor_observations(readings: DataFrame, keys: tuple[str, ...] = S.KEY) -> DataFrame:
    """One reading per (key, parameter) to pollutant columns and their AQI.

    Stored concentrations stay raw; gases are converted only for the index. A
    row with readings but no index keeps a null AQI, so it still outranks a
    later source and is refused by validation.
    """
    wide = readings.groupBy(*keys).agg(
        *[F.max(F.when(F.col("parameter") == p, F.col("value"))).alias(n) for p, n in STATION_POLLUTANTS.items()],
        *[F.max(F.when(F.col("parameter") == p, F.col("unit"))).alias(f"_unit_{n}") for p, n in STATION_POLLUTANTS.items()],
    )
    gases = ("co", "so2", "no2", "o3")
    index = epa_aqi(
        pm2_5=F.col("pm2_5"), pm10=F.col("pm10"),
        **{g: unit_conversion(F.col(g), F.col(f"_unit_{g}"), g) for g in gases},
    )
    return wide.select(*keys, index.alias("aqi"), *STATION_POLLUTANTS.values(), F.lit(AQ_SENSORS).alias("source"))
