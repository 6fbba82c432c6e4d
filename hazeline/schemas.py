"""Fixed column sets of the observation and feature tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Column order of one observation.
OBSERVATION_FIELDS = (
    "timestamp", "collection_timestamp", "city", "latitude", "longitude",
    "temperature", "feels_like", "humidity", "pressure", "wind_speed",
    "wind_direction", "clouds", "visibility", "weather", "aqi", "pm2_5",
    "pm10", "co", "so2", "no2", "o3", "weather_source", "aqi_source",
)
TEXT_FIELDS = ("timestamp", "collection_timestamp", "city", "weather", "weather_source", "aqi_source")

# Validation field lists.
REQUIRED_FIELDS = (
    "timestamp", "collection_timestamp", "city", "latitude", "longitude",
    "temperature", "humidity", "pressure", "wind_speed", "weather", "aqi", "pm2_5",
)
OPTIONAL_FIELDS = ("pm10", "co", "so2", "no2", "o3")
NUMERIC_FIELDS = (
    "latitude", "longitude", "temperature", "humidity", "pressure", "wind_speed",
    "wind_direction", "visibility", "clouds", "aqi", "pm2_5", "pm10", "co", "so2", "no2", "o3",
)
NON_NEGATIVE_FIELDS = (
    "humidity", "pressure", "wind_speed", "visibility", "aqi", "pm2_5",
    "pm10", "co", "so2", "no2", "o3",
)

SERIES = ("city",)
TIME = "collection_timestamp"
KEY = ("city", "collection_timestamp")

OBSERVATIONS = T.StructType(
    [
        T.StructField(name, T.StringType() if name in TEXT_FIELDS else T.DoubleType())
        for name in OBSERVATION_FIELDS
    ]
)

# Feature engineering.
SHORT_LAGS = (1, 2)
SEASONAL_LAGS = (24, 48, 72, 168)
LAGS = SHORT_LAGS + SEASONAL_LAGS
CHANGE_COLUMNS = ("aqi", "pm2_5", "pm10", "temperature", "humidity")
ROLLING_COLUMNS = ("aqi", "pm2_5", "pm10")
ROLLING_ROWS = {"24h": 24, "48h": 48}
HORIZON_ROWS = 72
COVERAGE_THRESHOLD = 0.90
CYCLES = {"hour": 24, "day_of_week": 7, "month": 12}


def model_features() -> list[str]:
    """Ordered whitelist of hourly model features, current AQI last."""
    lagged = ("aqi", "pm2_5", "temperature", "humidity")
    return [
        "temperature", "feels_like", "humidity", "pressure", "wind_speed", "wind_direction",
        "clouds", "pm2_5",
        *[f"{name}_{wave}" for name in CYCLES for wave in ("sin", "cos")],
        *[f"{name}_lag_{n}" for name in lagged for n in SHORT_LAGS],
        *[f"{name}_lag_{n}" for name in lagged for n in SEASONAL_LAGS],
        *[f"{name}_change_rate" for name in lagged],
        *[f"{name}_rolling_{stat}_{label}"
          for name in ("aqi", "pm2_5") for label in ROLLING_ROWS for stat in ("mean", "std")],
        "aqi",
    ]


# Daily forecasting.
HORIZONS = (("day1_avg", 1), ("day2_avg", 2), ("day3_avg", 3))
FUTURE_VARS = ("wind", "humid", "temp", "clouds", "pressure")
DAILY_AQI_LAGS = (1, 2, 3, 4, 5, 7, 10, 14)
DAILY_LAGGED = ("pm25", "temp", "wind", "humid")
DAILY_LAGS = (1, 2, 3)
DAILY_MEAN_DAYS = (3, 7, 14, 30)
DAILY_STD_DAYS = (7, 14)
DAILY_HELPERS = ("collection_timestamp", "aqi_max", "aqi_min", "aqi_std", "wind_max", "temp_max", "day")
