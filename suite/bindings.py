"""How the driver tables stand in for observation tables.

`events` is an hourly-style sensor table (one series per event type), `orders`
a daily-style one (one series per order status). Each binding is written twice,
as a DataFrame and as the SQL common table expression the oracles start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.session import pin_utc

DIGITS = 6
# Means of two-decimal values can lie exactly between two rounded values, where
# the last bit decides. Both sides add this offset first, so no value does. Zero
# is added after rounding because a rounded value may be a negative zero.
NUDGE = 3.7e-10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table with its zone-less timestamps read as UTC instants."""
    df = pin_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    instants = {f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"}
    return df.withColumns(instants) if instants else df


def sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observations."""
    return sensor_columns(table(spark, sf_dir, "events"))


def sensor_columns(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return events.select(
        F.col("event_type").alias("city"),
        F.col("ts").alias("collection_timestamp"),
        F.col("value").alias("aqi"),
        k.alias("pm2_5"),
        F.when(F.col("event_id") % 10 == 0, F.col("value")).alias("pm10"),
        (k * 0.4 - 5).alias("temperature"),
        (F.col("user_id") % 90 + 10).cast("double").alias("humidity"),
        (F.col("event_id") % 40 + 990).cast("double").alias("pressure"),
        (F.col("user_id") % 17).cast("double").alias("wind_speed"),
        (F.col("event_id") % 360).cast("double").alias("wind_direction"),
        (F.col("event_id") % 101).cast("double").alias("clouds"),
        (k * 0.5 - 6).alias("feels_like"),
        F.col("user_id"),
        F.col("event_id").alias("ingest_seq"),
    )


SENSOR = """sensor AS (
  SELECT event_type AS city, ts AS collection_timestamp, value AS aqi,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS pm2_5,
         CASE WHEN event_id % 10 = 0 THEN value END AS pm10,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) * 0.4::DOUBLE - 5 AS temperature,
         CAST(user_id % 90 + 10 AS DOUBLE) AS humidity,
         CAST(event_id % 40 + 990 AS DOUBLE) AS pressure,
         CAST(user_id % 17 AS DOUBLE) AS wind_speed,
         CAST(event_id % 360 AS DOUBLE) AS wind_direction,
         CAST(event_id % 101 AS DOUBLE) AS clouds,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) * 0.5::DOUBLE - 6 AS feels_like,
         user_id, event_id AS ingest_seq
  FROM events)"""


def station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as observations of several years."""
    return station_columns(table(spark, sf_dir, "orders"))


def station_as_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the stored time type, so that time filters reach the scan."""
    return station_columns(pin_utc(spark).read.parquet(f"{sf_dir}/orders.parquet"))


def station_columns(orders: DataFrame) -> DataFrame:
    price = F.col("o_totalprice")
    return orders.select(
        F.col("o_orderstatus").alias("city"),
        F.col("o_orderdate").alias("collection_timestamp"),
        (price / 1000).alias("aqi"),
        (price / 2500 + F.col("o_custkey") % 20).alias("pm2_5"),
        (F.col("o_custkey") % 30 + 5).cast("double").alias("temperature"),
        (F.col("o_orderkey") % 90 + 10).cast("double").alias("humidity"),
        (F.col("o_orderkey") % 40 + 990).cast("double").alias("pressure"),
        (F.col("o_custkey") % 17).cast("double").alias("wind_speed"),
        (F.col("o_orderkey") % 101).cast("double").alias("clouds"),
        F.col("o_orderpriority").alias("aqi_source"),
        F.col("o_orderkey").alias("ingest_seq"),
    )


STATION = """station AS (
  SELECT o_orderstatus AS city, o_orderdate AS collection_timestamp,
         o_totalprice / 1000 AS aqi, o_totalprice / 2500 + o_custkey % 20 AS pm2_5,
         CAST(o_custkey % 30 + 5 AS DOUBLE) AS temperature,
         CAST(o_orderkey % 90 + 10 AS DOUBLE) AS humidity,
         CAST(o_orderkey % 40 + 990 AS DOUBLE) AS pressure,
         CAST(o_custkey % 17 AS DOUBLE) AS wind_speed,
         CAST(o_orderkey % 101 AS DOUBLE) AS clouds,
         o_orderpriority AS aqi_source, o_orderkey AS ingest_seq
  FROM orders)"""


def tidy(df: DataFrame) -> DataFrame:
    """Oracle form of a result: zone-less timestamps, doubles to six places."""
    out = {}
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "double":
            out[f.name] = F.round(F.col(f.name) + F.lit(NUDGE), DIGITS) + F.lit(0.0)
        elif kind == "timestamp":
            out[f.name] = F.col(f.name).cast("timestamp_ntz")
    return df.withColumns(out) if out else df


def rounded(*names: str) -> str:
    """SQL select items that round to the same places."""
    return ", ".join(f"round({n} + {NUDGE}, {DIGITS}) + 0 AS {n}" for n in names)


class Suite:
    """Queries with their oracle SQL side by side."""

    def __init__(self) -> None:
        self.plain: dict = {}
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def register(fn):
            self.plain[name] = fn
            self.queries[name] = lambda spark, sf_dir: tidy(fn(pin_utc(spark), sf_dir))
            if sql is not None:
                self.oracles[name] = sql
            return fn

        return register
