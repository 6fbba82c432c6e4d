"""The resumable historical backfill as one Spark job over payload tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.functions.calendar import day_end, interval_grid, to_utc
from hazeline.operators.joins import (
    WINDOW, WINDOW_HOURS, bronze_records, first_sensor_with_data, incremental_anti, nearest_hour, sensor_candidates, source_fallback,
)
from hazeline.operators.ordered import join_on
from hazeline.operators.validate import VIOLATIONS, with_violations
from hazeline.session import materialize
from hazeline.sources import payloads
from hazeline.sources.audit import backfill_audit, sink_run_audit
from hazeline.sources.tables import read_stored, sink_append, sink_bronze_json

@dataclass
class Archives:
    """Payload tables, one JSON document per row.

    weather and model have city, date and payload; catalog has city and
    payload; measurements has sensor_id and payload, and may have window_from and
    window_to, the time its response was asked for.
    """

    weather: DataFrame
    catalog: DataFrame
    measurements: DataFrame
    model: DataFrame


def _weather(wanted: DataFrame, archive: DataFrame) -> DataFrame:
    """Weather of each requested hour, `problem` when there is none."""
    documents = join_on(archive, wanted.select("city", F.to_date(S.TIME).alias("date")).distinct(), ["city", "date"])
    hours = payloads.norm_weather_hourly(documents.drop("date"))
    usable = hours.filter(F.col("problem").isNull()).drop("problem")
    found = nearest_hour(wanted, usable)
    kept = [c for c in usable.columns if c not in (*S.KEY, "seq")]
    return found.select(
        *S.KEY, *[F.col("hit")[c].alias(c) for c in kept], F.when(F.col("hit").isNull(), "no weather").alias("problem")
    )


def _ground(wanted: DataFrame, archives: Archives) -> DataFrame:
    """Sensor observations of the requested hours that have any reading."""
    sensors = payloads.norm_sensor_catalog(archives.catalog)
    nearest = sensor_candidates(sensors, ["city", "parameter"], "sensor_id", "proximity")
    measured = payloads.norm_sensor_measurements(archives.measurements).drop("parameter")
    asked = wanted.select(
        *S.KEY, F.col(S.TIME).alias("request"),
        F.explode(F.array(*[F.lit(p) for p in payloads.STATION_POLLUTANTS])).alias("parameter"),
    )
    readings = first_sensor_with_data(asked, nearest, measured, ["city", "parameter"], "sensor_id", "request")
    flat = readings.select("city", S.TIME, "parameter", "hit.value", "hit.unit")
    return payloads.sensor_observations(flat).withColumn("problem", F.lit(None).cast("string"))


def _model(wanted: DataFrame, archive: DataFrame) -> DataFrame:
    """Model estimates of the requested hours that have a document, `problem` where it lacks the hour.

    Documents are parsed once, to hours; an hour that one names twice counts as it stands first.
    """
    dated = wanted.withColumns({"date": F.to_date(S.TIME), "hour": F.date_format(S.TIME, "yyyy-MM-dd'T'HH:'00'")})
    days = archive.select("city", "date").distinct()
    asked = join_on(dated, days.withColumn("_there", F.lit(True)), ["city", "date"]).drop("_there")
    hours = payloads.norm_aq_model_days(archive)
    values = [c for c in hours.columns if c not in ("city", "date", "hour", "seq")]
    first = hours.groupBy("city", "date", "hour").agg(F.min_by(F.struct(*values), "seq").alias("_e"))
    found = join_on(asked, first, ["city", "date", "hour"], "left")
    problem = F.when(F.col("_e").isNull(), "missing matching hour")
    return found.select(*S.KEY, *[F.col("_e")[c].alias(c) for c in values], problem.alias("problem"))


def _within(archives: Archives, start: Column, end: Column) -> Archives:
    """The archives of a span of time: documents by day, responses by their window and the hours around a request."""
    first, last = F.to_date(start), F.to_date(end)
    measured = archives.measurements
    if set(WINDOW) <= set(measured.columns):
        around = F.make_dt_interval(hours=F.lit(WINDOW_HOURS))
        unknown = F.col(WINDOW[0]).isNull() | F.col(WINDOW[1]).isNull()
        measured = measured.filter(unknown | ((F.col(WINDOW[1]) >= start - around) & (F.col(WINDOW[0]) <= end + around)))
    day = F.col("date").between(first, last)
    return Archives(archives.weather.filter(day), archives.catalog, measured, archives.model.filter(day))


def run_backfill(
    places: DataFrame, archives: Archives, start_date: str, end_date: str, store: str, bronze: str, audits: str,
    hours: int = 1, force: bool = False,
) -> DataFrame:
    """Collect the missing hours of every place and return the audit rows.

    Hours already in `store` are skipped unless `force`; sensors outrank the
    model; invalid records are refused; what is written is valid. Rerunning
    after a stop takes up the hours that are still missing.
    """
    spark, started = places.sparkSession, dt.datetime.now(dt.timezone.utc)
    span = places.select("city", to_utc(F.lit(start_date)).alias("_from"), day_end(F.lit(end_date)).alias("_to"))
    grid = interval_grid(span, "_from", "_to", hours)
    stored = read_stored(spark, store, "parquet")
    known = grid.limit(0) if stored is None else stored.select(*S.KEY).distinct()
    wanted = materialize(incremental_anti(grid, known, force=force), "wanted")

    archives = _within(archives, to_utc(F.lit(start_date)), day_end(F.lit(end_date)))
    weather = materialize(_weather(wanted, archives.weather), "weather")
    chosen, rejected = source_fallback(
        [
            (payloads.AQ_SENSORS, _first_of(_ground(wanted, archives))),
            (payloads.AQ_MODEL, _first_of(_model(wanted, archives.model))),
        ],
        order="_once",
    )
    usable = weather.filter(F.col("problem").isNull()).drop("problem")
    paired = bronze_records(usable, chosen.drop("source").withColumnRenamed("aqi_source", "source"))
    checked = materialize(with_violations(paired.select("weather_raw", "aqi_raw", "merged.*"), F.current_timestamp()), "checked")
    valid = checked.filter(F.size(VIOLATIONS) == 0).select(*S.OBSERVATION_FIELDS)

    steps = materialize(_outcomes(grid, wanted, weather, checked, rejected), "steps")
    if not valid.isEmpty():
        # The store is what a rerun skips by, so it comes last.
        sink_bronze_json(_bronze(checked), bronze)
        sink_append(valid, store)
    audit = backfill_audit(steps, started, dt.datetime.now(dt.timezone.utc), start_date, end_date, hours, force)
    sink_run_audit(audit, audits)
    return audit


def _first_of(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_once", F.lit(0))


def _bronze(checked: DataFrame) -> DataFrame:
    good = checked.filter(F.size(VIOLATIONS) == 0)
    return good.select(*S.KEY, "weather_raw", "aqi_raw", F.struct(*S.OBSERVATION_FIELDS).alias("merged"))


def _outcomes(grid: DataFrame, wanted: DataFrame, weather: DataFrame, checked: DataFrame, rejected: DataFrame) -> DataFrame:
    """Per grid hour: new, skipped or error with its reason."""
    keys: Sequence[str] = list(S.KEY)
    asked = join_on(grid, wanted.withColumn("_asked", F.lit(True)), keys, "left")
    with_weather = join_on(asked, weather.select(*keys, F.col("problem").alias("_weather")), keys, "left")
    with_aqi = join_on(with_weather, rejected.withColumnRenamed("reasons", "_aqi"), keys, "left")
    record = checked.select(*keys, "weather_source", "aqi_source", F.concat_ws(", ", VIOLATIONS).alias("_bad"))
    full = join_on(with_aqi, record, keys, "left")
    reason = F.coalesce(
        F.col("_weather"), F.nullif(F.col("_aqi"), F.lit("")), F.nullif(F.col("_bad"), F.lit("")),
        F.when(F.col("_bad").isNull(), "no air-quality source"),
    )
    status = F.when(F.col("_asked").isNull(), "skipped").when(reason.isNull(), "new").otherwise("error")
    return full.select(*keys, status.alias("status"), "weather_source", "aqi_source", reason.alias("error"))
