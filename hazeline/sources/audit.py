"""Run audit rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.operators.ordered import join_on

MAX_ERRORS = 20


def _sources(column: str) -> Column:
    joined = F.concat_ws(", ", F.array_sort(F.collect_set(F.when(F.col("status") == "new", F.col(column)))))
    return F.when(joined == "", "Unknown").otherwise(joined)


BACKFILL_FIELDS = (
    "run_start", "run_end", "execution_time_seconds", "pipeline_type", "city", "weather_source", "aqi_source",
    "interval_hours", "total_requested_steps", "successful_records", "skipped_duplicates", "error_count",
    "start_date", "end_date", "force_mode", "errors", "status",
)


def backfill_audit(
    steps: DataFrame, started: dt.datetime, ended: dt.datetime, start_date: str, end_date: str,
    interval_hours: int = 1, force: bool = False,
) -> DataFrame:
    """One audit row per city from per-step outcomes.

    `steps` has city, collection_timestamp, status (new, skipped or error),
    weather_source, aqi_source and error. Sources are distinct and sorted; the
    first 20 errors in time order are kept as text.
    """
    run = {
        "run_start": started.isoformat(), "run_end": ended.isoformat(),
        "execution_time_seconds": round((ended - started).total_seconds(), 2), "pipeline_type": "historical",
        "interval_hours": interval_hours, "start_date": start_date, "end_date": end_date, "force_mode": force,
    }
    counted = steps.groupBy("city").agg(
        _sources("weather_source").alias("weather_source"),
        _sources("aqi_source").alias("aqi_source"),
        F.count("*").alias("total_requested_steps"),
        F.count_if(F.col("status") == "new").alias("successful_records"),
        F.count_if(F.col("status") == "skipped").alias("skipped_duplicates"),
        F.count_if(F.col("status") == "error").alias("error_count"),
    )
    earliest = Window.partitionBy("city").orderBy(S.TIME, "error")
    when = F.date_format(S.TIME, "yyyy-MM-dd'T'HH:mm:ss")
    errors = (
        steps.filter(F.col("status") == "error")
        .withColumn("_n", F.row_number().over(earliest))
        .filter(F.col("_n") <= MAX_ERRORS)
        .groupBy("city")
        .agg(F.array_sort(F.collect_list(F.struct("_n", F.concat(F.lit("["), when, F.lit("] "), "error").alias("_e")))).alias("_l"))
        .select("city", F.col("_l._e").alias("errors"))
    )
    status = F.when(F.col("error_count") == 0, "SUCCESS").otherwise("PARTIAL")
    return join_on(counted, errors, ["city"], "left").withColumns(
        {
            "errors": F.coalesce("errors", F.array().cast("array<string>")), "status": status,
            **{name: F.lit(value) for name, value in run.items()},
        }
    ).select(*BACKFILL_FIELDS)


def live_audit(rows: DataFrame, run_time: Column) -> DataFrame:
    """One audit row per city for a live run: SUCCESS when a row was written."""
    good = F.col("problem").isNull()
    return rows.groupBy("city").agg(
        F.max("weather_source").alias("weather_source"),
        F.max("aqi_source").alias("aqi_source"),
        F.count_if(good).alias("records"),
        F.when(F.count_if(good) > 0, "SUCCESS").otherwise("FAILED").alias("status"),
        F.min(F.when(~good, F.col("problem"))).alias("error"),
    ).select(
        F.date_format(run_time, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("run_time"),
        "city", "weather_source", "aqi_source", "records", "status", "error",
    )


def union_audits(live: DataFrame, backfill: DataFrame) -> DataFrame:
    """Both audit shapes in one table, absent fields null."""
    return live.unionByName(backfill, allowMissingColumns=True)


def sink_run_audit(audit: DataFrame, path: str) -> None:
    audit.write.mode("append").json(path)


def latest_run_audit(docs: DataFrame) -> DataFrame:
    """The document with the greatest file name."""
    rest = docs.columns
    last = docs.agg(F.max_by(F.struct(*rest), "file_name").alias("_d"))
    return last.select("_d.*")
