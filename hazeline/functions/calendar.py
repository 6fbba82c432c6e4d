"""Calendar fields, cycles and interval alignment."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline import schemas as S


def to_utc(text: Column) -> Column:
    """Trimmed mixed-format timestamp text as an instant, null if unparseable."""
    return F.try_to_timestamp(F.trim(text.cast("string")))


def cycle(value: Column, period: float) -> tuple[Column, Column]:
    """(sin, cos) of a position on a cycle."""
    angle = F.lit(2 * math.pi) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def time_fields(df: DataFrame, ts: str = S.TIME) -> DataFrame:
    """hour, day_of_week (Monday 0), day_of_month and month of the instant."""
    at = F.col(ts)
    return df.withColumns(
        {
            "hour": F.hour(at),
            "day_of_week": F.weekday(at),
            "day_of_month": F.dayofmonth(at),
            "month": F.month(at),
        }
    )


def cyclical(df: DataFrame) -> DataFrame:
    """Sine and cosine of hour, weekday and month (month is not shifted to 0)."""
    added = {}
    for name, period in S.CYCLES.items():
        added[f"{name}_sin"], added[f"{name}_cos"] = cycle(F.col(name), period)
    return df.withColumns(added)


def align_interval(ts: Column, hours: int) -> Column:
    """Floor to a boundary of `hours` counted from midnight of the same day."""
    into_day = F.floor(F.hour(ts) / hours) * hours
    return F.date_trunc("day", ts) + F.make_dt_interval(hours=into_day.cast("int"))


def interval_grid(spans: DataFrame, start: str, end: str, hours: int, name: str = S.TIME) -> DataFrame:
    """One row per interval boundary from the aligned start through `end`.

    A span whose start is after its end is an error.
    """
    checked = F.when(F.col(start) > F.col(end), F.raise_error(F.lit("start is after end"))).otherwise(
        align_interval(F.col(start), hours)
    )
    steps = F.sequence(checked, F.col(end), F.make_dt_interval(hours=F.lit(hours)))
    return spans.withColumn(name, F.explode(steps)).drop(start, end)


def day_end(date_text: Column) -> Column:
    """End instant of a span: a date without a time means its last second."""
    parsed = to_utc(date_text)
    return F.when(
        F.contains(date_text, F.lit("T")), parsed
    ).otherwise(F.date_trunc("day", parsed) + F.make_dt_interval(hours=F.lit(23), mins=F.lit(59), secs=F.lit(59)))


def city_slug(city: Column) -> Column:
    return F.replace(F.lower(city), F.lit(" "), F.lit("_"))
