"""Unit conversion, air-quality indices, bands, trends and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mass per volume to ppm (CO) or ppb (others).
MASS_UNIT = "µg"
MASS_DIVISORS = {"co": 1146.0, "so2": 2.62, "no2": 1.88, "o3": 1.96}

# US EPA breakpoints as (concentration low, high, index low, high).
EPA_BREAKPOINTS = {
    "pm2_5": (
        (0.0, 12.0, 0, 50), (12.1, 35.4, 51, 100), (35.5, 55.4, 101, 150),
        (55.5, 150.4, 151, 200), (150.5, 250.4, 201, 300), (250.5, 500.4, 301, 500),
    ),
    "pm10": (
        (0, 54, 0, 50), (55, 154, 51, 100), (155, 254, 101, 150),
        (255, 354, 151, 200), (355, 424, 201, 300), (425, 604, 301, 500),
    ),
    "co": (
        (0.0, 4.4, 0, 50), (4.5, 9.4, 51, 100), (9.5, 12.4, 101, 150),
        (12.5, 15.4, 151, 200), (15.5, 30.4, 201, 300), (30.5, 50.4, 301, 500),
    ),
    "so2": (
        (0, 35, 0, 50), (36, 75, 51, 100), (76, 185, 101, 150),
        (186, 304, 151, 200), (305, 604, 201, 300), (605, 1004, 301, 500),
    ),
    "no2": (
        (0, 53, 0, 50), (54, 100, 51, 100), (101, 360, 101, 150),
        (361, 649, 151, 200), (650, 1249, 201, 300), (1250, 2049, 301, 500),
    ),
    "o3": (
        (0, 54, 0, 50), (55, 70, 51, 100), (71, 85, 101, 150),
        (86, 105, 151, 200), (106, 200, 201, 300),
    ),
}

# Reference concentrations of the composite index.
POLLUTION_REFERENCE = {"pm2_5": 35.4, "pm10": 154.0, "co": 9.4, "so2": 75.0, "no2": 100.0, "o3": 70.0}

# AQI bands as (upper bound, label, colour).
AQI_BANDS = (
    (50, "Good", "#16a34a"),
    (100, "Moderate", "#ca8a04"),
    (150, "Unhealthy for sensitive groups", "#ea580c"),
    (200, "Unhealthy", "#dc2626"),
    (300, "Very unhealthy", "#9333ea"),
    (float("inf"), "Hazardous", "#7f1d1d"),
)
ALERT_FROM = 150
STABLE_WITHIN = 2.0


def unit_conversion(value: Column, unit: Column, pollutant: str) -> Column:
    """Concentration in the unit the index expects; the stored value stays raw."""
    by_mass = F.coalesce(F.contains(unit, F.lit(MASS_UNIT)), F.lit(False))
    return F.when(by_mass, value / F.lit(MASS_DIVISORS[pollutant])).otherwise(value)


def epa_subindex(concentration: Column, pollutant: str) -> Column:
    """Piecewise-linear index, rounded half to even.

    Concentrations between two intervals or above the table have no index.
    """
    chain = None
    for c_low, c_high, i_low, i_high in EPA_BREAKPOINTS[pollutant]:
        slope = (i_high - i_low) / (c_high - c_low)
        index = F.rint(F.lit(slope) * (concentration - F.lit(float(c_low))) + F.lit(float(i_low))).cast("int")
        inside = concentration.between(float(c_low), float(c_high))
        chain = F.when(inside, index) if chain is None else chain.when(inside, index)
    return chain


def epa_aqi(**concentrations: Column) -> Column:
    """Largest available sub-index, null when there is none.

    Concentrations are keyed by pollutant: µg/m³ for particles, ppm for CO and
    ppb for the other gases.
    """
    indices = [epa_subindex(value, name) for name, value in concentrations.items()]
    return indices[0] if len(indices) == 1 else F.greatest(*indices)


def available_pollutants(df: DataFrame) -> list[str]:
    """Pollutant columns of the composite index that hold any data (one aggregate)."""
    present = [c for c in POLLUTION_REFERENCE if c in df.columns]
    if not present:
        return []
    counts = df.agg(*[F.count(c).alias(c) for c in present]).first()
    return [c for c in present if counts[c] > 0]


def pollution_index(available: Sequence[str]) -> Column:
    """Mean of concentration over reference across the pollutants a row has.

    With fewer than two available pollutants the index would repeat a single
    column, so it is null.
    """
    if len(available) < 2:
        return F.lit(None).cast("double")
    ratios = [F.col(c).cast("double") / F.lit(POLLUTION_REFERENCE[c]) for c in available]
    total, count = F.lit(0.0), F.lit(0)
    for ratio in ratios:
        total = total + F.coalesce(ratio, F.lit(0.0))
        count = count + ratio.isNotNull().cast("int")
    return F.try_divide(total, count)


def aqi_category(aqi: Column, field: str = "label") -> Column:
    """Band label (or `colour`) of an AQI value; null for null."""
    place = {"label": 1, "colour": 2}[field]
    chain = F.when(aqi.isNull(), F.lit(None).cast("string"))
    for band in AQI_BANDS[:-1]:
        chain = chain.when(aqi <= band[0], band[place])
    return chain.otherwise(AQI_BANDS[-1][place])


def trend_delta(value: Column, baseline: Column, stable_within: float = STABLE_WITHIN) -> Column:
    """Direction of value against baseline; null when either is missing."""
    delta = value - baseline
    return (
        F.when(F.abs(delta) < stable_within, "Stable")
        .when(delta > 0, "Increasing")
        .when(delta <= 0, "Decreasing")
    )


def alert_level(aqi: Column) -> Column:
    """Band label from 150 upwards, else null."""
    return F.when(aqi >= ALERT_FROM, aqi_category(aqi))


def numeric_coerce(value: Column) -> Column:
    return value.try_cast("double")


def clip_percent(value: Column) -> Column:
    """Clamp to 0..100, keeping null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0)))


def nan_to_null(df: DataFrame) -> DataFrame:
    """One missing marker: NaN becomes null at the read boundary."""
    fixed = {
        f.name: F.when(~F.isnan(f.name), F.col(f.name))
        for f in df.schema.fields
        if f.dataType.typeName() in ("double", "float")
    }
    return df.withColumns(fixed) if fixed else df
