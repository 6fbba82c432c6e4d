"""Reproducible forecast error for future-weather features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.functions.indices import clip_percent

# Error of day 1 and growth per further day, by variable.
FORECAST_NOISE = {
    "wind": (0.8, 0.4),
    "humid": (5.0, 3.0),
    "temp": (1.0, 0.5),
    "clouds": (10.0, 5.0),
    "pressure": (1.0, 0.5),
}
PERCENT_VARS = ("humid", "clouds")


def _uniform(*parts: Column | str | int) -> Column:
    """A value in (0, 1] that depends only on `parts`, not on partitioning: the first 48 bits of their md5."""
    columns = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digits = F.substring(F.md5(F.concat_ws("|", *columns)), 1, 12)
    return (F.conv(digits, 16, 10).cast("long") + 1) / F.lit(float(2**48))


def standard_normal(*parts: Column | str | int) -> Column:
    """Box-Muller over two hashes of `parts`."""
    radius = F.sqrt(F.lit(-2.0) * F.log(_uniform(*parts, "radius")))
    return radius * F.cos(F.lit(2 * math.pi) * _uniform(*parts, "angle"))


def forecast_noise(daily: DataFrame, max_horizon: int, seed: int = 42) -> DataFrame:
    """Add horizon-growing error to `fw_*`; percentages are clipped afterwards.

    Null features stay null, so the rows that survive a null drop are the same
    with and without noise.
    """

    def noisy(variable: str, day: int) -> Column:
        first, growth = FORECAST_NOISE[variable]
        error = standard_normal(F.col("city"), F.unix_micros("collection_timestamp"), variable, day, seed)
        value = F.col(f"fw_{variable}{day}") + (first + growth * (day - 1)) * error
        return clip_percent(value) if variable in PERCENT_VARS else value

    features = {f"fw_{v}{d}": (v, d) for d in range(1, max_horizon + 1) for v in FORECAST_NOISE}
    return daily.withColumns({c: noisy(*features[c]) for c in daily.columns if c in features})
