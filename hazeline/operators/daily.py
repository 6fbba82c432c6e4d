"""The daily table and its features.

A daily table has at most one row per city and day, so a city's series is
bounded by the days of its history; plain windows by city are safe here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.functions.calendar import cycle
from hazeline.operators.ordered import join_on

SOURCES = {
    "aqi": "aqi", "pm25": "pm2_5", "temp": "temperature", "wind": "wind_speed",
    "humid": "humidity", "pressure": "pressure", "clouds": "clouds",
}


def _along() -> Window:
    return Window.partitionBy(*S.SERIES).orderBy(S.TIME)


def daily_resample(df: DataFrame) -> DataFrame:
    """Hourly rows to one row per city and day that has an AQI reading."""
    day = F.date_trunc("day", S.TIME).alias(S.TIME)
    return (
        df.groupBy("city", day)
        .agg(
            *[F.avg(source).alias(name) for name, source in SOURCES.items()],
            F.max("aqi").alias("aqi_max"),
            F.min("aqi").alias("aqi_min"),
            F.stddev_samp("aqi").alias("aqi_std"),
            F.max("wind_speed").alias("wind_max"),
            F.max("temperature").alias("temp_max"),
        )
        .filter(F.col("aqi").isNotNull())
    )


def daily_calendar(daily: DataFrame) -> DataFrame:
    """Day of year and weekday with their cycles."""
    out = daily.withColumns({"day": F.dayofyear(S.TIME), "dow": F.weekday(S.TIME)})
    doy_sin, doy_cos = cycle(F.col("day"), 365.25)
    dow_sin, dow_cos = cycle(F.col("dow"), 7)
    return out.withColumns({"doy_sin": doy_sin, "doy_cos": doy_cos, "dow_sin": dow_sin, "dow_cos": dow_cos})


def daily_lags(daily: DataFrame) -> DataFrame:
    """Lags over observed days."""
    w = _along()
    lags = {f"aqi_l{n}": F.lag("aqi", n).over(w) for n in S.DAILY_AQI_LAGS}
    lags |= {f"{c}_l{n}": F.lag(c, n).over(w) for n in S.DAILY_LAGS for c in S.DAILY_LAGGED}
    return daily.withColumns(lags)


def daily_rolling(daily: DataFrame) -> DataFrame:
    """Mean and deviation of AQI over full windows of prior days."""
    added = {}
    for prefix, sizes, stat in (("rm", S.DAILY_MEAN_DAYS, F.avg), ("std", S.DAILY_STD_DAYS, F.stddev_samp)):
        for n in sizes:
            prior = _along().rowsBetween(-n, -1)
            added[f"{prefix}{n}"] = F.when(F.count("aqi").over(prior) == n, stat("aqi").over(prior))
    return daily.withColumns(added)


def daily_interactions(daily: DataFrame) -> DataFrame:
    c = F.col
    return daily.withColumns(
        {
            "anom7": c("aqi") - c("rm7"),
            "anom14": c("aqi") - c("rm14"),
            "trend3": c("rm7") - c("rm3"),
            "trend7": c("rm7") - c("rm14"),
            "trend14": c("rm14") - c("rm30"),
            "range_l1": c("aqi_max") - c("aqi_min"),
            "hum_temp": c("humid") * c("temp") / 100,
            "wind_hum": c("wind") * c("humid") / 100,
        }
    )


def future_weather_lead(daily: DataFrame) -> DataFrame:
    """Weather 1..3 observed days ahead, the row's own weather where unknown."""
    w = _along()
    return daily.withColumns(
        {
            f"fw_{v}{h}": F.coalesce(F.lead(v, h).over(w), F.col(v))
            for _, h in S.HORIZONS
            for v in S.FUTURE_VARS
        }
    )


def override_anchor(daily: DataFrame, future: DataFrame) -> DataFrame:
    """Replace `fw_*` of each city's newest day by supplied daily weather.

    `future` has one row per (city, date) with the future-weather variables.
    Only the days that match the anchor plus 1..3 are replaced.
    """
    anchors = daily.groupBy("city").agg(F.max(S.TIME).alias("_anchor"))
    days_ahead = F.date_diff(F.col("date"), F.col("_anchor"))
    matched = join_on(future, anchors, ["city"]).withColumn("_h", days_ahead)
    wide = matched.filter(F.col("_h").between(1, 3)).groupBy("city", F.col("_anchor").alias(S.TIME)).agg(
        *[F.count_if(F.col("_h") == h).alias(f"_has{h}") for _, h in S.HORIZONS],
        *[F.max(F.when(F.col("_h") == h, F.col(v))).alias(f"_new_{v}{h}") for _, h in S.HORIZONS for v in S.FUTURE_VARS],
    )
    joined = join_on(daily, wide, list(S.KEY), "left")
    replaced = {
        f"fw_{v}{h}": F.when(F.col(f"_has{h}") > 0, F.col(f"_new_{v}{h}")).otherwise(F.col(f"fw_{v}{h}"))
        for _, h in S.HORIZONS
        for v in S.FUTURE_VARS
    }
    return joined.withColumns(replaced).select(*daily.columns)


def daily_features(df: DataFrame, future_weather: DataFrame | None = None) -> DataFrame:
    """Hourly observations to the daily feature table."""
    needed = [S.TIME, "aqi", "pm2_5", "temperature", "wind_speed", "humidity", "pressure", "clouds"]
    absent = [c for c in needed if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    daily = daily_calendar(daily_resample(df))
    daily = future_weather_lead(daily_interactions(daily_rolling(daily_lags(daily))))
    return daily if future_weather is None else override_anchor(daily, future_weather)


def target_mean_ahead(daily: DataFrame, n_days: int, name: str = "target") -> DataFrame:
    """Mean AQI of the next n observed days; the first n-1 rows have none."""
    w = _along()
    coming = w.rowsBetween(1, n_days)
    full = (F.count("aqi").over(coming) == n_days) & (F.row_number().over(w) >= n_days)
    return daily.withColumn(name, F.when(full, F.avg("aqi").over(coming)))


def daily_mean_tail(df: DataFrame, days: int = 90) -> DataFrame:
    """Daily mean AQI of each city's last `days` observed days."""
    daily = df.groupBy("city", F.date_trunc("day", S.TIME).alias(S.TIME)).agg(F.avg("aqi").alias("aqi"))
    newest_first = Window.partitionBy("city").orderBy(F.col(S.TIME).desc())
    return (
        daily.filter(F.col("aqi").isNotNull())
        .withColumn("_rank", F.row_number().over(newest_first))
        .filter(F.col("_rank") <= days)
        .drop("_rank")
    )


def train_cutoff(df: DataFrame, endpoint: str) -> DataFrame:
    """Rows up to a fixed training endpoint, as a filter the scan can use."""
    kind = df.schema[S.TIME].dataType
    return df.filter(F.col(S.TIME) <= F.lit(endpoint).cast("timestamp").cast(kind))


def latest_row(df: DataFrame) -> DataFrame:
    """Newest row of every city."""
    rest = [c for c in df.columns if c != "city"]
    newest = df.groupBy("city").agg(F.max_by(F.struct(*rest), S.TIME).alias("_row"))
    return newest.select(*[c if c == "city" else F.col("_row")[c].alias(c) for c in df.columns])
