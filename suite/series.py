"""Queries over series windows, daily features, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.operators import daily, features, metrics, splits
from hazeline.plans.daily_models import stack
from suite.bindings import NUDGE, SENSOR, STATION, Suite, rounded, sensor, station

suite = Suite()
W = "PARTITION BY city ORDER BY collection_timestamp"
ID = ("city", "collection_timestamp", "ingest_seq")
IDS = ", ".join(ID)


def rnd(expression: str, name: str) -> str:
    return f"round({expression} + {NUDGE}, 6) + 0 AS {name}"


CHANGES = {f"{c}_change_rate": f"{c} - lag({c}, 1) OVER ({W})" for c in S.CHANGE_COLUMNS}
LAGS = {f"{c}_lag_{n}": f"lag({c}, {n}) OVER ({W})" for c in S.CHANGE_COLUMNS for n in S.LAGS}
ROLLING = {
    f"{c}_rolling_{name}_{label}": f"{fn}({c}) OVER ({W} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    for c in S.ROLLING_COLUMNS
    for label, rows in S.ROLLING_ROWS.items()
    for name, fn in (("mean", "avg"), ("std", "stddev_samp"))
}


def items(columns: dict[str, str]) -> str:
    return ", ".join(rnd(e, n) for n, e in columns.items())


@suite.query("change_rate", f"WITH {SENSOR} SELECT {IDS}, {items(CHANGES)} FROM sensor")
def change_rate(spark, sf_dir):
    return features.change_rate(sensor(spark, sf_dir)).select(*ID, *CHANGES)


@suite.query("lag_features", f"WITH {SENSOR} SELECT {IDS}, {items(LAGS)} FROM sensor")
def lag_features(spark, sf_dir):
    return features.lag_features(sensor(spark, sf_dir)).select(*ID, *LAGS)


@suite.query("rolling_stats", f"WITH {SENSOR} SELECT {IDS}, {items(ROLLING)} FROM sensor")
def rolling_stats(spark, sf_dir):
    return features.rolling_stats(sensor(spark, sf_dir)).select(*ID, *ROLLING)


@suite.query("target_ahead", f"WITH {SENSOR} SELECT {IDS}, {rnd(f'lead(aqi, 72) OVER ({W})', 'aqi_target')} FROM sensor")
def target_ahead(spark, sf_dir):
    return features.target_ahead(sensor(spark, sf_dir)).select(*ID, "aqi_target")


COMPLETE = f"""{SENSOR}, wide AS (SELECT *, lead(aqi, 72) OVER ({W}) AS aqi_target,
  {', '.join(f'{e} AS {n}' for n, e in {**LAGS, **CHANGES, **ROLLING}.items())} FROM sensor),
complete AS (SELECT * FROM wide WHERE aqi_target IS NOT NULL AND aqi_lag_168 IS NOT NULL)"""


@suite.query(
    "drop_incomplete",
    f"WITH {COMPLETE} SELECT {IDS}, {rounded('aqi_target', 'aqi_lag_168', 'pm10_lag_168', 'aqi_rolling_std_48h')} FROM complete",
)
def drop_incomplete(spark, sf_dir):
    rows = sensor(spark, sf_dir)
    kept = features.drop_incomplete(features.series_features(rows), rows)
    return kept.select(*ID, "aqi_target", "aqi_lag_168", "pm10_lag_168", "aqi_rolling_std_48h")


HOURLY_FEATURES = [c for c in S.model_features() if not c.endswith(("_sin", "_cos"))]


@suite.query(
    "build_features",
    f"WITH {COMPLETE} SELECT {IDS}, {rounded(*HOURLY_FEATURES, 'aqi_target')}, "
    f"{rnd('(pm2_5 / 35.4::DOUBLE + coalesce(pm10 / 154.0::DOUBLE, 0)) / (1 + CASE WHEN pm10 IS NULL THEN 0 ELSE 1 END)', 'pollution_index')} "
    "FROM complete",
)
def build_features(spark, sf_dir):
    return features.build_features(sensor(spark, sf_dir)).select(*ID, *HOURLY_FEATURES, "aqi_target", "pollution_index")


XY = ["aqi", "pm2_5", "pm10", "aqi_lag_24"]


@suite.query(
    "build_xy",
    f"WITH {COMPLETE} SELECT {rounded(*XY, 'aqi_target')} FROM wide WHERE pm10 IS NOT NULL AND aqi_lag_24 IS NOT NULL AND aqi_target IS NOT NULL",
)
def build_xy(spark, sf_dir):
    wide = features.series_features(sensor(spark, sf_dir))
    return features.build_xy(wide, XY)


@suite.query(
    "build_feature_matrix",
    f"WITH {COMPLETE} SELECT {rounded(*XY)} FROM wide WHERE pm10 IS NOT NULL AND aqi_lag_24 IS NOT NULL",
)
def build_feature_matrix(spark, sf_dir):
    wide = features.series_features(sensor(spark, sf_dir))
    return features.build_feature_matrix(wide, XY)


NAIVE = {
    "roll_mean_24h": f"avg(aqi) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)",
    "roll_mean_7d": f"avg(aqi) OVER ({W} ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)",
    "roll_std_24h": f"stddev_samp(aqi) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)",
}


@suite.query("rolling_naive", f"WITH {SENSOR} SELECT {IDS}, {items(NAIVE)} FROM sensor")
def rolling_naive(spark, sf_dir):
    return metrics.rolling_naive(sensor(spark, sf_dir)).select(*ID, *NAIVE)


# ---- daily table -----------------------------------------------------------

DAILY = f"""{STATION}, daily AS (
  SELECT city, date_trunc('day', collection_timestamp) AS collection_timestamp,
    {', '.join(f'avg({s}) AS {n}' for n, s in daily.SOURCES.items())},
    max(aqi) AS aqi_max, min(aqi) AS aqi_min, stddev_samp(aqi) AS aqi_std, max(wind_speed) AS wind_max, max(temperature) AS temp_max
  FROM station GROUP BY ALL HAVING avg(aqi) IS NOT NULL)"""
DAILY_COLUMNS = [*daily.SOURCES, "aqi_max", "aqi_min", "aqi_std", "wind_max", "temp_max"]
DID = ("city", "collection_timestamp")
DIDS = ", ".join(DID)


def days(spark, sf_dir):
    return daily.daily_resample(station(spark, sf_dir))


@suite.query("daily_resample", f"WITH {DAILY} SELECT {DIDS}, {rounded(*DAILY_COLUMNS)} FROM daily")
def daily_resample(spark, sf_dir):
    return days(spark, sf_dir)


@suite.query(
    "daily_mean_tail",
    f"WITH {DAILY} SELECT {DIDS}, {rounded('aqi')} FROM daily "
    "QUALIFY row_number() OVER (PARTITION BY city ORDER BY collection_timestamp DESC) <= 90",
)
def daily_mean_tail(spark, sf_dir):
    return daily.daily_mean_tail(station(spark, sf_dir))


CALENDAR = {
    "doy_sin": "sin(2 * pi() * dayofyear(collection_timestamp) / 365.25::DOUBLE)",
    "doy_cos": "cos(2 * pi() * dayofyear(collection_timestamp) / 365.25::DOUBLE)",
    "dow_sin": "sin(2 * pi() * (isodow(collection_timestamp) - 1) / 7)",
    "dow_cos": "cos(2 * pi() * (isodow(collection_timestamp) - 1) / 7)",
}


@suite.query("daily_calendar", f"WITH {DAILY} SELECT {DIDS}, CAST(isodow(collection_timestamp) - 1 AS INTEGER) AS dow, {items(CALENDAR)} FROM daily")
def daily_calendar(spark, sf_dir):
    return daily.daily_calendar(days(spark, sf_dir)).select(*DID, "dow", *CALENDAR)


DAILY_LAGS = {f"aqi_l{n}": f"lag(aqi, {n}) OVER ({W})" for n in S.DAILY_AQI_LAGS} | {
    f"{c}_l{n}": f"lag({c}, {n}) OVER ({W})" for n in S.DAILY_LAGS for c in S.DAILY_LAGGED
}
DAILY_ROLLING = {
    f"{prefix}{n}": f"CASE WHEN count(aqi) OVER ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} "
    f"THEN {fn}(aqi) OVER ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END"
    for prefix, sizes, fn in (("rm", S.DAILY_MEAN_DAYS, "avg"), ("std", S.DAILY_STD_DAYS, "stddev_samp"))
    for n in sizes
}
INTERACTIONS = {
    "anom7": "aqi - rm7", "anom14": "aqi - rm14", "trend3": "rm7 - rm3", "trend7": "rm7 - rm14", "trend14": "rm14 - rm30",
    "range_l1": "aqi_max - aqi_min", "hum_temp": "humid * temp / 100", "wind_hum": "wind * humid / 100",
}
FUTURE = {f"fw_{v}{h}": f"coalesce(lead({v}, {h}) OVER ({W}), {v})" for h in (1, 2, 3) for v in S.FUTURE_VARS}
WIDE_DAYS = f"{DAILY}, rolled AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in DAILY_ROLLING.items())} FROM daily)"


@suite.query("daily_lags", f"WITH {DAILY} SELECT {DIDS}, {items(DAILY_LAGS)} FROM daily")
def daily_lags(spark, sf_dir):
    return daily.daily_lags(days(spark, sf_dir)).select(*DID, *DAILY_LAGS)


@suite.query("daily_rolling", f"WITH {DAILY} SELECT {DIDS}, {items(DAILY_ROLLING)} FROM daily")
def daily_rolling(spark, sf_dir):
    return daily.daily_rolling(days(spark, sf_dir)).select(*DID, *DAILY_ROLLING)


@suite.query("daily_interactions", f"WITH {WIDE_DAYS} SELECT {DIDS}, {items(INTERACTIONS)} FROM rolled")
def daily_interactions(spark, sf_dir):
    return daily.daily_interactions(daily.daily_rolling(days(spark, sf_dir))).select(*DID, *INTERACTIONS)


@suite.query("future_weather_lead", f"WITH {DAILY} SELECT {DIDS}, {items(FUTURE)} FROM daily")
def future_weather_lead(spark, sf_dir):
    return daily.future_weather_lead(days(spark, sf_dir)).select(*DID, *FUTURE)


TARGETS = {
    f"target{n}": f"CASE WHEN count(aqi) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING) = {n} AND row_number() OVER ({W}) >= {n} "
    f"THEN avg(aqi) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING) END"
    for n in (1, 2, 3)
}


@suite.query("target_mean_ahead", f"WITH {DAILY} SELECT {DIDS}, {items(TARGETS)} FROM daily")
def target_mean_ahead(spark, sf_dir):
    rows = days(spark, sf_dir)
    for n in (1, 2, 3):
        rows = daily.target_mean_ahead(rows, n, f"target{n}")
    return rows.select(*DID, *TARGETS)


@suite.query(
    "daily_features",
    f"WITH {WIDE_DAYS} SELECT {DIDS}, {rounded('aqi', 'humid', *DAILY_ROLLING)}, {items(INTERACTIONS)}, {items(DAILY_LAGS)}, {items(FUTURE)} FROM rolled",
)
def daily_features(spark, sf_dir):
    return daily.daily_features(station(spark, sf_dir)).select(
        *DID, "aqi", "humid", *DAILY_ROLLING, *INTERACTIONS, *DAILY_LAGS, *FUTURE
    )


@suite.query(
    "select_daily_features",
    f"WITH {WIDE_DAYS} SELECT city, n_days, 46 + 5 * n_days AS features, count(*) AS complete_rows "
    "FROM rolled, (VALUES (1), (2), (3)) horizons(n_days) WHERE rm30 IS NOT NULL GROUP BY city, n_days",
)
def select_daily_features(spark, sf_dir):
    table = daily.daily_features(station(spark, sf_dir))
    parts = []
    for _, n in S.HORIZONS:
        columns = features.select_daily_features(table.columns, n)
        complete = features.complete_rows(table, columns).groupBy("city").agg(F.count("*").alias("complete_rows"))
        parts.append(complete.select("city", F.lit(n).alias("n_days"), F.lit(len(columns)).alias("features"), "complete_rows"))
    return stack(parts)


@suite.query(
    "latest_row",
    f"WITH {SENSOR} SELECT {IDS}, {rounded('aqi', 'pm2_5')} FROM sensor QUALIFY row_number() OVER (PARTITION BY city ORDER BY collection_timestamp DESC) = 1",
)
def latest_row(spark, sf_dir):
    return daily.latest_row(sensor(spark, sf_dir)).select(*ID, "aqi", "pm2_5")


# ---- splits ----------------------------------------------------------------

PLACED = f"{SENSOR}, placed AS (SELECT *, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY city) AS n FROM sensor)"


@suite.query(
    "split_two",
    f"WITH {PLACED} SELECT {IDS}, CASE WHEN rn <= floor(n * (1 - 0.2::DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM placed",
)
def split_two(spark, sf_dir):
    return splits.split_two(sensor(spark, sf_dir)).select(*ID, "split")


THREE = ("CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train' "
         "WHEN rn <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END")


@suite.query("split_three", f"WITH {PLACED} SELECT {IDS}, {THREE} AS split FROM placed")
def split_three(spark, sf_dir):
    return splits.split_three(sensor(spark, sf_dir)).select(*ID, "split")


@suite.query(
    "split_tail",
    f"WITH {DAILY} SELECT {DIDS}, CASE WHEN rn <= n - floor(n * 0.2::DOUBLE) THEN 'train' ELSE 'test' END AS split "
    f"FROM (SELECT *, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY city) AS n FROM daily)",
)
def split_tail(spark, sf_dir):
    return splits.split_tail(days(spark, sf_dir), bounded=True).select(*DID, "split")


@suite.query(
    "concat_train_val",
    f"WITH {PLACED} SELECT {IDS}, split FROM (SELECT *, {THREE} AS split FROM placed) WHERE split IN ('train', 'val')",
)
def concat_train_val(spark, sf_dir):
    return splits.concat_train_val(splits.split_three(sensor(spark, sf_dir))).select(*ID, "split")


@suite.query(
    "ts_cv_folds",
    f"""WITH {PLACED}, sized AS (SELECT *, CASE WHEN n >= 6 + 72 * 5 THEN 5 WHEN n >= 5 + 72 * 4 THEN 4 WHEN n >= 4 + 72 * 3 THEN 3 ELSE 2 END AS k FROM placed),
    folded AS (SELECT *, unnest(range(k)) AS fold, CAST(floor(n / (k + 1)) AS BIGINT) AS ts FROM sized),
    roles AS (SELECT *, CASE WHEN rn - 1 >= n - (k - fold) * ts AND rn - 1 < n - (k - fold) * ts + ts THEN 'test'
      WHEN rn - 1 < n - (k - fold) * ts - 72 THEN 'train' END AS role FROM folded)
    SELECT {IDS}, CAST(fold AS INTEGER) AS fold, role FROM roles WHERE role IS NOT NULL""",
)
def ts_cv_folds(spark, sf_dir):
    return splits.ts_cv_folds(sensor(spark, sf_dir)).select(*ID, "fold", "role")


@suite.query(
    "walk_forward_blocks",
    f"WITH {PLACED} SELECT {IDS}, CASE WHEN rn <= 1500 THEN -1 ELSE CAST(floor((rn - 1 - 1500) / 336) AS BIGINT) END AS block "
    "FROM placed WHERE n > 1500",
)
def walk_forward_blocks(spark, sf_dir):
    return splits.walk_forward_blocks(sensor(spark, sf_dir), ["aqi", "pm2_5"]).select(*ID, "block")
