"""Queries over quality, distribution, correlation, drift and scores."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from hazeline.operators import metrics, profile, splits
from hazeline.operators.features import series_features
from suite.bindings import NUDGE, SENSOR, STATION, Suite, rounded, sensor, station, table
from suite.series import CHANGES, COMPLETE, LAGS, PLACED, ROLLING, THREE, W, rnd

suite = Suite()
#: Every numeric column of the sensor table.
PROFILED = ("aqi", "pm2_5", "pm10", "temperature", "humidity", "wind_speed", "pressure", "clouds", "feels_like", "wind_direction", "user_id", "ingest_seq")
LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM sensor WHERE {c} IS NOT NULL" for c in PROFILED
) + ")"


@suite.query(
    "dataset_quality",
    "SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_orderpriority, o_orderdate FROM orders)) AS duplicates, "
    "count(*) FILTER (WHERE o_totalprice / 1000 > 500) AS invalid_aqi FROM orders",
)
def dataset_quality(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("city"), F.col("o_orderdate").alias("collection_timestamp"), (F.col("o_totalprice") / 1000).alias("aqi")
    )
    out = profile.dataset_quality(rows)
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])


MISSING = [*PROFILED, "city"]
MISSING_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS missing, "
    f"count(*) FILTER (WHERE {c} IS NULL) AS missing_count, count(*) AS n FROM sensor" for c in MISSING
)


@suite.query("missing_ratio", f"WITH {SENSOR}, m AS ({MISSING_SQL}) SELECT \"column\", {rounded('missing')} FROM m")
def missing_ratio(spark, sf_dir):
    return profile.missing_ratio(sensor(spark, sf_dir).select(*MISSING))


@suite.query(
    "topk_missing",
    f"WITH {SENSOR}, m AS ({MISSING_SQL}) SELECT \"column\", {rounded('missing')} FROM m ORDER BY m.missing DESC, \"column\" LIMIT 15",
)
def topk_missing(spark, sf_dir):
    return profile.topk_missing(sensor(spark, sf_dir).select(*MISSING), 15)


@suite.query(
    "missing_summary",
    f"WITH {SENSOR}, m AS ({MISSING_SQL}) SELECT \"column\", missing_count, round(missing_count / n * 100, 2) AS missing_pct FROM m WHERE missing_count > 0",
)
def missing_summary(spark, sf_dir):
    return profile.missing_summary(sensor(spark, sf_dir).select(*MISSING))


@suite.query(
    "source_summary",
    """SELECT coalesce(s, 'Unavailable') AS source, count(*) AS records, round(count(*) / (SELECT count(*) FROM orders) * 100 + 3.7e-10, 6) AS percent
    FROM (SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS s FROM orders) GROUP BY 1""",
)
def source_summary(spark, sf_dir):
    rows = station(spark, sf_dir)
    return profile.source_summary(rows.withColumn("aqi_source", F.when(F.col("aqi_source") != "5-LOW", F.col("aqi_source"))))


@suite.query(
    "history_summary",
    f"WITH {SENSOR} SELECT count(*) AS rows, count(DISTINCT city) AS cities, {rnd('avg(aqi)', 'aqi_mean')}, "
    f"{rnd('quantile_cont(aqi, 0.5)', 'aqi_median')}, min(collection_timestamp) AS first_ts, max(collection_timestamp) AS last_ts FROM sensor",
)
def history_summary(spark, sf_dir):
    return profile.history_summary(sensor(spark, sf_dir))


@suite.query(
    "describe",
    f"WITH {SENSOR}, {LONG} SELECT \"column\", count(value) AS count, {rnd('avg(value)', 'mean')}, {rnd('stddev_samp(value)', 'std')}, "
    f"{rnd('min(value)', 'min')}, {rnd('quantile_cont(value, 0.25)', 'q1')}, {rnd('quantile_cont(value, 0.5)', 'median')}, "
    f"{rnd('quantile_cont(value, 0.75)', 'q3')}, {rnd('max(value)', 'max')} FROM long GROUP BY 1",
)
def describe(spark, sf_dir):
    return profile.describe(sensor(spark, sf_dir), PROFILED)


# Lines as they would be without their numbers, so that full rows repeat.
@suite.query(
    "duplicate_rows",
    "WITH twice AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1) "
    "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM twice)) AS duplicate_rows FROM twice",
)
def duplicate_rows(spark, sf_dir):
    """Whole rows; the first line of every order stands there twice."""
    items = table(spark, sf_dir, "lineitem")
    rows = items.unionByName(items.filter("l_linenumber = 1"))
    return profile.duplicate_rows(rows).select(F.col("duplicate_rows").cast("long").alias("duplicate_rows"))


@suite.query(
    "distinct_values",
    "SELECT DISTINCT 'o_orderstatus' AS \"column\", o_orderstatus AS value FROM orders UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders",
)
def distinct_values(spark, sf_dir):
    return profile.distinct_values(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


CORRELATED = list(PROFILED)


@suite.query(
    "correlation_matrix",
    f"WITH {SENSOR} " + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {rnd(f'corr({a}, {b})', 'r')} FROM sensor" for a, b in combinations(CORRELATED, 2)
    ),
)
def correlation_matrix(spark, sf_dir):
    return profile.correlation_matrix(sensor(spark, sf_dir), CORRELATED)


#: All columns but those that are another one on a different scale, whose ties would decide who is among the first.
RELATED = [c for c in (*PROFILED, *LAGS, *CHANGES, *ROLLING) if not c.startswith(("temperature", "feels_like"))]


@suite.query(
    "target_correlation",
    f"WITH {COMPLETE}, r AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, aqi_target) AS r FROM wide" for c in RELATED)
    + f") SELECT feature, {rounded('r')} FROM r ORDER BY abs(r.r) DESC LIMIT 20",
)
def target_correlation(spark, sf_dir):
    return profile.target_correlation(series_features(sensor(spark, sf_dir)), RELATED, k=20)


@suite.query(
    "high_corr_pairs",
    f"WITH {SENSOR}, r AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr({a}, {b}) AS r FROM sensor" for a, b in combinations(CORRELATED, 2)
    ) + ") SELECT feature_1, feature_2, round(r, 3) AS correlation FROM r WHERE abs(r) >= 0.9::DOUBLE",
)
def high_corr_pairs(spark, sf_dir):
    return profile.high_corr_pairs(sensor(spark, sf_dir), CORRELATED)


@suite.query("pair_correlation", f"WITH {SENSOR} SELECT {rnd('corr(humidity, aqi)', 'correlation')}, count(*) AS pairs FROM sensor")
def pair_correlation(spark, sf_dir):
    text = sensor(spark, sf_dir).withColumn("humidity", F.col("humidity").cast("string"))
    return profile.pair_correlation(text, "humidity")


@suite.query(
    "histogram",
    f"""WITH {SENSOR}, {LONG}, ends AS (SELECT "column", min(value) AS lo, (max(value) - min(value)) / 20 AS width FROM long GROUP BY 1),
    binned AS (SELECT l."column", lo, width, CAST(least(floor((value - lo) / width), 19) AS INTEGER) AS bin FROM long l JOIN ends e ON l."column" = e."column")
    SELECT "column", bin, {rnd('any_value(lo + bin * width)', 'bin_start')}, count(*) AS count FROM binned GROUP BY "column", bin""",
)
def histogram(spark, sf_dir):
    return profile.histogram(sensor(spark, sf_dir), PROFILED)


@suite.query("skewness", f"WITH {SENSOR}, {LONG} SELECT \"column\", {rnd('skewness(value)', 'skew')} FROM long GROUP BY 1")
def skewness(spark, sf_dir):
    return profile.skewness(sensor(spark, sf_dir), PROFILED)


@suite.query(
    "iqr_outliers",
    f"""WITH {SENSOR}, {LONG}, q AS (SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY 1),
    b AS (SELECT "column", q1 - 1.5::DOUBLE * (q3 - q1) AS lo, q3 + 1.5::DOUBLE * (q3 - q1) AS hi FROM q)
    SELECT l."column", count(*) FILTER (WHERE value < lo OR value > hi) AS count,
      round(count(*) FILTER (WHERE value < lo OR value > hi) / count(*) * 100, 2) AS pct,
      round(any_value(lo), 2) AS lower_bound, round(any_value(hi), 2) AS upper_bound
    FROM long l JOIN b ON l."column" = b."column" GROUP BY 1""",
)
def iqr_outliers(spark, sf_dir):
    return profile.iqr_outliers(sensor(spark, sf_dir), PROFILED)


@suite.query(
    "box_stats",
    " UNION ALL ".join(
        f"SELECT '{name}' AS kind, CAST({key} AS INTEGER) AS bucket, {rnd('min(value)', 'min')}, {rnd('quantile_cont(value, 0.25)', 'q1')}, "
        f"{rnd('quantile_cont(value, 0.5)', 'median')}, {rnd('quantile_cont(value, 0.75)', 'q3')}, {rnd('max(value)', 'max')}, count(*) AS n FROM events GROUP BY 2"
        for name, key in (("hour", "hour(ts)"), ("day_of_week", "isodow(ts) - 1"), ("month", "month(ts)"))
    ),
)
def box_stats(spark, sf_dir):
    from hazeline.functions.calendar import time_fields

    rows = time_fields(sensor(spark, sf_dir))
    parts = [
        profile.box_stats(rows, k).withColumnRenamed(k, "bucket").withColumn("kind", F.lit(k)) for k in ("hour", "day_of_week", "month")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@suite.query(
    "monthly_profile",
    f"WITH {STATION} SELECT city, CAST(month(collection_timestamp) AS INTEGER) AS month, {rnd('avg(aqi)', 'mean')}, "
    f"{rnd('stddev_samp(aqi)', 'std')}, count(aqi) AS n FROM station GROUP BY 1, 2",
)
def monthly_profile(spark, sf_dir):
    return profile.monthly_profile(station(spark, sf_dir))


@suite.query(
    "volatility_drift",
    f"""WITH {SENSOR}, moved AS (SELECT city, strftime(collection_timestamp, '%Y-%m') AS month, aqi, aqi - lag(aqi) OVER ({W}) AS change,
      stddev_samp(aqi) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS roll FROM sensor)
    SELECT city, month, count(*) AS n, {rnd('avg(aqi)', 'aqi_mean')}, {rnd('stddev_pop(change)', 'change_std')},
      {rnd('avg(roll)', 'roll_std_24h_mean')} FROM moved GROUP BY 1, 2""",
)
def volatility_drift(spark, sf_dir):
    return profile.volatility_drift(sensor(spark, sf_dir))


@suite.query(
    "split_stats",
    f"""WITH {PLACED}, s AS (SELECT *, {THREE} AS split FROM placed) SELECT city, split, count(*) AS n, {rnd('avg(aqi)', 'aqi_mean')},
    {rnd('stddev_pop(aqi)', 'aqi_std')}, {rnd('min(aqi)', 'aqi_min')}, {rnd('max(aqi)', 'aqi_max')} FROM s GROUP BY 1, 2""",
)
def split_stats(spark, sf_dir):
    return profile.split_stats(splits.split_three(sensor(spark, sf_dir)))


SHIFT = f"""{PLACED}, s AS (SELECT *, {THREE} AS split FROM placed),
  long AS ({' UNION ALL '.join(f'''SELECT '{c}' AS "column", CAST({c} AS DOUBLE) AS value, split FROM s WHERE {c} IS NOT NULL''' for c in PROFILED)}),
  tallied AS (SELECT "column", value, count(*) FILTER (WHERE split = 'train') AS a, count(*) FILTER (WHERE split = 'test') AS b FROM long GROUP BY 1, 2),
  stepped AS (SELECT "column", abs(sum(a) OVER w / sum(a) OVER t - sum(b) OVER w / sum(b) OVER t) AS d,
      sum(a) OVER t AS n, sum(b) OVER t AS m FROM tallied
    WINDOW w AS (PARTITION BY "column" ORDER BY value), t AS (PARTITION BY "column")),
  ks AS (SELECT "column", max(d) AS ks_stat, max(d) * sqrt(CAST(any_value(n) AS DOUBLE) * any_value(m) / (any_value(n) + any_value(m))) AS x,
      CAST(least(any_value(n), any_value(m)) AS BIGINT) AS n, CAST(greatest(any_value(n), any_value(m)) AS BIGINT) AS m,
      CAST(round(max(d) * any_value(n) * any_value(m)) AS BIGINT) AS h FROM stepped GROUP BY 1),
  walk AS (SELECT "column", CAST(0 AS BIGINT) AS t, [CASE WHEN h <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END] AS p FROM ks WHERE n > 0 AND m <= 10000 UNION ALL
    SELECT w."column", t + 1, list_transform(range(0, least(n, t + 1) + 1), lambda i: CASE WHEN abs(i * m - (t + 1 - i) * n) >= h THEN 1.0::DOUBLE
      ELSE (i * coalesce(p[i], 0) + greatest(t + 1 - i, 0) * coalesce(p[i + 1], 0)) / (t + 1) END) FROM walk w JOIN ks ON ks."column" = w."column" WHERE t < n + m),
  exact AS (SELECT w."column", p[n + 1] AS p FROM walk w JOIN ks ON ks."column" = w."column" WHERE t = n + m),
  limits AS (SELECT "column", any_value(ks_stat) AS ks_stat, CASE WHEN any_value(x) < 0.2 THEN 1.0::DOUBLE ELSE
      least(greatest(sum(CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END * exp(-2.0::DOUBLE * k * k * x * x)), 0.0::DOUBLE), 1.0::DOUBLE) END AS ks_pvalue
    FROM ks, range(1, 101) terms(k) GROUP BY 1),
  tails AS (SELECT l."column", ks_stat, coalesce(e.p, ks_pvalue) AS ks_pvalue FROM limits l LEFT JOIN exact e ON e."column" = l."column"),
  moments AS (SELECT "column", avg(value) FILTER (WHERE split = 'train') AS train_mean, avg(value) FILTER (WHERE split = 'test') AS test_mean,
    stddev_pop(value) FILTER (WHERE split = 'train') AS train_std, stddev_pop(value) FILTER (WHERE split = 'test') AS test_std FROM long GROUP BY 1)"""
SHIFT_OUT = f"SELECT m.\"column\", {rounded('train_mean', 'test_mean', 'train_std', 'test_std', 'ks_stat', 'ks_pvalue')} FROM moments m JOIN tails t ON m.\"column\" = t.\"column\""


@suite.query("distribution_shift", f"WITH RECURSIVE {SHIFT} {SHIFT_OUT}")
def distribution_shift(spark, sf_dir):
    return profile.distribution_shift(splits.split_three(sensor(spark, sf_dir)), PROFILED)


@suite.query("topk_shift", f"WITH RECURSIVE {SHIFT} {SHIFT_OUT} ORDER BY t.ks_stat DESC LIMIT 25")
def topk_shift(spark, sf_dir):
    return profile.distribution_shift(splits.split_three(sensor(spark, sf_dir)), PROFILED, k=25)


ACF_LAGS = 72


@suite.query(
    "acf",
    f"""WITH {SENSOR}, c AS (SELECT city, collection_timestamp, aqi - avg(aqi) OVER (PARTITION BY city) AS x,
      row_number() OVER ({W}) AS rn FROM sensor), ss AS (SELECT city, sum(x * x) AS ss FROM c GROUP BY city),
    p AS (SELECT a.city, b.rn - a.rn AS lag, sum(a.x * b.x) AS s FROM c a JOIN c b ON a.city = b.city AND b.rn BETWEEN a.rn + 1 AND a.rn + {ACF_LAGS} GROUP BY ALL)
    SELECT p.city, CAST(lag AS INTEGER) AS lag, {rnd('s / ss', 'acf')} FROM p JOIN ss ON p.city = ss.city""",
)
def acf(spark, sf_dir):
    return profile.acf(sensor(spark, sf_dir), ACF_LAGS)


HORIZONS = f"""{PLACED}, naive AS (SELECT city, collection_timestamp, aqi, rn, n, month(collection_timestamp) AS m,
    avg(aqi) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS roll_mean_24h,
    avg(aqi) OVER ({W} ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS roll_mean_7d,
    {', '.join(f'lead(aqi, {h}) OVER ({W}) AS y{h}' for h in metrics.HORIZON_HOURS)} FROM placed),
  targets AS ({' UNION ALL '.join(f'SELECT city, aqi, m, roll_mean_24h, roll_mean_7d, rn > floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) AS test, {h} AS horizon, y{h} AS y FROM naive' for h in metrics.HORIZON_HOURS)}),
  seasonal AS (SELECT city, horizon, m, avg(y) AS seasonal_month FROM targets WHERE NOT test GROUP BY ALL),
  tested AS (SELECT t.*, s.seasonal_month, aqi AS persistence FROM targets t LEFT JOIN seasonal s ON t.city = s.city AND t.horizon = s.horizon AND t.m = s.m
    WHERE test AND y IS NOT NULL)"""


def scores_sql(y: str, p: str) -> str:
    return ", ".join(
        (
            rnd(f"sqrt(avg(({y} - {p}) * ({y} - {p})))", "rmse"),
            rnd(f"avg(abs({y} - {p}))", "mae"),
            rnd(f"1 - sum(({y} - {p}) * ({y} - {p})) / (var_pop({y}) * count({y}))", "r2"),
            rnd(f"avg(CASE WHEN abs({y}) + abs({p}) = 0 THEN 0 ELSE 2 * abs({y} - {p}) / (abs({y}) + abs({p})) END) * 100", "smape"),
        )
    )


@suite.query(
    "target_stats",
    f"""WITH {HORIZONS} SELECT city, horizon, count(*) AS n, {rnd('avg(y)', 'mean')}, {rnd('stddev_pop(y)', 'std')}, {rnd('var_pop(y)', 'var')},
    {rnd('1 - sum((y - seasonal_month) * (y - seasonal_month)) / (var_pop(y) * count(y))', 'month_mean_baseline_r2')},
    {rnd('sqrt(avg((y - seasonal_month) * (y - seasonal_month)))', 'month_mean_baseline_rmse')} FROM tested GROUP BY 1, 2""",
)
def target_stats(spark, sf_dir):
    return metrics.target_stats(sensor(spark, sf_dir))


@suite.query(
    "naive_baselines",
    f"WITH {HORIZONS} " + " UNION ALL ".join(
        f"SELECT city, horizon, '{p}' AS baseline, count({p}) AS n, {scores_sql('y', p)} FROM tested WHERE {p} IS NOT NULL GROUP BY city, horizon"
        for p in metrics.NAIVE
    ),
)
def naive_baselines(spark, sf_dir):
    return metrics.naive_baselines(sensor(spark, sf_dir))


@suite.query(
    "forecast_metrics",
    f"WITH {SENSOR} SELECT city, count(*) AS n, {scores_sql('aqi', 'pm2_5')} FROM sensor GROUP BY city",
)
def forecast_metrics(spark, sf_dir):
    return metrics.forecast_metrics(sensor(spark, sf_dir), "aqi", "pm2_5", ["city"])


MODELS = {"a": "pm2_5", "b": "humidity", metrics.PERSISTENCE: "aqi"}
COMPARED = "compared AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, count(*) AS n, {scores_sql('y', p)} FROM ahead WHERE y IS NOT NULL" for m, p in MODELS.items()
) + ")"
AHEAD = f"ahead AS (SELECT *, lead(aqi, 72) OVER ({W}) AS y FROM sensor)"


def compared(spark, sf_dir):
    ahead = series_features(sensor(spark, sf_dir)).select("aqi_target", *MODELS.values())
    models = ahead.select("aqi_target", *[F.col(c).alias(m) for m, c in MODELS.items()])
    return metrics.forecast_metrics(models.unpivot(["aqi_target"], list(MODELS), "model", "prediction"), "aqi_target", "prediction", ["model"])


@suite.query("comparison_table", f"WITH {SENSOR}, {AHEAD}, {COMPARED} SELECT * FROM compared")
def comparison_table(spark, sf_dir):
    return metrics.comparison_table(compared(spark, sf_dir))


@suite.query("select_best", f"WITH {SENSOR}, {AHEAD}, {COMPARED} SELECT model, rmse FROM compared WHERE model <> '{metrics.PERSISTENCE}' ORDER BY rmse LIMIT 1")
def select_best(spark, sf_dir):
    return metrics.select_best(compared(spark, sf_dir))


@suite.query(
    "persistence_model",
    f"WITH {SENSOR} SELECT ingest_seq, {rnd(f'lead(aqi, 72) OVER ({W})', 'aqi_target')}, round(aqi + {NUDGE}, 6) AS prediction FROM sensor",
)
def persistence_model(spark, sf_dir):
    rows = series_features(sensor(spark, sf_dir))
    return metrics.persistence_model(rows).select("ingest_seq", "aqi_target", "prediction")
