"""Queries over training, backtesting, scoring and explanation.

Fits on many features have no SQL form; they are checked by rows here and
against closed-form results in the tests. One-feature ridge has one, and the
`_single` queries compare the same code with it. The ensembles are trained with few trees so
that the whole suite stays quick; the library's defaults are the full ones.
"""

from __future__ import annotations

from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from hazeline.functions.calendar import time_fields
from hazeline.functions.noise import FORECAST_NOISE, PERCENT_VARS
from hazeline.functions.noise import forecast_noise as add_noise
from hazeline.operators import daily, features, metrics, splits
from hazeline.plans import daily_models, linear, reports, trees
from hazeline.schemas import FUTURE_VARS, HORIZONS, TIME
from hazeline.session import materialize, scratch_path
from hazeline.sources import registry
from suite.bindings import NUDGE, SENSOR, Suite, sensor, station
from suite.profiles import PROFILED, scores_sql
from suite.profiles import suite as profiles
from suite.series import COMPLETE, DAILY, FUTURE, NAIVE, TARGETS, W, rnd

suite = Suite()
HOURLY = ["temperature", "humidity", "pressure", "wind_speed", "pm2_5", "aqi_lag_1", "aqi_lag_24", "aqi_rolling_mean_24h", "aqi"]
ALPHA = 100.0
MIN_TRAIN = 1500


def forest():
    return RandomForestRegressor(featuresCol=trees.FEATURES, numTrees=10, maxDepth=5, seed=trees.SEED)


def boosted():
    return GBTRegressor(featuresCol=trees.FEATURES, maxIter=5, maxDepth=3, seed=trees.SEED)


def feature_table(spark, sf_dir):
    return features.build_features(sensor(spark, sf_dir))


def model_rows(spark, sf_dir, columns=HOURLY):
    """The feature table with a model's columns alone, written once: places in a series read it twice."""
    return materialize(feature_table(spark, sf_dir).select("city", TIME, *columns, trees.TARGET), "features")


def split_table(spark, sf_dir):
    return materialize(splits.split_three(model_rows(spark, sf_dir)), "split")


def ridges(spark, sf_dir):
    return daily_models.train_daily(daily.daily_features(station(spark, sf_dir)))


@suite.query("ridge_daily")
def ridge_daily(spark, sf_dir):
    return daily_models.ridge_daily(ridges(spark, sf_dir))


@suite.query("alpha_grid")
def alpha_grid(spark, sf_dir):
    return daily_models.alpha_grid(ridges(spark, sf_dir))


@suite.query("leakage_gap")
def leakage_gap(spark, sf_dir):
    return daily_models.leakage_gap(daily_models.ridge_daily(ridges(spark, sf_dir)))


@suite.query("ablation_fw")
def ablation_fw(spark, sf_dir):
    return daily_models.ablation_fw(ridges(spark, sf_dir))


@suite.query("coefficient_rank")
def coefficient_rank(spark, sf_dir):
    return daily_models.coefficients(ridges(spark, sf_dir))


def noise_sql(variable: str, day: int) -> str:
    first, growth = FORECAST_NOISE[variable]
    part = lambda side: (
        f"((CAST('0x' || substr(md5(concat_ws('|', city, epoch_us(collection_timestamp), '{variable}', {day}, 42, '{side}')), 1, 12) AS BIGINT) + 1) / 281474976710656.0::DOUBLE)"
    )
    name = f"fw_{variable}{day}"
    value = f"{name} + {first + growth * (day - 1)}::DOUBLE * sqrt(-2.0::DOUBLE * ln({part('radius')})) * cos(2 * pi() * {part('angle')})"
    clipped = f"CASE WHEN {name} IS NOT NULL THEN least(greatest({value}, 0), 100) END" if variable in PERCENT_VARS else value
    return f"round({clipped} + {NUDGE}, 6) + 0 AS {name}"


@suite.query(
    "forecast_noise",
    f"""WITH {DAILY}, led AS (SELECT city, collection_timestamp, {', '.join(f'{e} AS {n}' for n, e in FUTURE.items())} FROM daily)
    SELECT city, collection_timestamp, {', '.join(noise_sql(v, h) for _, h in HORIZONS for v in FUTURE_VARS)} FROM led""",
)
def forecast_noise(spark, sf_dir):
    rows = daily.future_weather_lead(daily.daily_resample(station(spark, sf_dir)))
    noisy = add_noise(rows, len(HORIZONS))
    return noisy.select("city", TIME, *[f"fw_{v}{h}" for _, h in HORIZONS for v in FUTURE_VARS])


def served(spark, sf_dir):
    """The daily table with the models of a stored and reloaded run."""
    table = daily_models.daily_table(station(spark, sf_dir))
    folder, run = scratch_path(spark, "registry"), "ridge_3day_dailyavg_v6_20010801T000000Z"
    daily_models.save_run(daily_models.train_daily(table), folder, run)
    return (table, *daily_models.load_run(spark, folder, run))


@suite.query("forecast_3day")
def forecast_3day(spark, sf_dir):
    return daily_models.forecast_3day(*served(spark, sf_dir))


@suite.query("forecast_cards")
def forecast_cards(spark, sf_dir):
    forecast = daily_models.forecast_3day(*served(spark, sf_dir))
    return daily_models.forecast_cards(forecast, daily.latest_row(station(spark, sf_dir)))


@suite.query("linear_contributions")
def linear_contributions(spark, sf_dir):
    return daily_models.explain_forecast(*served(spark, sf_dir))


@suite.query("topk_contributions")
def topk_contributions(spark, sf_dir):
    return linear.topk_contributions(daily_models.explain_forecast(*served(spark, sf_dir)))


@suite.query("forest_model")
def forest_model(spark, sf_dir):
    rows = split_table(spark, sf_dir)
    model = trees.fit_pipeline(forest(), rows.filter(F.col("split") == "train"), HOURLY)
    return trees.evaluate_model(model, rows.filter(F.col("split") == "test"), by=["city"])


@suite.query("boosted_model")
def boosted_model(spark, sf_dir):
    rows = split_table(spark, sf_dir)
    model = trees.fit_pipeline(boosted(), rows.filter(F.col("split") == "train"), HOURLY)
    return trees.evaluate_model(model, rows.filter(F.col("split") == "test"), by=["city"])


@suite.query("evaluate_model")
def evaluate_model(spark, sf_dir):
    rows = split_table(spark, sf_dir)
    train = features.complete_rows(rows.filter(F.col("split") == "train"), HOURLY, trees.TARGET)
    model = daily_models.ridge_pipeline(train, HOURLY, ALPHA, trees.TARGET)
    scored = model.transform(features.complete_rows(rows, HOURLY, trees.TARGET))
    return metrics.forecast_metrics(scored, trees.TARGET, "prediction", ["split"])


@suite.query("random_search_cv")
def random_search_cv(spark, sf_dir):
    train = split_table(spark, sf_dir).filter(F.col("split") == "train")
    space = {"numTrees": [5, 10], "maxDepth": [3, 5], "minInstancesPerNode": [1, 5]}
    _, trials = trees.random_search_cv(forest(), space, train, HOURLY, k=3, n_iter=2)
    found = [(i, t["rmse"], str(sorted(t["setting"].items()))) for i, t in enumerate(trials, 1)]
    return spark.createDataFrame(found, "rank int, rmse double, setting string")


@suite.query("train_select")
def train_select(spark, sf_dir):
    result = trees.train_select(split_table(spark, sf_dir), HOURLY)
    stages = {"validation": result["validation"], "test": result["test"], "baseline_test": result["baseline_test"]}
    parts = [df.withColumn("stage", F.lit(name)) for name, df in stages.items()]
    backtest = result["walk_forward"].withColumns({"model": F.lit(result["best"]), "stage": F.lit("walk_forward")})
    return daily_models.stack([*parts, backtest])


@suite.query("walk_forward_eval")
def walk_forward_eval(spark, sf_dir):
    predictions = linear.walk_forward_ridge(model_rows(spark, sf_dir), HOURLY, trees.TARGET, ALPHA)
    return linear.walk_forward_eval(predictions, trees.TARGET)


BACKTEST = f"""{COMPLETE}, placed AS (SELECT city, aqi, aqi_target AS y, row_number() OVER ({W}) AS rn FROM complete),
  blocked AS (SELECT *, CAST(floor((rn - 1 - {MIN_TRAIN}) / 336) AS BIGINT) AS block FROM placed)"""


@suite.query(
    "walk_forward_persistence",
    f"WITH {BACKTEST} SELECT city, count(*) AS n, {scores_sql('y', 'aqi')}, count(DISTINCT block) AS n_windows FROM blocked WHERE rn > {MIN_TRAIN} GROUP BY city",
)
def walk_forward_persistence(spark, sf_dir):
    blocks = splits.walk_forward_blocks(model_rows(spark, sf_dir), [*HOURLY, trees.TARGET])
    scored = metrics.persistence_model(blocks.filter(F.col("block") >= 0))
    return linear.walk_forward_eval(scored, trees.TARGET)


# With one feature, ridge has a closed form in SQL aggregates: the least-squares
# slope shrunk by n / (n + alpha), through the means.


@suite.query(
    "walk_forward_single",
    f"""WITH {BACKTEST}, windows AS (SELECT DISTINCT city, block, {MIN_TRAIN} + 336 * block AS known FROM blocked WHERE rn > {MIN_TRAIN}),
    models AS (SELECT w.city, w.block, avg(b.aqi) AS mx, avg(b.y) AS my, count(*) / (count(*) + {ALPHA}) * regr_slope(b.y, b.aqi) AS slope
      FROM windows w JOIN blocked b ON w.city = b.city AND b.rn <= w.known GROUP BY ALL),
    scored AS (SELECT b.city, b.block, b.y, my + slope * (b.aqi - mx) AS p FROM blocked b JOIN models m ON b.city = m.city AND b.block = m.block WHERE rn > {MIN_TRAIN})
    SELECT city, count(*) AS n, {scores_sql('y', 'p')}, count(DISTINCT block) AS n_windows FROM scored GROUP BY city""",
)
def walk_forward_single(spark, sf_dir):
    predictions = linear.walk_forward_ridge(model_rows(spark, sf_dir, ["aqi"]), ["aqi"], trees.TARGET, ALPHA)
    return linear.walk_forward_eval(predictions, trees.TARGET)


DAYS_AHEAD = f"""{DAILY}, ahead AS ({' UNION ALL '.join(f"SELECT city, collection_timestamp, aqi, '{label}' AS horizon, {TARGETS[f'target{n}']} AS y FROM daily" for label, n in HORIZONS)}),
  held AS (SELECT *, row_number() OVER v AS rn, count(*) OVER u AS n FROM ahead WHERE y IS NOT NULL
    WINDOW u AS (PARTITION BY city, horizon), v AS (PARTITION BY city, horizon ORDER BY collection_timestamp)),
  parted AS (SELECT *, rn > n - floor(n * 0.2::DOUBLE) AS test FROM held)"""
GRID_SQL = ", ".join(f"({a})" for a in daily_models.ALPHA_GRID)


@suite.query(
    "ridge_single",
    f"""WITH {DAYS_AHEAD}, models AS (SELECT city, horizon, alpha, avg(aqi) AS mx, avg(y) AS my,
      count(*) / (count(*) + alpha) * regr_slope(y, aqi) AS slope FROM parted, (VALUES {GRID_SQL}) grid(alpha) WHERE NOT test GROUP BY city, horizon, alpha),
    scored AS (SELECT p.city, p.horizon, CAST(alpha AS DOUBLE) AS alpha, y, my + slope * (aqi - mx) AS p
      FROM parted p JOIN models m ON p.city = m.city AND p.horizon = m.horizon WHERE test)
    SELECT city, horizon, alpha, count(*) AS n, {scores_sql('y', 'p')} FROM scored GROUP BY city, horizon, alpha""",
)
def ridge_single(spark, sf_dir):
    days = daily.daily_resample(station(spark, sf_dir))
    parts = []
    for label, n in HORIZONS:
        rows = features.complete_rows(daily.target_mean_ahead(days, n), ["aqi"], "target")
        split = materialize(splits.split_tail(rows.select("city", TIME, "aqi", "target"), bounded=True), "split")
        models = linear.RidgeSums(split.filter("split = 'train'"), ["aqi"], "target").fit(daily_models.ALPHA_GRID)
        scored = linear.predict_linear(split.filter("split = 'test'"), models, ["aqi"], extra=["alpha"])
        scores = metrics.forecast_metrics(scored, "target", "prediction", ["city", "alpha"])
        parts.append(scores.withColumn("horizon", F.lit(label)))
    return daily_models.stack(parts)


@suite.query(
    "contributions_single",
    f"""WITH {COMPLETE}, models AS (SELECT city, avg(aqi) AS mx, avg(aqi_target) AS my,
      count(*) / (count(*) + {ALPHA}) * regr_slope(aqi_target, aqi) AS slope FROM complete GROUP BY city)
    SELECT c.city, collection_timestamp, {rnd('my + slope * (aqi - mx)', 'prediction')}, {rnd('my', 'base_value')}, 'aqi' AS feature,
      {rnd('slope * (aqi - mx)', 'contribution')} FROM complete c JOIN models m ON c.city = m.city""",
)
def contributions_single(spark, sf_dir):
    rows = materialize(feature_table(spark, sf_dir).select("city", TIME, "aqi", trees.TARGET), "rows")
    models = linear.RidgeSums(rows, ["aqi"], trees.TARGET).fit([ALPHA])
    return linear.linear_contributions(rows, models, rows, ["aqi"])


@suite.query(
    "ridge_ml_single",
    f"""WITH {COMPLETE}, model AS (SELECT avg(aqi) AS mx, avg(aqi_target) AS my,
      count(*) / (count(*) + {ALPHA}) * regr_slope(aqi_target, aqi) AS slope FROM complete)
    SELECT city, collection_timestamp, {rnd('my + slope * (aqi - mx)', 'prediction')} FROM complete, model""",
)
def ridge_ml_single(spark, sf_dir):
    rows = materialize(feature_table(spark, sf_dir).select("city", TIME, "aqi", trees.TARGET), "rows")
    model = daily_models.ridge_pipeline(rows, ["aqi"], ALPHA, trees.TARGET)
    return model.transform(rows).select("city", TIME, "prediction")


@suite.query("horizon_sweep")
def horizon_sweep(spark, sf_dir):
    table = features.build_features(sensor(spark, sf_dir), complete_only=False)
    return reports.horizon_sweep(table, HOURLY)


SWEPT = f"""{SENSOR}, valid AS (SELECT city, collection_timestamp, aqi, month(collection_timestamp) AS m, {NAIVE['roll_mean_24h']} AS roll_mean_24h,
    {NAIVE['roll_mean_7d']} AS roll_mean_7d, lead(aqi, 24) OVER ({W}) AS y FROM sensor QUALIFY y IS NOT NULL),
  spots AS (SELECT *, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY city) AS n FROM valid),
  seasonal AS (SELECT city, m, avg(aqi) AS seasonal_month FROM spots WHERE rn <= floor(n * 0.7::DOUBLE) GROUP BY ALL),
  tested AS (SELECT s.*, aqi AS persistence, seasonal_month FROM spots s LEFT JOIN seasonal x ON s.city = x.city AND s.m = x.m
    WHERE rn > floor(n * (0.7::DOUBLE + 0.15::DOUBLE)))"""


@suite.query(
    "sweep_baselines",
    f"WITH {SWEPT} " + " UNION ALL ".join(
        f"SELECT '{p}' AS model, count({p}) AS n, {scores_sql('y', p)} FROM tested WHERE {p} IS NOT NULL" for p in metrics.NAIVE
    ),
)
def sweep_baselines(spark, sf_dir):
    ahead = features.target_ahead(time_fields(metrics.rolling_naive(sensor(spark, sf_dir))), 24)
    split = materialize(splits.split_three(features.complete_rows(ahead, ["aqi_target"])), "sweep")
    return reports.sweep_baselines(split.filter("split = 'test'"), split.filter("split = 'train'"))


def section(name: str, item: str, metrics_of: list[str], sql: str, city: str = "city") -> str:
    return " UNION ALL ".join(
        f"SELECT {city} AS city, '{name}' AS section, CAST({item} AS VARCHAR) AS item, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM ({sql})"
        for m in metrics_of
    )


REPORT = " UNION ALL ".join(
    [
        section("shape", "'all'", ["n_rows", "first_epoch", "last_epoch"],
                f"WITH {SENSOR} SELECT city, count(*) AS n_rows, round(epoch_us(min(collection_timestamp)) / 1e6 + 3.7e-10, 6) AS first_epoch, "
                "round(epoch_us(max(collection_timestamp)) / 1e6 + 3.7e-10, 6) AS last_epoch FROM sensor GROUP BY city"),
        section("month", "month", ["mean", "std", "n"],
                f"WITH {SENSOR} SELECT city, month(collection_timestamp) AS month, {rnd('avg(aqi)', 'mean')}, {rnd('stddev_samp(aqi)', 'std')}, "
                "count(aqi) AS n FROM sensor GROUP BY 1, 2"),
        section("acf", "lag", ["acf"], profiles.oracles["acf"]),
        section("split", "split", ["n", "aqi_mean", "aqi_std", "aqi_min", "aqi_max"], profiles.oracles["split_stats"]),
        section("shift", '"column"', ["train_mean", "test_mean", "train_std", "test_std", "ks_stat", "ks_pvalue"],
                profiles.oracles["distribution_shift"], "NULL"),
        section("target", "horizon", ["n", "mean", "std", "var", "month_mean_baseline_r2", "month_mean_baseline_rmse"], profiles.oracles["target_stats"]),
        section("baseline", "horizon || ':' || baseline", ["rmse", "mae", "r2", "smape"], profiles.oracles["naive_baselines"]),
    ]
)


@suite.query("diagnose_report", REPORT)
def diagnose_report(spark, sf_dir):
    return reports.diagnose_report(sensor(spark, sf_dir), PROFILED)


def saved_run(spark, sf_dir):
    """A forest saved under a stamped run name with its test scores."""
    rows = split_table(spark, sf_dir)
    model = trees.fit_pipeline(forest(), splits.concat_train_val(rows), HOURLY)
    test = rows.filter(F.col("split") == "test")
    scores = trees.evaluate_model(model, test).first()
    naive = metrics.forecast_metrics(metrics.persistence_model(test), trees.TARGET, "prediction").first()
    entry = {
        "version": "v1", "n_days": 3, "feature_cols": HOURLY, "target": "aqi 72 rows ahead", "n_test": scores["n"],
        "test_metrics": {k: scores[k] for k in ("rmse", "mae", "r2")},
        "naive_baseline": {k: naive[k] for k in ("rmse", "mae", "r2")},
    }
    folder = scratch_path(spark, "registry")
    registry.model_save(spark, folder, "random_forest_20240201T000000Z", {"hourly72": model}, {"hourly72": entry})
    return folder, rows


@suite.query("model_save")
def model_save(spark, sf_dir):
    folder, _ = saved_run(spark, sf_dir)
    return registry.registry_scan(registry.registry_documents(spark, folder))


@suite.query("model_load")
def model_load(spark, sf_dir):
    folder, rows = saved_run(spark, sf_dir)
    latest = registry.registry_latest(registry.registry_documents(spark, folder)).first()["by_stamp"]
    models, metadata = registry.model_load(spark, folder, latest)
    scored = trees.score_batch(models["hourly72"], rows.select("city", *metadata["hourly72"]["feature_cols"]))
    return scored.groupBy("city").agg(F.count("*").alias("n"), F.avg("prediction").alias("mean_forecast"))


@suite.query("score_batch")
def score_batch(spark, sf_dir):
    folder, rows = saved_run(spark, sf_dir)
    models, _ = registry.model_load(spark, folder, "random_forest_20240201T000000Z")
    return trees.score_batch(models["hourly72"], rows, "aqi_forecast_72h").select("city", TIME, "aqi_forecast_72h")
