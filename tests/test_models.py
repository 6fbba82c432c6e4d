"""Fits against closed forms, backtests, scores and explanations."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from hazeline.operators import daily, features, metrics, splits
from hazeline.plans import daily_models, linear, trees

START = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def test_backtest_of_trees_is_one_scan_however_many_windows(spark):
    rows = [("a" if i % 3 else "b", START + dt.timedelta(hours=i), float(i % 7), float(i % 7) * 2 + i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "city string, collection_timestamp timestamp, x double, y double").coalesce(1)
    forest = RandomForestRegressor(featuresCol="features", numTrees=2, maxDepth=2, seed=1)
    scored = trees.walk_forward_trees(forest, df, ["x"], "y", 20, 40)
    assert scored.columns == ["city", "collection_timestamp", "x", "y", "block", "prediction"]
    assert scored._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {r.collection_timestamp: (r.block, r.prediction) for r in scored.collect()}
    wanted = {}
    for block, first in enumerate(range(40, 120, 20)):
        known = df.filter(F.col("collection_timestamp") < F.lit(START + dt.timedelta(hours=first)))
        ahead = df.filter(F.col("collection_timestamp").between(F.lit(START + dt.timedelta(hours=first)), F.lit(START + dt.timedelta(hours=first + 19))))
        model = trees.fit_pipeline(forest, known, ["x"], "y")
        wanted |= {r.collection_timestamp: (block, r.prediction) for r in trees.score_batch(model, ahead).collect()}
    assert len(got) == 80 and got.keys() == wanted.keys()
    assert all(got[t][0] == wanted[t][0] and got[t][1] == pytest.approx(wanted[t][1]) for t in got)


def closed_form(x, y, alpha):
    mean, std = x.mean(0), x.std(0)
    z = (x - mean) / np.where(std > 0, std, 1.0)
    coef = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda rows: ((rows - mean) / np.where(std > 0, std, 1.0)) @ coef + y.mean()


@pytest.fixture(scope="module")
def linear_rows(spark):
    rng = np.random.default_rng(5)
    rows = []
    for city, n in (("a", 300), ("b", 80)):
        x = rng.normal([1000.0, 3.0, 50.0], [5.0, 1.0, 20.0], (n, 3))
        y = x @ np.array([0.3, -2.0, 0.5]) + rng.normal(0, 1, n) + (10 if city == "b" else 0)
        rows += [(city, START + dt.timedelta(hours=i), *map(float, x[i]), 7.0, float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "city string, collection_timestamp timestamp, p double, q double, r double, flat double, y double").repartition(4).cache()


COLUMNS = ["p", "q", "r", "flat"]


@pytest.mark.parametrize("alpha", [0.5, 100.0])
def test_group_ridge_equals_closed_form(linear_rows, alpha):
    sums = linear.RidgeSums(linear_rows, COLUMNS, "y")
    scored = linear.predict_linear(linear_rows, sums.fit([alpha]), COLUMNS).toPandas()
    for _, rows in scored.groupby("city"):
        x, y = rows[COLUMNS].to_numpy(), rows["y"].to_numpy()
        assert np.allclose(closed_form(x, y, alpha)(x), rows["prediction"], atol=1e-8)


def test_sums_of_many_groups_are_passed_on_in_parts(linear_rows, monkeypatch):
    from hazeline.operators import moments

    whole = linear.RidgeSums(linear_rows, COLUMNS, "y").fit([1.0]).orderBy("city").collect()
    monkeypatch.setattr(moments, "GROUPS_HELD", 0)
    linear_rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        parts = linear.RidgeSums(linear_rows, COLUMNS, "y").fit([1.0]).orderBy("city").collect()
    finally:
        linear_rows.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for a, b in zip(whole, parts):
        assert a.city == b.city and a.n_train == b.n_train and np.allclose(a.beta, b.beta, atol=1e-9)


def test_subset_of_sums_equals_own_fit(linear_rows):
    sums = linear.RidgeSums(linear_rows, COLUMNS, "y")
    scored = linear.predict_linear(linear_rows, sums.fit([10.0], ["q", "r"]), ["q", "r"]).toPandas()
    for _, rows in scored.groupby("city"):
        x, y = rows[["q", "r"]].to_numpy(), rows["y"].to_numpy()
        assert np.allclose(closed_form(x, y, 10.0)(x), rows["prediction"], atol=1e-8)


def test_saved_pipeline_equals_closed_form(linear_rows, tmp_path):
    from pyspark.ml import PipelineModel

    one = linear_rows.filter("city = 'a'")
    daily_models.ridge_pipeline(one, COLUMNS, 100.0, "y").write().save(str(tmp_path / "m"))
    rows = PipelineModel.load(str(tmp_path / "m")).transform(one).toPandas()
    x, y = rows[COLUMNS].to_numpy(), rows["y"].to_numpy()
    assert np.allclose(closed_form(x, y, 100.0)(x), rows["prediction"], atol=1e-6)


def test_contributions_add_up(linear_rows):
    models = linear.RidgeSums(linear_rows, COLUMNS, "y").fit([10.0])
    parts = linear.linear_contributions(linear_rows, models, linear_rows, COLUMNS)
    sums = parts.groupBy("city", "collection_timestamp", "prediction", "base_value").agg(F.sum("contribution").alias("s"))
    assert sums.filter(F.abs(F.col("s") + F.col("base_value") - F.col("prediction")) > 1e-6).isEmpty()
    direct = linear.predict_linear(linear_rows, models, COLUMNS)
    joined = sums.join(direct, ["city", "collection_timestamp"])
    assert joined.filter(F.abs(sums["prediction"] - direct["prediction"]) > 1e-9).isEmpty()
    top = linear.topk_contributions(parts.withColumn("horizon", F.lit("h")), 2)
    assert top.groupBy("city", "collection_timestamp").count().filter("count <> 2").isEmpty()


def test_coefficients_are_ranked(linear_rows):
    models = linear.RidgeSums(linear_rows, COLUMNS, "y").fit([1.0])
    ranked = linear.coefficient_rank(models, COLUMNS).filter("city = 'a'").orderBy("rank").collect()
    assert ranked[0].feature == "r" and ranked[-1].feature == "flat"
    assert [abs(r.coef) for r in ranked] == sorted((abs(r.coef) for r in ranked), reverse=True)


def exact_rows(spark, n):
    rows = [("x", START + dt.timedelta(hours=i), float(i), 2.0 * i + 1, float(i), float(i)) for i in range(n)]
    return spark.createDataFrame(rows, "city string, collection_timestamp timestamp, x double, y double, aqi double, aqi_target double")


@pytest.mark.parametrize("n, step, min_train, scored, windows", [(60, 10, 20, 40, 4), (25, 10, 10, 15, 2)])
def test_walk_forward_windows(spark, n, step, min_train, scored, windows):
    predictions = linear.walk_forward_ridge(exact_rows(spark, n), ["x"], "y", 1e-9, step, min_train)
    row = linear.walk_forward_eval(predictions, "y").first()
    assert (row.n, row.n_windows) == (scored, windows) and row.rmse < 1e-6
    blocks = splits.walk_forward_blocks(exact_rows(spark, n), ["aqi", "aqi_target"], step, min_train)
    naive = linear.walk_forward_eval(metrics.persistence_model(blocks.filter("block >= 0")), "aqi_target").first()
    assert (naive.n, naive.n_windows, naive.rmse, naive.r2) == (scored, windows, 0.0, 1.0)


def test_walk_forward_needs_rows(spark):
    assert splits.walk_forward_blocks(exact_rows(spark, 20), ["x", "y"], 10, 20).isEmpty()
    assert trees.walk_forward_trees(RandomForestRegressor(featuresCol="features"), exact_rows(spark, 20), ["x"], "y", 10, 20).isEmpty()


def test_walk_forward_equals_refitting(spark, linear_rows):
    one = linear_rows.filter("city = 'b'")
    got = linear.walk_forward_ridge(one, COLUMNS, "y", 5.0, 15, 30).orderBy("collection_timestamp").toPandas()
    rows = one.orderBy("collection_timestamp").toPandas()
    x, y = rows[COLUMNS].to_numpy(), rows["y"].to_numpy()
    expected = np.concatenate([closed_form(x[:t], y[:t], 5.0)(x[t:t + 15]) for t in range(30, len(y), 15)])
    assert np.allclose(got["prediction"], expected, atol=1e-7)


def scores(spark, pairs):
    return metrics.forecast_metrics(spark.createDataFrame(pairs, "y double, p double"), "y", "p").first()


def test_scores(spark):
    s = scores(spark, [(1.0, 2.0), (2.0, 2.0), (3.0, 4.0), (4.0, 4.0)])
    assert s.mae == 0.5 and s.rmse == pytest.approx(0.5**0.5) and s.smape == pytest.approx(25 * (2 / 3 + 2 / 7))
    assert scores(spark, [(0.0, 0.0)]).smape == 0.0 and scores(spark, [(0.0, 5.0)]).smape == 200.0
    assert scores(spark, [(3.0, 3.0), (3.0, 3.0)]).r2 == 1.0 and scores(spark, [(3.0, 3.0), (3.0, 4.0)]).r2 == 0.0


def test_selection(spark):
    table = spark.createDataFrame([("a", 3.0), ("b", 2.0), (metrics.PERSISTENCE, 1.0)], "model string, rmse double")
    assert metrics.select_best(table).first().model == "b"
    assert [r.model for r in metrics.comparison_table(table).collect()][1:] == ["b", "a"]
    with pytest.raises(Exception, match="no model to choose"):
        metrics.select_best(table.limit(0)).collect()


def hourly_rows(spark, days, gap_after=None, city="x"):
    rows = []
    for d in range(days):
        shift = 90 if gap_after is not None and d >= gap_after else 0
        for h in range(24):
            base = 100 + 10 * np.sin(d / 3) + d % 5 + h / 10
            rows.append((city, START + dt.timedelta(days=d + shift, hours=h), float(base), float(base / 2), 20.0 + d % 7, 3.0 + d % 4,
                         40.0 + d % 11, 1000.0 + d % 13, 10.0 + d % 9))
    return spark.createDataFrame(
        rows, "city string, collection_timestamp timestamp, aqi double, pm2_5 double, temperature double, wind_speed double, humidity double, pressure double, clouds double"
    )


def test_daily_rows_and_anchor_override(spark):
    hours = hourly_rows(spark, 40)
    table = daily.daily_features(hours)
    assert table.count() == 40
    future = spark.createDataFrame(
        [("x", (START + dt.timedelta(days=39 + h)).date(), *[100.0 * h + i for i in range(5)]) for h in (1, 2, 3, 9)],
        "city string, date date, wind double, humid double, temp double, clouds double, pressure double",
    )
    last = daily.latest_row(daily.daily_features(hours, future)).first()
    assert [last.fw_wind1, last.fw_humid2, last.fw_pressure3] == [100.0, 201.0, 304.0]
    own = daily.latest_row(table).first()
    assert own.fw_wind1 == own.wind and own.fw_pressure3 == own.pressure
    earlier = daily.daily_features(hours, future).filter(F.col("collection_timestamp") < last.collection_timestamp)
    assert earlier.exceptAll(table).isEmpty()


def test_gap_counts_observed_days(spark):
    table = daily.daily_features(hourly_rows(spark, 40, gap_after=38)).orderBy("collection_timestamp").collect()
    assert len(table) == 40 and table[38].aqi_l1 == table[37].aqi and table[39].rm30 is not None


def test_target_needs_full_coming_days(spark):
    rows = [("x", START + dt.timedelta(days=i), float(v)) for i, v in enumerate([1, 2, 3, 4, 5])]
    df = spark.createDataFrame(rows, "city string, collection_timestamp timestamp, aqi double")
    got = [r.target for r in daily.target_mean_ahead(df, 2).orderBy("collection_timestamp").collect()]
    assert got == [None, 3.5, 4.5, None, None]


def test_training_serving_and_cards(spark, tmp_path):
    rows = hourly_rows(spark, 120).unionByName(hourly_rows(spark, 90, city="y"))
    table = daily_models.daily_table(rows)
    ridges = daily_models.train_daily(table)
    scored = daily_models.ridge_daily(ridges).toPandas()
    assert len(scored) == 2 * 3 * 3 and set(scored.kind) == {"forecast", "exact_weather", "naive"}
    first = ridges["day1_avg"]
    assert first.train.filter("city = 'x'").count() == scored[(scored.city == "x") & (scored.horizon == "day1_avg")].n_train.iloc[0]
    models, columns = {k: r.models for k, r in ridges.items()}, {k: r.columns for k, r in ridges.items()}
    assert [len(c) for c in columns.values()] == [51, 56, 61]
    forecast = daily_models.forecast_3day(table, models, columns)
    found = forecast.filter("city = 'x'").orderBy("n_days").collect()
    assert [r.horizon for r in found] == ["day1_avg", "day2_avg", "day3_avg"]
    assert found[0].forecast_date == (START + dt.timedelta(days=120)).date()
    cards = daily_models.forecast_cards(forecast, daily.latest_row(rows)).filter("city = 'x'").orderBy("horizon").collect()
    assert cards[2].target_date == (START + dt.timedelta(days=122)).date() and cards[0].category in {b[1] for b in daily_models_bands()}
    explained = daily_models.explain_forecast(table, models, columns)
    total = explained.groupBy("city", "horizon", "prediction", "base_value").agg(F.sum("contribution").alias("s"))
    assert total.count() == 6 and total.filter(F.abs(F.col("s") + F.col("base_value") - F.col("prediction")) > 1e-6).isEmpty()
    grid = daily_models.alpha_grid(ridges)
    assert grid.count() == 2 * 3 * 5
    own = grid.filter("city = 'x' and horizon = 'day1_avg' and alpha = 100").first().r2
    assert own == pytest.approx(scored[(scored.city == "x") & (scored.horizon == "day1_avg") & (scored.kind == "forecast")].r2.iloc[0])
    gap = daily_models.leakage_gap(daily_models.ridge_daily(ridges))
    assert gap.count() == 6
    document = daily_models.run_metadata(ridges, "x")
    assert document["day3_avg"]["n_days"] == 3 and len(document["day3_avg"]["feature_cols"]) == 61
    daily_models.save_run(ridges, str(tmp_path), "ridge_3day_dailyavg_v6_20260501T000000Z")
    loaded, inputs = daily_models.load_run(spark, str(tmp_path), "ridge_3day_dailyavg_v6_20260501T000000Z")
    assert inputs == columns
    assert daily_models.forecast_3day(table, loaded, inputs).exceptAll(forecast).isEmpty()
    with pytest.raises(Exception, match="no metadata|PATH_NOT_FOUND"):
        daily_models.load_run(spark, str(tmp_path), "ridge_3day_dailyavg_v6_20260101T000000Z")
    with pytest.raises(ValueError, match="complete history"):
        daily_models.forecast_3day(daily.daily_features(hourly_rows(spark, 10)), models, columns)


def daily_models_bands():
    from hazeline.functions.indices import AQI_BANDS

    return AQI_BANDS


def test_sampled_settings_are_distinct_and_seeded():
    space = {"a": [1, 2, 3], "b": [4, 5]}
    drawn = trees.sample_settings(space, 4, 1)
    assert drawn == trees.sample_settings(space, 4, 1) and len({tuple(s.items()) for s in drawn}) == 4
    assert len(trees.sample_settings(space, 99, 1)) == 6
    names = {p.name for e in trees.candidates().values() for p in e.params}
    assert all(set(s) <= names for s in trees.SPACES.values())


def test_training_run_end_to_end(spark):
    rows = hourly_rows(spark, 12)
    table = features.build_features(rows.withColumn("ingest_seq", F.monotonically_increasing_id()), horizon=24, complete_only=False)
    split = splits.split_three(features.complete_rows(table, ["aqi", "aqi_lag_24"], "aqi_target"))
    forest = RandomForestRegressor(featuresCol="features", numTrees=3, maxDepth=3, seed=1)
    result = trees.train_select(split, ["aqi", "aqi_lag_24"], {"Random Forest": forest}, {"Random Forest": {"maxDepth": [2, 3]}},
                                n_iter=2, k=2, gap=5, step=100, min_train=100)
    assert result["best"] == "Random Forest" and result["validation"].count() == 2
    assert result["test"].first().n == split.filter("split = 'test'").count()
    assert result["walk_forward"].first().n == split.count() - 100


def test_splits_validate(spark):
    rows = exact_rows(spark, 100)
    counts = {r.split: r["count"] for r in splits.split_three(rows).groupBy("split").count().collect()}
    assert counts == {"train": 70, "val": 15, "test": 15}
    for bad in (lambda: splits.split_two(rows, 0.0), lambda: splits.split_three(rows, 0.7, 0.2, 0.2), lambda: splits.ts_cv_folds(rows, 1),
                lambda: splits.ts_cv_folds(rows, 3, -1)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="at least 10 rows"):
        splits.split_two(exact_rows(spark, 9)).collect()
    with pytest.raises(Exception, match="too short"):
        splits.split_tail(exact_rows(spark, 4)).collect()


def test_training_on_nothing_is_an_error(spark):
    rows, forest = exact_rows(spark, 3).limit(0), RandomForestRegressor(featuresCol="features")
    for fit in (lambda: trees.fit_pipeline(forest, rows, ["x"], "y"), lambda: daily_models.ridge_pipeline(rows, ["x"], 1.0, "y"),
                lambda: trees.random_search_cv(forest, {"maxDepth": [2]}, rows, ["x"], "y")):
        with pytest.raises(ValueError, match="no complete rows"):
            fit()


def test_feature_lists(spark):
    rows = exact_rows(spark, 5).withColumn("pm2_5", F.lit(None).cast("double"))
    assert features.select_features(rows) == ["aqi"]
    with pytest.raises(ValueError):
        features.select_features(rows.select("city"))
    with pytest.raises(ValueError, match="nope"):
        features.complete_rows(rows, ["aqi", "nope"])


def test_complete_rows_are_told_without_rolling_windows(spark):
    import math

    start = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    rows = []
    for city in "ab":
        for i in range(400):
            pm = None if 200 <= i < 223 or (city == "b" and i % 200 == 7) else math.nan if (city, i) == ("b", 300) else 1.0 * (i % 13)
            rows.append((city, start + dt.timedelta(hours=i), float(i % 50), pm, 20.0, 40.0, i))
    df = spark.createDataFrame(rows, "city string, collection_timestamp timestamp, aqi double, pm2_5 double, temperature double, humidity double, ingest_seq long")
    built = features.build_features(df, horizon=24)
    values = features.drop_incomplete(features.build_features(df, horizon=24, complete_only=False), df)
    assert built.columns == values.columns
    key = lambda frame: sorted((r.city, r.collection_timestamp) for r in frame.select("city", "collection_timestamp").collect())
    assert key(built) == key(values) != []
    plan = built.select("city", "aqi_lag_1")._jdf.queryExecution().optimizedPlan().toString()
    assert "stddev" not in plan and "avg(" not in plan


def test_complete_rows_take_few_window_columns(spark):
    start, odd = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc), {40: None, 300: float("nan"), 310: float("inf"), 311: float("inf"), 330: float("-inf")}
    rows = [(c, start + dt.timedelta(hours=i), float(i % 50), 1.0 * (i % 13), odd.get(i, 20.0) if c == "b" else 20.0, 40.0, i) for c in "ab" for i in range(500)]
    df = spark.createDataFrame(rows, "city string, collection_timestamp timestamp, aqi double, pm2_5 double, temperature double, humidity double, ingest_seq long")
    built = features.build_features(df, horizon=24)
    values = features.drop_incomplete(features.build_features(df, horizon=24, complete_only=False), df)
    key = lambda frame: sorted((r.city, r.collection_timestamp) for r in frame.select("city", "collection_timestamp").collect())
    assert key(built) == key(values) != []
    # One flag is lagged six times and three counts once, whatever the number of columns; the rest are the rates of four columns.
    plan = built.select("city", "collection_timestamp", "aqi_target")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" lag(") <= 13
