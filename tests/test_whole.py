"""Registered training queries ask for their whole job."""

import datetime as dt
import random

import pytest

from hazeline.plans import reports
from suite import ensembles, models

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def asked(spark, monkeypatch):
    """Fits that a query asks for, over rows that are never looked at."""
    fits = []

    def recorded(rows, wanted, columns, edges, windows):
        fits.extend(wanted)
        found = [("x", k, 1.0, float(k)) for k in range(len(wanted))]
        return spark.createDataFrame(found, "city string, fit int, y double, prediction double")

    rows = spark.createDataFrame([("x", START + dt.timedelta(hours=h), START.timestamp() + 3600.0 * h) for h in range(2000)], "city string, collection_timestamp timestamp, t double")
    monkeypatch.setattr(ensembles, "rows_of", lambda *_: (None, rows, [[]] * len(ensembles.LEARNED), float("inf")))
    monkeypatch.setattr(ensembles.selection, "predict_each", recorded)
    return fits


def test_the_search_grows_the_rounds_of_its_space(spark, asked):
    assert ensembles.ensemble_search(spark, "").count() == 25
    space = ensembles.selection.SPACES["Boosted Leaves"]
    assert len(asked) == 125 and {f.trees for f in asked} == set(space["trees"]) and {f.leaves for f in asked} == set(space["leaves"])


def test_the_backtest_grows_all_rounds_of_its_family(spark, asked):
    assert ensembles.ensemble_walk_forward(spark, "").first().n == 2
    assert [f.trees for f in asked] == [ensembles.selection.CANDIDATES["Boosted Leaves"]["trees"]] * 2


@pytest.fixture
def events(spark, tmp_path):
    """Three weeks of two hourly series."""
    rng = random.Random(3)
    rows = [
        (i, START.replace(tzinfo=None) + dt.timedelta(hours=i // 2), rng.randrange(900), "ab"[i % 2], rng.uniform(0, 200), f'{{"k": {rng.randrange(100)}}}') for i in range(1000)
    ]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_the_sweep_tunes_leaf_wise_trees_for_each_horizon(spark, events, monkeypatch):
    asked = []

    def recorded(rows, name, columns, edges, space, n_iter, k, gap, seed):
        asked.append((name, columns, space, n_iter, k, gap))
        return [{"setting": {"trees": 2, "leaves": 3}}]

    monkeypatch.setattr(reports, "search", recorded)
    found = models.horizon_sweep(spark, events).collect()
    assert {(r.model, r.horizon) for r in found} == {(m, h) for m in ("model", "persistence", "roll_mean_24h", "roll_mean_7d", "seasonal_month") for h in reports.HORIZON_HOURS}
    assert all(r.n > 0 for r in found)
    assert [(a[0], a[1], a[5]) for a in asked] == [("Boosted Leaves", models.HOURLY, h) for h in reports.HORIZON_HOURS]
    assert all(a[3:5] == (40, 5) and a[2]["trees"] == [200, 400, 800] and {"l1", "l2", "features", "rows", "min_rows", "leaves"} < set(a[2]) for a in asked)


def test_the_sweep_scores_its_best_setting(spark, events):
    table = models.features.build_features(models.sensor(spark, events), complete_only=False)
    space = {"trees": [2, 30], "leaves": [2, 8], "step": [0.3], "min_rows": [5]}
    found = {r.model: r for r in reports.horizon_sweep(table, ["aqi", "humidity", "aqi_lag_24"], [6], space=space, n_iter=3, k=2).collect()}
    assert len(found) == 5 and found["model"].n == found["persistence"].n and 0 < found["model"].rmse < found["persistence"].rmse


def test_folds_shorter_than_the_gap_train_on_what_there_is(spark):
    from hazeline.operators import splits

    rows = spark.createDataFrame([(c, START + dt.timedelta(hours=h)) for h in range(120) for c in "xy"], "city string, collection_timestamp timestamp")
    hours = lambda folds: [(s - START.timestamp()) / 3600 for _, s, _ in folds]
    assert hours(splits.time_folds(rows, 3, 50)) == [30.0, 60.0, 90.0] and hours(splits.trained_folds(rows, 3, 50)) == [60.0, 90.0]
    assert splits.trained_folds(rows, 3, 20) == splits.time_folds(rows, 3, 20)
    with pytest.raises(ValueError, match="no complete rows"):
        splits.trained_folds(rows, 2, 120)


def test_the_training_run_tunes_every_family(spark, events, monkeypatch):
    asked, backtests = [], []
    trees = models.trees

    def searched(estimator, space, train, columns, target, k, gap, n_iter, seed):
        asked.append((space, k, gap, n_iter))
        few = estimator.copy({estimator.getParam(next(p for p in space if p in ("maxIter", "numTrees"))): 1, estimator.maxDepth: 1})
        return trees.fit_pipeline(few, train, columns, target), [{"estimator": few}]

    def backtest(estimator, df, columns, target, step, min_train):
        backtests.append((step, min_train))
        return df.withColumn("prediction", models.F.lit(1.0))

    monkeypatch.setattr(trees, "random_search_cv", searched)
    monkeypatch.setattr(trees, "walk_forward_trees", backtest)
    found = models.train_select(spark, events).collect()
    assert {r.model for r in found if r.stage == "validation"} == {*trees.SPACES, "Persistence Baseline"}
    assert [a[0] for a in asked] == list(trees.SPACES.values()) and {a[1:] for a in asked} == {(5, 72, 25)} and backtests == [(336, 1500)]


def test_a_batch_of_any_size_is_streamed_a_few_rows_at_a_time(monkeypatch):
    import numpy as np
    import pandas as pd

    from hazeline import schemas as S
    from hazeline.streaming import live

    class Held:
        value = None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

    rng, most, derived = np.random.default_rng(5), [], live._derived
    rows = pd.DataFrame({S.TIME: pd.Timestamp("2026-01-01") + pd.to_timedelta(rng.integers(0, 4000, 5000), "h"), "city": "x", "aqi": rng.random(5000), "ingest_seq": range(5000)})
    rows.loc[rng.integers(0, 5000, 300), "aqi"] = None
    parts = [rows[:3500], rows[3500:]]

    def run(open_rows):
        names = [S.TIME, "city", "aqi", "ingest_seq", "version", "late", *derived(rows[:1])]
        task, out = live.RecentRows(names, "ingest_seq", open_rows), []
        task.held = Held()
        for part in parts:
            out += task.handleInputRows(("x",), iter([part[i : i + 70] for i in range(0, len(part), 70)]), None)
        return pd.concat(out).reset_index(drop=True), task.held.value[2], live.pa.ipc.open_stream(task.held.value[0]).read_pandas()

    whole = {n: run(n) for n in (10_000, 900)}
    for name, n in (("RUN_ROWS", 400), ("READ_ROWS", 50), ("DERIVED_ROWS", 200)):
        monkeypatch.setattr(live, name, n)
    monkeypatch.setattr(live, "_derived", lambda frame: (most.append(len(frame)), derived(frame))[1])
    for n, (found, cut, state) in whole.items():
        again, cut_again, state_again = run(n)
        by = ["late", "version", S.TIME, "ingest_seq"]
        pd.testing.assert_frame_equal(found.sort_values(by, ignore_index=True), again.sort_values(by, ignore_index=True))
        pd.testing.assert_frame_equal(state, state_again)
        assert cut == cut_again == (n == 900) and found["late"].any() == cut
    assert max(most) < 1200
    newest = rows.drop_duplicates(S.TIME, keep="last")
    assert len(newest) == whole[10_000][0].groupby(S.TIME).ngroups
