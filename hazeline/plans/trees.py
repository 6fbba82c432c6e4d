"""Tree ensembles on Spark ML: candidates, search over time folds, selection.

The source grids name parameters of other libraries; each is mapped to the
Spark ML parameter of the same role, and those Spark ML does not have (extra
regularisation weights, minimum samples to split) are left out.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from math import inf, prod
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.operators.features import build_xy, complete_rows
from hazeline.operators.metrics import PERSISTENCE, comparison_table, forecast_metrics, persistence_model, select_best
from hazeline.operators.splits import backtest_windows, between, concat_train_val, trained_folds
from hazeline.session import materialize, scratch_path

TARGET = "aqi_target"
FEATURES = "features"
DEEPEST = 30  # the depth limit of Spark ML trees, used for "no limit"

# Candidate settings and search spaces.
FOREST_TREES = 200
BOOSTED_STEPS = [0.01, 0.03, 0.05, 0.1, 0.2]
BOOSTED_ROUNDS = [200, 400, 600]
FOREST_SPACE = {
    "numTrees": [200, 400, 600],
    "featureSubsetStrategy": ["0.3", "0.5", "sqrt", "all"],
    "minInstancesPerNode": [1, 3, 5],
    "maxDepth": [DEEPEST, 10, 20, 30],
}
SPACES = {
    "Boosted Leaves": {
        "maxDepth": [4, 5, 6, 7],
        "stepSize": BOOSTED_STEPS,
        "maxIter": BOOSTED_ROUNDS,
        "subsamplingRate": [0.7, 0.8, 1.0],
        "featureSubsetStrategy": ["0.6", "0.8", "all"],
        "minInstancesPerNode": [5, 20, 50],
    },
    "Boosted Depth": {
        "maxDepth": [3, 5, 7, 9],
        "stepSize": BOOSTED_STEPS,
        "maxIter": BOOSTED_ROUNDS,
        "subsamplingRate": [0.7, 0.8, 1.0],
        "featureSubsetStrategy": ["0.6", "0.8", "all"],
        "minInstancesPerNode": [1, 3, 10],
    },
    "Boosted Symmetric": {
        "maxDepth": [4, 6, 8, 10],
        "stepSize": BOOSTED_STEPS,
        "maxIter": BOOSTED_ROUNDS,
    },
    "Extra Trees": FOREST_SPACE,
    "Random Forest": FOREST_SPACE,
}
N_ITER = 25
N_FOLDS = 5
SEED = 42
#: Fits of a search or windows of a backtest at a time.
PARALLEL = 8


def candidates(seed: int = SEED) -> dict[str, object]:
    """Untrained estimators by name."""
    boosted = {n: GBTRegressor(featuresCol=FEATURES, seed=seed) for n in SPACES if n.startswith("Boosted")}
    forest = RandomForestRegressor(featuresCol=FEATURES, numTrees=FOREST_TREES, maxDepth=DEEPEST, seed=seed)
    return {**boosted, "Extra Trees": forest.copy().setBootstrap(False), "Random Forest": forest}


def fit_pipeline(estimator, train: DataFrame, columns: Sequence[str], target: str = TARGET) -> PipelineModel:
    """Assembler plus estimator, so the fitted model scores plain tables.

    Training rows without a single complete one are an error.
    """
    rows = build_xy(train, columns, target)
    vector = VectorAssembler(inputCols=list(columns), outputCol=FEATURES, handleInvalid="error")
    return Pipeline(stages=[vector, estimator.copy().setLabelCol(target)]).fit(rows)


def score_batch(model: PipelineModel, df: DataFrame, name: str = "prediction") -> DataFrame:
    """All complete rows with the model's prediction."""
    columns = model.stages[0].getInputCols()
    scored = model.transform(complete_rows(df, columns)).drop(FEATURES)
    return scored.withColumnRenamed("prediction", name)


def evaluate_model(model: PipelineModel, df: DataFrame, target: str = TARGET, by: Sequence[str] = ()) -> DataFrame:
    return forecast_metrics(score_batch(model, df), target, "prediction", by)


def sample_settings(space: Mapping[str, Sequence], n_iter: int, seed: int) -> list[dict]:
    """Distinct settings drawn from the grid without building it."""
    sizes = [len(v) for v in space.values()]
    total = prod(sizes)
    picks = random.Random(seed).sample(range(total), min(n_iter, total))
    settings = []
    for pick in picks:
        chosen = {}
        for name, values in space.items():
            pick, place = divmod(pick, len(values))
            chosen[name] = values[place]
        settings.append(chosen)
    return settings


def random_search_cv(
    estimator, space: Mapping[str, Sequence], train: DataFrame, columns: Sequence[str], target: str = TARGET,
    k: int = N_FOLDS, gap: int = S.HORIZON_ROWS, n_iter: int = N_ITER, seed: int = SEED,
) -> tuple[PipelineModel, list[dict]]:
    """Sampled settings scored by mean rmse over expanding folds, best refitted.

    Folds are spans of time that hold all cities, `gap` hours apart from what trains before
    them. The rows are written once; each fit filters its fold from them, so
    no fold is copied. Fits do not depend on each other, so several run at a time.
    Returns the refitted model and the trials, best first. No settings, no search.
    """
    if not space:
        return fit_pipeline(estimator, train, columns, target), []
    rows = materialize(complete_rows(train, columns, target), "folds")
    folds = trained_folds(rows, k, gap)
    settings = sample_settings(space, n_iter, seed)
    tuned = [estimator.copy({estimator.getParam(p): v for p, v in setting.items()}) for setting in settings]

    def error(one: tuple) -> float:
        trial, (until, start, end) = one
        model = fit_pipeline(trial, rows.filter(between(-inf, until)), columns, target)
        return evaluate_model(model, rows.filter(between(start, end)), target).first()["rmse"]

    fits = [(trial, fold) for trial in tuned for fold in folds]
    with ThreadPool(min(PARALLEL, len(fits))) as pool:
        errors = pool.map(inheritable_thread_target(rows.sparkSession)(error), fits, chunksize=1)
    mean = lambda i: sum(errors[i * len(folds) : (i + 1) * len(folds)]) / len(folds)
    trials = [{"setting": setting, "rmse": mean(i), "estimator": tuned[i]} for i, setting in enumerate(settings)]
    trials.sort(key=lambda t: t["rmse"])
    return fit_pipeline(trials[0]["estimator"], train, columns, target), trials


def walk_forward_trees(estimator, df: DataFrame, columns: Sequence[str], target: str = TARGET, step: int = 336,
                       min_train: int = 1500) -> DataFrame:
    """Out-of-sample predictions with `block`, the model refitted before each on what all cities had by then.

    Windows do not depend on each other, so several are fitted at a time. Each writes its
    predictions, so the result is one scan however many there are.
    """
    names = list(dict.fromkeys(["city", S.TIME, *columns, target]))
    rows = materialize(complete_rows(df.select(*names), columns, target), "backtest")
    scored = rows.limit(0).withColumns({"block": F.lit(0).cast("long"), "prediction": F.lit(0.0)})
    windows = backtest_windows(rows, step, min_train)
    if not windows:
        return scored
    spark = rows.sparkSession
    folder = scratch_path(spark, "scored")

    def score(window: tuple[int, tuple[float, float]]) -> None:
        block, (start, end) = window
        model = fit_pipeline(estimator, rows.filter(between(-inf, start)), columns, target)
        part = score_batch(model, rows.filter(between(start, end)))
        part.write.option("compression", "zstd").parquet(f"{folder}/block={block}")

    with ThreadPool(min(PARALLEL, len(windows))) as pool:
        pool.map(inheritable_thread_target(spark)(score), enumerate(windows), chunksize=1)
    return spark.read.schema(scored.schema).parquet(folder).select(*scored.columns)


def train_select(
    split_rows: DataFrame, columns: Sequence[str], estimators: Mapping[str, object] | None = None,
    spaces: Mapping[str, Mapping] | None = None, target: str = TARGET, n_iter: int = N_ITER, k: int = N_FOLDS,
    gap: int = S.HORIZON_ROWS, step: int = 336, min_train: int = 1500, seed: int = SEED,
) -> dict:
    """Tune each family, choose on validation, refit on train and validation,
    score the test split and backtest.

    `split_rows` carries `split` (train, val, test). The naive model is scored
    alongside but never chosen.
    """
    estimators = estimators or candidates(seed)
    spaces = SPACES if spaces is None else spaces
    rows = materialize(complete_rows(split_rows, columns, target), "training")
    train, val, test = (rows.filter(F.col("split") == s) for s in ("train", "val", "test"))
    scores, tuned = None, {}
    for name, estimator in estimators.items():
        model, trials = random_search_cv(estimator, spaces.get(name, {}), train, columns, target, k, gap, n_iter, seed)
        tuned[name] = trials[0]["estimator"] if trials else estimator
        one = evaluate_model(model, val, target).withColumn("model", F.lit(name))
        scores = one if scores is None else scores.unionByName(one)
    naive = forecast_metrics(persistence_model(val), target, "prediction").withColumn("model", F.lit(PERSISTENCE))
    table = comparison_table(scores.unionByName(naive))
    best = select_best(table).first()["model"]
    final = fit_pipeline(tuned[best], concat_train_val(rows), columns, target)
    backtest = walk_forward_trees(tuned[best], rows, columns, target, step, min_train)
    return {
        "best": best,
        "model": final,
        "validation": table,
        "test": evaluate_model(final, test, target).withColumn("model", F.lit(best)),
        "baseline_test": forecast_metrics(persistence_model(test), target, "prediction").withColumn("model", F.lit(PERSISTENCE)),
        "walk_forward": forecast_metrics(backtest, target, "prediction"),
    }
