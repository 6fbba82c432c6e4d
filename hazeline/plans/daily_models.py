"""Daily-average forecasts for 1, 2 and 3 days: training, tests and serving."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.functions.indices import aqi_category, alert_level, trend_delta
from hazeline.functions.noise import forecast_noise
from hazeline.operators.daily import daily_features, latest_row, target_mean_ahead
from hazeline.operators.features import complete_rows, select_daily_features
from hazeline.operators.metrics import forecast_metrics
from hazeline.operators.moments import centres
from hazeline.operators.ordered import join_on
from hazeline.plans.linear import RidgeSums, coefficient_rank, linear_contributions, predict_linear
from hazeline.session import materialize
from hazeline.sources.registry import load_coefficients, model_save, run_document, save_coefficients

# Penalties, holdout and training endpoint.
ALPHAS = {"day1_avg": 100.0, "day2_avg": 300.0, "day3_avg": 300.0}
ALPHA_GRID = (10.0, 30.0, 100.0, 300.0, 1000.0)
TEST_FRACTION = 0.2
SEED = 42
TRAIN_END = "2026-07-27 23:00:00+00:00"
MAX_HORIZON = max(n for _, n in S.HORIZONS)
EXACT = "exact_"


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def daily_table(observations: DataFrame) -> DataFrame:
    """The daily feature table, written once for all horizons."""
    return materialize(daily_features(observations), "daily")


def future_columns(n_days: int) -> list[str]:
    return [f"fw_{v}{h}" for h in range(1, n_days + 1) for v in S.FUTURE_VARS]


def training_table(daily: DataFrame, seed: int = SEED) -> DataFrame:
    """What all horizons train and test on, written once.

    `fw_*` carry simulated forecast error and `exact_*` their true values. Per
    horizon there is a target and a chronological split, null on incomplete
    rows and in cities with too few complete days to hold any out.
    """
    exact = daily.withColumns({EXACT + c: F.col(c) for c in future_columns(MAX_HORIZON)})
    rows = forecast_noise(exact, MAX_HORIZON, seed)
    for label, n_days in S.HORIZONS:
        rows = target_mean_ahead(rows, n_days, f"target_{label}")
    whole = Window.partitionBy(*S.SERIES)
    upto = whole.orderBy(S.TIME).rowsBetween(Window.unboundedPreceding, 0)
    for label, n_days in S.HORIZONS:
        needed = [*select_daily_features(daily.columns, n_days), f"target_{label}"]
        complete = reduce(and_, [F.col(c).isNotNull() for c in needed])
        rows = rows.withColumn("_complete", complete.cast("int"))
        place, size = F.sum("_complete").over(upto), F.sum("_complete").over(whole)
        held_out = F.floor(size * F.lit(TEST_FRACTION))
        split = F.when(place <= size - held_out, "train").otherwise("test")
        rows = rows.withColumn(f"split_{label}", F.when(complete & (held_out >= 1), split))
    return materialize(rows.drop("_complete"), "training")


class DailyRidge:
    """Per-city ridge of one horizon with its held-out rows."""

    def __init__(self, table: DataFrame, label: str, n_days: int, known: dict | None = None):
        self.label, self.n_days = label, n_days
        self.columns = select_daily_features(
            [c for c in table.columns if not c.startswith((EXACT, "target_", "split_"))], n_days
        )
        rows = table.withColumn("target", F.col(f"target_{label}"))
        self.train = rows.filter(F.col(f"split_{label}") == "train")
        self.test = rows.filter(F.col(f"split_{label}") == "test")
        self.sums = RidgeSums(self.train, self.columns, "target", known=known)
        self.models = materialize(self.sums.fit([ALPHAS[label]]), "models")

    def exact_columns(self) -> list[str]:
        """The model's inputs with exact instead of simulated future weather."""
        return [EXACT + c if c.startswith("fw_") else c for c in self.columns]

    def scores(self) -> DataFrame:
        """Test scores: noisy weather (the one to report), exact weather and naive."""
        scored = predict_linear(
            self.test, self.models, self.columns, name="forecast", also={"exact_weather": self.exact_columns()}
        ).withColumn("naive", F.col("aqi"))
        kinds = scored.unpivot(["city", "target"], ["forecast", "exact_weather", "naive"], "kind", "prediction")
        return forecast_metrics(kinds, "target", "prediction", ["city", "kind"]).withColumn("horizon", F.lit(self.label))

    def grid_scores(self, alphas: Sequence[float] = ALPHA_GRID) -> DataFrame:
        """Test scores per penalty, all fitted from the same sums."""
        predicted = predict_linear(self.test, self.sums.fit(alphas), self.columns, extra=["alpha"])
        return forecast_metrics(predicted, "target", "prediction", ["city", "alpha"]).withColumn("horizon", F.lit(self.label))

    def ablation(self) -> DataFrame:
        """R² with and without future weather on the same rows and penalty."""
        history = [c for c in self.columns if not c.startswith("fw_")]
        without = self.sums.fit([ALPHAS[self.label]], history)
        full = predict_linear(self.test, self.models, self.columns, name="r2_full")
        both = predict_linear(full, without, history, name="r2_history")
        kinds = both.unpivot(["city", "target"], ["r2_full", "r2_history"], "kind", "prediction")
        r2 = forecast_metrics(kinds, "target", "prediction", ["city", "kind"])
        wide = r2.groupBy("city").agg(*[F.max(F.when(F.col("kind") == k, F.col("r2"))).alias(k) for k in ("r2_full", "r2_history")])
        return wide.withColumns({"horizon": F.lit(self.label), "delta_r2": F.col("r2_full") - F.col("r2_history")})


def train_daily(daily: DataFrame, seed: int = SEED) -> dict[str, DailyRidge]:
    """The three horizons, trained from one table."""
    table = training_table(daily, seed)
    known = centres(table, select_daily_features(daily.columns, MAX_HORIZON))
    known["target"] = known["aqi"]
    return {label: DailyRidge(table, label, n, known) for label, n in S.HORIZONS}


def ridge_daily(ridges: Mapping[str, DailyRidge]) -> DataFrame:
    """Scores of every city, horizon and kind with split sizes."""
    sizes = stack([r.models.select("city", "n_train").withColumn("horizon", F.lit(label)) for label, r in ridges.items()])
    return join_on(stack([r.scores() for r in ridges.values()]), sizes, ["city", "horizon"])


def alpha_grid(ridges: Mapping[str, DailyRidge], alphas: Sequence[float] = ALPHA_GRID) -> DataFrame:
    return stack([r.grid_scores(alphas) for r in ridges.values()])


def leakage_gap(scores: DataFrame) -> DataFrame:
    """How much R² exact future weather would add, to four places."""
    r2 = {k: F.max(F.when(F.col("kind") == k, F.col("r2"))) for k in ("forecast", "exact_weather")}
    return scores.groupBy("city", "horizon").agg(
        r2["forecast"].alias("r2"), r2["exact_weather"].alias("r2_exact"),
        F.round(r2["exact_weather"] - r2["forecast"], 4).alias("leakage_r2_gap"),
    )


def ablation_fw(ridges: Mapping[str, DailyRidge]) -> DataFrame:
    return stack([r.ablation() for r in ridges.values()])


def coefficients(ridges: Mapping[str, DailyRidge]) -> DataFrame:
    """Coefficients of every city and horizon by absolute size."""
    return stack([coefficient_rank(r.models, r.columns).withColumn("horizon", F.lit(label)) for label, r in ridges.items()])


def run_metadata(ridges: Mapping[str, DailyRidge], city: str | None = None) -> dict[str, dict]:
    """The metadata document of a run: one entry per horizon.

    Scores are pooled over cities unless one is named; only these few numbers
    reach the driver.
    """
    document = {}
    for label, r in ridges.items():
        test, models = r.test, r.models
        if city is not None:
            test, models = test.filter(F.col("city") == city), models.filter(F.col("city") == city)
        scored = predict_linear(test, models, r.columns, name="test_metrics").withColumn("naive_baseline", F.col("aqi"))
        kinds = scored.unpivot(["target"], ["test_metrics", "naive_baseline"], "kind", "prediction")
        scores = {row["kind"]: row for row in forecast_metrics(kinds, "target", "prediction", ["kind"]).collect()}
        document[label] = {
            "version": "v6", "n_days": r.n_days, "alpha": ALPHAS[label], "feature_cols": r.columns,
            "n_train": models.agg(F.sum("n_train")).first()[0], "n_test": scores["test_metrics"]["n"],
            "target": f"mean AQI over next {r.n_days} day(s)",
            **{kind: {k: row[k] for k in ("rmse", "mae", "r2")} for kind, row in scores.items()},
        }
    return document


def save_run(ridges: Mapping[str, DailyRidge], registry: str, run: str) -> str:
    """Store a run: the models of every city and horizon, and its metadata."""
    models = stack([r.models.withColumn("horizon", F.lit(label)) for label, r in ridges.items()])
    folder = save_coefficients(models, registry, run)
    model_save(models.sparkSession, registry, run, {}, run_metadata(ridges))
    return folder


def load_run(spark: SparkSession, registry: str, run: str) -> tuple[dict[str, DataFrame], dict[str, list[str]]]:
    """Models and input columns per horizon of a stored run; a missing horizon
    is an error."""
    document = run_document(spark, registry, run)
    absent = [label for label, _ in S.HORIZONS if label not in document]
    if absent:
        raise ValueError(f"run '{run}' lacks {absent}")
    stored = load_coefficients(spark, registry, run)
    models = {label: stored.filter(F.col("horizon") == label).drop("horizon") for label, _ in S.HORIZONS}
    return models, {label: document[label]["feature_cols"] for label, _ in S.HORIZONS}


def ridge_pipeline(train: DataFrame, columns: Sequence[str], alpha: float, label: str = "target") -> PipelineModel:
    """One scaled ridge over all rows as a Spark ML pipeline that can be saved.

    Spark ML penalises the mean error of a label scaled to unit deviation, and
    its scaler uses the sample deviation; the penalty is converted so that the
    model equals ridge with penalty `alpha` on population-scaled columns.
    """
    size = train.agg(F.count("*").alias("n"), F.stddev_pop(label).alias("spread")).first()
    n, spread = size["n"], size["spread"]
    if not n:
        raise ValueError("no complete rows to train on")
    penalty = alpha * (n - 1) / n * spread / n
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(columns), outputCol="raw_features", handleInvalid="error"),
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
            LinearRegression(labelCol=label, solver="normal", elasticNetParam=0.0, standardization=False, regParam=penalty),
        ]
    ).fit(train)


def anchor_rows(daily: DataFrame, columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each city's newest day that at least one horizon can score."""
    complete = [reduce(and_, [F.col(c).isNotNull() for c in cols]) for cols in columns.values()]
    return latest_row(daily.filter(reduce(or_, complete)))


def forecast_3day(daily: DataFrame, models: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]],
                  strict: bool = True) -> DataFrame:
    """(city, anchor, horizon, forecast_date, prediction) from each anchor day.

    The forecast date is the day after the anchor. No scoreable day at all is
    an error when `strict`.
    """
    anchors = anchor_rows(daily, columns)
    if strict and anchors.isEmpty():
        raise ValueError("no day has the complete history a forecast needs")
    parts = []
    for label, n_days in S.HORIZONS:
        scored = predict_linear(anchors, models[label], columns[label])
        parts.append(
            scored.select(
                "city", F.col(S.TIME).alias("anchor"), F.lit(label).alias("horizon"), F.lit(n_days).alias("n_days"),
                F.date_add(F.to_date(S.TIME), 1).alias("forecast_date"), "prediction",
            )
        )
    return stack(parts)


def forecast_cards(forecast: DataFrame, latest: DataFrame) -> DataFrame:
    """Forecasts with target date, band, trend against the newest AQI and the
    city's peak alert."""
    now = latest.select("city", F.col("aqi").alias("current_aqi"))
    peak = forecast.groupBy("city").agg(F.max("prediction").alias("peak"))
    joined = join_on(join_on(forecast, now, ["city"], "left"), peak, ["city"])
    value, baseline = F.col("prediction"), F.col("current_aqi")
    return joined.select(
        "city", "horizon", "prediction",
        F.expr("date_add(forecast_date, n_days - 1)").alias("target_date"),
        aqi_category(value).alias("category"),
        F.coalesce(trend_delta(value, baseline), F.lit("Unavailable")).alias("direction"),
        (value - baseline).alias("delta"),
        alert_level(F.col("peak")).alias("peak_alert"),
    )


def explain_forecast(daily: DataFrame, models: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """Contributions of every feature to each city's newest forecasts.

    The background is every day that has all features of all horizons.
    """
    every = list(dict.fromkeys(c for cols in columns.values() for c in cols))
    scoreable = complete_rows(daily, every)
    newest = latest_row(scoreable)
    return stack(
        [
            linear_contributions(newest, models[label], scoreable, columns[label]).withColumn("horizon", F.lit(label))
            for label, _ in S.HORIZONS
        ]
    )
