"""Forecast scores, naive baselines and model comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.operators.joins import seasonal_lookup
from hazeline.operators.ordered import over_series, series_index
from hazeline.session import materialize

HORIZON_HOURS = (6, 12, 24, 48, 72)
PERSISTENCE = "Persistence Baseline"
TRAIN_VAL_SHARE = 0.7 + 0.15


def metric_columns(truth: Column, predicted: Column) -> dict[str, Column]:
    """Aggregates rmse, mae, r2 and smape, to be used in one `agg`."""
    error = truth - predicted
    scale = F.abs(truth) + F.abs(predicted)
    total = F.var_pop(truth) * F.count(truth)
    unexplained = F.sum(error * error)
    constant = F.when(unexplained == 0, 1.0).otherwise(0.0)
    return {
        "rmse": F.sqrt(F.avg(error * error)),
        "mae": F.avg(F.abs(error)),
        "r2": F.when(total == 0, constant).otherwise(1 - F.try_divide(unexplained, total)),
        "smape": F.avg(F.when(scale == 0, 0.0).otherwise(F.try_divide(2 * F.abs(error), scale))) * 100,
    }


def forecast_metrics(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Scores of predictions per group, over rows that have both values."""
    scored = df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    scores = metric_columns(F.col(truth), F.col(predicted))
    return scored.groupBy(*by).agg(F.count("*").alias("n"), *[c.alias(n) for n, c in scores.items()])


def comparison_table(scores: DataFrame) -> DataFrame:
    return scores.orderBy("rmse")


def select_best(scores: DataFrame, by: Sequence[str] = (), exclude: str = PERSISTENCE) -> DataFrame:
    """Model with the lowest rmse, the naive model aside; no model is an error."""
    ranked = scores.filter(F.col("model") != exclude)
    best = ranked.groupBy(*by).agg(F.min_by("model", F.struct("rmse", "model")).alias("model"), F.min("rmse").alias("rmse"))
    if by:
        return best
    none = F.raise_error(F.lit("no model to choose from"))
    return best.withColumn("model", F.when(F.col("model").isNull(), none).otherwise(F.col("model")))


def persistence_model(df: DataFrame, aqi: str = "aqi") -> DataFrame:
    """Predict the current AQI."""
    if aqi not in df.columns:
        raise ValueError(f"the persistence model needs the '{aqi}' column")
    return df.withColumn("prediction", F.col(aqi).cast("double"))


def rolling_naive(df: DataFrame) -> DataFrame:
    """24- and 168-row means, at least one value, and 24-row deviation."""
    return over_series(df, S.SERIES, [S.TIME], 168, 0, _rolling_naive)


def _rolling_naive(df: DataFrame, by: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(S.TIME)
    day, week = w.rowsBetween(-23, 0), w.rowsBetween(-167, 0)
    return df.withColumns(
        {
            "roll_mean_24h": F.avg("aqi").over(day),
            "roll_mean_7d": F.avg("aqi").over(week),
            "roll_std_24h": F.stddev_samp("aqi").over(day),
        }
    )


def _with_targets(df: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Positions, naive forecasts and one target per horizon, in one series pass."""
    base = df.select("city", S.TIME, "aqi", F.month(S.TIME).alias("month"))

    def add(frame: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(S.TIME)
        return _rolling_naive(frame, by).withColumns({f"_y{h}": F.lead("aqi", h).over(w) for h in horizons})

    placed = series_index(base, S.SERIES, [S.TIME])
    # Written once, because test and training rows are both read from it.
    wide = materialize(over_series(placed, S.SERIES, [S.TIME], 168, max(horizons), add, size_of=base), "targets")
    cut = F.floor(F.col("n_rows") * F.lit(TRAIN_VAL_SHARE))
    targets = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_y{h}").alias("y")) for h in horizons])
    return (
        wide.withColumn("is_test", F.col("row_index") > cut)
        .withColumn("_t", F.explode(targets))
        .select("city", S.TIME, "month", "aqi", "roll_mean_24h", "roll_mean_7d", "is_test",
                F.col("_t.horizon").alias("horizon"), F.col("_t.y").alias("y"))
    )


def _month_means(rows: DataFrame) -> DataFrame:
    return seasonal_lookup(
        rows.filter("is_test"), rows.filter(~F.col("is_test")), "y", by=["city", "horizon"]
    )


def target_stats(df: DataFrame, horizons: Sequence[int] = HORIZON_HOURS) -> DataFrame:
    """Target spread on the newest 15 % and what a month mean explains of it.

    Month means use the target of the first 85 % of rows; their scores are null
    when the test rows hold a month those rows lack.
    """
    test = _month_means(_with_targets(df, horizons)).filter(F.col("y").isNotNull())
    scores = metric_columns(F.col("y"), F.col("seasonal_month"))
    known = F.count("seasonal_month") == F.count("*")
    return test.groupBy("city", "horizon").agg(
        F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"), F.var_pop("y").alias("var"),
        F.when(known, scores["r2"]).alias("month_mean_baseline_r2"),
        F.when(known, scores["rmse"]).alias("month_mean_baseline_rmse"),
    )


NAIVE = ("persistence", "roll_mean_24h", "roll_mean_7d", "seasonal_month")


def naive_baselines(df: DataFrame, horizons: Sequence[int] = HORIZON_HOURS) -> DataFrame:
    """Scores of four naive forecasts per horizon on the newest 15 %."""
    test = _month_means(_with_targets(df, horizons)).withColumn("persistence", F.col("aqi"))
    forecasts = test.unpivot(["city", "horizon", "y"], list(NAIVE), "baseline", "prediction")
    return forecast_metrics(forecasts, "y", "prediction", ["city", "horizon", "baseline"])
