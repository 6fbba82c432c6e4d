"""Jobs that combine operators: ingest, diagnosis, horizon sweep."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.operators import profile
from hazeline.operators.features import complete_rows, select_features, target_ahead
from hazeline.operators.joins import merge_weather_aqi, seasonal_lookup
from hazeline.operators.metrics import HORIZON_HOURS, NAIVE, forecast_metrics, naive_baselines, rolling_naive, target_stats
from hazeline.operators.splits import concat_train_val, split_three
from hazeline.operators.validate import validate_records
from hazeline.plans.apart import grow_each
from hazeline.plans.ensembles import bin_edges, binned, binned_table, predict_windows
from hazeline.plans.selection import SWEEP, SWEEP_ITER, fit_of, scored, search
from hazeline.session import materialize


def process_observations(weather: DataFrame, aqi: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Merge both sides and split into valid and quarantined observations."""
    return validate_records(merge_weather_aqi(weather, aqi), as_of)


def _long(df: DataFrame, section: str, item: Column, metrics: Sequence[str]) -> DataFrame:
    values = df.select("city", F.lit(section).alias("section"), item.cast("string").alias("item"),
                       *[F.col(m).cast("double").alias(m) for m in metrics])
    return values.unpivot(["city", "section", "item"], list(metrics), "metric", "value")


def diagnose_report(features: DataFrame, columns: Sequence[str] | None = None, lags: int = 72,
                    horizons: Sequence[int] = HORIZON_HOURS) -> DataFrame:
    """Shape, seasonality, autocorrelation, splits, drift, targets and baselines
    as one table (city, section, item, metric, value)."""
    rows = materialize(features, "diagnose")
    columns = list(columns or profile.numeric_columns(rows))
    split = materialize(split_three(rows), "split")
    shape = rows.groupBy("city").agg(
        F.count("*").alias("n_rows"),
        F.min(S.TIME).cast("double").alias("first_epoch"), F.max(S.TIME).cast("double").alias("last_epoch"),
    )
    shift = profile.distribution_shift(split, columns).withColumn("city", F.lit(None).cast("string"))
    sections = [
        _long(shape, "shape", F.lit("all"), ["n_rows", "first_epoch", "last_epoch"]),
        _long(profile.monthly_profile(rows), "month", F.col("month"), ["mean", "std", "n"]),
        _long(profile.acf(rows, lags), "acf", F.col("lag"), ["acf"]),
        _long(profile.split_stats(split), "split", F.col("split"), ["n", "aqi_mean", "aqi_std", "aqi_min", "aqi_max"]),
        _long(shift, "shift", F.col("column"),
              ["train_mean", "test_mean", "train_std", "test_std", "ks_stat", "ks_pvalue"]),
        _long(target_stats(rows, horizons), "target", F.col("horizon"),
              ["n", "mean", "std", "var", "month_mean_baseline_r2", "month_mean_baseline_rmse"]),
        _long(naive_baselines(rows, horizons), "baseline", F.concat_ws(":", "horizon", "baseline"),
              ["rmse", "mae", "r2", "smape"]),
    ]
    out = sections[0]
    for section in sections[1:]:
        out = out.unionByName(section)
    return out


def sweep_baselines(test: DataFrame, train: DataFrame) -> DataFrame:
    """Scores of the naive forecasts on `test`, per model; month means are of
    the training rows' current AQI."""
    forecasts = seasonal_lookup(test, train, "aqi").withColumn("persistence", F.col("aqi"))
    long = forecasts.unpivot(["aqi_target"], list(NAIVE), "model", "prediction")
    return forecast_metrics(long, "aqi_target", "prediction", ["model"])


def horizon_sweep(features: DataFrame, columns: Sequence[str] | None = None, horizons: Sequence[int] = HORIZON_HOURS, name: str = "Boosted Leaves",
                  space: Mapping[str, Sequence] = SWEEP, n_iter: int = SWEEP_ITER, k: int = 5, seed: int = 42) -> DataFrame:
    """Leaf-wise trees tuned over time folds, and naive forecasts, per horizon, scored on the newest 15 %."""
    columns = list(columns or select_features(features))
    # Only what a horizon reads is carried along, and written before each step that reads it twice.
    needed = list(dict.fromkeys(["city", S.TIME, "month", "aqi", *columns]))
    whole = materialize(complete_rows(features, columns).select(*needed), "sweep")
    base = materialize(rolling_naive(whole).drop("roll_std_24h", *({"aqi_target"} & set(needed))), "sweep")
    out = None
    for h in horizons:
        rows = materialize(complete_rows(target_ahead(base, h), ["aqi_target"]), "sweep")
        split = materialize(split_three(rows), "sweep")
        train, test = (split.filter(F.col("split") == s) for s in ("train", "test"))
        edges = bin_edges(train, columns)
        known, whole = (binned_table(part, columns, "aqi_target", edges) for part in (train, concat_train_val(split)))
        trials = search(known, name, columns, edges, space, n_iter, k, h, seed)
        model = grow_each(whole, [fit_of(name, len(columns), trials[0]["setting"], seed)], columns, edges)[0]
        tested = scored(predict_windows(binned(test, columns, "aqi_target", edges), [model], [(-inf, inf)])).withColumn("model", F.lit("model"))
        both = tested.unionByName(sweep_baselines(test, train))
        both = both.withColumn("horizon", F.lit(h))
        out = both if out is None else out.unionByName(both)
    return out
