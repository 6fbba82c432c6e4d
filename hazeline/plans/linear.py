"""Per-city ridge regression from cross-product sums.

One pass over the rows gives, per group, the sums that every ridge model on
those columns needs: all penalties of a grid, any subset of the columns and,
with running totals, every training window of a backtest. Rows are never
gathered per group; each task reduces its own rows to one small matrix per
group.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline import schemas as S
from hazeline.operators.metrics import forecast_metrics
from hazeline.operators.moments import centres, constants, cross_products
from hazeline.operators.ordered import join_on
from hazeline.operators.splits import walk_forward_blocks
from hazeline.session import materialize

FLAT = 1e-12


def _gathered(entries: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per group with its matrix entries in order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return entries.groupBy(*by).agg(F.transform(ordered, lambda e: e["v"]).alias("products"))


def solve_ridge(
    sums: DataFrame, by: Sequence[str], names: Sequence[str], columns: Sequence[str], label: str,
    alphas: Sequence[float], shift: np.ndarray, unit: np.ndarray,
) -> DataFrame:
    """Ridge on standardised `columns` per group and penalty.

    The scaler uses the population deviation and the intercept is free. `coef`
    is on the standardised scale, `beta` on the raw one.
    """
    by, names = list(by), list(names)
    width = len(names) + 1
    upper = np.triu_indices(width)
    at = [names.index(c) + 1 for c in columns]
    y = names.index(label) + 1

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for record in rows.itertuples(index=False):
                full = np.zeros((width, width))
                full[upper] = record[len(by)]
                full = np.triu(full) + np.triu(full, 1).T
                n = full[0, 0]
                mean = full[0] / n
                cov = full / n - np.outer(mean, mean)
                std = np.sqrt(np.maximum(np.diag(cov)[at], 0.0))
                std = np.where(std > FLAT, std, 1.0)
                gram = n * cov[np.ix_(at, at)] / np.outer(std, std)
                moment = n * cov[at, y] / std
                for alpha in alphas:
                    solved = np.linalg.solve(gram + alpha * np.eye(len(at)), moment)
                    places = np.array(at) - 1
                    coef = solved * unit[y - 1]
                    beta = coef / (std * unit[places])
                    raw_mean = mean[at] * unit[places] + shift[places]
                    level = mean[y] * unit[y - 1] + shift[y - 1]
                    out.append((*record[:len(by)], float(alpha), int(round(n)), float(level - beta @ raw_mean),
                                coef.tolist(), beta.tolist(), raw_mean.tolist()))
            yield pd.DataFrame(out, columns=[*by, "alpha", "n_train", "intercept", "coef", "beta", "means"])

    vector = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [
            *[sums.schema[c] for c in by],
            T.StructField("alpha", T.DoubleType()), T.StructField("n_train", T.LongType()),
            T.StructField("intercept", T.DoubleType()), T.StructField("coef", vector),
            T.StructField("beta", vector), T.StructField("means", vector),
        ]
    )
    return _gathered(sums, by).mapInPandas(solve, schema)


class RidgeSums:
    """Cross-product sums of training rows, ready for any ridge on them."""

    def __init__(self, train: DataFrame, columns: Sequence[str], label: str, by: Sequence[str] = S.SERIES,
                 known: dict[str, tuple[float, float]] | None = None):
        self.by, self.columns, self.label = list(by), list(columns), label
        self.names = [*columns, label]
        self.shift, self.unit = constants(self.names, known or centres(train, self.names))
        self.sums = materialize(cross_products(train, by, self.names, self.shift, self.unit), "ridge")

    def fit(self, alphas: Sequence[float], columns: Sequence[str] | None = None) -> DataFrame:
        """One model per group and penalty on `columns` (all by default)."""
        return solve_ridge(
            self.sums, self.by, self.names, columns or self.columns, self.label, alphas, self.shift, self.unit
        )


def dot(coefficients: str, columns: Sequence[str]) -> str:
    """SQL of Σ coefficients[i] · column i."""
    return " + ".join(f"{coefficients}[{i}] * `{c}`" for i, c in enumerate(columns))


def predict_linear(rows: DataFrame, models: DataFrame, columns: Sequence[str], by: Sequence[str] = S.SERIES,
                   name: str = "prediction", extra: Sequence[str] = (),
                   also: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Rows with their group's linear prediction, computed as one expression.

    `extra` model columns, such as alpha, are kept. `also` names predictions of
    the same models on other input columns, made in the same pass.
    """
    joined = join_on(rows, models.select(*by, *extra, "intercept", "beta"), list(by))
    wanted = {name: columns, **(also or {})}
    return joined.withColumns(
        {n: F.expr(f"intercept + {dot('beta', inputs)}") for n, inputs in wanted.items()}
    ).drop("intercept", "beta")


def coefficient_rank(models: DataFrame, columns: Sequence[str], by: Sequence[str] = S.SERIES) -> DataFrame:
    """(by..., rank, feature, coef): coefficients by absolute size."""
    names = F.array(*[F.lit(c) for c in columns])
    pairs = F.arrays_zip(names.alias("feature"), F.col("coef").alias("coef"))
    ordered = F.sort_array(
        F.transform(pairs, lambda e: F.struct(F.abs(e["coef"]).alias("size"), e["feature"].alias("feature"), e["coef"].alias("coef"))),
        asc=False,
    )
    return models.select(*by, F.posexplode(ordered).alias("_i", "_e")).select(
        *by, (F.col("_i") + 1).alias("rank"), F.col("_e.feature").alias("feature"), F.col("_e.coef").alias("coef")
    )


def linear_contributions(rows: DataFrame, models: DataFrame, background: DataFrame, columns: Sequence[str],
                         by: Sequence[str] = S.SERIES) -> DataFrame:
    """Exact additive contributions of a linear model, one row per feature.

    A contribution is beta · (value − background mean); the base value is the
    prediction at the background mean, and base plus contributions is the
    prediction.
    """
    means = background.groupBy(*by).agg(F.array(*[F.avg(c) for c in columns]).alias("_mean"))
    joined = join_on(join_on(rows, models.select(*by, "intercept", "beta"), list(by)), means, list(by))
    names = F.array(*[F.lit(c) for c in columns])
    values = F.array(*[F.col(c).cast("double") for c in columns])
    parts = F.zip_with(
        F.arrays_zip(F.col("beta").alias("beta"), values.alias("x"), F.col("_mean").alias("mean")), names,
        lambda e, name: F.struct(name.alias("feature"), (e["beta"] * (e["x"] - e["mean"])).alias("contribution")),
    )
    base = F.zip_with("beta", "_mean", lambda b, m: b * m)
    return joined.select(
        *by, S.TIME, F.expr(f"intercept + {dot('beta', columns)}").alias("prediction"),
        F.aggregate(base, F.col("intercept"), lambda total, term: total + term).alias("base_value"),
        F.explode(parts).alias("_e"),
    ).select(*by, S.TIME, "prediction", "base_value", "_e.*")


def topk_contributions(contributions: DataFrame, k: int = 12, by: Sequence[str] = ("city", "horizon")) -> DataFrame:
    """The k largest contributions by absolute value per forecast."""
    largest = Window.partitionBy(*by, S.TIME).orderBy(F.abs("contribution").desc(), "feature")
    return contributions.withColumn("rank", F.row_number().over(largest)).filter(F.col("rank") <= k)


def walk_forward_ridge(
    df: DataFrame, columns: Sequence[str], target: str, alpha: float, step: int = 336, min_train: int = 1500,
    by: Sequence[str] = S.SERIES,
) -> DataFrame:
    """Out-of-sample predictions with `block`: each block is scored by a model
    fitted on all rows before it.

    Sums are taken per block and added up over the blocks, so the data is read
    once however many windows there are.
    """
    by, names = list(by), [*columns, target]
    rows = df.select(*by, *dict.fromkeys([S.TIME, *names]))
    blocks = materialize(walk_forward_blocks(rows, names, step, min_train, by), "blocks")
    shift, unit = constants(names, centres(blocks, names))
    per_block = materialize(cross_products(blocks, [*by, "block"], names, shift, unit), "block_sums")
    # One row for every `step` rows of a series.
    upto = Window.partitionBy(*by, "pos").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    before = per_block.select(*by, (F.col("block") + 1).alias("block"), "pos", F.sum("v").over(upto).alias("v"))
    models = solve_ridge(before, [*by, "block"], names, columns, target, [alpha], shift, unit)
    return predict_linear(blocks.filter(F.col("block") >= 0), models, columns, [*by, "block"])


def walk_forward_eval(predictions: DataFrame, target: str, by: Sequence[str] = S.SERIES) -> DataFrame:
    """Out-of-sample scores per series, pooled over its windows, and their number."""
    scores = forecast_metrics(predictions, target, "prediction", by)
    windows = predictions.groupBy(*by).agg(F.countDistinct("block").alias("n_windows"))
    return join_on(scores, windows, list(by))
