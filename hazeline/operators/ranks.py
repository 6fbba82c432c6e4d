"""Exact order statistics over columns of any size.

`percentile` keeps a column's distinct values in one task. Here the values are
first reduced to (key, value, count), and ranks come from running totals that
split a long column over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.operators.ordered import running_sum


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, value) rows of the given numeric columns, nulls dropped."""
    as_double = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return as_double.unpivot(list(keep), list(columns), "column", "value").filter(F.col("value").isNotNull())


def quantiles(values: DataFrame, keys: Sequence[str], probabilities: dict[str, float], value: str = "value") -> DataFrame:
    """Linearly interpolated quantiles `{name: p}` of `value` per key, plus `n`."""
    keys = list(keys)
    counts = values.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = running_sum(counts, keys, [value], {"_upto": "_n"})
    placed = ranked.withColumnRenamed("_upto_total", "n")

    def at_rank(rank: Column) -> Column:
        holds = (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
        return F.max(F.when(holds, F.col(value)))

    picks = []
    for name, p in probabilities.items():
        position = (F.col("n") - 1) * F.lit(float(p))
        picks += [at_rank(F.floor(position)).alias(f"_lo_{name}"), at_rank(F.ceil(position)).alias(f"_hi_{name}")]
    found = placed.groupBy(*keys, "n").agg(*picks)

    def between(name: str, p: float) -> Column:
        position = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return (lo + (hi - lo) * (position - F.floor(position))).alias(name)

    return found.select(*keys, "n", *[between(name, p) for name, p in probabilities.items()])


def ks_two_sample(values: DataFrame, key: str, first: Column, second: Column, value: str = "value") -> DataFrame:
    """Kolmogorov-Smirnov distance of two samples per key.

    `first` and `second` are boolean columns naming the samples. The p-value is exact
    while both samples have at most EXACT_VALUES values, asymptotic beyond.
    """
    counts = values.groupBy(key, value).agg(F.count_if(first).alias("_a"), F.count_if(second).alias("_b"))
    ranked = running_sum(counts, [key], [value], {"_upto_a": "_a", "_upto_b": "_b"})
    sized = ranked.withColumnsRenamed({"_upto_a_total": "n_first", "_upto_b_total": "n_second"})
    distance = F.abs(
        F.try_divide(F.col("_upto_a"), F.col("n_first")) - F.try_divide(F.col("_upto_b"), F.col("n_second"))
    )
    result = sized.groupBy(key, "n_first", "n_second").agg(F.max(distance).alias("ks_stat"))
    stat, n, m = F.col("ks_stat"), F.col("n_first"), F.col("n_second")
    return result.withColumn("ks_pvalue", F.coalesce(_exact_pvalues(stat, n, m), ks_pvalue(stat, n, m)))


#: Fixed value: samples up to this size have exact p-values.
EXACT_VALUES = 10_000


def exact_pvalue(distance: float, n: int, m: int) -> float:
    """Share of the orders of n and m values whose distribution functions differ by `distance` or more somewhere.

    An order is a path over the lattice of (values of the first, of the second sample) so far. The
    share of paths to a point that have already strayed that far is 1 if the point itself has, else
    the mean of its two predecessors, weighted by the paths that come from each. Points with the
    same total are one step.
    """
    n, m = min(n, m), max(n, m)
    least = round(distance * n * m)
    i = np.arange(n + 1, dtype=np.int64)
    strayed = np.zeros(n + 1)
    strayed[0] = float(least <= 0)
    for total in range(1, n + m + 1):
        j = total - i
        via_first = np.concatenate([[0.0], strayed[:-1]]) * i
        strayed = np.where(np.abs(i * m - j * n) >= least, 1.0, (via_first + strayed * np.maximum(j, 0)) / total)
    return float(strayed[n])


@F.pandas_udf(T.DoubleType())
def _exact_pvalues(distance: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """One value per column of a table, null where a sample is large or empty."""
    return pd.Series(
        [exact_pvalue(d, int(a), int(b)) if 0 < a <= EXACT_VALUES and 0 < b <= EXACT_VALUES else None for d, a, b in zip(distance, n, m, strict=True)], dtype="float64"
    )


KS_TERMS = 100
SMALL_ARGUMENT = 0.2


def ks_pvalue(distance: Column, n: Column, m: Column) -> Column:
    """Kolmogorov's limiting tail 2 Σ (-1)^(k-1) exp(-2 k² x²).

    The alternating series does not settle near zero, where the tail is 1.
    """
    x = distance * F.sqrt(n.cast("double") * m / (n + m))
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(KS_TERMS)),
        lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(F.lit(-2.0) * k * k * x * x),
    )
    tail = F.aggregate(terms, F.lit(0.0), lambda total, term: total + term)
    return F.when(x < SMALL_ARGUMENT, F.lit(1.0)).otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))
