"""Chronological splits, folds and walk-forward blocks, per city."""

from __future__ import annotations

from collections.abc import Sequence
from math import inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.operators.ordered import series_index

MIN_ROWS = 10


def _fraction(name: str, size: float) -> None:
    if not 0.0 < size < 1.0:
        raise ValueError(f"{name} must lie strictly between 0 and 1, got {size}")


def _cut(share: float) -> Column:
    return F.floor(F.col("n_rows") * F.lit(float(share)))


def _large_enough(split: Column) -> Column:
    few = F.raise_error(F.lit(f"a series needs at least {MIN_ROWS} rows to be split"))
    return F.when(F.col("n_rows") < MIN_ROWS, few).otherwise(split)


def _labelled(df: DataFrame, split: Column, by: Sequence[str], bounded: bool) -> DataFrame:
    return series_index(df, by, [S.TIME], bounded).withColumn("split", split).drop("row_index", "n_rows")


def split_two(
    df: DataFrame, test_size: float = 0.2, by: Sequence[str] = S.SERIES, bounded: bool = False
) -> DataFrame:
    """Add `split`: the newest `test_size` share of each series is the test."""
    _fraction("test_size", test_size)
    label = F.when(F.col("row_index") <= _cut(1 - test_size), "train").otherwise("test")
    return _labelled(df, _large_enough(label), by, bounded)


def split_three(
    df: DataFrame, train_size: float = 0.7, val_size: float = 0.15, test_size: float = 0.15,
    by: Sequence[str] = S.SERIES, bounded: bool = False,
) -> DataFrame:
    """Add `split`: oldest rows train, then val, newest test."""
    for name, size in (("train_size", train_size), ("val_size", val_size), ("test_size", test_size)):
        _fraction(name, size)
    if abs(train_size + val_size + test_size - 1.0) > 1e-8:
        raise ValueError("the split sizes must sum to 1")
    label = (
        F.when(F.col("row_index") <= _cut(train_size), "train")
        .when(F.col("row_index") <= _cut(train_size + val_size), "val")
        .otherwise("test")
    )
    return _labelled(df, _large_enough(label), by, bounded)


def split_tail(
    df: DataFrame, test_fraction: float = 0.2, by: Sequence[str] = S.SERIES, bounded: bool = False
) -> DataFrame:
    """Add `split`: the last int(n * fraction) rows are the test.

    A series too short to give a test row is an error.
    """
    n_test = _cut(test_fraction)
    empty = F.raise_error(F.lit("a series is too short to hold out test rows"))
    label = F.when(F.col("row_index") <= F.col("n_rows") - n_test, "train").otherwise("test")
    return _labelled(df, F.when(n_test < 1, empty).otherwise(label), by, bounded)


def with_folds(df: DataFrame, k: int = 5, gap: int = 72, by: Sequence[str] = S.SERIES) -> DataFrame:
    """Add what `fold_role` needs: `row_index`, `n_rows` and `folds`.

    A series too short for k folds gets fewer, down to two.
    """
    if k < 2:
        raise ValueError("time-series folds need k >= 2")
    if gap < 0:
        raise ValueError("the gap must not be negative")
    folds = F.lit(2)
    for count in range(3, k + 1):
        folds = F.when(F.col("n_rows") >= (count + 1) + gap * count, F.lit(count)).otherwise(folds)
    return series_index(df, by, [S.TIME]).withColumn("folds", folds)


def fold_role(fold: Column, gap: int = 72) -> Column:
    """train, test or null for a row's part in an expanding fold.

    `gap` rows between train and test take no part.
    """
    size = F.floor(F.col("n_rows") / (F.col("folds") + 1))
    start = F.col("n_rows") - (F.col("folds") - fold) * size
    position = F.col("row_index") - 1
    return F.when(
        fold < F.col("folds"),
        F.when((position >= start) & (position < start + size), "test").when(position < start - gap, "train"),
    )


def ts_cv_folds(df: DataFrame, k: int = 5, gap: int = 72, by: Sequence[str] = S.SERIES) -> DataFrame:
    """One copy of a row per fold it takes part in, with `fold` and `role`."""
    placed = with_folds(df, k, gap, by).withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("folds") - 1)))
    roles = placed.withColumn("role", fold_role(F.col("fold"), gap))
    return roles.filter(F.col("role").isNotNull()).drop("folds", "row_index", "n_rows")


def walk_forward_blocks(df: DataFrame, columns: Sequence[str], step: int = 336, min_train: int = 1500,
                        by: Sequence[str] = S.SERIES) -> DataFrame:
    """Complete rows with `block`: -1 for the first training rows, then 0, 1, ...

    A series with at most `min_train` complete rows has no block to score and
    is left out.
    """
    complete = df.na.drop(subset=list(columns))
    block = F.floor((F.col("row_index") - 1 - min_train) / step)
    return (
        series_index(complete, by, [S.TIME])
        .filter(F.col("n_rows") > min_train)
        .withColumn("block", F.when(F.col("row_index") <= min_train, F.lit(-1)).otherwise(block).cast("long"))
        .drop("row_index", "n_rows")
    )


def seconds() -> Column:
    """Epoch seconds of a row."""
    return F.unix_micros(S.TIME) / 1e6


def moments(rows: DataFrame, ranks: Sequence[int]) -> list[float]:
    """Times of the rows with these places (from 0) in the order of all series' times."""
    placed = series_index(rows.select(F.lit(1).alias("all"), S.TIME), ["all"], [S.TIME])
    found = placed.filter(F.col("row_index").isin([r + 1 for r in ranks])).select("row_index", seconds().alias("t")).collect()
    wanted = {r["row_index"] - 1: r["t"] for r in found}
    return [wanted[r] for r in ranks]


def time_folds(rows: DataFrame, k: int = 5, gap: int = 72) -> list[tuple[float, float, float]]:
    """(training until, test from, test to) of expanding folds, moments for all series; `gap` hours before a test take no part.

    Tests are as long as an equal share of all rows; too few rows give fewer folds, down to two.
    """
    if k < 2 or gap < 0:
        raise ValueError("time folds need k >= 2 and no negative gap")
    n = rows.count()
    while k > 2 and n < (k + 1) + gap * k:
        k -= 1
    size = n // (k + 1)
    if not size:
        raise ValueError("no complete rows to train on")
    starts = moments(rows, [n - (k - i) * size for i in range(k)])
    return [(start - gap * 3600.0, start, end) for start, end in zip(starts, [*starts[1:], inf], strict=True)]


def trained_folds(rows: DataFrame, k: int = 5, gap: int = 72) -> list[tuple[float, float, float]]:
    """The `time_folds` that have rows to train on; where a fold is shorter than the gap, the first ones have none. No such fold is an error."""
    folds = time_folds(rows, k, gap)
    first = rows.agg(F.min(seconds())).first()[0]
    trained = [fold for fold in folds if fold[0] > first]
    if not trained:
        raise ValueError("no complete rows to train on")
    return trained


def backtest_windows(rows: DataFrame, step: int = 336, min_train: int = 1500) -> list[tuple[float, float]]:
    """Spans of `step` rows after the first `min_train`, in the order of all series' times; none if there are no more rows."""
    n = rows.count()
    starts = sorted(set(moments(rows, range(min_train, n, step)))) if n > min_train else []
    return [(start, end) for start, end in zip(starts, [*starts[1:], inf], strict=False)]


def between(start: float, end: float) -> Column:
    return (seconds() >= start) & (seconds() < end)


def concat_train_val(df: DataFrame) -> DataFrame:
    """Rows used to refit the chosen model."""
    return df.filter(F.col("split").isin("train", "val"))
