"""Data quality, distribution, correlation and drift of the tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline import schemas as S
from hazeline.operators.moments import pair_moments
from hazeline.operators.ordered import BLOCK, in_blocks, join_on, over_series
from hazeline.operators.ranks import ks_two_sample, long_form, quantiles

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
IQR_FACTOR = 1.5
AQI_MAX = 500


def numeric_columns(df: DataFrame, drop: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in drop]


def wide_to_long(row: DataFrame, columns: Sequence[str], stats: dict[str, str]) -> DataFrame:
    """One aggregate row with `<stat>|<column>` fields to a row per column."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), *[F.col(f"`{p}|{c}`").alias(n) for n, p in stats.items()]) for c in columns]
    )
    return row.select(F.explode(entries).alias("_e")).select("_e.*")


def missing_ratio(df: DataFrame) -> DataFrame:
    """(column, missing): null share of every column, worst first."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"m|{c}") for c in df.columns])
    return wide_to_long(row, df.columns, {"missing": "m"}).orderBy(F.desc("missing"), "column")


def topk_missing(df: DataFrame, k: int = 15) -> DataFrame:
    return missing_ratio(df).orderBy(F.desc("missing"), "column").limit(k)


def missing_summary(df: DataFrame) -> DataFrame:
    """Columns with nulls: count and percent to two places, most first."""
    row = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"m|{c}") for c in df.columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`m|{c}`").alias("missing_count")) for c in df.columns])
    return (
        row.select("_n", F.explode(entries).alias("_e"))
        .select("_e.*", F.round(F.try_divide(F.col("_e.missing_count"), "_n") * 100, 2).alias("missing_pct"))
        .filter(F.col("missing_count") > 0)
        .orderBy(F.desc("missing_count"), "column")
    )


def dataset_quality(df: DataFrame, keys: Sequence[str] = S.KEY) -> DataFrame:
    """Rows, duplicate keys and AQI values outside 0..500."""
    per_key = df.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.count_if((F.col("aqi").try_cast("double") < 0) | (F.col("aqi").try_cast("double") > AQI_MAX)).alias("_bad"),
    )
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("invalid_aqi"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Full-row copies beyond the first."""
    return df.groupBy(*df.columns).count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows")
    )


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) of each distinct value."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return text.unpivot([], list(columns), "column", "value").distinct()


def source_summary(df: DataFrame, source: str = "aqi_source") -> DataFrame:
    """Records and percent per source, most first."""
    counts = df.groupBy(F.coalesce(F.col(source), F.lit("Unavailable")).alias("source")).agg(F.count("*").alias("records"))
    # One row per source is left by now, so the total is a window over few rows.
    total = F.sum("records").over(Window.partitionBy())
    return counts.select("source", "records", (F.col("records") / total * 100).alias("percent")).orderBy(F.desc("records"), "source")


def history_summary(df: DataFrame) -> DataFrame:
    """Rows, cities, AQI mean and median, first and last instant."""
    one = F.lit(1).alias("_one")
    plain = df.groupBy(one).agg(
        F.count("*").alias("rows"), F.countDistinct("city").alias("cities"), F.avg("aqi").alias("aqi_mean"),
        F.min(S.TIME).alias("first_ts"), F.max(S.TIME).alias("last_ts"),
    )
    median = quantiles(df.select(F.lit(1).alias("_one"), F.col("aqi").alias("value")), ["_one"], {"aqi_median": 0.5})
    # Two rows at most are stacked, so no join is needed.
    both = plain.drop("_one").unionByName(median.select("aqi_median"), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("rows", "cities", "aqi_mean", "aqi_median", "first_ts", "last_ts")]).filter(F.col("rows").isNotNull())


def history_window(df: DataFrame, days: int) -> DataFrame:
    """Rows of the last `days` before the newest instant of the data.

    The newest instant is one value; as a literal it reaches the scan filter.
    """
    newest = df.agg(F.max(S.TIME)).first()[0]
    if newest is None:
        return df.limit(0)
    kind = df.schema[S.TIME].dataType
    since = F.lit(newest).cast(kind) - F.make_dt_interval(days=F.lit(days))
    return df.filter(F.col(S.TIME) >= since)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per column; a column of nulls has count 0."""
    values = long_form(df, columns)
    moments = values.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    found = moments.join(quantiles(values, ["column"], QUARTILES).drop("n"), "column")
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(found, "column", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))


def box_stats(df: DataFrame, key: str, value: str = "aqi") -> DataFrame:
    """Five-number summary of `value` per hour, month or weekday."""
    pairs = df.select(key, F.col(value).cast("double").alias("value"))
    ends = pairs.filter(F.col("value").isNotNull()).groupBy(key).agg(F.min("value").alias("min"), F.max("value").alias("max"))
    return join_on(ends, quantiles(pairs, [key], QUARTILES), [key])


def iqr_outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values outside Q1 - 1.5 IQR .. Q3 + 1.5 IQR per column, most affected first."""
    values = long_form(df, columns)
    spread = IQR_FACTOR * (F.col("q3") - F.col("q1"))
    bounds = quantiles(values, ["column"], {"q1": 0.25, "q3": 0.75}).select(
        "column", (F.col("q1") - spread).alias("_lower"), (F.col("q3") + spread).alias("_upper")
    )
    # the bounds hold one row per column name
    outside = (F.col("value") < F.col("_lower")) | (F.col("value") > F.col("_upper"))
    counted = join_on(values, F.broadcast(bounds), ["column"]).groupBy("column").agg(
        F.count_if(outside).alias("count"),
        F.round(F.count_if(outside) / F.count("*") * 100, 2).alias("pct"),
        F.round(F.first("_lower"), 2).alias("lower_bound"),
        F.round(F.first("_upper"), 2).alias("upper_bound"),
    )
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return join_on(names, counted, ["column"], "left").select(
        "column",
        F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("pct", F.lit(0.0)).alias("pct"),
        "lower_bound", "upper_bound",
    ).orderBy(F.desc("count"), "column")


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 20) -> DataFrame:
    """Counts in `bins` equal-width bins between each column's min and max."""
    ends = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}|{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    ends = wide_to_long(ends, columns, {"lo": "lo", "hi": "hi"})
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.floor(F.try_divide(F.col("value") - F.col("lo"), width))
    bin_no = F.coalesce(F.least(place, F.lit(bins - 1)), F.lit(0)).cast("int")
    # the ends hold one row per column name
    placed = join_on(long_form(df, columns), F.broadcast(ends), ["column"])
    return placed.groupBy("column", bin_no.alias("bin"), (F.col("lo") + bin_no * width).alias("bin_start")).agg(
        F.count("*").alias("count")
    )


def skewness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bias-adjusted skewness G1 per column; null below three values."""
    n = F.col("n").cast("double")
    return (
        long_form(df, columns).groupBy("column")
        .agg(F.count("value").alias("n"), F.skewness("value").alias("g1"))
        .select("column", F.when(F.col("n") > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"))
    )


def pearson(a: Column, b: Column) -> Column:
    """Correlation over rows where both are present; null for a constant side."""
    left, right = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(left) * F.stddev_pop(right))


FLAT = 1e-12


def correlations(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """(feature_1, feature_2, r) of every left and right column, pairwise complete.

    One pass for any number of columns; a side that is constant over the pair's
    rows has no correlation.
    """
    c, n = F.col, F.nullif(F.col("n"), F.lit(0.0))
    cov = c("sxy") - c("sx") * c("sy") / n
    var_x, var_y = c("sxx") - c("sx") * c("sx") / n, c("syy") - c("sy") * c("sy") / n
    varies = (var_x > FLAT * c("sxx")) & (var_y > FLAT * c("syy"))
    return pair_moments(df, left, right).select(
        "feature_1", "feature_2", F.when(c("n") > 1, F.when(varies, cov / F.sqrt(var_x * var_y))).alias("r")
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Upper triangle of the correlation matrix, in column order."""
    place = F.array(*[F.lit(c) for c in columns])
    earlier = F.array_position(place, F.col("feature_1")) < F.array_position(place, F.col("feature_2"))
    return correlations(df, columns, columns).filter(earlier)


def target_correlation(df: DataFrame, columns: Sequence[str], target: str = "aqi_target", k: int = 20) -> DataFrame:
    """The k features most correlated with the target, by absolute value."""
    found = correlations(df, [c for c in columns if c != target], [target])
    return found.select(F.col("feature_1").alias("feature"), "r").orderBy(F.desc_nulls_last(F.abs("r")), "feature").limit(k)


def high_corr_pairs(df: DataFrame, columns: Sequence[str], target: str = "aqi_target", threshold: float = 0.9) -> DataFrame:
    """Redundant pairs: |r| at or above the threshold, target excluded."""
    return (
        correlation_matrix(df, [c for c in columns if c != target])
        .filter(F.abs("r") >= threshold)
        .select("feature_1", "feature_2", F.round("r", 3).alias("correlation"))
    )


def pair_correlation(df: DataFrame, column: str, other: str = "aqi") -> DataFrame:
    """Correlation of one column with AQI, non-numeric values ignored."""
    a, b = F.col(column).try_cast("double"), F.col(other).try_cast("double")
    both = F.count_if(a.isNotNull() & b.isNotNull())
    return df.agg(F.when(both > 1, pearson(a, b)).alias("correlation"), both.alias("pairs"))


def monthly_profile(df: DataFrame, by: Sequence[str] = S.SERIES) -> DataFrame:
    """AQI mean, deviation and count by calendar month."""
    return df.groupBy(*by, F.month(S.TIME).alias("month")).agg(
        F.avg("aqi").alias("mean"), F.stddev_samp("aqi").alias("std"), F.count("aqi").alias("n")
    )


def volatility_drift(df: DataFrame, rows: int = 24) -> DataFrame:
    """Level and volatility of AQI by year and month; steps cross month ends."""

    def add(frame: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(S.TIME)
        return frame.withColumns(
            {
                "_change": F.col("aqi") - F.lag("aqi", 1).over(w),
                "_roll_std": F.stddev_samp("aqi").over(w.rowsBetween(-(rows - 1), 0)),
            }
        )

    stepped = over_series(df.select("city", S.TIME, "aqi"), S.SERIES, [S.TIME], rows, 0, add)
    return stepped.groupBy("city", F.date_format(S.TIME, "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"),
        F.avg("aqi").alias("aqi_mean"),
        F.stddev_pop("_change").alias("change_std"),
        F.avg("_roll_std").alias("roll_std_24h_mean"),
    )


def split_stats(df: DataFrame, by: Sequence[str] = ("city", "split"), value: str = "aqi") -> DataFrame:
    """Size, mean, population deviation and range of each split."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(value).alias("aqi_mean"), F.stddev_pop(value).alias("aqi_std"),
        F.min(value).alias("aqi_min"), F.max(value).alias("aqi_max"),
    )


MIN_SHIFT_VALUES = 5


def distribution_shift(df: DataFrame, columns: Sequence[str], split: str = "split", k: int | None = 25) -> DataFrame:
    """Train against test per column: moments and KS distance, largest first."""
    values = long_form(df, columns, [split])
    train, test = F.col(split) == "train", F.col(split) == "test"
    moments = values.groupBy("column").agg(
        F.avg(F.when(train, F.col("value"))).alias("train_mean"),
        F.avg(F.when(test, F.col("value"))).alias("test_mean"),
        F.stddev_pop(F.when(train, F.col("value"))).alias("train_std"),
        F.stddev_pop(F.when(test, F.col("value"))).alias("test_std"),
    )
    distance = ks_two_sample(values, "column", train, test).filter(
        (F.col("n_first") >= MIN_SHIFT_VALUES) & (F.col("n_second") >= MIN_SHIFT_VALUES)
    )
    report = join_on(moments, distance.drop("n_first", "n_second"), ["column"])
    return report if k is None else report.orderBy(F.desc("ks_stat"), "column").limit(k)


def acf(df: DataFrame, lags: int = 72, value: str = "aqi") -> DataFrame:
    """(city, lag, acf): autocorrelation at row lags 1..lags.

    Each block of a series sums the products of its centred values with those up to
    `lags` rows before, missing ones as nothing; the few sums per block are added up and
    divided by the sum of squares (1 when that is zero).
    """
    means = df.groupBy("city").agg(F.avg(value).alias("_mean"))
    centred = join_on(df.select("city", S.TIME, value), means, ["city"]).select(
        "city", S.TIME, (F.col(value) - F.col("_mean")).alias("_x")
    )

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(S.TIME, kind="stable", na_position="first")
        x, own = pdf["_x"].to_numpy(), (pdf[BLOCK] == pdf["_own"]).to_numpy()
        known = bool((own & ~np.isnan(x)).any())
        x = np.nan_to_num(x)
        sums = [float((x[k:] * x[: len(x) - k])[own[k:]].sum()) for k in range(min(lags + 1, len(x)))]
        return pd.DataFrame({"city": pdf["city"].iloc[:1], "_s": [sums + [0.0] * (lags + 1 - len(sums))], "_known": [known]})

    city = df.schema["city"].dataType.simpleString()
    per_block = in_blocks(centred, S.SERIES, S.TIME, lags, 0, size_of=df).groupBy("city", BLOCK).applyInPandas(products, f"city {city}, _s array<double>, _known boolean")
    sums = per_block.groupBy("city").agg(F.max("_known").alias("_known"), *[F.sum(F.col("_s")[k]).alias("_ss" if k == 0 else f"_s{k}") for k in range(lags + 1)])
    # Without any value there is no autocorrelation either.
    total = F.when(F.col("_known"), F.when(F.col("_ss") == 0, 1.0).otherwise(F.col("_ss")))
    entries = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"_s{k}") / total).alias("acf")) for k in range(1, lags + 1)])
    return sums.select("city", F.explode(entries).alias("_e")).select("city", "_e.*")
