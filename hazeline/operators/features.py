"""Per-city time-series features of the hourly observation table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.functions.calendar import cyclical, time_fields
from hazeline.functions.indices import available_pollutants, pollution_index
from hazeline.operators.ordered import keep_last, over_series
from hazeline.session import materialize


def _present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def _along(by: Sequence[str]) -> Window:
    return Window.partitionBy(*by).orderBy(S.TIME)


def _change_rate(df: DataFrame, by: Sequence[str]) -> DataFrame:
    w = _along(by)
    return df.withColumns(
        {f"{c}_change_rate": F.col(c) - F.lag(c, 1).over(w) for c in _present(df, S.CHANGE_COLUMNS)}
    )


def _lags(df: DataFrame, by: Sequence[str]) -> DataFrame:
    w = _along(by)
    return df.withColumns(
        {f"{c}_lag_{n}": F.lag(c, n).over(w) for c in _present(df, S.CHANGE_COLUMNS) for n in S.LAGS}
    )


def _rolling(df: DataFrame, by: Sequence[str]) -> DataFrame:
    added = {}
    for label, rows in S.ROLLING_ROWS.items():
        recent = _along(by).rowsBetween(-(rows - 1), 0)
        for c in _present(df, S.ROLLING_COLUMNS):
            added[f"{c}_rolling_mean_{label}"] = F.avg(c).over(recent)
            added[f"{c}_rolling_std_{label}"] = F.stddev_samp(c).over(recent)
    return df.withColumns(added)


def _target(df: DataFrame, by: Sequence[str], horizon: int) -> DataFrame:
    return df.withColumn("aqi_target", F.lead("aqi", horizon).over(_along(by)))


def change_rate(df: DataFrame) -> DataFrame:
    """First difference of each change column, null on a city's first row."""
    return over_series(df, S.SERIES, [S.TIME], 1, 0, _change_rate)


def lag_features(df: DataFrame) -> DataFrame:
    """Row lags, short and seasonal."""
    return over_series(df, S.SERIES, [S.TIME], max(S.LAGS), 0, _lags)


def rolling_stats(df: DataFrame) -> DataFrame:
    """Mean and sample deviation over the last 24 and 48 rows, nulls skipped."""
    return over_series(df, S.SERIES, [S.TIME], max(S.ROLLING_ROWS.values()), 0, _rolling)


def target_ahead(df: DataFrame, horizon: int = S.HORIZON_ROWS) -> DataFrame:
    """AQI `horizon` rows later in the same city."""
    if "aqi" not in df.columns:
        raise ValueError("the 'aqi' column is required to build the target")
    return over_series(df, S.SERIES, [S.TIME], 0, horizon, lambda d, by: _target(d, by, horizon))


def _rolled(df: DataFrame, by: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    """Add whether all rolling means and deviations of `columns` are numbers, from running counts alone.

    A deviation is one with two values or more, all of them finite; its mean then is one too. The
    shortest window has the fewest values and the longest holds all odd ones, so these two decide.
    """
    upto, fewest, most = _along(by).rowsBetween(Window.unboundedPreceding, 0), min(S.ROLLING_ROWS.values()), max(S.ROLLING_ROWS.values())
    odd, counts = F.lit(False), {}
    for c in columns:
        value = F.col(c).cast("double")
        odd = odd | F.coalesce(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(False))
        counts[f"_known_{c}"] = F.count_if(F.col(c).isNotNull()).over(upto)
    counted = df.withColumns({**counts, "_odd": F.count_if(odd).over(upto)})
    recent = lambda count, rows: F.col(count) - F.coalesce(F.lag(count, rows).over(_along(by)), F.lit(0))
    whole = recent("_odd", most) == 0
    for count in counts:
        whole = whole & (recent(count, fewest) >= 2)
    return counted.withColumn(name, whole).drop(*counts, "_odd")


def _lagged(df: DataFrame, by: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    """Add whether all lags of `columns` are numbers: one flag of a row is lagged, not each column."""
    number = F.lit(True)
    for c in columns:
        number = number & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    w, flagged = _along(by), df.withColumn("_number", number)
    whole = F.lit(True)
    for n in S.LAGS:
        whole = whole & F.coalesce(F.lag("_number", n).over(w), F.lit(False))
    return flagged.withColumn(name, whole).drop("_number")


def series_features(df: DataFrame, horizon: int | None = S.HORIZON_ROWS, rolled: tuple[str, Sequence[str]] | None = None,
                    lagged: tuple[str, Sequence[str]] | None = None) -> DataFrame:
    """Change, lag, rolling and target columns in one pass over each series.

    All windows share one partitioning and order, so the plan has a single
    shuffle and sort. `rolled` and `lagged` name columns to add that tell whether the rolling
    and the lag columns of the given sources are all numbers.
    """

    def add(frame: DataFrame, by: list[str]) -> DataFrame:
        if rolled:
            frame = _rolled(frame, by, rolled[1], rolled[0])
        if lagged:
            frame = _lagged(frame, by, lagged[1], lagged[0])
        frame = _rolling(_lags(_change_rate(frame, by), by), by)
        return frame if horizon is None else _target(frame, by, horizon)

    return over_series(df, S.SERIES, [S.TIME], max(S.LAGS), horizon or 0, add)


def source_coverage(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, coverage): share of non-null values per column."""
    columns = list(columns or df.columns)
    row = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return row.unpivot([], columns, "column", "coverage")


def covered_sources(df: DataFrame, threshold: float = S.COVERAGE_THRESHOLD) -> set[str]:
    """Source columns with enough non-null values (one aggregate)."""
    sources = _present(df, dict.fromkeys(S.CHANGE_COLUMNS + S.ROLLING_COLUMNS))
    return {r["column"] for r in source_coverage(df, sources).collect() if (r["coverage"] or 0.0) >= threshold}


def required_columns(columns: Sequence[str], covered: set[str]) -> list[str]:
    """Target plus the derived columns of the covered sources."""
    names = ["aqi_target"]
    for c in S.CHANGE_COLUMNS:
        if c in covered:
            names += [f"{c}_change_rate", *[f"{c}_lag_{n}" for n in S.LAGS]]
    for c in S.ROLLING_COLUMNS:
        if c in covered:
            names += [f"{c}_rolling_{stat}_{label}" for label in S.ROLLING_ROWS for stat in ("mean", "std")]
    return [c for c in names if c in columns]


def drop_incomplete(
    features: DataFrame, observations: DataFrame | None = None, threshold: float = S.COVERAGE_THRESHOLD
) -> DataFrame:
    """Drop rows lacking a required derived column.

    Coverage is measured on `observations`, the table the features were built
    from, so the measuring pass reads a few plain columns and runs no windows.
    """
    covered = covered_sources(features if observations is None else observations, threshold)
    return features.na.drop(subset=required_columns(features.columns, covered))


def build_features(
    observations: DataFrame,
    horizon: int = S.HORIZON_ROWS,
    complete_only: bool = True,
    ingest_order: str | None = "ingest_seq",
) -> DataFrame:
    """Observations to the feature table: dedupe, calendar, series, index, target.

    The deduplicated table is written once: the presence and coverage passes
    then read single columns of it instead of repeating the dedupe shuffle. Whether
    rolling and lag columns are complete is told from counts and flags, so a reader who takes
    none of them does not wait for their windows.
    """
    clean = observations.filter(F.col(S.TIME).isNotNull())
    if ingest_order:
        clean = materialize(keep_last(clean, S.KEY, ingest_order), "observations")
    pollutants = available_pollutants(clean)
    covered = covered_sources(clean) if complete_only else set()
    rolling = [c for c in _present(clean, S.ROLLING_COLUMNS) if c in covered]
    lagging = [c for c in _present(clean, S.CHANGE_COLUMNS) if c in covered]
    flags = (("_rolled", rolling), ("_lagged", lagging)) if complete_only else (None, None)
    features = cyclical(time_fields(series_features(clean, horizon, *flags)))
    features = features.withColumn("pollution_index", pollution_index(pollutants))
    if not complete_only:
        return features
    counted = {f"{c}_rolling_{stat}_{label}" for c in rolling for label in S.ROLLING_ROWS for stat in ("mean", "std")}
    counted |= {f"{c}_lag_{n}" for c in lagging for n in S.LAGS}
    needed = [c for c in required_columns(features.columns, covered) if c not in counted]
    return features.na.drop(subset=needed).filter("_rolled and _lagged").drop("_rolled", "_lagged")


def select_features(df: DataFrame) -> list[str]:
    """Whitelisted model columns that exist and hold any data, in order."""
    present = _present(df, S.model_features())
    if not present:
        raise ValueError("no whitelisted feature column is present")
    counts = df.agg(*[F.count(c).alias(c) for c in present]).first()
    usable = [c for c in present if counts[c] > 0]
    if not usable:
        raise ValueError("no whitelisted feature column holds data")
    return usable


def select_daily_features(columns: Sequence[str], n_days: int) -> list[str]:
    """Daily model columns: history plus future weather for days 1..n."""
    future = [f"fw_{v}{h}" for h in range(1, n_days + 1) for v in S.FUTURE_VARS]
    skip = {*S.DAILY_HELPERS, "city"}
    history = [c for c in columns if c not in skip and not c.startswith("fw_")]
    return history + [c for c in future if c in columns]


def complete_rows(df: DataFrame, columns: Sequence[str], target: str | None = None) -> DataFrame:
    """Rows with every feature (and the target) present; missing columns are an error."""
    needed = [*columns, *([target] if target else [])]
    absent = [c for c in needed if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    return df.na.drop(subset=needed)


def build_xy(df: DataFrame, columns: Sequence[str], target: str = "aqi_target") -> DataFrame:
    """Features and target of the complete rows; none left is an error."""
    rows = complete_rows(df, columns, target).select(*columns, target)
    if rows.isEmpty():
        raise ValueError("no complete rows to train on")
    return rows


def build_feature_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Features of the rows that can be scored."""
    return complete_rows(df, columns).select(*columns)
