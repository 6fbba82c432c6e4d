"""Row rules. Every rule yields reasons; rows without reasons are valid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline import schemas as S

VIOLATIONS = "violations"
FUTURE_SECONDS = 86400
ISO_DATE = r"^\s*\d{4}-\d{2}-\d{2}"


def _reasons(checks: Sequence[Column]) -> Column:
    """The reasons of the checks that fail; a check is null when it passes."""
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def _number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return F.col(name)
    if isinstance(kind, T.StringType):
        return F.col(name).try_cast("double")
    return F.lit(None).cast("double")


def _required() -> list[Column]:
    return [F.when(F.col(c).isNull(), f"required:{c}") for c in S.REQUIRED_FIELDS]


def _datatypes(df: DataFrame) -> list[Column]:
    open_types = [c for c in S.NUMERIC_FIELDS if c in df.columns and not isinstance(df.schema[c].dataType, T.NumericType)]
    return [F.when(F.col(c).isNotNull() & _number(df, c).isNull(), f"numeric:{c}") for c in open_types]


def _non_negative(df: DataFrame) -> list[Column]:
    return [F.when(_number(df, c) < 0, f"negative:{c}") for c in S.NON_NEGATIVE_FIELDS if c in df.columns]


def _coordinates(df: DataFrame) -> list[Column]:
    return [
        F.when(~F.coalesce(_number(df, c).between(-bound, bound), F.lit(False)), f"range:{c}")
        for c, bound in (("latitude", 90), ("longitude", 180))
    ]


def _timestamp(as_of: Column, field: str) -> list[Column]:
    text = F.col(field)
    parsed = F.when(text.rlike(ISO_DATE), F.try_to_timestamp(F.trim(text)))
    ahead = parsed.cast("double") - as_of.cast("double")
    return [F.when(parsed.isNull(), f"format:{field}"), F.when(ahead > FUTURE_SECONDS, f"future:{field}")]


def rule_required() -> Column:
    """Fields that must not be null."""
    return _reasons(_required())


def rule_optional_keys(df: DataFrame) -> None:
    """Pollutant columns that must exist, though their values may be null."""
    absent = [c for c in S.OPTIONAL_FIELDS if c not in df.columns]
    if absent:
        raise ValueError(f"optional pollutant columns missing entirely: {absent}")


def rule_datatypes(df: DataFrame) -> Column:
    """Numeric fields hold numbers; booleans are not numbers, null is skipped."""
    return _reasons(_datatypes(df))


def rule_non_negative(df: DataFrame) -> Column:
    return _reasons(_non_negative(df))


def rule_coordinates(df: DataFrame) -> Column:
    """Latitude in [-90, 90] and longitude in [-180, 180]; null fails."""
    return _reasons(_coordinates(df))


def rule_timestamp(as_of: Column, field: str = "timestamp") -> Column:
    """ISO-8601 text, not more than a day after `as_of`."""
    return _reasons(_timestamp(as_of, field))


def with_violations(df: DataFrame, as_of: Column) -> DataFrame:
    """All rules at once: `violations` holds every reason of a row."""
    rule_optional_keys(df)
    checks = [*_required(), *_datatypes(df), *_non_negative(df), *_coordinates(df), *_timestamp(as_of, "timestamp")]
    return df.withColumn(VIOLATIONS, _reasons(checks))


def validate_records(df: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with all their reasons)."""
    checked = with_violations(df, as_of)
    valid = checked.filter(F.size(VIOLATIONS) == 0).drop(VIOLATIONS)
    return valid, checked.filter(F.size(VIOLATIONS) > 0)
