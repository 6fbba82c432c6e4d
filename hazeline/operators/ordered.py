"""Ordered computation over series of any length, in one plan for all sizes.

No series is ever one task. Row-offset windows and positions rest on a small table
of the hours of a series: rows per hour, counted and added up, give each hour its
place, and from that its block and the blocks whose windows reach into it. Running
totals and nearest values, whose order need not be time, rest on a range
partitioning by (series, order), with one small row per part that carries totals or last
values across the parts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.session import materialize

#: Rows of a block. A block also holds the rows before and after it that its windows need.
BLOCK_ROWS = 50_000
#: Blocks are so many times longer than what their windows reach over, at least.
REACHES = 4
PART, HOUR, BLOCK = "_part", "_day_hour", "_block"


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys and keeps the left key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"_r_{k}" for k in keys])


def _hour(time: str) -> Column:
    return F.date_trunc("hour", time)


def _hours(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """`keys, _day_hour, _n, _before, _total`: rows of each hour, of all hours before it, and of the series."""
    counts = df.groupBy(*keys, _hour(time).alias(HOUR)).agg(F.count("*").alias("_n"))
    series = Window.partitionBy(*keys)
    upto = F.sum("_n").over(series.orderBy(HOUR).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumns({"_before": upto - F.col("_n"), "_total": F.sum("_n").over(series)})


def _spread(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-partition by (keys, order) and record the part of every row.

    The parts are written out, so the part ids do not change when a lost task
    is run again.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *keys, *order).withColumn(PART, F.spark_partition_id())
    return materialize(placed, "ordered")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column | str]
) -> DataFrame:
    """Add inclusive running totals `{name: value}` in `order` within `keys`, and `<name>_total` of all of them.

    `order` must be unique within `keys`.
    """
    keys, order = list(keys), list(order)
    values = {name: F.col(v) if isinstance(v, str) else v for name, v in sums.items()}
    parts = _spread(df, keys, order)
    per_part = parts.groupBy(*keys, PART).agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in values.items()])
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        *keys, PART, *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}") for n in values],
        *[F.sum(f"_sum_{n}").over(Window.partitionBy(*keys)).alias(f"{n}_total") for n in values],
    )
    upto = Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = join_on(parts, offsets, [*keys, PART])
    return joined.withColumns(
        {n: F.col(f"_off_{n}") + F.coalesce(F.sum(v).over(upto), F.lit(0)) for n, v in values.items()}
    ).drop(PART, *[f"_off_{n}" for n in values])


def series_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], bounded: bool = False) -> DataFrame:
    """Add `row_index` (from 1) and `n_rows` of each row's series, ordered by time first.

    `bounded` takes plain windows, for series whose length the data model
    limits, such as the days of a city.
    """
    keys = list(keys)
    if bounded:
        whole = Window.partitionBy(*keys)
        return df.withColumns(
            {
                "row_index": F.row_number().over(whole.orderBy(*order)).cast("long"),
                "n_rows": F.count("*").over(whole),
            }
        )
    dated = df.withColumn(HOUR, _hour(order[0]))
    placed = join_on(dated, _hours(df, keys, order[0]).drop("_n"), [*keys, HOUR])
    within = F.row_number().over(Window.partitionBy(*keys, HOUR).orderBy(*order))
    return placed.withColumns(
        {"row_index": F.col("_before") + within, "n_rows": F.col("_total")}
    ).drop(HOUR, "_before", "_total")


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Add `<value>_before` and `<value>_after`: the last non-null one at or before each row, and the first at or after it."""
    keys, order = list(keys), list(order)
    backwards = [F.col(c).desc() for c in order]
    parts = _spread(df, keys, order)
    by, position = [*keys, PART], F.struct(*order)

    def ends(value: str) -> list[Column]:
        held = F.when(F.col(value).isNotNull(), position)
        return [F.max_by(value, held).alias(f"_last_{value}"), F.min_by(value, held).alias(f"_first_{value}")]

    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.col(PART).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.groupBy(*by).agg(*[c for v in values for c in ends(v)]).select(
        *by,
        *[F.last(f"_last_{v}", True).over(earlier).alias(f"_carry_before_{v}") for v in values],
        *[F.last(f"_first_{v}", True).over(later).alias(f"_carry_after_{v}") for v in values],
    )
    ahead = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*by).orderBy(*backwards).rowsBetween(Window.unboundedPreceding, 0)
    added = {f"{v}_before": F.coalesce(F.last(v, True).over(ahead), f"_carry_before_{v}") for v in values}
    added |= {f"{v}_after": F.coalesce(F.last(v, True).over(behind), f"_carry_after_{v}") for v in values}
    return join_on(parts, carried, by).withColumns(added).drop(PART, *[f"_carry_{side}_{v}" for side in ("before", "after") for v in values])


def in_blocks(
    df: DataFrame, keys: Sequence[str], time: str, back: int, ahead: int, size_of: DataFrame | None = None
) -> DataFrame:
    """The rows of every block, with `_block` and `_own`.

    Hours are the unit: an hour belongs to the block in which it starts and is copied to
    each block that has a row at most `back` rows after it or `ahead` rows before it.
    In a block, the rows around its own ones stand complete, so row-offset
    windows are right for the rows with `_own` = `_block`. `size_of` is a frame
    with the same series that is cheaper to count than `df`.
    """
    keys = list(keys)
    size = max(BLOCK_ROWS, REACHES * (back + ahead))
    own = F.floor(F.col("_before") / size)
    hours = _hours(df if size_of is None else size_of, keys, time).withColumn("_own", own)
    first = F.col("_own")
    if ahead:
        reached = Window.partitionBy(*keys).orderBy("_before").rangeBetween(Window.unboundedPreceding, -ahead)
        first = F.coalesce(F.max("_own").over(reached), F.lit(0).cast("long"))
    last = F.floor((F.col("_before") + F.col("_n") - 1 + back) / size) if back else F.col("_own")
    spans = hours.select(*keys, HOUR, "_own", F.sequence(first, last).alias(BLOCK))
    dated = df.withColumn(HOUR, _hour(time))
    return join_on(dated, spans, [*keys, HOUR]).drop(HOUR).withColumn(BLOCK, F.explode(BLOCK))


def over_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    back: int,
    ahead: int,
    add_columns: Callable[[DataFrame, list[str]], DataFrame],
    size_of: DataFrame | None = None,
) -> DataFrame:
    """Apply row-offset windows to every series, however long.

    `add_columns(frame, by)` adds columns whose windows are partitioned by `by`
    and look at most `back` rows back and `ahead` rows ahead. Series are ordered
    by time first and cut into blocks.
    """
    copies = in_blocks(df, keys, order[0], back, ahead, size_of)
    return add_columns(copies, [*keys, BLOCK]).filter(F.col(BLOCK) == F.col("_own")).drop("_own", BLOCK)


def keep_last(df: DataFrame, keys: Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest `order`.

    Written as an aggregate, so copies of one key are reduced before the
    shuffle and no key is ever sorted in one task.
    """
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_kept"))
    return last.select(*[c if c in keys else F.col("_kept")[c].alias(c) for c in df.columns])
