"""Sums of products of many columns, taken in one pass.

Each task reduces its rows to small matrices; only those are shuffled. This
keeps a wide correlation matrix or a regression on many features at one pass
over the data, where one SQL aggregate per pair would need very large plans.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUPS_HELD = 1000


def centres(df: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float]]:
    """A level and a magnitude per column.

    Any constants give the same results; these keep the sums of products small,
    so that columns such as pressure lose no digits.
    """
    level = [F.avg(F.col(c).cast("double")).alias(f"level|{c}") for c in names]
    magnitude = [F.max(F.abs(F.col(c).cast("double"))).alias(f"magnitude|{c}") for c in names]
    row = df.agg(*level, *magnitude).first()
    return {c: (float(row[f"level|{c}"] or 0.0), float(row[f"magnitude|{c}"] or 0.0) or 1.0) for c in names}


def constants(names: Sequence[str], known: dict[str, tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([known[c][0] for c in names]), np.array([known[c][1] for c in names])


def cross_products(df: DataFrame, by: Sequence[str], names: Sequence[str], shift: np.ndarray, unit: np.ndarray) -> DataFrame:
    """(by..., pos, v): upper triangle of Σ z zᵀ with z = (1, shifted columns)."""
    by, names = list(by), list(names)
    upper = np.triu_indices(len(names) + 1)

    def reduce_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def emit() -> pd.DataFrame:
            keys = pd.DataFrame(list(held), columns=by)
            return keys.assign(products=[v.tolist() for v in held.values()])

        for rows in batches:
            z = (rows[names].to_numpy(dtype="float64") - shift) / unit
            z = np.column_stack([np.ones(len(z)), z])
            for key, places in rows.groupby(by, sort=False).indices.items():
                block = z[places]
                key = key if isinstance(key, tuple) else (key,)
                held[key] = held.get(key, 0.0) + (block.T @ block)[upper]
            if len(held) > GROUPS_HELD:
                yield emit()
                held.clear()
        if held:
            yield emit()

    schema = T.StructType([*[df.schema[c] for c in by], T.StructField("products", T.ArrayType(T.DoubleType()))])
    partial = df.select(*by, *[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(reduce_rows, schema)
    return (
        partial.select(*by, F.posexplode("products").alias("pos", "v")).groupBy(*by, "pos").agg(F.sum("v").alias("v"))
    )


def pair_moments(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """(feature_1, feature_2, n, sx, sy, sxx, syy, sxy) per pair of columns.

    Every pair uses the rows in which both of its columns are present; values
    are shifted and scaled per column, which leaves correlations unchanged.
    """
    left, right = list(left), list(right)
    names = list(dict.fromkeys([*left, *right]))
    shift, unit = constants(names, centres(df, names))
    a, b = [names.index(c) for c in left], [names.index(c) for c in right]
    first, second = np.repeat(left, len(right)), np.tile(right, len(left))
    fields = ("n", "sx", "sy", "sxx", "syy", "sxy")

    def reduce_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((len(fields), len(left), len(right)))
        for rows in batches:
            z = (rows[names].to_numpy(dtype="float64") - shift) / unit
            here = ~np.isnan(z)
            z, have = np.where(here, z, 0.0), here.astype("float64")
            x, y, in_x, in_y = z[:, a], z[:, b], have[:, a], have[:, b]
            totals += np.stack(
                [in_x.T @ in_y, x.T @ in_y, in_x.T @ y, (x * x).T @ in_y, in_x.T @ (y * y), x.T @ y]
            )
        out = pd.DataFrame({"feature_1": first, "feature_2": second})
        yield out.assign(**{f: totals[i].ravel() for i, f in enumerate(fields)})

    schema = "feature_1 string, feature_2 string, " + ", ".join(f"{f} double" for f in fields)
    values = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    return values.mapInPandas(reduce_rows, schema).groupBy("feature_1", "feature_2").agg(*[F.sum(f).alias(f) for f in fields])
