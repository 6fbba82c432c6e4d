"""Nearest neighbours by a block matrix join.

Vectors are quantised to int8 with a scale of their own. A tile, one block of queries
against one block of candidates, multiplies the int8 matrices; the product gives
every distance up to a bound that follows from the quantisation errors. Only
candidates whose least possible distance is within the k-th greatest possible one
are computed again in double precision. A heap keeps the k best of each
query in a tile, another merges the tiles of a query.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.session import materialize

NEAREST = 10
QUERY_BLOCK, CANDIDATE_BLOCK = 1_024, 8_192


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """`id, v` of rows with a key and a vector of finite numbers that are not all 0."""
    rows = df.select(df[key].alias("id"), df[vector].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def quantised(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the length of what quantisation cut off."""
    scale = np.abs(matrix).max(1) / 127
    small = np.rint(matrix / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
    return small, scale, np.linalg.norm(matrix - small * scale[:, None], axis=1)


def tile(queries: np.ndarray, query_ids: np.ndarray, matrix: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, id, distance) of the k nearest rows of `matrix` to each query, itself apart."""
    out = []
    q8, q_scale, q_error = quantised(queries)
    c8, c_scale, c_error = quantised(matrix)
    # Sums of int8 products stay exact in float32 for up to 1,000 dimensions.
    exact = np.float32 if matrix.shape[1] <= 1_000 else np.float64
    product = (q8.astype(exact) @ c8.astype(exact).T).astype(np.float64) * q_scale[:, None] * c_scale
    q_norm, c_norm = (np.linalg.norm(x.astype(np.float64) * s[:, None], axis=1) ** 2 for x, s in ((q8, q_scale), (c8, c_scale)))
    near = np.sqrt(np.maximum(q_norm[:, None] + c_norm - 2 * product, 0))
    slack = (q_error[:, None] + c_error) * (1 + 1e-9) + 1e-9 * (1 + near)
    for i in range(len(queries)):
        low, high = near[i] - slack[i], near[i] + slack[i]
        own = ids == query_ids[i]
        high[own] = np.inf
        limit = np.partition(high, k - 1)[k - 1] if len(high) > k else np.inf
        rows = np.flatnonzero((low <= limit) & ~own)
        # Summed in the order of the components, as a plain loop would.
        distance = np.sqrt(np.cumsum((matrix[rows] - queries[i]) ** 2, axis=1)[:, -1])
        out += [(int(query_ids[i]), int(c), float(d)) for d, c in heapq.nsmallest(k, zip(distance, ids[rows].tolist(), strict=True))]
    return out


def search(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """`query_id, rank, <key>, score` of the k rows nearest to each query by Euclidean distance.

    `queries` has the same columns. A query's own key is no candidate for it. Vectors
    that are null, zero, or hold nulls or non-finite numbers take no part, nor do
    candidates of another length than the query. Ties go to the smaller key. Rows
    with equal keys count once, with the smallest vector.
    """
    rows = usable(df, key, vector).groupBy("id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
    asked = usable(queries, key, vector).groupBy("id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
    rows, asked = materialize(rows, "candidates"), materialize(asked, "queries")
    n_rows, n_asked = rows.count(), asked.count()
    parts, blocks = max(1, -(-n_rows // CANDIDATE_BLOCK)), max(1, -(-n_asked // QUERY_BLOCK))
    dealt = rows.withColumns({"part": F.pmod(F.xxhash64("id"), F.lit(parts)), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    spread = asked.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), "part": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))})
    schema = "query_id long, id long, score double"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            found = tile(np.stack(right["v"].to_numpy()), right["id"].to_numpy(), np.stack(left["v"].to_numpy()), left["id"].to_numpy(), k)
        return pd.DataFrame(found, columns=["query_id", "id", "score"])

    tiles = dealt.groupBy("d", "block", "part").cogroup(spread.groupBy("d", "block", "part")).applyInPandas(run, schema)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        best = heapq.nsmallest(k, zip(pdf["score"], pdf["id"], strict=True))
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "rank": range(1, len(best) + 1), "id": [c for _, c in best], "score": [d for d, _ in best]})

    merged = tiles.groupBy("query_id").applyInPandas(merge, "query_id long, rank int, id long, score double")
    return merged.withColumnRenamed("id", key)
