"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates are dealt to blocks of bounded size. A block keeps, for each dimension, the
order of its rows by that component. A query walks all lists at once, from the end
that its sign prefers; rows that come up are scored in full, and the components at the
present depth give the greatest score that a row not yet seen can have. The walk
stops when that bound is below the k-th best score. At equality it goes on,
as a row of the same score and a smaller key may follow. Depths double, so a walk that
has to see the whole block takes few rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.session import materialize

NEAREST = 5
SCALE = 256
#: Mean rows of a block; a block of queries meets a block of candidates in one task.
QUERY_BLOCK = CANDIDATE_BLOCK = 50_000
#: Depth of the first round.
FIRST = 16
LONGS = (-(2**63), 2**63 - 1)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """`id, v`, one row for each key that is not null and has a vector of finite numbers; the smallest of several."""
    rows = df.select(df[key].alias("id"), df[vector].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(finite, F.lit(False))).groupBy("id").agg(F.min("v").alias("v"))


def blocks(rows: DataFrame, parts: int, scale: int, lists: bool) -> DataFrame:
    """`d, part, ids, wide, matrix, orders`: rows of one length dealt to `parts` blocks, whole numbers floor(scale * x).

    `orders` holds for each dimension the rows by ascending component, if `lists`.
    """
    schema = T.StructType([T.StructField("d", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("ids", T.BinaryType())])
    schema.add("wide", "boolean").add("matrix", "binary").add("orders", "binary")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        d = int(pdf["d"].iloc[0])
        with np.errstate(over="ignore"):
            matrix = np.clip(np.floor(scale * np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), d)), -np.finfo(float).max, np.finfo(float).max)
        wide = bool(np.abs(matrix).max(initial=0) >= 2**15)
        orders = np.argsort(matrix, axis=0, kind="stable").T.astype(np.uint32).tobytes() if lists else b""
        ids = pdf["id"].to_numpy(np.int64).tobytes()
        return pd.DataFrame({"d": [d], "part": [int(pdf["part"].iloc[0])], "ids": [ids], "wide": [wide], "matrix": [matrix.astype(np.float64 if wide else np.int16).tobytes()], "orders": [orders]})

    dealt = rows.select("id", "v", F.size("v").alias("d"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    return dealt.groupBy("d", "part").applyInPandas(pack, schema)


def unpacked(row: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["matrix"], np.float64 if row["wide"] else np.int16).reshape(len(ids), int(row["d"]))


def exact(queries: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as numbers whose products and sums are exact: floats where they suffice, else Python's integers."""
    most = matrix.shape[1] * float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(matrix.astype(np.float64)).max(initial=0))
    if most < 2**53:
        kind = np.float32 if most < 2**24 else np.float64
        return queries.astype(kind), matrix.astype(kind)
    return tuple(np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape) for m in (queries, matrix))


def best_of(scores: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest scores and their rows, of equal ones the smaller row."""
    if len(scores) > 4 * k and scores.dtype != object:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= limit
        scores, rows = scores[near], rows[near]
    order = np.argsort(rows, kind="stable")
    order = order[np.argsort(-scores[order], kind="stable")][:k]
    return scores[order], rows[order]


def walk(query: np.ndarray, own: int, matrix: np.ndarray, orders: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, rows, rows seen) of the k best rows of a block whose rows ascend by key; row `own` is left out."""
    n = len(matrix)
    active = np.flatnonzero(query != 0)
    down = query[active] > 0
    seen = np.zeros(n + 1, bool)
    seen[own] = True
    scores, rows = np.zeros(0, matrix.dtype), np.zeros(0, np.int64)
    at, to = 0, FIRST if len(active) else n
    while True:
        to = min(to, n)
        fresh = np.zeros(n + 1, bool)
        if to == n:
            fresh[:n] = True
        else:
            fresh[orders[active[~down], at:to]] = True
            fresh[orders[active[down], n - to : n - at]] = True
        new = np.flatnonzero(fresh & ~seen)
        seen[new] = True
        scores, rows = best_of(np.concatenate([scores, matrix[new] @ query]), np.concatenate([rows, new]), k)
        if to == n:
            return scores, rows, n
        edge = orders[active, np.where(down, n - to, to - 1)]
        if len(rows) == k and scores[-1] > (matrix[edge, active] * query[active]).sum():
            return scores, rows, int(seen[:n].sum())
        at, to = to, 2 * to


def tile(left: pd.DataFrame, right: pd.DataFrame, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score) of the k best candidates in the block `left` for each query of the block `right`."""
    ids, matrix = unpacked(left.iloc[0])
    asked, queries = unpacked(right.iloc[0])
    orders = np.frombuffer(left["orders"].iloc[0], np.uint32).reshape(matrix.shape[1], len(ids))
    queries, matrix = exact(queries, matrix)
    place = np.searchsorted(ids, asked)
    own = np.where(ids[np.minimum(place, len(ids) - 1)] == asked, place, len(ids))
    out = []
    for query, key, mine in zip(queries, asked.tolist(), own.tolist(), strict=True):
        scores, rows, _ = walk(query, mine, matrix, orders, k)
        out += [(key, c, min(max(int(s), LONGS[0]), LONGS[1])) for s, c in zip(scores.tolist(), ids[rows].tolist(), strict=True)]
    return out


def search(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int = NEAREST, scale: int = SCALE) -> DataFrame:
    """`query_id, rank, <key>, score`: for each query the k rows of the greatest inner product of floor(scale * x).

    `queries` has the same columns; keys are integers. A query's own key is no candidate for it.
    Null keys, null vectors and vectors with nulls or non-finite numbers take no part, nor do
    candidates of another length than the query; a zero vector scores 0, as an empty one does
    with its like. Ties go to the smaller key. Rows with equal keys count once, with the
    smallest vector. Numbers are exact at any size, but a score beyond a long counts
    as the nearest long and a component beyond a double as the greatest one.
    """
    rows, asked = materialize(usable(df, key, vector), "vectors"), materialize(usable(queries, key, vector), "asked")
    spread = df.sparkSession.sparkContext.defaultParallelism
    parts, crowds = max(spread, -(-rows.count() // CANDIDATE_BLOCK)), max(1, -(-asked.count() // QUERY_BLOCK))
    held = materialize(blocks(rows, parts, scale, True), "blocks").withColumn("crowd", F.explode(F.sequence(F.lit(0), F.lit(crowds - 1))))
    crowd = blocks(asked, crowds, scale, False).withColumnRenamed("part", "crowd").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = tile(left, right, k) if len(left) and len(right) else []
        return pd.DataFrame(found, columns=["query_id", "id", "score"])

    tiles = held.groupBy("d", "part", "crowd").cogroup(crowd.groupBy("d", "part", "crowd")).applyInPandas(run, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("int")
    best = tiles.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(key), "score")
