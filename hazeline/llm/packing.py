"""Best-fit packing of tokenised documents by large-item matching.

A sequence holds at most two pieces of more than a third of its capacity. These
large pieces are paired first, each from the largest down with the largest that
still fits beside it; all others then go, largest first, to the tightest gap
that takes them.

Both steps need lengths only, and there are no more lengths than the capacity.
So the plan is made from the number of pieces of each length, as runs of equal
sequences, and its size depends on the capacity alone. Spark counts the
pieces, numbers those of each length, and looks every number up in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.llm import batches, bpe
from hazeline.session import materialize

CAPACITY = 2048
END = 0
NUMBERED = 100_000


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for a first that may be shorter."""
    first = (length - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def pieces(df: DataFrame, key: str, text: str, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """`key, piece, start, length, ids_crc32` of every document: its ids and an end mark, cut to capacity.

    Null text is empty: one piece of the end mark alone. Rows with equal keys
    give their own pieces each.
    """
    names = ["key", "piece", "start", "length", "ids_crc32"]
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("piece", T.IntegerType())])
    for name in names[2:]:
        schema.add(name, T.LongType())
    end = np.array([END], "<u4").tobytes()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(vocabulary)
        for batch in batches.slices(rows, "text"):
            out = []
            for row, ids in enumerate(codec.encode(batches.texts(batch, "text"))):
                ids += end
                for n, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    out.append((row, n, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            row, *rest = zip(*out, strict=True)
            columns = [batch.column("key").take(pa.array(row)), pa.array(rest[0], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(x, pa.int64()) for x in rest[1:]], names=names)

    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, schema)


class Plan:
    """Runs of equal sequences, and where the numbered pieces of each length go in them."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.left = capacity, dict(counts)
        self.used = dict.fromkeys(counts, 0)
        self.sequences = 0
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.gaps: list[int] = []
        large = sorted((n for n in counts if 3 * n > capacity), reverse=True)
        for n in large:
            while self.left[n]:
                self.pair(n, large)
        for n in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
            while self.left[n]:
                self.fit(n)

    def put(self, length: int, first: int, count: int, offset: int) -> None:
        """`count` pieces go, one each, to the sequences from `first` on."""
        self.rows.append((length, self.used[length], count, first, offset))
        self.used[length] += count
        self.left[length] -= count

    def open(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in self.runs:
                insort(self.gaps, gap)
            self.runs.setdefault(gap, []).append((first, count))

    def new(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def pair(self, n: int, large: list[int]) -> None:
        room = self.capacity - n
        mate = next((m for m in large if m <= room and self.left[m] > (m == n)), None)
        count = self.left[n] if mate is None else self.left[n] // 2 if mate == n else min(self.left[n], self.left[mate])
        first = self.new(count)
        self.put(n, first, count, 0)
        if mate is not None:
            self.put(mate, first, count, n)
            room -= mate
        self.open(room, first, count)

    def fit(self, n: int) -> None:
        at = bisect_left(self.gaps, n)
        if at == len(self.gaps):
            count = -(-self.left[n] // (self.capacity // n))
            self.open(self.capacity, self.new(count), count)
            return
        gap = self.gaps[at]
        first, size = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap], self.gaps[at]
        count = min(size, self.left[n])
        self.put(n, first, count, self.capacity - gap)
        self.open(gap, first + count, size - count)
        self.open(gap - n, first, count)


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`parts` (as `pieces` gives them) with `sequence_id` and `offset`.

    The pieces of a length are numbered in groups by hash, each of which starts
    where the one before ends; so a length that a third of all pieces have is
    numbered by many tasks. The result is the same for any partitioning.
    """
    spark = parts.sparkSession
    rows = materialize(parts, "pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    plan = Plan(counts, capacity)
    places = spark.createDataFrame(plan.rows, "length long, from long, count long, first long, offset long")
    groups = 1 + sum(counts.values()) // NUMBERED
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("key", "piece", "ids_crc32"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("length", "_group").agg(F.count("*").alias("n"))
    starts = starts.select("length", "_group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    order = Window.partitionBy("length", "_group").orderBy("key", "piece", "ids_crc32", "start")
    numbered = rows.withColumn("_row", F.row_number().over(order) - 1).join(starts, ["length", "_group"])
    number = F.col("_row") + F.col("_start")
    # Bounded by the capacity: no length needs more than a run for each gap.
    placed = numbered.withColumn("_number", number).join(
        F.broadcast(places.withColumnRenamed("length", "_length")),
        (F.col("length") == F.col("_length")) & (F.col("_number") >= F.col("from")) & (F.col("_number") < F.col("from") + F.col("count")),
    )
    return placed.select(
        *parts.columns, (F.col("first") + F.col("_number") - F.col("from")).alias("sequence_id"), "offset"
    )


def pack_documents(df: DataFrame, key: str, text: str, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document of `df` with their places; `key` keeps its name."""
    return pack(pieces(df, key, text, vocabulary, capacity), capacity).withColumnRenamed("key", key)
