"""How filters interact: what each removes first, in vain, or alone, in every order.

Counts come from one finite-state pass over the UTF-8 bytes of a batch. A table gives, for the
state before a byte and the byte, what is counted there and whether a word begins or
ends. No byte's effect depends on more than the one before it, so numpy looks up
all bytes at once. Word spans go to an open-addressing hash table whose hits
are verified byte by byte; all spans probe in step, one place per round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.llm import batches, shingles
from hazeline.session import materialize

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#$%&*|"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
POINT, CAPITAL, SYMBOL, BEGINS, ENDS = 1, 2, 4, 8, 16
GAP, WORD = 0, 1
#: Bytes of text in a step; its spans and their table stay in a core's cache.
STEP = 500_000
#: Longer words are hashed and compared one by one.
LONG = 64
COUNTS = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


def transducer() -> np.ndarray:
    """What happens at each byte, by 256 * state + byte. The state after a byte is GAP for a space, else WORD."""
    actions = np.zeros((2, 256), np.uint8)
    byte = np.arange(256)
    space = np.isin(byte, list(SPACES))
    actions[:, (byte & 0xC0) != 0x80] |= POINT
    actions[:, (byte >= ord("A")) & (byte <= ord("Z"))] |= CAPITAL
    actions[:, np.isin(byte, list(SYMBOLS))] |= SYMBOL
    actions[GAP, ~space] |= BEGINS
    actions[WORD, space] |= ENDS
    return actions.ravel()


ACTIONS = transducer()
AFTER = np.where(np.isin(np.arange(256), list(SPACES)), np.uint16(256 * GAP), np.uint16(256 * WORD))
#: The lowest n bytes of eight.
LOWEST = np.array([2 ** (8 * n) - 1 for n in range(9)], np.uint64)


class Spans:
    """Words of a batch of texts as places in its bytes, with a hash of text number and word."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> None:
        self.data, self.start, self.size, self.owner = data, start, end - start, owner
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.eights = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
        self.head = self.part(np.arange(len(start)), 0)
        self.hash = shingles.mixed(self.head ^ shingles.mixed(owner.astype(np.uint64) * np.uint64(LONG) + self.size.astype(np.uint64)))
        rows = np.flatnonzero((self.size > 8) & (self.size <= LONG))
        for at in range(8, LONG, 8):
            rows = rows[self.size[rows] > at]
            self.hash[rows] = shingles.mixed(self.hash[rows] * np.uint64(3) + self.part(rows, at))
        for i in np.flatnonzero(self.size > LONG):
            self.hash[i] = xxhash.xxh3_64_intdigest(self.word(i), int(owner[i]))

    def part(self, rows: np.ndarray, at: int) -> np.ndarray:
        """Up to eight bytes of each word from its byte `at` on, as a number."""
        return self.eights[self.start[rows] + at] & LOWEST[np.minimum(self.size[rows] - at, 8)]

    def word(self, i: int) -> memoryview:
        return self.data[self.start[i] : self.start[i] + self.size[i]].data

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which rows of `a` and `b` are the same word of the same text, by all their bytes."""
        same = (a == b) | ((self.owner[a] == self.owner[b]) & (self.size[a] == self.size[b]) & (self.head[a] == self.head[b]))
        left = np.flatnonzero(same & (a != b) & (self.size[a] > 8))
        for i in left[self.size[a[left]] > LONG]:
            same[i] = self.word(a[i]) == self.word(b[i])
        left = left[self.size[a[left]] <= LONG]
        for at in range(8, LONG, 8):
            left = left[self.size[a[left]] > at]
            if not len(left):
                break
            alike = self.part(a[left], at) == self.part(b[left], at)
            same[left[~alike]] = False
            left = left[alike]
        return same

    def first_ones(self) -> np.ndarray:
        """Whether a span was the one to enter its word into the hash table."""
        n = len(self.start)
        size = 1 << max(1, (2 * n).bit_length())
        table = np.full(size, -1, np.int64)
        place = (self.hash & np.uint64(size - 1)).astype(np.int64)
        entered = np.zeros(n, bool)
        open_ = np.arange(n)
        while len(open_):
            at = place[open_]
            free = table[at] < 0
            table[at[free]] = open_[free]
            there = table[at]
            entered[open_[there == open_]] = True
            open_ = open_[~self.equal(open_, there)]
            place[open_] = (place[open_] + 1) & (size - 1)
        return entered


def counted(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The five counts of each text."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    edges = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=edges[1:])
    code = data.astype(np.uint16)
    code[1:] += AFTER[data[:-1]]
    action = ACTIONS[code]

    def owners(of: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(action & of)
        return at, np.searchsorted(edges, at, side="right") - 1

    n = len(texts)
    start, owner = owners(BEGINS)
    spans = Spans(data, start, owners(ENDS)[0], owner)
    points = np.add.reduceat(action & POINT, edges[:-1], dtype=np.int64) if n else np.zeros(0, np.int64)
    return {
        "n_words": np.bincount(owner, minlength=n), "n_distinct": np.bincount(owner[spans.first_ones()], minlength=n),
        "n_capitals": np.bincount(owners(CAPITAL)[1], minlength=n), "n_points": points - 1, "n_symbols": np.bincount(owners(SYMBOL)[1], minlength=n),
    }


def measure(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns `keep` and n_words, n_distinct, n_capitals (A-Z), n_points (code points) and n_symbols of every row.

    A null text counts as empty, and an empty one has only zeros.
    """
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in COUNTS])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.slices(rows, "_text", STEP):
            counts = counted(batches.raw(batch, "_text"))
            kept = [batch.column(i + 1) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(counts[c], pa.int64()) for c in COUNTS]], names=schema.names)

    return df.select(df[text].alias("_text"), *[df[c] for c in keep]).mapInArrow(run, schema)


def failures() -> dict[str, Column]:
    """Filters on the counts of a text, by letter; true where it fails."""
    return {
        "A": F.col("n_words") < MIN_WORDS, "B": 100 * F.col("n_distinct") < MIN_DISTINCT * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > MAX_CAPITALS * F.col("n_points"), "D": F.col("n_symbols") > 0,
    }


def bits(failed: dict[str, Column]) -> Column:
    """One number for the filters that fail, a bit each."""
    total = F.lit(0)
    for i, flag in enumerate(failed.values()):
        total = total + F.when(flag, 1 << i).otherwise(0)
    return total


def every_order(cells: DataFrame, part: str, names: list[str], losses: list[str]) -> DataFrame:
    """`part, filter_order, step, kept, removed, redundant, unique_fails, <loss>_lost, shapley` for all orders of the filters.

    `cells` has part, mask (bit i: the filter names[i] fails), n and one sum per loss; at most one
    row for each mask of a part goes on.
    """
    bit = {name: 1 << i for i, name in enumerate(names)}
    steps = []
    for order in permutations(names):
        before = 0
        for i, name in enumerate(order):
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(bit[name]).alias("bit"), F.lit(before).alias("before")))
            before |= bit[name]
    summed = cells.groupBy(part, "mask").agg(*[F.sum(c).cast("long").alias(c) for c in ("n", *losses)])
    by_part = summed.groupBy(part).agg(F.collect_list(F.struct("mask", "n", *losses)).alias("cells"))
    rows = by_part.withColumn("at", F.explode(F.array(*steps))).select(part, "cells", "at.*")
    fails, earlier = (lambda c: c["mask"].bitwiseAND(F.col("bit")) != 0), (lambda c: c["mask"].bitwiseAND(F.col("before")) != 0)

    def total(of, where) -> Column:
        return F.aggregate(F.filter("cells", where), F.lit(0).cast("long"), lambda acc, c: acc + of(c))

    count = lambda c: c["n"]
    removed = lambda c: fails(c) & ~earlier(c)
    orders = math.factorial(len(names))
    return rows.select(
        part, "filter_order", "step",
        total(count, lambda c: ~fails(c) & ~earlier(c)).alias("kept"), total(count, removed).alias("removed"),
        total(count, lambda c: fails(c) & earlier(c)).alias("redundant"), total(count, lambda c: c["mask"] == F.col("bit")).alias("unique_fails"),
        *[total(lambda c, x=x: c[x], removed).alias(f"{x}_lost") for x in losses],
        # Of all orders, a filter stands before the other failing ones of a document in one of as many as fail.
        total(lambda c: c["n"] * (F.lit(orders) / F.bit_count(c["mask"])).cast("long"), fails).alias("shapley"),
    )


def audit(df: DataFrame, labels: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """Interactions of the filters A to E among the documents of each `part`, named `part`.

    E fails a text that a row with a smaller key has too; rows with the same key do not fail
    each other, and a null key is greater than all others. A null part is
    the empty one, a null text the empty one. `labels` has key, quality and toxic; a label of
    1 in any row of a key counts, a missing or null one does not. Without documents
    there are no rows.
    """
    marked = labels.groupBy(labels[key].alias("_key")).agg(
        F.max(F.coalesce((labels["quality"] == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((labels["toxic"] == 1).cast("int"), F.lit(0))).alias("toxic"),
    )
    docs = df.select(df[key].alias("_key"), F.coalesce(df[part], F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce(df[text], F.lit("")), 256)).alias("print"), df[text].alias("body"))
    judged = measure(docs, "body", ["_key", "part", "print"]).select("_key", "part", "print", bits(failures()).alias("mask"))
    known = judged.join(marked, "_key", "left").select("_key", "part", "print", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    rows = materialize(known, "judged")
    kinds = ["part", "mask", "good", "toxic"]
    # The first rows of a text pass E, all others fail it: counted as what the total has besides.
    place = F.rank().over(Window.partitionBy("print").orderBy(F.asc_nulls_last("_key")))
    first = rows.withColumn("place", place).where("place = 1").groupBy(*kinds).agg(F.count("*").alias("n"))
    repeats = 1 << len(failures())
    later = rows.groupBy(*kinds).agg(F.count("*").alias("n")).withColumn("mask", F.col("mask") + repeats)
    less = first.withColumns({"n": -F.col("n"), "mask": F.col("mask") + repeats})
    cells = first.unionByName(later).unionByName(less).select("part", "mask", "n", *[(F.col(x) * F.col("n")).alias(x) for x in ("good", "toxic")])
    return every_order(cells, "part", [*failures(), "E"], ["good", "toxic"])
