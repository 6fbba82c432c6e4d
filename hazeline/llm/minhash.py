"""Near-duplicate documents by min-max hashing.

A document is its set of word shingles. Each permutation gives two values of the
signature, the smallest and the largest hash, so half as many hashes are
evaluated. Bands of four values make documents candidates: a pair of similarity 0.8
shares none of 32 bands once in twenty million, one of 0.85 once in 18 billion.
Candidates are confirmed on their full sets.

Documents with equal sets are one entry from the start. In a bucket the
entry that shares most buckets is compared with all others; then the
components so far are labelled, and only buckets that still hold several go on. There,
entries are dealt to blocks of bounded size and every pair of blocks is one task's
work: all pairs of different components are compared and links alone come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.llm import batches, shingles
from hazeline.llm.components import components
from hazeline.llm.lines import small_side
from hazeline.session import materialize

WORDS = 3
PERCENT = 85
PERMUTATIONS = 64
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Shingles in a block of a bucket; 8 bytes each.
BLOCK = 500_000


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_259)
    return rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


def signatures(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Smallest and largest hash of each set under each permutation; sets must not be empty."""
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), 2 * PERMUTATIONS), np.uint64)
    for i, (a, b) in enumerate(zip(*permutations(PERMUTATIONS), strict=True)):
        hashed = values * a
        hashed += b
        out[:, 2 * i] = np.minimum.reduceat(hashed, starts)
        out[:, 2 * i + 1] = np.maximum.reduceat(hashed, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, its number included."""
    keys = np.zeros((len(signature), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(signature), band, np.uint64)
        for r in range(ROWS):
            key = shingles.mixed(key * np.uint64(3) + signature[:, band * ROWS + r])
        keys[:, band] = key
    return keys


def sets_of(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    words, counts = shingles.hashed_words([t.lower() for t in batches.raw(batch, "text")])
    return shingles.distinct_runs(words, counts, size)


def sketches(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """`key, n, p, q, bands`: set size, a 128-bit print of the set, and its band keys."""
    schema = T.StructType([T.StructField("key", df.schema[key].dataType)])
    for name in ("n", "p", "q"):
        schema.add(name, "long")
    schema.add("bands", T.ArrayType(T.LongType()))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.slices(rows, "text"):
            values, counts = sets_of(batch, size)
            full = counts > 0
            p, q, bands = (np.zeros(s, np.uint64) for s in (len(counts), len(counts), (len(counts), BANDS)))
            if full.any():
                starts = (np.cumsum(counts) - counts)[full]
                p[full], q[full] = np.add.reduceat(shingles.mixed(values), starts), np.bitwise_xor.reduceat(shingles.mixed(values + np.uint64(7)), starts)
                bands[full] = band_keys(signatures(values, counts[full]))
            flat = pa.array(bands.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat)
            columns = [batch.column("key"), pa.array(counts), pa.array(p.view(np.int64)), pa.array(q.view(np.int64)), lists]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, schema)


def full_sets(df: DataFrame, size: int) -> DataFrame:
    """`id, n, values` for rows of `id, text`: the whole set as ascending 64-bit numbers."""
    schema = T.StructType([T.StructField("id", df.schema["id"].dataType), T.StructField("n", T.LongType()), T.StructField("values", T.BinaryType())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.slices(rows, "text"):
            values, counts = sets_of(batch, size)
            ends = np.cumsum(counts)
            data = [values[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts), pa.array(data, pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)


def enough(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | bool:
    return 100 * common >= percent * (a + b - common)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough."""
    sizes = sets.select("id", "n")
    near = pairs.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(
        sizes.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b"
    ).where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    left = near.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("values").alias("va")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("values").alias("vb")), "b")
    schema = pairs.select("a", "b").schema

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.slices(rows, "va"):
            good = []
            for va, vb in zip(batch.column("va").to_pylist(), batch.column("vb").to_pylist(), strict=True):
                x, y = np.frombuffer(va, np.uint64), np.frombuffer(vb, np.uint64)
                at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                good.append(bool(enough(int((y[at] == x).sum()), len(x), len(y), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "va", "vb").mapInArrow(run, schema)


def crossing_links(rows: pa.Table, percent: int) -> pa.Table:
    """Links between different components among the rows of a pair of blocks.

    Rows hold id, component, side (1, 2, or 3 for a block with itself), band keys and
    values. A pair is compared in the first band that its two entries share, and no
    more once their components have been joined here.
    """
    rows = rows.sort_by("id").combine_chunks()
    column = {name: rows.column(name).combine_chunks() for name in ("id", "component", "side", "bands", "values")}
    sets = [np.frombuffer(v, np.uint64) for v in column["values"].to_pylist()]
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    bands = column["bands"].flatten().to_numpy().reshape(len(sets), -1)
    here = rows.column("band")[0].as_py()
    group = column["component"].dictionary_encode().indices.to_numpy()
    group, side, places = group.copy(), column["side"].to_numpy(), np.arange(len(sets))
    order = mark = None
    out = []
    for x in range(len(sets)):
        other = np.flatnonzero((group != group[x]) & (places > x) & ((side != side[x]) | (side == 3)))
        other = other[100 * np.minimum(sizes[other], sizes[x]) >= percent * np.maximum(sizes[other], sizes[x])]
        other = other[(bands[other, :here] != bands[x, :here]).all(1)]
        if not len(other):
            continue
        if order is None:
            order = np.unique(np.concatenate(sets), return_inverse=True)[1]
            mark = np.zeros(len(order) + 1, bool)
        mine = order[starts[x] : starts[x] + sizes[x]]
        mark[mine] = True
        if 4 * len(other) < len(sets):
            common = np.array([np.count_nonzero(mark[order[starts[y] : starts[y] + sizes[y]]]) for y in other])
        else:
            common = np.add.reduceat(mark[order].astype(np.int64), starts)[other]
        mark[mine] = False
        for y in other[enough(common, sizes[other], sizes[x], percent)].tolist():
            if group[x] != group[y]:
                out.append((x, y))
                group[group == group[y]] = group[x]
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pa.table({"a": column["id"].take(pa.array(pairs[:, 0])), "b": column["id"].take(pa.array(pairs[:, 1]))})


def cross_links(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """`crossing_links` of a pandas frame."""
    return crossing_links(pa.Table.from_pandas(pdf, preserve_index=False), percent).to_pandas()


def undecided(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `shared`, with `component`, in buckets that may hold a link the first round has not found.

    A bucket of two entries is its hub and the one compared with it, so nothing in it is left to compare.
    """
    named = shared.where("size > 2").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return named.join(mixed.select("bucket"), "bucket", "left_semi")


def links(df: DataFrame, entries: DataFrame, size: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) that connect all similar entries.

    `df` has id and text, `entries` id, n and bands, one row per different set.
    """
    every = entries.where("n > 0").select("id", "n", F.posexplode("bands").alias("band", "bucket"))
    many = every.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("total")).where("size > 1")
    shared = materialize(every.join(many, "bucket"), "buckets")
    weighed = shared.join(shared.groupBy("id").agg(F.sum("size").alias("w")), "id")
    hubs = weighed.groupBy("bucket").agg(F.max(F.struct("w", F.col("id")))["id"].alias("hub"))
    star = shared.join(hubs, "bucket").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    pairs = star.distinct()
    # Few documents share a bucket as a rule; the texts of the others are not shuffled.
    needed = materialize(shared.select("id").distinct(), "needed")
    found = df.join(small_side(needed, needed.count()), "id", "left_semi")
    sets = materialize(full_sets(found.dropDuplicates(["id"]), size), "sets")
    first = materialize(confirm(pairs, sets, percent), "star_links")
    labels = components(first, "a", "b").withColumnRenamed("node", "id")
    rows = undecided(shared, labels).withColumn("blocks", F.ceil(F.col("total") / BLOCK).cast("int"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = rows.withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "id", "band", "bucket", "component", F.least("mine", "theirs").alias("i"), F.greatest("mine", "theirs").alias("j"),
        F.when(F.col("mine") == F.col("theirs"), 3).when(F.col("mine") < F.col("theirs"), 1).otherwise(2).alias("side"),
    )
    # A block with itself and a pair of blocks are different groups, so sides never mix.
    full = dealt.join(sets.select("id", "values"), "id").join(entries.select("id", "bands"), "id")
    schema = first.schema
    crossing = full.groupBy("bucket", "i", "j").applyInArrow(lambda rows: crossing_links(rows, percent), schema)
    return first.unionByName(crossing.distinct())


def near_duplicates(df: DataFrame, key: str, text: str, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """`key, n_shingles, component_id, kept` of every row.

    Words are cut at spaces and the control characters 9 to 13 and A-Z count as a-z.
    A text of fewer words than a shingle is one shingle; a null text, or one
    without words, has none and is linked to nothing. A component is named by its
    smallest key, whose row is kept; rows with equal keys are kept alike. A null
    key forms the component null.
    """
    sketch = materialize(sketches(df, key, text, size), "sketches")
    same = sketch.where("n > 0 and key is not null").groupBy("n", "p", "q").agg(F.min("key").alias("id"), F.first("bands").alias("bands"))
    entries = materialize(same, "entries")
    source = df.select(df[key].alias("id"), df[text].alias("text"))
    named = components(links(source, entries, size, percent), "a", "b").withColumnRenamed("node", "id")
    labelled = entries.select("n", "p", "q", "id").join(named, "id", "left").select("n", "p", "q", F.coalesce("component", "id").alias("component"))
    out = sketch.select("key", "n", "p", "q").join(labelled, ["n", "p", "q"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "key")).otherwise(F.col("key"))
    return out.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("key")).alias("kept")
    )
