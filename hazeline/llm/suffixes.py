"""Removal of long repeated byte strings with suffix arrays.

Every string of `LENGTH` bytes has an anchor: the smallest hash of its `GRAM`-byte
runs, the leftmost of equal ones. Equal strings have equal anchors at equal places, and
neighbouring strings mostly share theirs, so a text falls into runs of starts that
share an anchor, each with a window: the bytes that its strings cover.

1. Windows are grouped by (anchor, hash of the window). All strings of a window
   that occurs in two places are repeated.
2. Of anchors with several windows, one copy of each goes to the shard of the
   anchor. A shard sorts the suffixes of its windows by Larsson-Sadakane refinement,
   takes common prefixes in Kasai's order, and marks the starts whose string
   occurs again.
3. The windows of an anchor too large for one shard are dealt to several. Each
   gives the sorted hashes of its different strings, and strings of other shards
   are found in them by binary search.

So what is sorted is only what shares an anchor, and no shard grows with the
number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.llm import batches
from hazeline.llm.shingles import mixed
from hazeline.session import materialize

LENGTH, GRAM = 400, 64
#: Bytes of windows in a shard, on the average and, for one anchor, at most.
SHARD, SPLIT = 1_500_000, 1_000_000
NEVER = np.uint64(2**64 - 1)
TOP = np.uint64(0xFFFFFFFF00000000)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of every run of `GRAM` bytes, built from runs of half the size."""
    h = mixed(data.astype(np.uint64) + np.uint64(1))
    factor, n = 0xD6E8FEB86659FD93, 1
    while n < GRAM:
        h = h[:-n] * np.uint64(factor) + h[n:]
        factor, n = factor * factor % 2**64, 2 * n
    return mixed(h)


def anchor_runs(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last start of each run of starts that share an anchor."""
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(data)
    wide, n = length - GRAM + 1, len(h)
    # The upper half of the hash decides, then the position.
    x = np.full(n + (-n) % wide, NEVER)
    x[:n] = (h & TOP) | np.arange(n, dtype=np.uint64)
    x = x.reshape(-1, wide)
    ahead = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()[: n - wide + 1]
    behind = np.minimum.accumulate(x, 1).ravel()[wide - 1 : n]
    at = (np.minimum(ahead, behind) & ~TOP).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return h[at[first]], first, np.append(first[1:], len(at)) - 1


def sorted_suffixes(data: np.ndarray) -> np.ndarray:
    """Suffix array by Larsson-Sadakane refinement.

    `data` holds bytes plus 1, and 0 for the end of a window. Suffixes are sorted by seven places, then
    groups that are still alike are split by the rank of what follows, each time
    twice as far on.
    """
    n = len(data)
    padded = np.zeros(n + 7, np.int64)
    padded[:n] = data.astype(np.int64) + 1
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = key << 9 | padded[k : n + k]
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    # A group's rank is the place of its last member, so ranks of others never move.
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n) - 1
    rank[order] = np.repeat(ends, ends - starts + 1)
    open_ = np.flatnonzero(np.repeat(ends > starts, ends - starts + 1))
    h = 7
    while len(open_):
        at = order[open_]
        group, follow = rank[at], rank[np.minimum(at + h, n)]
        by = np.argsort(group * (n + 1) + follow + 1)
        at, group, follow = at[by], group[by], follow[by]
        order[open_] = at
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(at)))
        rank[at] = np.repeat(open_[starts + sizes - 1], sizes)
        open_ = open_[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)].copy().view("<u8").ravel()


def repeated_starts(windows: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every start of every window, in order: whether its string occurs at another
    start, and the first start with the same string in sorted order."""
    sizes = np.array([len(w) for w in windows], np.int64)
    data = np.frombuffer(b"\0".join(windows) + b"\0", np.uint8)
    first = np.cumsum(sizes + 1) - sizes - 1
    ends = np.repeat(first + sizes, sizes + 1)
    coded = data.astype(np.uint16) + np.uint16(1)
    coded[first + sizes] = 0
    order = sorted_suffixes(coded)
    place = np.empty(len(data), np.int64)
    place[order] = np.arange(len(data))
    before = np.full(len(data), -1, np.int64)
    before[order[1:]] = order[:-1]
    starts = sizes - length + 1
    long_word = words_at(data)
    alike = np.zeros(len(data), bool)
    # Kasai: the next start shares with its predecessor at least what this one does, less one.
    lanes = np.argsort(-starts, kind="stable")
    common = np.zeros(len(windows), np.int64)
    for step in range(int(starts.max(initial=0))):
        lanes = lanes[: np.searchsorted(-starts[lanes], -step)]
        here = first[lanes] + step
        other = before[here]
        shared = np.maximum(common[lanes] - 1, 0)
        limit = np.where(other >= 0, np.minimum(length, ends[here] - here), 0)
        limit = np.minimum(limit, np.where(other >= 0, ends[other] - other, 0))
        shared = np.minimum(shared, limit)
        going = np.flatnonzero(shared < limit)
        while len(going):
            x, y = long_word[here[going] + shared[going]], long_word[other[going] + shared[going]]
            diff = x ^ y
            same = np.where(diff == 0, 8, np.bitwise_count((diff & (~diff + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8)
            shared[going] += same
            going = going[(same == 8) & (shared[going] < limit[going])]
        shared = np.minimum(shared, limit)
        common[lanes] = shared
        alike[here] = shared >= length
    own = np.repeat(first, np.maximum(starts, 0)) + np.arange(int(np.maximum(starts, 0).sum())) - np.repeat(np.cumsum(np.maximum(starts, 0)) - np.maximum(starts, 0), np.maximum(starts, 0))
    # A string's group in sorted order begins where it no longer equals what stands before it.
    in_order = alike[order]
    head = np.maximum.accumulate(np.where(in_order, -1, np.arange(len(order))))
    group = head[place[own]]
    again = alike[own].copy()
    follows = np.append(in_order[1:], False)
    again |= follows[place[own]]
    return again, group


def spans(flags: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last place of each run of set flags; rows have `sizes` places each."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flags)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    edge = np.ones(len(flags) + 1, bool)
    if len(flags):
        edge[1:-1] = (flags[1:] != flags[:-1]) | (row[1:] != row[:-1])
    bounds = np.flatnonzero(edge)
    a, b = bounds[:-1], bounds[1:] - 1
    use = flags[a] if len(flags) else np.zeros(0, bool)
    a, b = a[use], b[use]
    return row[a], place[a], place[b]


def anchors(df: DataFrame, text: str, length: int) -> DataFrame:
    """`t, n, fp, wh, p, q`: digest and size of the text, anchor, hash of the window, first and last start."""
    schema = "t binary, n long, fp long, wh long, p long, q long"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.slices(rows, "text"):
            columns: list[list] = [[], [], [], [], [], []]
            for t, data in zip(batch.column("t").to_pylist(), batches.raw(batch, "text"), strict=True):
                fp, p, q = anchor_runs(np.frombuffer(data, np.uint8), length)
                hashes = [xxhash.xxh3_64_intdigest(data[a : b + length]) for a, b in zip(p.tolist(), q.tolist(), strict=True)]
                columns[0] += [t] * len(p)
                columns[1].append(np.full(len(p), len(data)))
                columns[2].append(fp.view(np.int64))
                columns[3].append(np.array(hashes, np.uint64).view(np.int64))
                columns[4].append(p)
                columns[5].append(q)
            arrays = [pa.array(columns[0], pa.binary()), *[pa.array(np.concatenate(c).astype(np.int64)) for c in columns[1:]]]
            yield pa.RecordBatch.from_arrays(arrays, names=["t", "n", "fp", "wh", "p", "q"])

    return df.select("t", text).withColumnRenamed(text, "text").mapInArrow(run, schema)


def cut_windows(wanted: DataFrame, length: int) -> DataFrame:
    """`fp, wh, window` for rows of text and the (fp, wh, p, q) wanted from it."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.slices(rows, "text", batches.CHUNK_BYTES // 2):
            out: tuple[list, list, list] = ([], [], [])
            for data, cuts in zip(batches.raw(batch, "text"), batch.column("cuts").to_pylist(), strict=True):
                for c in cuts:
                    out[0].append(c["fp"])
                    out[1].append(c["wh"])
                    out[2].append(data[c["p"] : c["q"] + length])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["fp", "wh", "window"])

    return wanted.select("text", "cuts").mapInArrow(run, "fp long, wh long, window binary")


SPAN_COLUMNS = ["fp", "wh", "a", "b", "slice", "strings", "places", "open"]
SLICES = 64


def shard_spans(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Runs of repeated starts (fp, wh, a, b) in a shard; in a split one also its
    different strings, as sorted slices of their hashes with (wh, a) of each and whether it is
    still unrepeated here."""
    pdf = pdf.sort_values(["fp", "wh"], kind="stable").drop_duplicates(["fp", "wh"])
    windows = pdf["window"].tolist()
    again, group = repeated_starts(windows, length)
    sizes = np.array([len(w) - length + 1 for w in windows])
    row, a, b = spans(again, sizes)
    fp, wh = pdf["fp"].to_numpy(), pdf["wh"].to_numpy()
    out = [(f, w, x, y, -1, None, None, None) for f, w, x, y in zip(fp[row], wh[row], a, b, strict=True)]
    if pdf["split"].iloc[0]:
        owner = np.repeat(np.arange(len(windows)), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        once = np.unique(group, return_index=True)[1]
        hashes = np.array([xxhash.xxh3_64_intdigest(windows[owner[i]][place[i] : place[i] + length]) for i in once], np.uint64)
        order = np.argsort(hashes)
        once, hashes = once[order], hashes[order]
        cuts = np.searchsorted(hashes, np.arange(1, SLICES, dtype=np.uint64) * np.uint64(2**64 // SLICES))
        places = np.stack([wh[owner[once]], place[once]], 1)
        for n, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(once)], strict=True)):
            if i < j:
                out.append((fp[0], 0, 0, 0, n, hashes[i:j].tobytes(), places[i:j].tobytes(), (~again[once[i:j]]).tobytes()))
    return pd.DataFrame(out, columns=SPAN_COLUMNS)


def merged_strings(pdf: pd.DataFrame) -> pd.DataFrame:
    """Starts of strings that other shards hold too, by binary search in their sorted hashes."""
    lists = [np.frombuffer(x, np.uint64) for x in pdf["strings"]]
    out = []
    for n, (own, places, open_) in enumerate(zip(lists, pdf["places"], pdf["open"], strict=True)):
        found = np.zeros(len(own), bool)
        for m, other in enumerate(lists):
            if m != n:
                found |= other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own
        found &= np.frombuffer(open_, bool)
        out += [(pdf["fp"].iloc[0], w, a, a) for w, a in np.frombuffer(places, np.int64).reshape(-1, 2)[found]]
    return pd.DataFrame(out, columns=["fp", "wh", "a", "b"])


def repeated(df: DataFrame, length: int, shard: int, split: int) -> DataFrame:
    """`t, a, b`: runs of starts, by text digest, whose strings occur elsewhere too. `df` has t and text."""
    found = materialize(anchors(df, "text", length), "anchors")
    place = F.struct("t", "p")
    # Copies of a text have the same places, so copies alone never count as two.
    windows = found.groupBy("fp", "wh").agg(
        F.min(F.struct("t", "p", "q")).alias("one"), (F.min(place) != F.max(place)).alias("many"), F.max(F.col("q") - F.col("p") + length).alias("size")
    )
    windows = materialize(windows, "windows")
    per_anchor = windows.groupBy("fp").agg(F.count("*").alias("kinds"), F.sum("size").alias("bytes")).where("kinds > 1")
    mixed_ = materialize(windows.join(per_anchor, "fp").select("fp", "wh", "one", "many", "bytes"), "mixed")
    # Whole windows that repeat.
    whole = found.join(windows.where("many").select("fp", "wh"), ["fp", "wh"], "left_semi").select("t", F.col("p").alias("a"), F.col("q").alias("b"))
    cuts = mixed_.select(F.col("one.t").alias("t"), F.struct("fp", "wh", "one.p", "one.q").alias("cut"))
    cuts = cuts.groupBy("t").agg(F.collect_list("cut").alias("cuts"))
    cut = cut_windows(df.join(cuts, "t"), length).dropDuplicates(["fp", "wh"])
    total = mixed_.agg(F.sum(F.col("one.q") - F.col("one.p") + length)).first()[0] or 0
    salts = F.ceil(F.col("bytes") / split).cast("long")
    sizes = mixed_.select("fp", "wh", "bytes")
    dealt = cut.join(sizes, ["fp", "wh"]).withColumns({
        "split": salts > 1,
        "shard": F.when(salts > 1, F.col("fp")).otherwise(F.pmod(F.xxhash64("fp"), F.lit(1 + total // shard))),
        "salt": F.when(salts > 1, F.pmod(F.xxhash64("wh"), salts)).otherwise(F.lit(0)),
    })
    schema = "fp long, wh long, a long, b long, slice long, strings binary, places binary, open binary"
    parts = dealt.groupBy("split", "shard", "salt").applyInPandas(lambda pdf: shard_spans(pdf, length), schema)
    parts = materialize(parts, "shards")
    merged = parts.where("slice >= 0").groupBy("fp", "slice").applyInPandas(merged_strings, "fp long, wh long, a long, b long")
    starts = parts.where("slice < 0").select("fp", "wh", "a", "b").unionByName(merged)
    # Every text that has the window has its repeated starts.
    single = starts.join(windows.where("not many").select("fp", "wh"), ["fp", "wh"], "left_semi")
    partial = found.join(single, ["fp", "wh"]).select("t", (F.col("p") + F.col("a")).alias("a"), (F.col("p") + F.col("b")).alias("b"))
    return whole.unionByName(partial).distinct()


def remove_repeats(df: DataFrame, key: str, text: str, length: int = LENGTH, shard: int = SHARD, split: int = SPLIT) -> DataFrame:
    """`key, n_bytes, n_removed, n_spans, kept` of every row; `kept` holds the remaining bytes.

    A byte goes if a string of `length` bytes that covers it starts at any other
    place too, in the same text or another. Strings are those of the input and lie
    within one text. Null text is empty. Rows count one by one, also those with equal
    keys: a repeated row repeats its text.
    """
    rows = df.select(df[key].alias("key"), F.coalesce(df[text], F.lit("")).alias("text")).withColumn("t", F.unhex(F.md5("text")))
    copies = rows.groupBy("t").agg(F.count("*").alias("copies"), F.first(F.octet_length("text")).alias("n"))
    copies = materialize(copies, "copies")
    strings = repeated(rows.select("t", "text").where(F.octet_length("text") >= length), length, shard, split)
    whole = copies.where((F.col("copies") > 1) & (F.col("n") >= length)).select("t", F.lit(0).cast("long").alias("a"), (F.col("n") - length).cast("long").alias("b"))
    gone = strings.unionByName(whole).groupBy("t").agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.BinaryType())])

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.slices(batches_, "text"):
            out: tuple[list, list, list, list] = ([], [], [], [])
            for data, cuts in zip(batches.raw(batch, "text"), batch.column("gone").to_pylist(), strict=True):
                removed, n_spans, at, left = 0, 0, 0, []
                for a, b in sorted((c["a"], c["b"] + length) for c in cuts or ()):
                    if b <= at:
                        continue
                    if a > at or not n_spans:
                        left.append(data[at:a])
                        n_spans += 1
                    removed += b - max(a, at)
                    at = b
                left.append(data[at:])
                for column, value in zip(out, (len(data), removed, n_spans, b"".join(left)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("key"), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.binary())], names=schema.names)

    return rows.join(gone, "t", "left").select("key", "text", "gone").mapInArrow(run, schema).withColumnRenamed("key", key)
