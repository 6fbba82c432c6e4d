"""Fill-in-middle transformation by displacement scatter.

Line starts are the places where a text may be cut. For a whole batch, every part (prefix,
middle, suffix) moves by one distance; the distances, entered at part
starts as differences, are summed up to the output place of each byte, and one
scatter writes all outputs. To restore, the markers found in the outputs give
the source place of each byte in the same way, and one gather reads the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.llm import batches

SEED = 7
#: Shares in a hundred: texts that are transformed, and of these the ones with the suffix first.
RATE, SUFFIX_FIRST = 100, 50
#: Markers of prefix, suffix and middle; a text that holds one stays plain.
MARKERS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes of text in a step; each byte takes two 4-byte places besides.
STEP = 1_000_000


def drawn(key: Column, seed: int = SEED) -> Column:
    """Four unsigned 32-bit numbers from a hash of seed and key; a null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in a row, and where each text starts and the last one ends."""
    edges = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=edges[1:])
    return np.frombuffer(b"".join(texts), np.uint8), edges


def places(starts: np.ndarray, moves: np.ndarray, size: int) -> np.ndarray:
    """Where each of `size` bytes goes: parts begin at `starts`, ascending, and move by `moves`."""
    kind = np.int32 if size + np.abs(moves).max(initial=0) < 2**31 else np.int64
    steps = np.zeros(size + 1, kind)
    np.add.at(steps, starts, np.diff(moves, prepend=0).astype(kind))
    np.cumsum(steps, out=steps)
    steps += np.arange(size + 1, dtype=kind)
    return steps[:size]


def found(data: np.ndarray, edges: np.ndarray, marker: bytes) -> np.ndarray:
    """Places of a marker that lies within one text."""
    size = len(marker)
    if len(data) < size:
        return np.zeros(0, np.int64)
    hit = data[: len(data) - size + 1] == marker[0]
    for i in range(1, size):
        hit &= data[i : len(data) - size + 1 + i] == marker[i]
    at = np.flatnonzero(hit)
    return at[at + size <= edges[np.searchsorted(edges, at, side="right")]] if len(at) else at


def transform(texts: list[bytes], draws: np.ndarray, rate: int, suffix_first: int, markers: tuple[bytes, ...]) -> tuple:
    """(n, form, prefix chars, middle chars, outputs) of each text; form 0 is plain, 1 psm, 2 spm."""
    data, edges = joined(texts)
    starts, ends = edges[:-1], edges[1:]
    breaks = np.flatnonzero(data == 10)
    first = np.searchsorted(breaks, starts)
    whole = np.searchsorted(breaks, ends) - first
    closed = (ends > starts) & (data[np.maximum(ends - 1, 0)] == 10) if len(data) else np.zeros(len(starts), bool)
    n = whole + ((ends > starts) & ~closed)

    def cut(unit: np.ndarray) -> np.ndarray:
        after = breaks[np.minimum(first + unit - 1, len(breaks) - 1)] + 1 if len(breaks) else ends
        return np.where(unit == 0, starts, np.where(unit <= whole, after, ends))

    a, b = draws[:, 0] % (n + 1), draws[:, 1] % (n + 1)
    p, m = cut(np.minimum(a, b)), cut(np.maximum(a, b))
    held = np.zeros(len(starts), bool)
    for marker in markers:
        held[np.searchsorted(edges, found(data, edges, marker), side="right") - 1] = True
    plain = (starts == ends) | held | (draws[:, 2] % 100 >= rate)
    form = np.where(plain, 0, np.where(draws[:, 3] % 100 < suffix_first, 2, 1))
    sizes = [len(x) for x in markers]
    out_edges = np.zeros(len(starts) + 1, np.int64)
    np.cumsum((ends - starts) + np.where(plain, 0, sum(sizes)), out=out_edges[1:])
    at = out_edges[:-1]
    # Places of the markers by form, then how far prefix, middle and suffix move.
    prefix_mark = np.where(form == 2, at + sizes[1] + (ends - m), at)
    suffix_mark = np.where(form == 2, at, at + sizes[0] + (p - starts))
    middle_mark = at + sizes[0] + sizes[1] + (p - starts) + (ends - m)
    moves = np.stack([prefix_mark + sizes[0] - starts, middle_mark + sizes[2] - p, suffix_mark + sizes[1] - m], 1)
    moves = np.where(plain[:, None], (at - starts)[:, None], moves)
    out = np.empty(out_edges[-1], np.uint8)
    out[places(np.stack([starts, p, m], 1).ravel(), moves.ravel(), len(data))] = data
    for marker, mark in zip(markers, (prefix_mark, suffix_mark, middle_mark), strict=True):
        for i, byte in enumerate(marker):
            out[mark[~plain] + i] = byte
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    return n, form, points[p] - points[starts], points[m] - points[p], (out, out_edges)


def restored(outputs: list[bytes], form: np.ndarray, markers: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Texts, in a row with their edges, from outputs and forms alone."""
    data, edges = joined(outputs)
    at, ends = edges[:-1], edges[1:]
    changed = form > 0
    marks = []
    for marker in markers:
        mark = at.copy()
        spots = found(data, edges, marker)
        owner = np.searchsorted(edges, spots, side="right") - 1
        mark[owner[changed[owner]]] = spots[changed[owner]]
        marks.append(mark)
    sizes = [len(x) for x in markers]
    prefix, suffix, middle = (m + s for m, s in zip(marks, sizes, strict=True))
    n_prefix = np.where(form == 2, marks[2], marks[1]) - prefix
    n_suffix = np.where(form == 2, marks[0], marks[2]) - suffix
    text_edges = np.zeros(len(at) + 1, np.int64)
    np.cumsum((ends - at) - np.where(changed, sum(sizes), 0), out=text_edges[1:])
    starts, stops = text_edges[:-1], text_edges[1:]
    p, m = np.where(changed, starts + n_prefix, starts), np.where(changed, stops - n_suffix, starts)
    moves = np.stack([prefix - starts, middle - p, suffix - m], 1)
    moves = np.where(changed[:, None], moves, (at - starts)[:, None])
    return data[places(np.stack([starts, p, m], 1).ravel(), moves.ravel(), int(text_edges[-1]))], text_edges


def strings(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    flat = data.tobytes()
    return pa.array([flat[a:b].decode() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.string())


def fill_in_middle(
    df: DataFrame, key: str, text: str, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST,
    markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """`key, n, form, prefix_chars, middle_chars, output` of every row.

    `n` is the number of lines, `form` plain, psm (prefix, suffix, middle) or spm (suffix, prefix,
    middle). A null text counts as empty; empty texts and those that hold a marker
    stay plain, with null lengths. Cuts and form follow from seed and key alone, so equal rows
    have equal outputs; a null key draws as an empty one. Markers must begin and end
    with characters that occur nowhere else in them.
    """
    names = np.array([PLAIN, PSM, SPM], object)
    codes = tuple(m.encode() for m in markers)
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType())])
    schema.add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.slices(rows, "text", STEP):
            draws = batch.column("draws").flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            n, form, prefix, middle, output = transform(batches.raw(batch, "text"), draws, rate, suffix_first, codes)
            lengths = [pa.array(x, pa.int64(), mask=form == 0) for x in (prefix, middle)]
            columns = [batch.column("key"), pa.array(n, pa.int64()), pa.array(names[form], pa.string()), *lengths, strings(*output)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    asked = df.select(df[key].alias("key"), df[text].alias("text"), drawn(df[key], seed).alias("draws"))
    return asked.mapInArrow(run, schema).withColumnRenamed("key", key)


def restore(df: DataFrame, output: str, form: str, name: str = "restored", markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """`df` with the text in front of the transformation, read from output and form."""
    codes = tuple(m.encode() for m in markers)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.slices(rows, output, STEP):
            forms = np.array([{PSM: 1, SPM: 2}.get(f, 0) for f in batch.column(form).to_pylist()], np.int64)
            texts = strings(*restored(batches.raw(batch, output), forms, codes))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=schema.names)

    return df.mapInArrow(run, schema)
