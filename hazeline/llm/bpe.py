"""Byte-level BPE by contiguous rank arrays, and its inverse.

A short word is one row of two arrays: its parts, and the merge rank of each
part with the next. Each step scans a row for the minimum, merges there, deletes
the boundary by moving the rest of the row up, and refreshes the two ranks beside
it. All words of one byte length form a block, so a step serves all of them.
Words of more than `SHORT` bytes keep their boundaries in a linked list and take
the minimum from a heap, which gives the same merges in n log n.

Vocabularies are read from the path given; nothing is trained or copied here.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hazeline.llm import batches

#: Fixed value: the split of the vocabulary's pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = 48
CACHED = 500_000
NONE = np.int32(2**31 - 1)


def byte_symbols() -> dict[int, str]:
    """The printable symbol of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        symbols = byte_symbols()
        self.byte_id = np.array([vocab[symbols[b]] for b in range(256)], np.int32)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = left << 20 | right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.pairs = {int(k): int(r) for k, r in zip(self.keys, self.ranks, strict=True)}
        first = np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256)
        self.byte_rank = self.rank(*first).reshape(256, 256)
        back = {s: b for b, s in symbols.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.piece = [b""] * size
        for symbol, i in vocab.items():
            if symbol not in self.special:
                self.piece[i] = bytes(back[c] for c in symbol)
        for content, i in self.special.items():
            self.piece[i] = content.encode()
        self.split_words = regex.compile(PATTERN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, bytes | None] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of neighbouring parts; NONE where they do not merge or one is missing (-1)."""
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def block(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each row of `words`, all of one byte length."""
        n, length = words.shape
        parts = np.full((n, length + 2), -1, np.int32)
        parts[:, :length] = self.byte_id[words]
        ranks = np.full((n, length + 1), NONE, np.int32)
        if length > 1:
            ranks[:, : length - 1] = self.byte_rank[words[:, :-1], words[:, 1:]]
        out, count = np.full((n, length), -1, np.int32), np.full(n, length)
        rows, columns, gone = np.arange(n), np.arange(length + 1), np.zeros(n, np.int64)
        while rows.size:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                out[rows[done]] = parts[done, :length]
                count[rows[done]] = length - gone[done]
                rows, parts, ranks, at, best, gone = (x[~done] for x in (rows, parts, ranks, at, best, gone))
                if not rows.size:
                    break
            i, moved = np.arange(len(rows)), columns + (columns > at[:, None])
            parts[:, :-1] = np.take_along_axis(parts, moved, 1)
            ranks[:, :-1] = np.take_along_axis(ranks, moved[:, :-1], 1)
            parts[i, at] = new = self.merged[best]
            ranks[i, at] = self.rank(new, parts[i, at + 1])
            before = np.maximum(at - 1, 0)
            ranks[i, before] = np.where(at > 0, self.rank(parts[i, before], new), ranks[i, before])
            gone += 1
        return out, count

    def long_word(self, word: bytes) -> list[int]:
        parts = [int(self.byte_id[b]) for b in word]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.pairs.get(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = int(self.merged[rank]), -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.pairs.get(parts[x] << 20 | parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word as little-endian 32-bit numbers."""
        data = [w.encode() for w in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        order = np.argsort(sizes, kind="stable")
        names = list(map(words.__getitem__, order.tolist()))
        data = list(map(data.__getitem__, order.tolist()))
        sizes, found = sizes[order], []
        for length in np.unique(sizes[sizes <= SHORT]).tolist():
            a, b = np.searchsorted(sizes, [length, length + 1])
            ids, count = self.block(np.frombuffer(b"".join(data[a:b]), np.uint8).reshape(-1, length))
            flat = ids[np.arange(length) < count[:, None]].astype("<u4").tobytes()
            ends = (4 * np.cumsum(count)).tolist()
            found += [flat[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        found += [np.array(self.long_word(b), "<u4").tobytes() for b in data[len(found):]]
        return dict(zip(names, found, strict=True))

    def pretokens(self, piece: str) -> list[str] | None:
        """Words of a space and `piece`; None if white space at its ends could join a longer run."""
        if piece.isalpha():
            return [" " + piece]
        if piece[:-1].isalpha() and piece[-1] in ".,;:!?":
            return [" " + piece[:-1], piece[-1]]
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        return self.split_words.findall(" " + piece)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers.

        Between two non-space characters a single space starts a new word
        whatever stands around it, so texts are cut there and each distinct
        cutting is encoded once. Texts with other runs of white space, or with
        special tokens, are split as a whole.
        """
        cuts = [t.split(" ") for t in texts]
        if len(self.cache) > CACHED:
            self.cache.clear()
        fresh = {c: self.pretokens(c) for c in set(chain.from_iterable(cuts)).difference(self.cache)}
        heads = [self.split_words.findall(cut[0]) for cut in cuts]
        need = set(chain.from_iterable(w for w in fresh.values() if w))
        ids = self.words(list(need.union(chain.from_iterable(heads))))
        get = ids.__getitem__
        self.cache.update({c: None if w is None else get(w[0]) if len(w) == 1 else b"".join(map(get, w)) for c, w in fresh.items()})
        cached, out, whole = self.cache.__getitem__, [], {}
        marks = list(self.special)
        for i, (t, cut, head) in enumerate(zip(texts, cuts, heads, strict=True)):
            odd = not cut[0] or cut[0][-1].isspace() or any(m in t for m in marks)
            try:
                out.append(b"" if odd else b"".join(map(get, head)) + b"".join(map(cached, cut[1:])))
            except TypeError:  # a piece with white space at an end
                odd = True
                out.append(b"")
            if odd and t:
                parts = self.split_special.split(t) if marks else [t]
                whole[i] = [p if p in self.special else self.split_words.findall(p) for p in parts if p]
        ids = self.words(list(set(chain.from_iterable(w for parts in whole.values() for w in parts if isinstance(w, list)))))
        ids.update({s: np.array([i], "<u4").tobytes() for s, i in self.special.items()})
        for i, parts in whole.items():
            out[i] = b"".join(ids[w] for p in parts for w in ([p] if isinstance(p, str) else p))
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of `ids`, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.piece.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec per worker and vocabulary."""
    return Codec(path)


def encode(df: DataFrame, key: str, text: str, vocabulary: str, decoded: bool = False) -> DataFrame:
    """`key`, `ids` and, if asked for, `decoded`: the text that the ids give back.

    One row per input row. Null or empty text has no ids. Other columns are
    left out, so their names cannot clash.
    """
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if decoded:
        schema.add("decoded", "string")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches.slices(rows, "text"):
            found = c.encode(batches.texts(batch, "text"))
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
            flat = np.frombuffer(b"".join(found), "<u4").astype(np.int32)
            columns = [batch.column("key"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            if decoded:
                columns.append(pa.array([c.decode(flat[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    out = df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("key", key)


def decode(df: DataFrame, key: str, ids: str, vocabulary: str) -> DataFrame:
    """`key` and `decoded` for a column of id arrays; null ids give null."""
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("decoded", T.StringType())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in rows:
            found = [None if x is None else c.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.string())], names=schema.names)

    return df.select(df[key].alias("key"), df[ids].alias("ids")).mapInArrow(run, schema).withColumnRenamed("key", key)
