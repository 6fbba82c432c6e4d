"""Words of texts as 64-bit numbers, and hashes of their runs, for whole batches."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

CACHED = 150_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of each word, computed once while the word is remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_seen = WordHashes()


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and the number of words of each text.

    Words are what stands between spaces and the control characters 9 to 13.
    """
    if len(_seen) > CACHED:
        _seen.clear()
    words = [t.split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter(map(_seen.__getitem__, chain.from_iterable(words)), np.uint64, int(counts.sum())), counts


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that scatters close ones."""
    x = x ^ (x >> np.uint64(31))
    x = x * MIX
    return x ^ (x >> np.uint64(29))


def runs(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a text, in order, and their number by text.

    A text of fewer words is one run of all of them; one without words has none.
    """
    ends = np.cumsum(counts)
    inside = np.maximum(counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), inside)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(inside) - inside, inside)
    first = (ends - counts)[owner] + at
    value = np.minimum(counts, size).astype(np.uint64)[owner]
    for k in range(size):
        here = first + k
        there = here < ends[owner]
        nxt = words[np.minimum(here, max(len(words) - 1, 0))] if len(words) else here.astype(np.uint64)
        value = np.where(there, mixed(value * np.uint64(3) + nxt), value)
    return value, inside


def distinct_runs(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The same, each different run of a text once, ascending within the text."""
    value, inside = runs(words, counts, size)
    owner = np.repeat(np.arange(len(counts)), inside)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=len(counts))
