"""Quality rules as a short-circuit cascade.

Every rule's cost (time per text) and selectivity (share of texts that it rejects)
are measured on a bounded sample; rules then run in order of rejections per cost,
each on the texts that all rules before it let through. The order decides
how long it takes, not what is kept.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.llm import batches, shingles

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Bound of the sample that costs and selectivities are measured on: texts, and characters in a text.
SAMPLE, LONGEST = 400, 20_000
WINDOW = 3
MIN_WORDS, REPEATED = 50, 50


def base_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    words, counts = shingles.hashed_words(texts)
    value, inside = shingles.runs(words, counts, WINDOW)
    owner = np.repeat(np.arange(len(texts)), inside)
    first = np.repeat(np.cumsum(counts) - counts, inside) + np.arange(len(value)) - np.repeat(np.cumsum(inside) - inside, inside)
    order = np.lexsort((value, owner))
    same = (value[order][1:] == value[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    again = np.zeros(len(value), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(len(words) + WINDOW, bool)
    for k in range(WINDOW):
        covered[first[again] + k] = True
    word_owner = np.repeat(np.arange(len(texts)), counts)
    characters = [len(t.decode("utf-8", "replace")) - (len(t) - len(t.translate(None, SPACE))) for t in texts]
    repeated_lines = []
    for t in texts:
        lines = [line for line in t.split(b"\n") if line and not line.isspace()]
        repeated_lines.append(len(lines) - len(set(lines)))
    return {
        "n_words": counts,
        "word_chars": np.array(characters, np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array(repeated_lines, np.int64),
        "n_repeat_words": np.bincount(word_owner, covered[: len(words)], len(texts)).astype(np.int64),
    }


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > REPEATED * counts["n_words"])


# Each rule tells which texts pass. All take the texts and their base counts.
Rule = Callable[[list[bytes], dict[str, np.ndarray]], np.ndarray]


def word_length(texts: list[bytes], counts: dict[str, np.ndarray]) -> np.ndarray:
    """The mean word has 2 to 15 characters."""
    mean = counts["word_chars"] / np.maximum(counts["n_words"], 1)
    return (mean >= 2) & (mean <= 15)


def few_symbols(texts: list[bytes], counts: dict[str, np.ndarray]) -> np.ndarray:
    """At most one symbol for four words."""
    return 4 * counts["n_symbols"] <= counts["n_words"]


def few_copied_lines(texts: list[bytes], counts: dict[str, np.ndarray]) -> np.ndarray:
    """At most half of the lines repeat an earlier one."""
    return np.array([2 * n <= t.count(b"\n") + 1 for t, n in zip(texts, counts["n_dup_lines"], strict=True)], bool)


LETTER_WORD = re.compile(r"[^\W\d_]\S*")


def mostly_letters(texts: list[bytes], counts: dict[str, np.ndarray]) -> np.ndarray:
    """At least 70 of 100 words have a letter."""
    found = [len(LETTER_WORD.findall(t.decode("utf-8", "replace"))) for t in texts]
    return 100 * np.array(found, np.int64) >= 70 * counts["n_words"]


def not_shouted(texts: list[bytes], counts: dict[str, np.ndarray]) -> np.ndarray:
    """At most 60 of 100 ASCII letters are capitals."""
    capitals = np.array([len(t) - len(t.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for t in texts], np.int64)
    small = np.array([len(t) - len(t.translate(None, b"abcdefghijklmnopqrstuvwxyz")) for t in texts], np.int64)
    return 100 * capitals <= 60 * (capitals + small)


BULLET = re.compile(rb"^[ \t]*(?:[-*]|\xe2\x80\xa2)", re.M)


def few_bullets(texts: list[bytes], counts: dict[str, np.ndarray]) -> np.ndarray:
    """At most 90 of 100 lines begin with a bullet."""
    return np.array([100 * len(BULLET.findall(t)) <= 90 * (t.count(b"\n") + 1) for t in texts], bool)


ELLIPSIS = re.compile(rb"(?:\.\.\.|\xe2\x80\xa6)[ \t]*$", re.M)


def few_ellipses(texts: list[bytes], counts: dict[str, np.ndarray]) -> np.ndarray:
    """At most 30 of 100 lines end in an ellipsis."""
    return np.array([100 * len(ELLIPSIS.findall(t)) <= 30 * (t.count(b"\n") + 1) for t in texts], bool)


RULES: dict[str, Rule] = {
    f.__name__: f for f in (word_length, few_symbols, few_copied_lines, mostly_letters, not_shouted, few_bullets, few_ellipses)
}


def measured(texts: list[bytes], rules: dict[str, Rule]) -> dict[str, tuple[float, float]]:
    """Seconds per text and share of rejected texts of each rule."""
    if not texts:
        return {name: (1.0, 0.0) for name in rules}
    counts, out = base_counts(texts), {}
    for name, rule in rules.items():
        start = time.perf_counter()
        passed = rule(texts, counts)
        out[name] = ((time.perf_counter() - start) / len(texts), 1 - float(passed.mean()))
    return out


def ordered(figures: dict[str, tuple[float, float]]) -> list[str]:
    """Rules by rejections per second, most first; ties by cost, then name."""
    return sorted(figures, key=lambda r: (-figures[r][1] / max(figures[r][0], 1e-12), figures[r][0], r))


def plan(df: DataFrame, key: str, text: str, rules: dict[str, Rule] = RULES) -> list[str]:
    """Order of the rules, from texts picked by a hash of their key."""
    rows = df.select(F.xxhash64(df[key]).alias("h"), df[text].alias("text")).where(F.length("text") <= LONGEST)
    total = df.count()
    share = min(1.0, 2 * SAMPLE / max(total, 1))
    picked = rows.where(F.pmod("h", F.lit(1_000_000)) < F.lit(max(1, int(1_000_000 * share)))).orderBy("h").limit(SAMPLE)
    return ordered(measured([(r["text"] or "").encode() for r in picked.select("text").collect()], rules))


def cascade(texts: list[bytes], counts: dict[str, np.ndarray], open_: np.ndarray, order: list[str], rules: dict[str, Rule]) -> list[str | None]:
    """First rule that rejects each open text, in `order`; each rule sees what is still open."""
    failed: list[str | None] = [None] * len(texts)
    left = np.flatnonzero(open_)
    for name in order:
        if not len(left):
            break
        passed = rules[name]([texts[i] for i in left], {k: v[left] for k, v in counts.items()})
        for i in left[~passed]:
            failed[i] = name
        left = left[passed]
    return failed


def judge(df: DataFrame, key: str, text: str, rules: dict[str, Rule] | None = None) -> DataFrame:
    """`key`, the base counts, base_failed, failed_rule and kept of every row.

    Null and empty texts have no words and fail the base. Texts that fail it are
    not shown to the rules. `failed_rule` is the first in the measured order.
    """
    rules = RULES if rules is None else rules
    order = plan(df, key, text, rules)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), *[T.StructField(n, T.LongType()) for n in names]])
    schema.add("base_failed", "boolean").add("failed_rule", "string").add("kept", "boolean")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.slices(rows, "text"):
            texts = batches.raw(batch, "text")
            counts = base_counts(texts)
            bad = base_failed(counts)
            failed = cascade(texts, counts, ~bad, order, rules)
            kept = ~bad & np.array([f is None for f in failed])
            columns = [batch.column("key"), *[pa.array(counts[n]) for n in names], pa.array(bad), pa.array(failed, pa.string()), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)
