"""Language of words and texts by a linear-chain conditional random field.

Words carry hashed features: the word itself (lexicon), its first and last one to
three letters (affixes), and its two- and three-letter runs. Transitions between
the languages of neighbouring words are learned too, from sequences that switch
between texts of different languages. Forward-backward gives each word a
probability for each language; the text takes the language with the largest sum.

A word of more than `LETTERS` letters, such as a run of a script without spaces, is
cut into pieces of so many characters, and each takes a place of its own in the chain.

Texts of more than `BLOCK` words are cut into blocks. The product of the step matrices
of a block carries probabilities across it, so all blocks of a batch advance together
and one very long text takes no more steps than many short ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.llm import batches
from hazeline.llm.shingles import MIX, mixed

UNKNOWN = "und"
#: Bound of the sample that the model is fitted on: texts of each language, and characters in a text.
SAMPLE, LONGEST = 300, 20_000
FEATURES = 1 << 17
SEQUENCES, LENGTH, ROUNDS = 3_000, 48, 40
BLOCK, LETTERS = 512, 64
CACHED = 100_000
#: Bytes of text that are labelled at a time; a word of them takes some 200 bytes meanwhile.
LABELLED = 1_000_000


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray


#: Hash seeds of the kinds of features: the word, its first and last letters, and its runs of two and of three.
WORD, PREFIX, SUFFIX, TWO, THREE = (np.uint64(n << 60) for n in range(1, 6))


def letters_of(word: str) -> str:
    w = word.lower()
    return w if w.isalpha() else "".join(filter(str.isalpha, w))


def numbered(seed: np.uint64, *codes: np.ndarray) -> np.ndarray:
    """Feature numbers of runs of up to three letters, given the code of each letter, 0 for none."""
    key = np.full(len(codes[0]), seed)
    for place, code in enumerate(codes):
        key |= code << np.uint64(20 * place)
    return 1 + (mixed(mixed(key)) % np.uint64(FEATURES - 1)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words in a row, and how many each word has.

    All words share feature 0. One without letters has no other.
    """
    letters = list(map(letters_of, words))
    size = np.fromiter(map(len, letters), np.int64, len(letters))
    count = np.where(size > 0, 9 + 2 * size, 1)
    out = np.zeros(int(count.sum()), np.int64)
    some = np.flatnonzero(size)
    if not len(some):
        return out, count
    n, base = size[some], (np.cumsum(count) - count)[some] + 1
    # Every word between two edges; the codes of letters have 20 bits, and those beyond the planes in use none at all.
    code = np.frombuffer("".join(f"<{letters[i]}>" for i in some.tolist()).encode("utf-32-le"), np.uint32).astype(np.uint64) & np.uint64(0xFFFFF)
    first = np.cumsum(n + 2) - n - 1
    last, none = first + n - 1, np.uint64(0)
    factor = np.cumprod(np.full(int(n.max()) + 2, MIX))
    owner = np.repeat(np.arange(len(n)), n + 2)
    place = np.arange(len(code)) - (first - 1)[owner]
    whole = np.add.reduceat(code * factor[place], first - 1)
    out[base] = 1 + (mixed(whole ^ WORD) % np.uint64(FEATURES - 1)).astype(np.int64)
    heads = [np.where(n > k, code[np.minimum(first + k, last)], none) for k in range(3)]
    tails = [np.where(n > k, code[np.maximum(last - k, first)], none) for k in range(3)]
    for k in range(3):
        out[base + 1 + k], out[base + 4 + k] = numbered(PREFIX, *heads[: k + 1]), numbered(SUFFIX, *tails[: k + 1])
    for length, seed, at in ((2, TWO, base + 7), (3, THREE, base + 8 + n)):
        begin = np.flatnonzero(place <= (n + 2 - length)[owner])
        out[at[owner[begin]] + place[begin]] = numbered(seed, *(code[begin + k] for k in range(length)))
    return out, count


def words_of(text: str) -> list[str]:
    """The words between spaces; those of more than `LETTERS` letters in pieces."""
    found = text.split()
    if max(map(len, found), default=0) <= LETTERS:
        return found
    return [p for w in found for p in ([w[i : i + LETTERS] for i in range(0, len(w), LETTERS)] if sum(map(str.isalpha, w)) > LETTERS else [w])]


def has_letter(word: str) -> bool:
    return any(map(str.isalpha, word))


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning."""
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def sample(df: DataFrame, key: str, text: str, lang: str) -> list[tuple[str, str]]:
    """At most `SAMPLE` (lang, text) of each language, picked by a hash of the key."""
    rows = df.select(df[key].alias("k"), df[lang].alias("lang"), df[text].alias("text"))
    rows = rows.where(F.coalesce(~held_out(F.col("k")), F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(F.length("text").between(1, LONGEST)).withColumn("h", F.pmod(F.xxhash64("k"), F.lit(1_000_000)))
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return []
    # Twice as many by a threshold, so that only few texts are sorted.
    limit = F.lit(None).cast("long")
    for r in counts:
        limit = F.when(F.col("lang") == r["lang"], min(1_000_000, 1 + 2_000_000 * SAMPLE // r["count"])).otherwise(limit)
    few = rows.where(F.col("h") < limit)
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "k", "text")))
    return [(r["lang"], r["text"]) for r in ranked.where(F.col("r") <= SAMPLE).orderBy("lang", "r").select("lang", "text").collect()]


def switching(texts: list[tuple[str, str]], labels: list[str]) -> tuple[list[list[str]], np.ndarray]:
    """Word sequences that change texts every few words, and the label of every word."""
    rng = np.random.default_rng(7)
    split = [(labels.index(lang), w) for lang, t in texts if len(w := words_of(t)) > 0]
    by_label = [[w for k, w in split if k == label] for label in range(len(labels))]
    by_label = [(k, ws) for k, ws in enumerate(by_label) if ws]
    out, truth = [], np.zeros((SEQUENCES, LENGTH), np.int64)
    for n in range(SEQUENCES):
        words: list[str] = []
        while len(words) < LENGTH:
            label, choices = by_label[rng.integers(len(by_label))]
            source = choices[rng.integers(len(choices))]
            size = int(rng.integers(4, 25))
            at = int(rng.integers(max(1, len(source) - size)))
            run = source[at : at + size][: LENGTH - len(words)]
            truth[n, len(words) : len(words) + len(run)] = label
            words += run
        out.append(words)
    return out, truth


def fit(texts: list[tuple[str, str]]) -> Model:
    """Weights and transitions that make the labels most likely, by Adam on the whole sample."""
    labels = sorted({lang for lang, _ in texts})
    k = len(labels)
    if k < 2:
        return Model(labels, np.zeros((FEATURES, max(k, 1)), np.float32), np.zeros((max(k, 1),) * 2, np.float32))
    words, truth = switching(texts, labels)
    vocabulary = sorted(set(chain.from_iterable(words)))
    number = {w: i for i, w in enumerate(vocabulary)}
    ids = np.array([[number[w] for w in s] for s in words]).T
    truth = truth.T
    flat, sizes = features(vocabulary)
    starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(vocabulary)), sizes)
    used, flat = np.unique(flat, return_inverse=True)
    parameters = [np.zeros((len(used), k)), np.zeros((k, k))]
    means, squares = [[np.zeros_like(p) for p in parameters] for _ in range(2)]
    seen_moves = np.bincount((truth[:-1] * k + truth[1:]).ravel(), minlength=k * k).reshape(k, k)
    seen = np.zeros((len(vocabulary), k))
    np.add.at(seen, (ids.ravel(), truth.ravel()), 1)
    for round_ in range(1, ROUNDS + 1):
        weights, moves = parameters
        emission = np.add.reduceat(weights[flat], starts)
        near = np.exp(emission - emission.max(1, keepdims=True))[ids]
        step = np.exp(moves)
        forward, backward = np.empty_like(near), np.ones_like(near)
        state = np.full((near.shape[1], k), 1 / k)
        for t in range(LENGTH):
            state = (state @ step) * near[t]
            state /= state.sum(1, keepdims=True)
            forward[t] = state
        expected_moves = np.zeros((k, k))
        for t in range(LENGTH - 1, 0, -1):
            ahead = near[t] * backward[t]
            joint = forward[t - 1][:, :, None] * step * ahead[:, None, :]
            expected_moves += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            back = ahead @ step.T
            backward[t - 1] = back / back.sum(1, keepdims=True)
        marginal = forward * backward
        marginal /= marginal.sum(2, keepdims=True)
        expected = np.stack([np.bincount(ids.ravel(), marginal[:, :, j].ravel(), len(vocabulary)) for j in range(k)], 1)
        wrong = (seen - expected)[owner]
        gradients = [np.stack([np.bincount(flat, wrong[:, j], len(used)) for j in range(k)], 1) - 0.1 * weights, seen_moves - expected_moves - 0.1 * moves]
        for p, g, m, s in zip(parameters, gradients, means, squares, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p += 0.1 * (m / (1 - 0.9**round_)) / (np.sqrt(s / (1 - 0.99**round_)) + 1e-8)
    weights = np.zeros((FEATURES, k), np.float32)
    weights[used] = parameters[0]
    return Model(labels, weights, parameters[1].astype(np.float32))


class Labeller:
    """A model with the emissions of the words met so far."""

    def __init__(self, model: Model) -> None:
        self.model, self.step = model, np.exp(model.moves - model.moves.max())
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.near = np.zeros((0, len(self.model.labels)), np.float32)
        self.letters = np.zeros(0, bool)

    def learn(self, words: list[str]) -> None:
        flat, sizes = features(words)
        emission = np.add.reduceat(self.model.weights[flat], np.cumsum(sizes) - sizes)
        self.near = np.concatenate([self.near, np.exp(np.maximum(emission - emission.max(1, keepdims=True), -60))])
        # A letter gives a word more than the shared feature.
        self.letters = np.concatenate([self.letters, sizes > 1])
        self.number.update({w: i for i, w in enumerate(words, len(self.number))})

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of every word of all texts, whether it has letters, and words by text."""
        if len(self.number) > CACHED:
            self.forget()
        words = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        new = set(chain.from_iterable(words)).difference(self.number)
        if new:
            self.learn(list(new))
        ids = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        return self.chain(self.near[ids], counts), self.letters[ids], counts

    def chain(self, near: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Forward-backward over texts of `counts` words whose emissions are `near`."""
        k = near.shape[1] if near.ndim == 2 else 1
        blocks = -(-counts // BLOCK)
        text = np.repeat(np.arange(len(counts)), blocks)
        place = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        first = (np.cumsum(counts) - counts)[text] + place * BLOCK
        size = np.minimum(BLOCK, counts[text] - place * BLOCK)
        order = np.argsort(-size, kind="stable")
        first, size, n = first[order], size[order], len(order)
        active = [int(np.searchsorted(-size, -t)) for t in range(BLOCK)]  # blocks of more than t words
        # Only blocks with others beside them need the matrix that carries across; they keep the order by size.
        beside = blocks[text[order]] > 1
        among, start = np.cumsum(beside) - 1, first[beside]
        matrix = np.tile(np.eye(k, dtype=np.float32), (len(start), 1, 1))
        for t in range(BLOCK):
            if not (a := int(beside[: active[t]].sum())):
                break
            m = (matrix[:a] @ self.step) * near[start[:a] + t][:, None, :]
            matrix[:a] = m / m.max((1, 2), keepdims=True)
        # Across the blocks of a text: states before each block, and what follows it.
        row = np.empty(n, np.int64)
        row[order] = np.arange(n)
        before, after = np.empty((n, k), np.float32), np.empty((n, k), np.float32)
        base, by_blocks = np.cumsum(blocks) - blocks, np.argsort(-blocks, kind="stable")
        state = np.full((len(counts), k), 1 / k, np.float32)
        follow = np.ones((len(counts), k), np.float32)
        for b in range(int(blocks.max(initial=0))):
            some = by_blocks[: np.searchsorted(-blocks[by_blocks], -b)]
            here, last = row[base[some] + b], row[base[some] + blocks[some] - 1 - b]
            before[here], after[last] = state[some], follow[some]
            more = blocks[some] > 1
            some, here, last = some[more], among[here[more]], among[last[more]]
            s, f = (state[some][:, None, :] @ matrix[here])[:, 0], (matrix[last] @ follow[some][:, :, None])[:, :, 0]
            state[some], follow[some] = s / s.sum(1, keepdims=True), f / f.sum(1, keepdims=True)
        out = np.empty_like(near)
        for t in range(BLOCK):
            if not (a := active[t]):
                break
            s = (before[:a] @ self.step) * near[first[:a] + t]
            before[:a] = out[first[:a] + t] = s / s.sum(1, keepdims=True)
        for t in range(BLOCK - 1, -1, -1):
            if a := active[t]:
                at = first[:a] + t
                p = out[at] * after[:a]
                out[at] = p / p.sum(1, keepdims=True)
                f = (near[at] * after[:a]) @ self.step.T
                after[:a] = f / f.sum(1, keepdims=True)
        return out


def train(df: DataFrame, key: str, text: str, lang: str) -> Model:
    """Model fitted on the bounded sample of the rows that are not held out.

    Without labelled rows the model knows no language and every text is `und`.
    """
    return fit(sample(df, key, text, lang))


def label(df: DataFrame, text: str, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` and `lang_pred, score, n_words, runs` of every row.

    Words are those of `words_of`. `score` is the mean probability of that language over the words with letters;
    `runs` are the languages of consecutive words, (lang, n_words), in order. Null
    texts and those without letters are `und` with score 0. Of `keep`, columns with those
    names are replaced; others may have any name.
    """
    made = [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("n_words", T.LongType())]))),
    ]
    keep = [c for c in keep if c not in {f.name for f in made}]
    schema = T.StructType([*[df.schema[c] for c in keep], *made])
    shared = df.sparkSession.sparkContext.broadcast(model)
    # A text that is kept goes to the workers once; any other takes a name longer than those that are kept.
    body = text if text in keep else "_".join(["_", *keep])
    rows = df.select(*keep) if text in keep else df.select(*keep, df[text].alias(body))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, labels = Labeller(shared.value), np.array([*shared.value.labels, UNKNOWN])
        unknown = len(labels) - 1
        for batch in batches.slices(parts, body, LABELLED):
            n = batch.num_rows
            if unknown:
                marginal, letters, counts = labeller.marginals(batches.texts(batch, body))
                owner = np.repeat(np.arange(n), counts)
                sums = np.stack([np.bincount(owner, marginal[:, j] * letters, n) for j in range(unknown)], 1)
                known = np.bincount(owner, letters, n)
                best = np.where(known > 0, sums.argmax(1), unknown)
                score = np.where(known > 0, sums.max(1) / np.maximum(known, 1), 0.0)
                word = marginal.argmax(1) if len(marginal) else np.zeros(0, np.int64)
            else:
                counts = np.zeros(n, np.int64)
                best, score, owner, word = np.zeros(n, np.int64), np.zeros(n), counts[:0], counts[:0]
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(new)
            length = np.diff(np.append(at, len(word)))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[at], minlength=n))]).astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(labels[word[at]].tolist(), pa.string()), pa.array(length, pa.int64())], names=["lang", "n_words"])
            columns = [
                *batch.columns[: len(keep)], pa.array(labels[best].tolist(), pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(counts),
                pa.ListArray.from_arrays(pa.array(offsets), structs),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
