"""Encoding, packing, language, quality and licences against plain versions."""

import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hazeline.llm import bpe, langid, licences, packing, quality

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n", "a" * 3_000 + " b", "<|endoftext|>", "x <|endoftext|> y", "  two  spaces \n\n end ", "日本 𐍈é's 23²"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def table(spark, texts, extra="ids"):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn(extra, F.lit("x"))


def test_ids_and_text_match_the_library(spark, library):
    rng = random.Random(1)
    parts = ["a", "the", "  ", "\n", " ", "\t", "é", "1", "23", "'s", "<|endoftext|>", " ", "\x1c", "日本", "x" * 60, ".", "!!", "\r\n", "𐍈", "́", "²"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3_000)] + ODD
    rows = bpe.encode(table(spark, texts), "doc_id", "text", VOCABULARY, decoded=True).collect()
    expected = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = {r["doc_id"]: r for r in rows}
    assert [got[i]["ids"] for i in range(len(texts))] == expected
    assert [got[i]["decoded"] for i in range(len(texts))] == [library.decode(e, skip_special_tokens=False) for e in expected]


def test_decode_of_ids_that_end_within_a_character(spark, library):
    ids = library.encode("日本語", add_special_tokens=False).ids
    df = spark.createDataFrame([(1, ids[:-1]), (2, None)], "k long, ids array<int>")
    rows = {r["k"]: r["decoded"] for r in bpe.decode(df, "k", "ids", VOCABULARY).collect()}
    assert rows == {1: library.decode(ids[:-1], skip_special_tokens=False), 2: None}


def test_encode_of_an_empty_table(spark):
    assert bpe.encode(table(spark, ["a"]).limit(0), "doc_id", "text", VOCABULARY).collect() == []


def check_places(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_holds_every_piece_once(spark, library):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["alpha", "b", "cc", "d1"], k=rng.choice([0, 3, 9, 30, 200]))) for _ in range(300)] + ODD
    rows = packing.pack_documents(table(spark, texts, "length"), "doc_id", "text", VOCABULARY, capacity=64).collect()
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, packing.END]
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine)))
        assert [r["start"] for r in mine] == np.cumsum([0, *[r["length"] for r in mine]])[:-1].tolist()
        assert sum(r["length"] for r in mine) == len(ids)
        assert all(r["length"] == 64 for r in mine[1:])
        for r in mine:
            cut = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert zlib.crc32(cut.tobytes()) == r["ids_crc32"]
    n = check_places(rows, 64)
    assert n <= 1.1 * -(-sum(r["length"] for r in rows) // 64) + 1


def test_plan_is_a_valid_tight_packing():
    rng = random.Random(4)
    for _ in range(50):
        capacity = rng.choice([10, 64, 100])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 400)))
        plan = packing.Plan(dict(counts), capacity)
        used, fill = Counter(), Counter()
        rows = []
        for length, start, count, first, offset in plan.rows:
            assert start == used[length]
            used[length] += count
            rows += [{"sequence_id": first + i, "offset": offset, "length": length} for i in range(count)]
        for r in rows:
            fill[r["sequence_id"]] += r["length"]
        assert used == counts
        assert check_places(rows, capacity) == plan.sequences
        assert sum(1 for f in fill.values() if 2 * f <= capacity) <= 1


def test_packing_of_equal_rows_and_an_empty_table(spark):
    rows = packing.pack_documents(table(spark, ["same text"] * 50).withColumn("doc_id", F.lit(7)), "doc_id", "text", VOCABULARY, capacity=8).collect()
    assert len(rows) == 50
    check_places(rows, 8)
    assert packing.pack_documents(table(spark, ["a"]).limit(0), "doc_id", "text", VOCABULARY).collect() == []


def test_labelling_a_batch_fits_in_little_memory():
    rng = np.random.default_rng(4)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 11)))) for _ in range(60_000)]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), 300)) for _ in range(langid.LABELLED // 2_100)]
    model = langid.Model(["a", "b"], rng.normal(size=(langid.FEATURES, 2)).astype(np.float32), np.zeros((2, 2), np.float32))
    tracemalloc.start()
    try:
        _, letters, counts = langid.Labeller(model).marginals(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert letters.all() and (counts == 300).all()
    assert peak < 70_000_000


def test_language_on_held_out_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("score", F.lit(1))
    model = langid.train(docs, "doc_id", "text", "lang")
    rows = langid.label(docs, "text", model, ["doc_id", "lang"]).withColumn("held_out", langid.held_out(F.col("doc_id"))).where("held_out").collect()
    assert len(rows) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(sum(x["n_words"] for x in r["runs"]) == r["n_words"] for r in rows)


def test_language_ignores_lang_of_held_out_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert langid.train(docs, "doc_id", "text", "lang").labels == langid.train(other, "doc_id", "text", "lang").labels


def test_texts_without_letters_or_labels(spark):
    rows = [(1, "und sie der die das ist nicht", "de"), (2, "the of and is was it not", "en"), (3, None, "en"), (4, "12 !!", None), (5, "", "de"), (None, "the and of", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.label(docs, "text", langid.fit([("de", rows[0][1]), ("en", rows[1][1])]), ["doc_id"]).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "de", 2: "en", 3: "und", 4: "und", 5: "und", None: "en"}
    assert got[3][1] == got[4][1] == 0
    nothing = langid.label(docs, "text", langid.train(docs.limit(0), "doc_id", "text", "lang"), ["doc_id"]).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_long_runs_are_judged_whole(spark):
    model = langid.fit([("de", "und sie der die das ist nicht " * 5), ("en", "the of and is was it not " * 5)])
    run = "the" * 20 + "undsiederdieistnicht" * 40
    rows = langid.label(spark.createDataFrame([(1, run), (2, "-" * 90 + "the")], "doc_id long, text string"), "text", model, ["doc_id"]).collect()
    got = {r["doc_id"]: r for r in rows}
    assert got[1]["lang_pred"] == "de" and got[1]["n_words"] == -(-len(run) // 64) and len(got[1]["runs"]) > 1
    assert got[2]["lang_pred"] == "en" and got[2]["n_words"] == 1


def test_blocks_give_the_plain_forward_backward():
    rng = np.random.default_rng(3)
    model = langid.Model(["a", "b", "c"], np.zeros((langid.FEATURES, 3), np.float32), rng.normal(size=(3, 3)).astype(np.float32))
    labeller = langid.Labeller(model)
    counts = np.array([5, 0, 1, 700, 512, 513, 1_600, 128])
    near = np.exp(rng.normal(size=(counts.sum(), 3))).astype(np.float32)
    got, at = labeller.chain(near, counts), 0
    for n in counts:
        e, step = near[at : at + n].astype(float), labeller.step.astype(float)
        forward, backward, state = np.zeros((n, 3)), np.ones((n, 3)), np.full(3, 1 / 3)
        for t in range(n):
            state = state @ step * e[t]
            state /= state.sum()
            forward[t] = state
        for t in range(n - 1, 0, -1):
            b = step @ (e[t] * backward[t])
            backward[t - 1] = b / b.sum()
        p = forward * backward
        assert np.allclose(got[at : at + n], p / p.sum(1, keepdims=True), atol=1e-4)
        at += n


def test_features_of_a_word_do_not_depend_on_its_neighbours():
    words = ["the", "The", "a", "", "--", "don't", "\u0130x", "\u00e9", "\U0001034d", "x" * 64, "ab", "\u65e5\u672c"]
    flat, sizes = langid.features(words)
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    for word, part in zip(words, parts, strict=True):
        assert part.tolist() == langid.features([word])[0].tolist()
        n = sum(map(str.isalpha, word.lower()))
        assert len(part) == (9 + 2 * n if n else 1) and part[0] == 0 and (part[1:] > 0).all() and part.max() < langid.FEATURES
    assert parts[0].tolist() == parts[1].tolist() != parts[2].tolist()


def test_labelling_equals_a_plain_chain(spark):
    model = langid.fit([("de", "und sie der die das ist nicht " * 5), ("en", "the of and is was it not " * 5), ("fr", "le la et les des est pas " * 5)])
    rng = np.random.default_rng(4)
    words = "und sie der the of and le la et 12 - Haus house maison".split()
    texts = [" ".join(rng.choice(words, n)) for n in (1, 3, 40, 511, 512, 513, 1_300)]
    df = spark.createDataFrame([(i, t, 0.5, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, score double, _text string, n_words int")
    rows = langid.label(df, "text", model, ["doc_id", "score", "_text", "n_words"])
    assert rows.columns == ["doc_id", "_text", "lang_pred", "score", "n_words", "runs"]
    step = np.exp(model.moves.astype(float))
    for r in rows.collect():
        each = texts[r["doc_id"]].split()
        near = [np.exp(model.weights[langid.features([w])[0]].astype(float).sum(0)) for w in each]
        forward, backward = [], [np.ones(3)]
        state = np.full(3, 1 / 3)
        for e in near:
            state = state @ step * e
            state /= state.sum()
            forward.append(state)
        for e in near[:0:-1]:
            b = step @ (e * backward[-1])
            backward.append(b / b.sum())
        p = np.array(forward) * np.array(backward[::-1])
        p /= p.sum(1, keepdims=True)
        lettered = np.array([any(map(str.isalpha, w)) for w in each])
        assert r["n_words"] == len(each) == sum(x["n_words"] for x in r["runs"])
        if lettered.any():
            mean = p[lettered].mean(0)
            assert r["lang_pred"] == model.labels[mean.argmax()] and abs(r["score"] - mean.max()) < 1e-3
            assert [x["lang"] for x in r["runs"] for _ in range(x["n_words"])] == [model.labels[k] for k in p.argmax(1)]
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0)


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines, copies = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            copies += line in lines
            lines.add(line)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": copies, "n_repeat_words": len(covered),
    }


def test_base_counts_and_verdict(spark):
    rng = random.Random(6)
    parts = ["a", "b", "cé", " ", " ", "\n", "\t", "#", "|", "\xa0", "\x1c", "日", "A", "...", "- "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 400))) for _ in range(200)] + [None, "", "one two", "a b c a b c"]
    texts += [" ".join(rng.choices(["word", "other", "thing", "more", "this", "that", "also", "very"], k=k)) for k in (60, 400)]
    texts.append(" ".join(f"word{i}" for i in range(80)))
    df = table(spark, texts, "n_words")
    got = {r["doc_id"]: r for r in quality.judge(df, "doc_id", "text").collect()}
    counts_of = [plain_counts(t or "") for t in texts]
    for i, (t, counts) in enumerate(zip(texts, counts_of, strict=True)):
        assert {k: got[i][k] for k in counts} == counts
        failed = counts["n_words"] < 50 or 100 * counts["n_repeat_words"] > 50 * counts["n_words"]
        assert got[i]["base_failed"] == failed
        arrays = {k: np.array([v]) for k, v in counts.items()}
        passes = not failed and all(rule([(t or "").encode()], arrays)[0] for rule in quality.RULES.values())
        assert got[i]["kept"] == passes
        assert (got[i]["failed_rule"] is not None) == (not failed and not passes)
    assert any(r["kept"] for r in got.values())


def test_cascade_orders_by_rejections_per_cost_and_stops_early():
    seen = []

    def rule(name, good):
        def run(texts, counts):
            seen.append((name, len(texts)))
            return np.array([good(t) for t in texts], bool)

        return run

    rules = {"cheap": rule("cheap", lambda t: b"x" not in t), "dear": rule("dear", lambda t: b"y" not in t)}
    assert quality.ordered({"dear": (2.0, 0.5), "cheap": (0.1, 0.2), "idle": (0.01, 0.0)}) == ["cheap", "dear", "idle"]
    texts = [b"x", b"y", b"z", b"xy"]
    failed = quality.cascade(texts, {"n": np.zeros(4)}, np.ones(4, bool), ["cheap", "dear"], rules)
    assert failed == ["cheap", "dear", None, "cheap"]
    assert seen == [("cheap", 4), ("dear", 2)]


def test_quality_of_an_empty_table(spark):
    assert quality.judge(table(spark, ["a"]).limit(0), "doc_id", "text").collect() == []


def plain_scan(text):
    lines = [re.findall(r"[^\W_]+", line.lower()) for line in text.split("\n")]
    units, first = {(i, i + 1) for i in range(len(lines))} | {(0, len(lines))}, 0
    for i in range(len(lines) + 1):
        if i == len(lines) or not lines[i]:
            units.add((first, i))
            first = i + 1
    out = {}
    for a, b in sorted(units):
        words = [w for line in lines[a:b] for w in line]
        grams = Counter(zip(words, words[1:], strict=False))
        for name, templates in licences.TEMPLATES.items():
            for t in templates:
                other = re.findall(r"[^\W_]+", t.lower())
                known = Counter(zip(other, other[1:], strict=False))
                score = 2 * (grams & known).total() / (grams.total() + known.total())
                if score >= licences.LEAST:
                    key = tuple(words)
                    if key not in out or score > out[key][1] or score == out[key][1] and name < out[key][0]:
                        out[key] = (name, score)
    return sorted(out.values())


def test_licences_match_a_comparison_with_every_template(spark):
    rng = random.Random(9)
    notices = [t for ts in licences.TEMPLATES.values() for t in ts]
    texts = [None, "", "\n", "word", "Released under the MIT License."]
    for _ in range(150):
        words = rng.choice(notices).split()
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(["foo", "BAR", "the"])
        notice = rng.choice([" ", "\n"]).join(words) if rng.random() < 0.3 else " ".join(words)
        texts.append(rng.choice(["{}", "Some prose here.\n{}\nand more of it", "A line.\n\n{}\n\nAnother."]).format(notice))
    rows = licences.scan(table(spark, texts, "score"), "doc_id", "text").collect()
    for r in rows:
        expected = plain_scan(texts[r["doc_id"]] or "")
        assert sorted((m["licence"], round(m["score"], 9)) for m in r["matches"]) == [(n, round(x, 9)) for n, x in expected]
        best = min(expected, key=lambda m: (-m[1], m[0]), default=(None, None))
        assert (r["licence"], r["score"]) == best
    assert sum(r["licence"] is not None for r in rows) > 50


def test_licences_of_an_empty_table(spark):
    assert licences.scan(table(spark, ["a"]).limit(0), "doc_id", "text").collect() == []


def test_a_kept_text_goes_to_the_labeller_once(spark):
    model = langid.fit([("de", "der Hund und die Katze sind im Haus " * 5), ("en", "the dog and the cat are in the house " * 5)])
    df = spark.createDataFrame([(1, "der Hund", "x"), (2, None, "y"), (3, "the cat", "z")], "doc_id long, text string, source string")
    out = langid.label(df, "text", model, ["doc_id", "text", "source"])
    sent = out._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1]
    assert " AS " not in sent
    other = langid.label(df, "text", model, ["doc_id"])
    pick = lambda frame: [(r.doc_id, r.lang_pred, r.score, r.n_words) for r in frame.orderBy("doc_id").collect()]
    assert out.columns == ["doc_id", "text", "source", "lang_pred", "score", "n_words", "runs"]
    assert [(r.text, r.source) for r in out.orderBy("doc_id").collect()] == [("der Hund", "x"), (None, "y"), ("the cat", "z")]
    assert pick(out) == pick(other) and [x[1] for x in pick(out)] == ["de", "und", "en"]
