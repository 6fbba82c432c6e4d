"""Filter interactions, fill-in-middle and exact top-k against plain versions."""

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeline.llm import audit, middle, threshold

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORDS.findall(text or "")
    return len(words), len(set(words)), len(re.findall("[A-Z]", text or "")), len(text or ""), len(re.findall(r"[#$%&*|]", text or ""))


def test_counts_of_one_pass():
    rng = random.Random(5)
    parts = ["a", "é", "日", "\n", " ", "\t", "𐍈", "A", "$", "|", "\x00", "\x1c", "\xa0", " ", "word " * 3, "x" * 70 + " ", "x" * 69 + "y ", "longerword1 ", "longerword2 ", "x" * 64 + "a ", "x" * 64 + "b "]
    for _ in range(200):
        texts = ["".join(rng.choices(parts, k=rng.choice([0, 1, 3, 40]))) for _ in range(rng.choice([0, 1, 2, 7]))]
        counts = audit.counted([t.encode() for t in texts])
        assert [tuple(int(counts[c][i]) for c in audit.COUNTS) for i in range(len(texts))] == [plain_counts(t) for t in texts]


def test_words_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(audit.shingles, "mixed", lambda x: x & np.uint64(3))
    texts = [b"a b c a bb cc averylongword averylongwore a averylongword", b"a b", b""]
    assert audit.counted(texts)["n_distinct"].tolist() == [7, 2, 0]


def plain_audit(docs, labels):
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    least = {}
    for key, text, _ in docs:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))
    rows = []
    for key, text, source in docs:
        words, distinct, capitals, points, symbols = plain_counts(text)
        failed = {"A": words < 200, "B": 100 * distinct < 50 * words, "C": 100 * capitals > 2 * points, "D": symbols > 0}
        failed["E"] = (text or "") in least and (key is None or least[text or ""] < key)
        rows.append((source or "", {f for f in failed if failed[f]}, key in good, key in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        totals = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            before = set()
            for step, f in enumerate(order):
                gone = [r for r in mine if f in r[1] and not r[1] & before]
                totals[f] += len(gone)
                out[part, "".join(order), step + 1] = [
                    sum(not r[1] & (before | {f}) for r in mine), len(gone), sum(f in r[1] and bool(r[1] & before) for r in mine),
                    sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
                before.add(f)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(totals[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_counts_every_order(spark):
    rng = random.Random(6)
    long = [" ".join(f"w{rng.randrange(n)}" for _ in range(220)) for n in (20, 500, 500, 500)]
    texts = [None, "", "short", "SHOUT IT", "a # b", long[0], long[1], long[2] + " |", long[3] + " " + "Q" * 60]
    docs = [(i if i % 17 else None, rng.choice(texts), rng.choice(["x", "y", None, ""])) for i in range(300)] + [(5, "twice", "x"), (5, "twice", "x"), (9, "twice", "y")]
    labels = [(rng.randrange(320), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(300)] + [(None, 1, 1), (5, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for clash in ("part", "_key", "mask", "n", "good", "n_words"):
        df = df.withColumn(clash, F.lit(1))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = audit.audit(df, marks, "doc_id", "text", "source").collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in rows}
    assert len(rows) == len(got) == 3 * 600
    assert got == plain_audit(docs, labels)
    assert sum(r["shapley"] for r in rows if r["filter_order"] == "ABCDE") == math.factorial(5) * sum(r["removed"] for r in rows if r["filter_order"] == "ABCDE")


def test_audit_of_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(df.limit(0), marks, "doc_id", "text", "source").count() == 0
    assert audit.audit(df, marks, "doc_id", "text", "source").count() == 600


def plain_middle(key, text, rate, first):
    units = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in middle.MARKERS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text or ""
    if h[3] % 100 < first:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("rate", "first"), [(100, 50), (60, 20)])
def test_fill_in_middle_and_back(spark, rate, first):
    rng = random.Random(7)
    parts = ["a", "é", "日", "\n", "\r\n", "𐍈", "<P", "P>", "<", ">", "\x00", "line of text\n", "M>"]
    texts = ["".join(rng.choices(parts + ["<S>"] * (i % 5 == 0), k=rng.choice([1, 3, 20, 60]))) for i in range(400)]
    texts += [None, "", "\n", "\n\n\n", "no end", "<M>", "a\n" * 300_000, "x" * 1_500_000, "same\nrow\n", "same\nrow\n"]
    rows = [(i if i % 31 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("draws", F.lit(0)).coalesce(2)
    made = middle.fill_in_middle(df, "doc_id", "text", rate=rate, suffix_first=first)
    back = middle.restore(made, "output", "form")
    got = sorted(back.collect(), key=repr)
    want = sorted([(k, *plain_middle(k, t, rate, first), t or "") for k, t in rows], key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert middle.fill_in_middle(df.limit(0), "doc_id", "text").count() == 0


def test_places_move_parts_and_skip_empty_ones():
    assert middle.places(np.array([0, 2, 2, 5]), np.array([10, 99, -2, 0]), 6).tolist() == [10, 11, 0, 1, 2, 5]


def plain_top(rows, queries, k):
    def whole(rows):
        held = {}
        for key, v in rows:
            if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
                held[key] = min(held.get(key, v), v)
        return {key: [math.floor(256 * x) for x in v] for key, v in held.items()}

    every, out = whole(rows), []
    for q, v in whole(queries).items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in every.items() if c != q and len(w) == len(v))
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def top(spark, rows, queries, **more):
    schema = "vec_id long, embedding array<double>"
    df, asked = spark.createDataFrame(rows, schema), spark.createDataFrame(queries, schema)
    for clash in ("id", "part", "d", "score"):
        df, asked = df.withColumn(clash, F.lit(1)), asked.withColumn(clash, F.lit(1))
    return sorted(map(tuple, threshold.search(df, "vec_id", "embedding", asked, **more).collect()))


def test_top_products_match_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [0.5] * 6) for i in range(150)] + [(500 + i, [-0.5, 0.0, 0.0, 0.0, 0.25, 0.0]) for i in range(5)]
    rows += [(600, [0.0] * 6), (601, None), (602, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (603, [float("nan")] * 6), (604, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(605, [1.0, 2.0]), (606, [0.5, -1.0]), (607, []), (608, []), (5, [0.1] * 6), (5, [0.1] * 6)]
    queries = [r for r in rows if r[0] is None or r[0] % 50 == 0 or r[0] > 595]
    assert top(spark, rows, queries, k=5) == plain_top(rows, queries, 5)
    monkeypatch.setattr(threshold, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(threshold, "QUERY_BLOCK", 3)
    assert top(spark, rows, queries, k=5) == plain_top(rows, queries, 5)


def test_top_products_of_wide_numbers_and_few_rows(spark):
    rows = [(1, [2.0**40, 1.0]), (2, [2.0**40, 3.0]), (3, [-(2.0**40), 2.0]), (4, [0.001, -0.001])]
    small = [(k, [x / 2**20 for x in v]) for k, v in rows]
    assert top(spark, small, small[:2]) == plain_top(small, small[:2], 5)
    got = top(spark, rows, rows[:1])
    assert [(c, s) for _, _, c, s in got] == [(2, 2**63 - 1), (4, -256), (3, -(2**63))]
    assert top(spark, [(1, [1.0])], [(1, [1.0])]) == []
    assert top(spark, rows[:1] * 2, []) == []


def test_the_walk_stops_before_it_has_seen_all():
    rng = np.random.default_rng(9)
    matrix = np.floor(256 * rng.normal(size=(20_000, 3)))
    orders = np.argsort(matrix, axis=0, kind="stable").T.astype(np.uint32)
    query = np.array([200.0, -100.0, 0.0])
    scores, rows, seen = threshold.walk(query, 20_000, matrix, orders, 5)
    assert seen < 4_000
    assert scores.tolist() == sorted(matrix @ query, reverse=True)[:5]
    assert (matrix[rows] @ query).tolist() == scores.tolist()
