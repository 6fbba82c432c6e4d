"""Near duplicates, repeated strings, components and neighbours against brute force."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from hazeline.llm import minhash, neighbours, suffixes
from hazeline.llm.components import components


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(7, 7), (9, 8), (8, 9)]
    links += [(rng.randint(1000, 1060), rng.randint(1000, 1060)) for _ in range(50)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df, "a", "b").collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: r for n, r in roots({n for link in links for n in link}, links).items() if n in nodes}
    assert components(df.limit(0), "a", "b").collect() == []


def shingle_sets(docs, size):
    out = {}
    for k, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        out[k] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}
    return out


def brute_groups(docs, size, percent):
    sets = shingle_sets(docs, size)
    keys = sorted(sets)
    links = [
        (a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return roots(keys, links), {k: len(s) for k, s in sets.items()}


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([2, 8, 60, 200]))
        for _ in range(rng.randint(1, 14)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9]) * len(words) // 120):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs.append((len(docs), rng.choice([" ", "\n"]).join(words)))
    docs += [(len(docs) + i, t) for i, t in enumerate([None, "", " \n", "One", "one", "one two", "É é", "é É"])]
    return docs


def test_near_duplicates_match_brute_force(spark):
    for seed, size, percent in ((1, 3, 85), (2, 5, 80)):
        docs = near_copies(seed)
        expected, sizes = brute_groups(docs, size, percent)
        df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("x"))
        rows = minhash.near_duplicates(df, "doc_id", "text", size, percent).collect()
        assert {r["doc_id"]: r["component_id"] for r in rows} == expected
        assert {r["doc_id"]: r["n_shingles"] for r in rows} == sizes
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
        assert len(set(expected.values())) < len(docs)


def test_texts_that_share_no_bucket_are_not_shuffled(spark, monkeypatch):
    plans, real = [], minhash.full_sets
    monkeypatch.setattr(minhash, "full_sets", lambda df, size: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, size))
    docs = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(40)] + [(40, near := " ".join(f"w0x{j}" for j in range(29))), (41, near)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans and all("BroadcastHashJoin" in p for p in plans)
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 0 if i in (40, 41) else i for i in range(42)}


def test_blocks_find_links_across_them(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 500)
    docs = near_copies(3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = minhash.near_duplicates(df, "doc_id", "text", 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_groups(docs, 3, 85)[0]


def test_cross_links_alone_find_every_component():
    rng = np.random.default_rng(5)
    base = np.sort(rng.choice(10_000, 100, replace=False)).astype(np.uint64)
    rows = []
    for i in range(30):
        mine = base.copy()
        mine[rng.choice(100, i % 12, replace=False)] += np.uint64(20_000 + 300 * i)
        rows.append((i, i, 3, 0, [1] * minhash.BANDS, np.sort(mine)))
    pdf = pd.DataFrame([(a, b, c, d, e, v.tobytes()) for a, b, c, d, e, v in rows], columns=["id", "component", "side", "band", "bands", "values"])
    found = minhash.cross_links(pdf, 85)
    sets = [set(v.tolist()) for *_, v in rows]
    links = [(i, j) for i in range(30) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert roots(range(30), found.itertuples(index=False)) == roots(range(30), links)


def test_buckets_of_two_are_compared_once(spark):
    # Bucket 1 holds two unlike entries, which met as hub and other; in bucket 2 the ones beside the hub have not met.
    shared = spark.createDataFrame([(1, 1, 2), (2, 1, 2), (3, 2, 3), (4, 2, 3), (5, 2, 3), (6, 3, 3), (7, 3, 3), (8, 3, 3)], "id long, bucket long, size long")
    labels = spark.createDataFrame([(3, 3), (4, 3), (6, 6), (7, 6), (8, 6)], "id long, component long")
    left = minhash.undecided(shared, labels)
    assert sorted((r["id"], r["bucket"], r["component"]) for r in left.collect()) == [(3, 2, 3), (4, 2, 3), (5, 2, 5)]


def test_crossing_links_take_arrow_and_any_key():
    sets = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 3, 500, 1000, 1002)]
    rows = pa.table({
        "id": ["e", "b", "c", "a", "d"], "component": ["e", "b", "c", "a", "d"], "side": [3] * 5, "band": [1] * 5,
        "bands": [[i, 1] for i in range(5)], "values": [x.tobytes() for x in sets],
    })
    assert minhash.crossing_links(rows, 85).to_pylist() == [{"a": "a", "b": "d"}, {"a": "b", "b": "e"}]
    # Pairs that share an earlier band are another bucket's.
    assert minhash.crossing_links(rows.set_column(4, "bands", pa.array([[1, 1]] * 5)), 85).num_rows == 0


def test_near_duplicates_of_null_and_equal_keys(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(None, text), (3, text), (3, text), (5, text), (6, "z")], "doc_id long, text string")
    rows = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, "doc_id", "text").collect())
    assert rows == [("3", 3, True), ("3", 3, True), ("5", 3, False), ("6", 6, True), ("None", 3, False)]
    assert minhash.near_duplicates(df.limit(0), "doc_id", "text").collect() == []


def brute_cover(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = True
        out.append(cover)
    return out


def test_repeated_starts_of_windows():
    rng = random.Random(5)
    for trial in range(150):
        length = rng.choice([4, 9, 17])
        windows = [bytes(rng.choices([0, 98, 255][: 2 + trial % 2], k=rng.randint(length, length + 30))) for _ in range(rng.randint(1, 12))]
        again, group = suffixes.repeated_starts(windows, length)
        strings = [w[i : i + length] for w in windows for i in range(len(w) - length + 1)]
        count = Counter(strings)
        assert again.tolist() == [count[s] > 1 for s in strings]
        named = {}
        assert all(named.setdefault(s, g) == g for s, g in zip(strings, group.tolist(), strict=True))
        assert len(set(named.values())) == len(named)


def test_suffix_array_is_sorted():
    rng = random.Random(8)
    for _ in range(50):
        data = [rng.randint(0, 3) for _ in range(rng.randint(1, 200))]
        order = suffixes.sorted_suffixes(np.array(data, np.uint16))
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_a_shard_of_usual_size_fits_in_little_memory():
    rng = np.random.default_rng(3)
    window = 700
    data = rng.integers(97, 101, (suffixes.SHARD // window, window), np.uint8)
    data[1::7] = data[0]
    tracemalloc.start()
    try:
        again, _ = suffixes.repeated_starts([row.tobytes() for row in data], 400)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert again.any() and not again.all()
    assert peak < 250_000_000


def test_removed_bytes_match_brute_force(spark):
    rng = random.Random(12)
    length = 100
    passages = ["".join(rng.choices("abcdé \n", k=rng.choice([90, 130, 300]))) for _ in range(8)]
    texts = [None, "", "short", "é" * 500]
    for _ in range(60):
        parts = ["".join(rng.choices("abcdefgh ", k=rng.randint(0, 150))) for _ in range(rng.randint(1, 4))]
        texts.append("".join(p + rng.choice([*passages, ""]) for p in parts))
    texts += texts[10:14]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("t", F.lit("x"))
    data = [(t or "").encode() for t in texts]
    cover = brute_cover(data, length)
    for split in (10**6, 600):
        for r in suffixes.remove_repeats(df, "doc_id", "text", length, shard=3_000, split=split).collect():
            c = cover[r["doc_id"]]
            edges = np.diff(np.concatenate([[0], c.astype(int)]))
            assert r["n_bytes"] == len(c)
            assert (r["n_removed"], r["n_spans"]) == (int(c.sum()), int((edges == 1).sum()))
            assert bytes(r["kept"]) == bytes(np.frombuffer(data[r["doc_id"]], np.uint8)[~c])


def test_repeats_of_equal_rows_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, "x" * 30 + "abc" * 40)] * 2 + [(None, "short")], "doc_id long, text string")
    rows = suffixes.remove_repeats(df, "doc_id", "text", 100).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in rows) == [(5, 0), (150, 150), (150, 150)]
    assert suffixes.remove_repeats(df.limit(0), "doc_id", "text", 100).collect() == []


def test_neighbours_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 40)
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 8)).round(1).astype(np.float32)
    vectors[50:80] = vectors[20]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1005, [0.0] * 8), (1010, [float("nan")] + [1.0] * 7), (1015, [None] + [1.0] * 7), (1020, [float("inf")] * 8), (None, [1.0] * 8), (1025, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(0))
    found = neighbours.search(df, "vec_id", "embedding", df.where("vec_id % 5 = 0"), k=6)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    wide = vectors.astype(float)
    assert set(got) == set(range(0, 300, 5))
    for q, mine in got.items():
        distance = np.sqrt(((wide - wide[q]) ** 2).sum(1))
        best = sorted((d, i) for i, d in enumerate(distance) if i != q)[:6]
        assert np.allclose([d for _, d in mine], [d for d, _ in best], rtol=1e-12)
        assert [d for _, d in mine] == sorted(d for _, d in mine)
        assert {i for i, d in mine if d < best[-1][0] - 1e-9} == {i for d, i in best if d < best[-1][0] - 1e-9}


def test_neighbours_ties_few_rows_and_an_empty_table(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(4)], "vec_id long, embedding array<float>")
    rows = neighbours.search(df, "vec_id", "embedding", df.where("vec_id = 2"), k=10).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in rows] == [(1, 0, 0.0), (2, 1, 0.0), (3, 3, 0.0)]
    assert neighbours.search(df.limit(0), "vec_id", "embedding", df.limit(0)).collect() == []
