"""Line dedup and personal data against plain Python."""

import random
import re

from pyspark.sql import functions as F

from hazeline import session
from hazeline.llm import lines, pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            number = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(number) <= 19 and luhn(number),
                "phone": 9 <= len(number) <= 15,
            }[kind]
            if good:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.find_spans(df, "text").select(
        "doc_id", pii.digest(F.filter("spans", pii.is_base)).alias("base"), pii.digest(F.col("spans")).alias("spans"),
        pii.masked(F.coalesce("text", F.lit("")), F.col("spans")).alias("masked"),
    )
    return {r["doc_id"]: r for r in rows.collect()}


def test_base_spans_match_plain_patterns(spark):
    rng = random.Random(3)
    parts = [
        "a", "b@c.d", "@", ".", "1.2.3.4", "300.1.1.1", "25", "4111111111111111", "4111 1111 1111 1111", "+1 (905) 555-9360", " ", "-", "é", "日",
        "\U0001034d", "+", "(5)", "0001.2.3.4.5", "_", "x.y@z.co.uk", "12-", "\n",
    ]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(1500)] + ["", None, "a@b.c " * 700]
    rows = found(spark, texts)
    assert [rows[i]["base"] for i in range(len(texts))] == [base_spans(t or "") for t in texts]


def test_long_runs_end_quickly(spark):
    rows = found(spark, ["a" * 200_000, "1" * 200_000, "1 " * 60_000, "1." * 20_000, "+" + "1" * 100_000, "@a" * 50_000])
    assert [rows[i]["base"] for i in (0, 1, 2, 4, 5)] == [""] * 5
    assert rows[3]["base"].count("ip:") == 5_000


def test_added_kinds_need_their_checks(spark):
    rows = found(spark, [
        "iban DE89 3704 0044 0532 0130 00 ok", "DE88370400440532013000", "ssn 123-45-6789.", "part 123-45-6789", "order ssn 123-45-6789", "xDE89370400440532013000",
    ])
    assert [rows[i]["spans"] for i in range(6)] == ["iban:5:32", "", "ssn:4:15", "", "", ""]
    assert rows[0]["masked"] == "iban <iban> ok"


def test_context_reaches_across_matches(spark):
    filler = "\U0001034d" * 250
    rows = found(spark, [
        "SSN: 123-45-6789, 987-65-4321", filler + " ssn 123-45-6789, 987-65-4321", "987-65-4321, 123-45-6789 ssn", "123-45-6789 " + "x" * 60 + " 987-65-4321 ssn",
        "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "DE89 3704 0044 0532 0130 00 GB29 NWBK 6016 1331 9268 19", "NO12 3456 DE89 3704 0044 0532 0130 00 EUR 12",
    ])
    assert [rows[i]["spans"] for i in range(7)] == [
        "ssn:5:16,ssn:18:29", "ssn:255:266,ssn:268:279", "ssn:0:11,ssn:13:24", "ssn:73:84", "iban:5:32", "iban:0:27,iban:28:55", "iban:10:37",
    ]


def test_masking_joins_overlaps(spark):
    rows = found(spark, ["+4222222222222 x", "write a@b.c, 1.2.3.4 now"])
    assert rows[0]["spans"] == "phone:0:14,card:1:14" and rows[0]["masked"] == "<phone> x"
    assert rows[1]["masked"] == "write <email>, <ip> now"


def test_pii_keeps_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a@b.c", "x")], "doc_id long, text string, kind string")
    assert pii.find_spans(df, "text").columns == ["doc_id", "text", "kind", "spans"]
    assert pii.find_spans(df.limit(0), "text").count() == 0


def words_of(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip().split()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_copies(docs, hashes):
    """Copied lines, given the SimHash of each line's words."""
    every = [(k, n, tuple(words_of(line))) for k, t in docs for n, line in enumerate((t or "").split("\n")) if t is not None]
    every = sorted(x for x in every if len(x[2]) >= lines.MIN_WORDS)
    distinct = sorted({w for _, _, w in every})
    group = {w: w for w in distinct}

    def root(w):
        while group[w] != w:
            w = group[w]
        return w

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            near = bin((hashes[a] ^ hashes[b]) & (2**64 - 1)).count("1") <= lines.BITS
            if near and edit_distance(a, b) <= int(max(len(a), len(b)) * (1 - lines.SIMILARITY) + 1e-9):
                group[root(b)] = root(a)
    seen, out = set(), set()
    for k, n, w in every:
        if root(w) in seen:
            out.add((k, n))
        seen.add(root(w))
    return out


def test_fuzzy_lines_match_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    bases = [rng.choices(vocabulary, k=rng.randint(6, 40)) for _ in range(30)]
    docs = []
    for k in range(60):
        text = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            text.append(rng.choice(["{}", "  {}!", "{}."]).format(" ".join(line)).capitalize())
        docs.append((k, "\n".join(text)))
    docs += [(100, None), (101, ""), (102, "\n\n")]
    df = spark.createDataFrame(docs, "key long, text string").withColumn("line_no", F.lit("x"))
    split = lines.materialize(lines.split_lines(df, "key", "text"), "lines")
    table = {tuple(r["words"].split()): r["s"] for r in split.join(lines.simhash(split), "line_key").select("words", "s").collect()}
    expected = brute_copies(docs, table)
    assert expected
    got = {(r["key"], r["line_no"]) for r in lines.find_copies(df, "key", "text").collect()}
    assert got == expected
    cleaned = {r["key"]: r for r in lines.deduplicate(df, "key", "text").collect()}
    for k, t in docs:
        left = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (k, n) not in expected)
        assert cleaned[k]["text"] == left
        assert cleaned[k]["line_no"] == "x"


def test_simhash_is_the_majority_of_bits(spark):
    long = " ".join(["alpha", "beta", "gamma"] * 25_000)
    df = spark.createDataFrame([(1, "a b c d e f g h i"), (2, long)], "key long, text string")
    split = lines.materialize(lines.split_lines(df, "key", "text"), "lines")
    got = {r["key"]: r["s"] for r in split.join(lines.simhash(split), "line_key").select("key", "s").collect()}
    for key, text in ((1, "a b c d e f g h i"), (2, long)):
        words = text.split()
        hashes = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in sorted(set(words))], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
        value = sum(1 << b for b in range(64) if 2 * sum(hashes[w] >> b & 1 for w in words) > len(words))
        assert got[key] & (2**64 - 1) == value


def test_lines_of_an_empty_table(spark):
    df = spark.createDataFrame([], "key long, text string")
    assert lines.deduplicate(df, "key", "text").collect() == []


def test_lines_of_any_length_match_edit_similarity_alone(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3_000)]
    rows, lines_of = [], {}
    for k in range(120):
        base = rng.choices(vocabulary, k=rng.choice([8, 9, 10, 14, 20, 24, 50, 100]))
        for j in range(3):
            line = list(base)
            for _ in range(rng.randint(1, len(base) // 5) if j else 0):
                at = rng.randrange(len(line))
                line[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [line[at], rng.choice(vocabulary)]])
            if len(line) >= lines.MIN_WORDS:
                lines_of[len(rows)] = line
                rows.append((len(rows), " ".join(line)))
    rows += [(len(rows) + i, "la la la la " * 3 + w) for i, w in enumerate(("one", "two three"))]
    lines_of |= {k: t.split() for k, t in rows[-2:]}
    first = {k: k for k in lines_of}
    pairs = [(a, b) for a in lines_of for b in lines_of if a < b and abs(len(lines_of[a]) - len(lines_of[b])) <= 25 and set(lines_of[a]) & set(lines_of[b])]
    for a, b in pairs:
        if edit_distance(lines_of[a], lines_of[b]) * 5 <= max(len(lines_of[a]), len(lines_of[b])):
            low, high = sorted((first[a], first[b]))
            first = {k: low if v == high else v for k, v in first.items()}
    df = spark.createDataFrame(rows, "key long, text string")
    got = {r["key"] for r in lines.find_copies(df, "key", "text").collect()}
    assert got == {k for k, v in first.items() if v != k} and len(got) > 150


def test_short_copies_and_unspaced_lines(spark):
    han = "今天天气很好我们一起去公园散步吧然后回家吃饭"
    rows = [(1, "All rights reserved.\n}\n" + han), (2, "all rights reserved\n}\n" + han.replace("公", "花")), (3, "some rights reserved\n\n"), (4, "\n" + han[:3])]
    df = spark.createDataFrame(rows, "key long, text string")
    assert {(r["key"], r["line_no"]) for r in lines.find_copies(df, "key", "text", short=True).collect()} == {(2, 0), (2, 2)}


def test_lines_of_one_template_stay_if_their_words_differ(spark):
    """15 words, 4 of them random: similarity 0.73, which equal hashes of words must not lift."""
    rng = random.Random(31)
    start = "the quick report of station number one says that"
    texts = [f"{start} {' '.join('w' + str(rng.randrange(10**9)) for _ in range(4))} at noon" for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    assert lines.find_copies(df, "key", "text").count() == 0


def test_word_numbers_reach_beyond_the_first_plane(spark):
    words = [f"w{i}" for i in range(2_500)]
    df = spark.createDataFrame([(words, list(reversed(words)))], "a array<string>, b array<string>")
    row = df.select(lines.numbered(F.col("a"), F.array_union("a", "b")).alias("x"), lines.numbered(F.col("b"), F.array_union("a", "b")).alias("y")).first()
    assert len(set(row.x)) == 2_500 and row.y == row.x[::-1] and ord(row.x[0]) == 0x10000 and ord(row.x[-1]) == 0x10000 + 2_499


def test_rows_of_one_key_and_names_that_clash(spark):
    same = "one two three four five six seven eight nine ten"
    rows = [(1, f"alone here with quite other words than all the rest\n{same}"), (2, f"{same}\nx"), (2, "only this row has words such as these ones in it"), (3, same), (3, same)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("_key", "_gone", "key", "gone", "row", "print", "line_no", "n_lines"):
        df = df.withColumn(name, F.lit("kept"))
    cleaned = lines.deduplicate(df, "doc_id", "text")
    got = sorted((r["doc_id"], r["text"], r["n_lines"], r["n_removed"], r["_key"], r["_gone"], r["row"]) for r in cleaned.collect())
    rest = ("kept", "kept", "kept")
    assert got == sorted([(1, rows[0][1], 2, 0, *rest), (2, "x", 2, 1, *rest), (2, rows[2][1], 1, 0, *rest), (3, "", 1, 1, *rest), (3, "", 1, 1, *rest)])
    assert set(cleaned.columns) == {*df.columns, "n_removed"}


def test_lines_that_share_word_pairs_alone_meet_in_no_bucket(spark):
    """Every pair of neighbouring words occurs in many lines, a triple in one: none of them can be alike."""
    rng = random.Random(7)
    heads = [f"a{i} b{i}" for i in range(40)]
    rows = [(k, " ".join(f"{rng.choice(heads)} x{k}y{j}" for j in range(8))) for k in range(60)]
    copy = (60, rows[0][1].upper())  # one line with the first, as an exact copy
    split = lines.materialize(lines.split_lines(spark.createDataFrame([*rows, copy], "key long, text string"), "key", "text"), "lines")
    hashes = lines.materialize(lines.simhash(split), "hashes")
    assert hashes.count() == 60 and lines.first_lines(split, hashes).count() == 60
    assert lines.word_buckets(split, hashes).count() == 0


def test_alike_lines_share_a_word_triple_of_their_prefix(spark):
    rng = random.Random(19)
    rows = []
    for n in range(8, 41):
        base = [f"w{n}x{i}" for i in range(n)]
        line = list(base)
        for at in range(2, 5 * (n // 5), 5):  # as many edits as are allowed, as far apart as they can be
            line[at] = f"e{rng.randrange(10**9)}"
        longer = list(base)
        for at in range((n + 1) // 5, 0, -1):
            longer.insert(at * n // ((n + 1) // 5 + 1), f"i{rng.randrange(10**9)}")
        rows += [(len(rows) + i, " ".join(x)) for i, x in enumerate((base, line, longer))]
    split = lines.materialize(lines.split_lines(spark.createDataFrame(rows, "key long, text string"), "key", "text"), "lines")
    met = lines.word_buckets(split, lines.materialize(lines.simhash(split), "hashes")).select(lines.number_of(F.col("entry")).alias("id"))
    assert {r["key"] for r in split.join(met.distinct(), "id").collect()} == {k for k, _ in rows}


def test_shuffle_files_of_line_dedup_go_with_its_steps(spark):
    left = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    rows = [(k, f"alpha beta gamma delta epsilon zeta eta theta iota {k % 20}\nsome line of quite other words that is number {k}") for k in range(200)]
    df = spark.createDataFrame(rows, "key long, text string")
    with session.shuffles_freed(spark):
        before = left()
        lines.materialize(lines.find_copies(df, "key", "text"), "copies")
        assert left() <= before
    assert spark.conf.get(session.FREE_SHUFFLES) == "false"
