"""Fuzzy line deduplication, with DataFrame functions only.

1. Lines are normalised (lower case, runs of anything but letters and digits
   become a space; a character of a script without spaces is a word). Those of
   fewer than `MIN_WORDS` words are compared with nothing, but may be removed as
   exact copies. Lines without letters and digits are left alone.
2. A 64-bit SimHash is made of a line's words. The ones of each bit are counted
   in sixteen numbers of four 16-bit lanes, so a word costs sixteen additions.
3. Two lines are alike when their edit similarity over words is at least
   `SIMILARITY`, whatever their SimHashes.
4. Of each connected group the first occurrence stays, by doc_id, then line.

Exact copies are grouped before any comparison. Lines that may be alike are found
twice. With five blocks of 12 or 13 bits, SimHashes that differ in at most
`NEAR_BITS` bits agree on a pair of blocks; the entry of most copies in such a bucket
is compared with the others, which links most copies early. No pair is left to it:
an edit touches three word triples at most, so alike lines of n words lack at most about
3n/5 of each other's, and in any order of all word triples the first `prefix_size` of
both lines have one in common. Every line is an entry of the buckets of these; rare
triples come first in the order. The first line of a bucket is compared with the others,
and then all pairs across the components found so far, so no link is lost. Pairs whose
word bits, one of 256 for each word, differ in more places than edits allow are left out first.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.llm.components import components
from hazeline.llm.pii import let
from hazeline.session import materialize, shuffles_freed

MIN_WORDS = 8
#: SimHash distance that alike lines may have: any.
BITS = 64
#: SimHash distance at which lines are compared with a hub.
NEAR_BITS = 3
SIMILARITY = 0.8
#: (first bit, width) of the five blocks of a SimHash.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
PAIRS = tuple(combinations(range(len(BLOCKS)), 2))
LANES, WIDTH = 16, 16
#: Columns of 64 bits each, a power of two of them, that tell which words a line has.
WORD_BITS = ("m0", "m1", "m2", "m3")
#: Bits of a triple's hash; those above tell how common it is. Bits beside a line's number that tell its words, up to `MOST_WORDS`.
HASH_BITS, SIZE_BITS = 56, 8
MOST_WORDS = (1 << SIZE_BITS) - 1
#: One line in so many is counted to learn which word triples are common; at most so many are kept, in a table of so many bytes.
SAMPLED, COMMON, TABLE = 16, 50_000, 1 << 18
#: Line numbers that a join may broadcast, 8 bytes each; beyond that it shuffles the other side.
BROADCAST_ROWS = 2_000_000
#: A lane counts to less than 2**14, which leaves a bit for the comparison and one for the sign.
PART = 1 << 14
ONES = 0x0001000100010001


#: Characters of scripts that put no spaces between words; each is a word.
#: All of them lie beyond the range named first, which spares most texts the lookup of scripts.
UNSPACED = r"([\x{0E00}-\x{10FFFF}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]])"


#: Runs of anything but letters, digits and line ends.
REST = r"[^a-z0-9\n\p{L}\p{N}]++"


def normalised(text: Column) -> Column:
    r"""Lower case, runs of anything but letters and digits as a space, spaces about unspaced characters; \n stays."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), UNSPACED, " $1 "), REST, " ")


def split_lines(df: DataFrame, key: str, text: str, least: int = MIN_WORDS) -> DataFrame:
    r"""`id, key, print, line_no, line_key, n_words, words` of every line of `least` words or more; lines end at \n.

    `id` numbers the rows; write them before using it more than once. `print` tells apart
    rows that share a key but not their text.
    """
    # Whole texts are hashed and normalised below the generator, which would carry them to each line.
    whole = df.select(df[key].alias("key"), F.xxhash64(df[text]).alias("print"), normalised(df[text]).alias("flat"))
    lines = whole.select("key", "print", F.posexplode(F.split("flat", "\n")).alias("line_no", "line"))
    words = lines.select("key", "print", "line_no", F.trim("line").alias("words"))
    counted = words.withColumn("n_words", F.char_length("words") - F.char_length(F.replace("words", F.lit(" "))) + 1)
    numbered = counted.where((F.col("n_words") >= least) & (F.col("words") != "")).withColumn("id", F.monotonically_increasing_id())
    return numbered.select("id", "key", "print", "line_no", F.unhex(F.md5("words")).alias("line_key"), "n_words", "words")


def simhash(lines: DataFrame) -> DataFrame:
    """`line_key, id, n, s, n_words, m0, ...`: one row of it, copies, SimHash, size and word bits of each distinct line."""
    mask = F.lit(ONES)
    lanes = [F.sum(F.shiftrightunsigned("_hash", i).bitwiseAND(mask)).alias(f"l{i}") for i in range(LANES)]
    count = F.max("n_words").alias("n_words")
    # A word sets one bit of all those of `WORD_BITS`.
    bits = [F.expr(f"bit_or(if((_hash >> 6) & {len(WORD_BITS) - 1} = {i}, shiftleft(1L, cast(_hash & 63 as int)), 0L))").alias(m) for i, m in enumerate(WORD_BITS)]
    places = [(i, p) for i in range(LANES) for p in range(64 // LANES)]
    # Numbers alone are grouped, which is several times cheaper than grouping by the line's key.
    words = lines.where(F.col("n_words") < PART).select("id", "n_words", F.explode(F.split("words", " ")).alias("word"))
    sums = words.select("id", "n_words", F.xxhash64("word").alias("_hash")).groupBy("id").agg(count, *bits, *lanes)
    # Four lanes at once: a count of more than half the words carries into bit 14.
    lift = (F.lit(PART - 1) - F.floor(F.col("n_words") / 2)).cast("long") * ONES
    carried = [F.shiftleft(F.shiftrightunsigned(F.col(f"l{i}") + F.col("lift"), 14).bitwiseAND(mask), i) for i in range(LANES)]
    short = sums.withColumn("lift", lift).select("id", reduce(Column.bitwiseOR, carried).alias("s"), *WORD_BITS)
    # Longer lines are counted in parts.
    words = lines.where(F.col("n_words") >= PART).select("id", "n_words", F.posexplode(F.split("words", " ")).alias("at", "word"))
    parts = words.select("id", "n_words", F.floor(F.col("at") / PART).alias("part"), F.xxhash64("word").alias("_hash")).groupBy("id", "part").agg(count, *bits, *lanes)
    wide = parts.groupBy("id").agg(count, *[F.bit_or(m).alias(m) for m in WORD_BITS], *[F.sum(ones(i, p)).alias(f"b{i + LANES * p}") for i, p in places])
    long = wide.select("id", reduce(Column.bitwiseOR, [bit(F.col(f"b{i}"), i) for i in range(64)]).alias("s"), *WORD_BITS)
    every = lines.select("id", "line_key", "n_words").join(short.unionByName(long), "id")
    return every.groupBy("line_key").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.min("s").alias("s"), F.min("n_words").alias("n_words"), *[F.min(m).alias(m) for m in WORD_BITS])


def ones(lane: int, place: int) -> Column:
    return F.shiftrightunsigned(F.col(f"l{lane}"), WIDTH * place).bitwiseAND(F.lit(0xFFFF))


def bit(count: Column, place: int) -> Column:
    value = 1 << place
    return F.when(count * 2 > F.col("n_words"), F.lit(value - (1 << 64) if place == 63 else value)).otherwise(F.lit(0)).cast("long")


def block(s: Column, n: int) -> Column:
    first, width = BLOCKS[n]
    return F.shiftrightunsigned(s, first).bitwiseAND(F.lit((1 << width) - 1))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def buckets(classes: DataFrame) -> DataFrame:
    """`s, hub` of the SimHashes near the hub of a bucket, the one of most copies."""
    s = F.col("s")
    choice = F.explode(F.sequence(F.lit(0), F.lit(len(PAIRS) - 1))).alias("i")
    bucket = F.lit(None).cast("long")
    for i, (a, b) in enumerate(PAIRS):
        both = F.shiftleft(block(s, a), 17).bitwiseOR(F.shiftleft(block(s, b), 4)).bitwiseOR(F.lit(i))
        bucket = F.when(F.col("i") == i, both).otherwise(bucket)
    # The bucket follows from the SimHash, so it is not shuffled with it.
    every = classes.select("s", "n", choice).repartition(bucket).withColumn("bucket", bucket)
    whole = Window.partitionBy("bucket")
    hub = F.max(F.struct("n", "s")).over(whole)["s"].alias("hub")
    return every.select("s", hub).where((F.col("s") != F.col("hub")) & (distance(F.col("s"), F.col("hub")) <= NEAR_BITS)).distinct()


def word_triples(words: Column) -> Column:
    """Hashes of the distinct triples of neighbouring words, of lines of three words or more."""
    def of(w: Column) -> Column:
        from_nth = lambda n: F.slice(w, F.lit(n), F.size(w) - 2)
        two = F.zip_with(from_nth(1), from_nth(2), lambda a, b: F.xxhash64(a, b))
        return F.array_distinct(F.zip_with(two, from_nth(3), lambda ab, c: F.xxhash64(ab, c)))

    return let(F.split(words, " "), of)


def prefix_size(n_words: Column) -> Column:
    """One more than the word triples that a line of so many words can lack in a line like it.

    Up to n/5 edits touch three triples each. A line like it that is longer by d words may
    allow an edit more, but then d of them add a word and touch two triples each.
    """
    return (F.floor(n_words / 5) * 3 + F.greatest(n_words % 5 - 2, F.lit(0)) + 1).cast("int")


def place(triple: Column) -> Column:
    return F.pmod(triple, F.lit(TABLE)).cast("int")


def commonness(distinct: DataFrame) -> bytearray:
    """By place of a word triple, how common it is: the bits of its number in a sample of the lines.

    It only orders the triples, so the lines found do not depend on the sample.
    """
    some = distinct.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0)
    counts = some.select(F.explode(word_triples(F.col("words"))).alias("triple")).groupBy("triple").count().where("count > 1")
    table = bytearray(TABLE)
    for r in counts.orderBy(F.desc("count"), "triple").limit(COMMON).select(place(F.col("triple")).alias("at"), "count").collect():
        table[r["at"]] = max(table[r["at"]], r["count"].bit_length())
    return table


def ranked(triple: Column, common: Column) -> Column:
    """The triple as one number that sorts by how common it is, then by its hash."""
    bits = F.ascii(F.substring(common, place(triple) + 1, F.lit(1)).cast("string")).cast("long")
    return F.shiftleft(bits, HASH_BITS).bitwiseOR(triple.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))


def entry(line_id: Column, n_words: Column) -> Column:
    """Number and words of a line in one number, in the order of the numbers."""
    return F.shiftleft(line_id, SIZE_BITS).bitwiseOR(F.least(n_words, F.lit(MOST_WORDS)).cast("long"))


def number_of(entry: Column) -> Column:
    return F.shiftright(entry, SIZE_BITS)


def entries_fit(a: Column, b: Column) -> Column:
    """`sizes_fit` of two entries; of lines of more than `MOST_WORDS` words it lets more through."""
    return sizes_fit(a.bitwiseAND(F.lit(MOST_WORDS)), b.bitwiseAND(F.lit(MOST_WORDS)))


def first_lines(lines: DataFrame, hashes: DataFrame) -> DataFrame:
    """`id, n_words, words` of one line of each distinct one, the others being left out by number: they are far fewer than the texts kept."""
    repeated = hashes.where("n > 1").select("line_key", F.col("id").alias("first"))
    others = materialize(lines.select("line_key", "id").join(repeated, "line_key").where("id <> first").select("id"), "later")
    return lines.select("id", "n_words", "words").join(small_side(others, others.count()), "id", "left_anti")


def word_buckets(lines: DataFrame, hashes: DataFrame) -> DataFrame:
    """`triple, entry, hub`: the distinct lines by the first of their word triples, where there is more than one."""
    distinct = first_lines(lines, hashes)
    common = F.lit(bytes(commonness(distinct)))
    ordered = F.sort_array(F.transform(word_triples(F.col("words")), lambda t: ranked(t, common)))
    rows = distinct.select(entry(F.col("id"), F.col("n_words")).alias("entry"), F.explode(F.slice(ordered, F.lit(1), prefix_size(F.col("n_words")))).alias("triple"))
    whole = Window.partitionBy("triple")
    shared = rows.withColumns({"size": F.count("*").over(whole), "hub": F.min("entry").over(whole)}).where("size > 1")
    return shared.select("triple", "entry", "hub")


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """`df` as the side to broadcast of a join if its `rows` are known to be few; the join shuffles beyond."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def symbol(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(20_000))


def as_symbols(words: Column) -> Column:
    """Every word as one character, so that an edit distance over characters is one over words.

    The 20,000 characters are picked by hash, so different words may look equal: the
    distance is the true one at most, and what it lets through is compared by `exact`.
    """
    return F.decode(F.unhex(F.array_join(F.transform(F.split(words, " "), lambda w: F.hex(symbol(w) + 0x4E00)), "")), "UTF-16BE")


def most_edits(n_a: Column, n_b: Column) -> Column:
    return F.floor(F.greatest(n_a, n_b) * (1 - SIMILARITY) + 1e-9).cast("int")


def sizes_fit(n_a: Column, n_b: Column) -> Column:
    """Whether lines of these numbers of words can be similar at all."""
    return F.abs(n_a - n_b) <= most_edits(n_a, n_b)


def plausible(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """Those pairs (a, b) of line ids of which few enough word bits are set for one line alone.

    Each such bit stands for a word that the other line lacks, which takes an edit, so no alike pair is lost.
    """
    one, other = (hashes.select(F.col("id").alias(x), F.col("n_words").alias(f"n{x}"), *[F.col(m).alias(m + x) for m in WORD_BITS]) for x in ("a", "b"))
    alone = lambda x, y: sum(F.bit_count(F.col(m + x).bitwiseAND(F.bitwise_not(F.col(m + y)))) for m in WORD_BITS)
    few = sizes_fit(F.col("na"), F.col("nb")) & (F.greatest(alone("a", "b"), alone("b", "a")) <= most_edits(F.col("na"), F.col("nb")))
    return pairs.join(one, "a").join(other, "b").where(few).select("a", "b")


def foreign(a: Column, b: Column) -> Column:
    """Words of `a` that do not occur in `b`; each takes an edit."""
    return F.char_length(F.call_function("translate", a, b, F.lit("")))


def similar(a: Column, b: Column, n_a: Column, n_b: Column) -> Column:
    """Whether the edit similarity over words is high enough; lengths, then words that only one has, rule out most others."""
    most = most_edits(n_a, n_b)
    near = F.call_function("levenshtein", a, b, most)  # -1 beyond
    return sizes_fit(n_a, n_b) & (foreign(a, b) <= most) & (foreign(b, a) <= most) & (near >= 0)


def clashing(among: Column) -> Column:
    """The words `among` those of a pair that share their symbol with another one."""
    ordered = F.sort_array(F.transform(among, lambda w: F.struct(symbol(w).alias("symbol"), w.alias("word"))))
    same = lambda o, i, x: F.coalesce(F.get(o, i)["symbol"] == x["symbol"], F.lit(False))
    return let(ordered, lambda o: F.transform(F.filter(o, lambda x, i: same(o, i - 1, x) | same(o, i + 1, x)), lambda x: x["word"]))


def numbered(words: Column, among: Column) -> Column:
    """`as_symbols` of an array of words, but a character of its own, by its place there, for each word of `among`."""
    def one(w: Column) -> Column:
        place = F.array_position(among, w).cast("int") - 1
        own = F.concat(F.hex(F.shiftright(place, 10) + 0xD800), F.hex(place.bitwiseAND(0x3FF) + 0xDC00))
        return F.when(place >= 0, own).otherwise(F.hex(symbol(w) + 0x4E00))

    return F.decode(F.unhex(F.array_join(F.transform(words, one), "")), "UTF-16BE")


def exact(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Those pairs (a, b) of line ids whose words themselves are similar."""
    found = lines.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi").select("id", "n_words", F.split("words", " ").alias("w"))
    held = materialize(found, "pair_words")
    left, right = (held.select(F.col("id").alias(x), F.col("w").alias(f"w{x}"), F.col("n_words").alias(f"n{x}")) for x in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b")

    def still_near(clash: Column) -> Column:
        edits = F.call_function("levenshtein", numbered(F.col("wa"), clash), numbered(F.col("wb"), clash), most_edits(F.col("na"), F.col("nb")))
        # Without two words of one symbol the distance over symbols was the true one already.
        return (F.size(clash) == 0) | (edits >= 0)

    return both.where(let(clashing(F.array_union("wa", "wb")), still_near)).select("a", "b")


def verify(pairs: DataFrame, symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """Those pairs (a, b) of line ids that are similar."""
    left = symbols.select(F.col("id").alias("a"), F.col("symbols").alias("sa"), F.col("n_words").alias("na"))
    right = symbols.select(F.col("id").alias("b"), F.col("symbols").alias("sb"), F.col("n_words").alias("nb"))
    both = pairs.join(left, "a").join(right, "b")
    near = both.where(similar(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb"))).select("a", "b")
    return exact(materialize(near, "near"), lines)


def symbols_of(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """`id, n_words, symbols` of the lines in `pairs`."""
    needed = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "needed")
    found = lines.join(small_side(needed, needed.count()), "id", "left_semi")
    return materialize(found.select("id", "n_words", as_symbols(F.col("words")).alias("symbols")), "symbols")


def links(lines: DataFrame, hashes: DataFrame) -> DataFrame:
    """Verified links (a, b) of line ids that connect every group of alike lines."""
    # One line stands for all of a SimHash in the first round; the others are compared with it.
    classes = materialize(hashes.groupBy("s").agg(F.min("id").alias("rep"), F.sum("n").alias("n"), F.count("*").alias("size")), "classes")
    star = buckets(classes).select(F.col("s").alias("x"), F.col("hub").alias("y"))
    reps = classes.select("s", "rep")
    named = star.join(reps.select(F.col("s").alias("x"), F.col("rep").alias("a")), "x").join(
        reps.select(F.col("s").alias("y"), F.col("rep").alias("b")), "y"
    ).select("a", "b")
    inside = hashes.join(classes.where("size > 1").select("s", "rep"), "s").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    shared = materialize(word_buckets(lines, hashes), "buckets")
    apart = shared.where((F.col("entry") != F.col("hub")) & entries_fit(F.col("entry"), F.col("hub")))
    beside = apart.select(number_of(F.col("entry")).alias("a"), number_of(F.col("hub")).alias("b"))
    every = named.unionByName(inside).unionByName(beside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    wanted = materialize(plausible(every.distinct(), hashes), "first_pairs")
    first = materialize(verify(wanted, symbols_of(lines, wanted), lines), "first_links")
    labels = components(first, "a", "b").withColumnRenamed("node", "id")

    # What the first round left apart: pairs of different components within a bucket.
    rows = shared.select("triple", "entry", number_of(F.col("entry")).alias("id")).join(small_side(labels, labels.count()), "id", "left")
    whole = Window.partitionBy("triple")
    by_component = rows.select("triple", "entry", F.coalesce("component", "id").alias("component"))
    mixed = by_component.withColumns({"low": F.min("component").over(whole), "high": F.max("component").over(whole)}).where("low <> high")
    rows = materialize(mixed.select("triple", "entry", "component"), "entries")
    l, r = rows.alias("l"), rows.alias("r")
    crossing = l.join(r, F.col("l.triple") == F.col("r.triple")).where((F.col("l.component") < F.col("r.component")) & entries_fit(F.col("l.entry"), F.col("r.entry")))
    pairs = crossing.select(number_of(F.least("l.entry", "r.entry")).alias("a"), number_of(F.greatest("l.entry", "r.entry")).alias("b")).distinct()
    second = materialize(plausible(pairs.join(wanted, ["a", "b"], "left_anti"), hashes), "second_pairs")
    if second.isEmpty():
        return first
    return first.unionByName(materialize(verify(second, symbols_of(lines, second), lines), "second_links"))


def find_copies(df: DataFrame, key: str, text: str, short: bool = False) -> DataFrame:
    """`key, print, line_no` of every line that repeats or resembles an earlier one of its group.

    With `short`, lines of fewer than `MIN_WORDS` words are groups of exact copies; without
    it they are left alone. Rows with the same key and text count as one occurrence, those with
    the same key and other texts are apart, told by `print`, a hash of the text. Null texts have no lines.
    """
    lines = materialize(split_lines(df, key, text, 1 if short else MIN_WORDS), "lines")
    long = lines.where(F.col("n_words") >= MIN_WORDS)
    hashes = materialize(simhash(long), "hashes")
    found = components(links(long, hashes), "a", "b")
    # Whatever has a component has a link; a line without one is its own group.
    named = hashes.join(found.withColumnRenamed("node", "id"), "id", "left").where("component is not null or n > 1")
    repeated = named.select("line_key", F.coalesce("component", "id").alias("group"))
    if short:
        copies = lines.where(F.col("n_words") < MIN_WORDS).groupBy("line_key").agg(F.min("id").alias("group"), F.count("*").alias("n")).where("n > 1")
        repeated = repeated.unionByName(copies.select("line_key", "group"))
    each = materialize(lines.select("key", "print", "line_no", "line_key").join(repeated, "line_key").select("key", "print", "line_no", "group"), "copies")
    where = F.struct("key", "print", "line_no")
    kept = each.groupBy("group").agg(F.min(where).alias("kept"))
    return each.join(kept, "group").where(~where.eqNullSafe(F.col("kept"))).select("key", "print", "line_no")


def deduplicate(df: DataFrame, key: str, text: str, short: bool = False) -> DataFrame:
    """`df` with `text` freed of copied lines, and `n_lines`, `n_removed` beside it; `short` as in `find_copies`.

    Null text stays null with no lines; empty text is one empty line. A text that
    loses all its lines becomes empty. Columns named n_lines or n_removed are
    replaced; all others stay, whatever their names.
    """
    with shuffles_freed(df.sparkSession):
        gone = materialize(find_copies(df, key, text, short).groupBy("key", "print").agg(F.collect_set("line_no").alias("gone")), "gone")
    n_gone = gone.agg(F.sum(F.size("gone") + 1)).first()[0] or 0
    row = F.struct(*[df[c] for c in df.columns]).alias("row")
    whole = df.select(row, df[key].alias("own_key"), F.xxhash64(df[text]).alias("own_print"))
    out = whole.join(small_side(gone, n_gone), F.col("own_key").eqNullSafe(F.col("key")) & (F.col("own_print") == F.col("print")), "left")
    old = F.col("row").getField(text)
    kept = F.array_join(F.filter(F.split(old, "\n"), lambda line, i: ~F.array_contains("gone", i)), "\n")
    made = {
        "n_lines": F.coalesce(F.size(F.split(old, "\n")).cast("long"), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("long"), text: F.when(F.col("gone").isNull(), old).otherwise(kept),
    }
    names = [*df.columns, *[n for n in ("n_lines", "n_removed") if n not in df.columns]]
    return out.select(*[(made[c] if c in made else F.col("row").getField(c)).alias(c) for c in names])
