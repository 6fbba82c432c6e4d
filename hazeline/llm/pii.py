"""Personal data in text, with DataFrame functions only.

Patterns propose spans, checks confirm them, and words that stand near a span
raise or lower its score. Positions count code points from 0, ends exclusive.

Kinds, in the order that breaks ties of position:

    email, ip, card, phone    the base: pattern and check alone decide
    iban                      two letters, two digits, as many more as the country has (11 to 30 if it is not in `LENGTHS`); mod-97 is 1
    ssn                       three, two and four digits; needs a context word

A pattern is applied twice, once for its matches and once for what stands
between them; the running lengths of both give the positions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

#: Characters of an account number by country, from the registry of ISO 13616.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
COUNTRIES = "|".join(" ".join(LENGTHS.values()).split())
#: The length of the country first, so that a match does not run into what follows; any other stops before the next account number.
IBAN = "(?:{}|{})".format(
    "|".join(rf"(?:{'|'.join(names.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, names in LENGTHS.items()),
    rf"[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20(?:{COUNTRIES})[0-9]{{2}})\x20?[A-Z0-9]){{11,30}}",
)

# A match can only begin where a run of its first characters begins, or where the
# match before ended (\G). Saying so, with possessive runs, keeps long runs linear
# and off the stack; what is found stays the same.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})" + IBAN,
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: What a text must hold before its pattern is tried.
HINTS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "ssn": "-[0-9]{2}-"}
#: Score of a confirmed pattern before its context is read.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social", "security"),
}
#: Words that speak against personal data: order numbers, versions, examples.
AGAINST = ("order", "version", "invoice", "isbn")
NEAR, STEP, LEAST = 40, 0.2, 0.5
#: Characters in a piece of a text, when parts of it are looked up by position.
PIECE = 256
RUN = 256


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.split(F.reverse(number), "")
    doubled = F.transform(each, lambda d, i: d.cast("int") * (i % 2 + 1))
    return F.aggregate(F.transform(doubled, lambda d: d - F.when(d > 9, 9).otherwise(0)), F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(number: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters
    read as 10 to 35, leaves 1 when divided by 97."""
    moved = F.concat(F.substring(number, 5, 100), F.substring(number, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        value = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


#: Characters that may not stand right beside a match.
BESIDE = {"iban": "[A-Za-z0-9]", "ssn": "[0-9-]"}


def confirmed(kind: str, match: Column, before: Column, after: Column) -> Column:
    """Whether a match passes its check, given the text before and after it."""
    if kind in BESIDE:
        alone = ~(before.rlike(BESIDE[kind] + "$") | after.rlike("^" + BESIDE[kind]))
        return F.when(alone, mod97(F.regexp_replace(match, " ", "")) if kind == "iban" else F.lit(True)).otherwise(False)
    if kind == "ip":
        return match.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    if kind == "card":
        number = digits(match)
        return F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    return F.lit(True)


def score(kind: str, before: Column, after: Column) -> Column:
    """Score of a confirmed span from the text just before and after it."""
    near = F.lower(F.concat_ws(" ", before, after))
    word = "(?:^|[^a-z])(?:{})"
    up = F.when(near.rlike(word.format("|".join(CONTEXT[kind]))), STEP).otherwise(0.0)
    down = F.when(near.rlike(word.format("|".join(AGAINST))), STEP).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(SCORES[kind]) + up - down))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(items: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Running position and outputs over `items`: (at, out).

    `step` takes the position and an item, and gives the new position and an
    output of type `kind`, null for none. Outputs are gathered in runs of `RUN`,
    so long arrays are not copied once for every item.
    """
    none, runs = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(state: Column, x: Column) -> Column:
        at, new = step(state["at"], x)
        return let(new.cast(kind), lambda n: F.struct(
            at.alias("at"), F.when(n.isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(n))).alias("out")
        ))

    def run(state: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(state["at"].alias("at"), none.alias("out")), one)
        return let(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(state["out"], F.array(r["out"])).alias("out")))

    def whole(every: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(every) - 1), F.lit(RUN)), lambda i: F.slice(every, i + 1, RUN))
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), runs.alias("out")), run)

    return let(items, lambda every: let(whole(every), lambda s: F.struct(s["at"].alias("at"), F.flatten(s["out"]).alias("out"))))


def part(pieces: Column, first: Column, n: Column | int) -> Column:
    """At most `NEAR` characters of a text from a position on, given its pieces."""
    i = F.floor(first / PIECE).cast("int")
    both = F.concat(F.coalesce(F.get(pieces, i), F.lit("")), F.coalesce(F.get(pieces, i + 1), F.lit("")))
    return F.substring(both, first - i * PIECE + 1, n)


def spans_of(kind: str, text: Column) -> Column:
    """Confirmed spans of one kind as an array of (order, start, end, score, text)."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    # Matches and gaps are zipped, then folded in one pass; the position is where the
    # next gap begins. The gap after the last match has no match and falls away. What is
    # near a match is read from the text, as other matches may stand there.
    zipped = F.arrays_zip(found.alias("m"), between.alias("gap"))
    pairs = F.filter(zipped, lambda x: x["m"].isNotNull())

    def step(at: Column, x: Column, pieces: Column) -> tuple[Column, Column]:
        first = at + F.char_length(x["gap"])
        last = first + F.char_length(x["m"])
        start = F.greatest(F.lit(0), first - NEAR)
        before, after = part(pieces, start, first - start), part(pieces, last, F.lit(NEAR))
        span = F.struct(
            F.lit(KINDS.index(kind)).alias("order"), first.alias("start"), last.alias("end"),
            score(kind, before, after).alias("score"), x["m"].alias("text"),
        )
        return last, F.when(confirmed(kind, x["m"], before, after), span)

    every = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda p: fold(pairs, SPAN, lambda at, x: step(at, x, p))["out"])
    kept = every if kind in BASE else F.filter(every, lambda s: s["score"] >= LEAST)
    return F.when(text.rlike(HINTS[kind]), kept).otherwise(F.array().cast(f"array<{SPAN}>"))


SPAN = "struct<order:int,start:int,end:int,score:double,text:string>"


def find_spans(df: DataFrame, text: str, out: str = "spans") -> DataFrame:
    """`df` with an array of spans by start, then kind: (kind, start, end, score, text).

    Null text has none. Spans of different kinds may overlap; those of one kind
    do not. A column of the name `out` is replaced.
    """
    value = F.coalesce(df[text], F.lit(""))
    every = F.concat(*[spans_of(kind, value) for kind in KINDS])
    by_start = F.array_sort(
        F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["score"].alias("score"), s["text"].alias("text")))
    )
    names = F.array(*map(F.lit, KINDS))
    return df.withColumn(
        out,
        F.transform(
            by_start,
            lambda s: F.struct(F.get(names, s["order"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), s["text"].alias("text")),
        ),
    )


def digest(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """`text` with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    def step(at: Column, s: Column) -> tuple[Column, Column]:
        new = F.concat(F.substring(text, at + 1, s["start"] - at), F.lit("<"), s["kind"], F.lit(">"))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, new)

    changed = let(fold(spans, "string", step), lambda done: F.concat(
        F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.char_length(text))
    ))
    return F.when(F.size(spans) == 0, text).otherwise(changed)


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def is_base(span: Column) -> Column:
    return reduce(lambda a, b: a | b, [span["kind"] == k for k in BASE])
