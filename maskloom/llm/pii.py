"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

DataFrame functions only, and no shuffle: each text is searched in place. A pattern's matches come from
regexp_extract_all and the stretches between them from split by the same pattern, so one fold over the
two lists gives code-point positions. The patterns below find what the plain ones in PLAIN find, but
with possessive runs and look-behind, so that a long run without a match costs linear time; for cards
only runs of 12 to 19 digits are proposed at all.

Kinds of the contract: email, ip (parts at most 255), card (12 to 19 digits passing Luhn) and phone
(9 to 15 digits). The method adds iban, confirmed by mod 97, ssn (a number that can be given out) and secret (long runs of
mixed letters and digits). Scores are percentages, raised by a context word shortly before a span; a span that the
method adds stays only if its score reaches SURE, so an ssn or a secret needs its context.

Defined cases: null text is empty and has no spans; every row gives one row, repeated ones too; an
empty table gives an empty result; texts are searched whole, however long; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: The kinds in the order of the contract, with their plain patterns.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "secret": r"[A-Za-z0-9_-]{20,}",
}

#: Kinds whose spans the contract fixes; the method's own follow them, and stay only if their score reaches SURE.
BASE = 4
SURE = 60

#: The same matches (cards: those of the right length) in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_-])",
    "secret": r"[A-Za-z0-9_-]{20,}+",
}

#: Score of a confirmed span in percent, what a context word adds, and the context words, whole ones.
SCORES = {
    "email": (80, 15, "mail|e-mail|email|contact|write|reach"),
    "ip": (60, 30, "ip|addr|address|host|server|login"),
    "card": (85, 14, "card|visa|credit|debit|pay|payment"),
    "phone": (60, 35, "tel|phone|call|mobile|fax|ring"),
    "iban": (90, 9, "iban|bank|account|konto|compte"),
    "ssn": (45, 45, "ssn|social|security|insurance"),
    "secret": (40, 50, "token|secret|password|passwd|pwd|key|apikey|auth|bearer|credential|credentials"),
}

#: Code points before a span in which context words count.
CONTEXT = 40



def context(words: str) -> str:
    """Pattern of any of the words between characters that are neither ASCII letters nor digits."""
    return f"(?:^|[^a-z0-9])(?:{words})(?:[^a-z0-9]|$)"


_IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)

    def step(acc, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0)


def mod97(code: Column) -> Column:
    """Remainder by 97 of an account number: first four characters moved to the end, letters as 10 to 35."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(acc, i):
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step)


def confirmed(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.rlike(rf"^{_IP_PART}(?:\.{_IP_PART}){{3}}$")
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(found, " ", "")) == 1
    if kind == "ssn":  # areas, groups and serials that are never given out
        return ~found.rlike("^(?:000|666|9)") & ~found.rlike("-00-") & ~found.rlike("-0000$")
    if kind == "secret":  # mixed letters and digits, as chance makes them
        return (F.length(digits) >= 4) & (F.length(F.regexp_replace(found, "[^A-Za-z]", "")) >= 4)
    return F.lit(True)


#: Matches of a kind that are put together before they are added to a text's others.
FOLD = 64


def spans_of(kind: str, rank: int, text: Column) -> Column:
    """Array of (start, kind, end, score) of the confirmed spans of one kind."""
    pattern, (score, more, words) = F.lit(PATTERNS[kind]), SCORES[kind]
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,score:int>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["between"])
        end = start + F.length(x["found"])
        near = F.lower(F.substring(x["between"], -CONTEXT, CONTEXT)).rlike(context(words))
        points = score + F.when(near, more).otherwise(0)
        span = F.struct(start.alias("start"), F.lit(rank).alias("kind"), end.alias("end"), points.alias("score"))
        stays = confirmed(kind, x["found"]) if rank < BASE else confirmed(kind, x["found"]) & (points >= SURE)
        return F.struct(end.alias("at"), F.when(stays, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    pairs = F.zip_with(found, between, lambda f, b: F.struct(f.alias("found"), b.alias("between")))
    pairs = F.filter(pairs, lambda x: x["found"].isNotNull())
    # A span found is added to those of its block of FOLD matches, and a whole block to the blocks before it: a text full of matches is not copied again and again.
    blocks = F.transform(F.sequence(F.lit(0), F.call_function("div", F.greatest(F.size(pairs) - 1, F.lit(0)), F.lit(FOLD)).cast("int")), lambda b: F.slice(pairs, b * FOLD + 1, F.lit(FOLD)))

    def add_block(acc, block):
        inner = F.aggregate(block, F.struct(acc["at"].alias("at"), empty.alias("spans")), step)
        return F.get(F.transform(F.array(inner), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["spans"], F.array(x["spans"])).alias("spans"))), F.lit(0))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<struct<start:bigint,kind:int,end:bigint,score:int>>>").alias("spans"))
    folded = F.aggregate(blocks, start, add_block, lambda acc: F.flatten(acc["spans"]))
    return F.when(text.rlike(PATTERNS[kind]), folded).otherwise(empty)


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and spans, an array of (start, kind, end, score) by start, then kind; end is exclusive."""
    text = text_or_empty()
    return docs.select("doc_id", F.array_sort(F.concat(*[spans_of(kind, k, text) for k, kind in enumerate(PLAIN)])).alias("spans"))


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts and texts of the spans that find_pii returns."""
    kinds = list(PLAIN)
    name = lambda s: F.get(F.array(*[F.lit(k) for k in kinds]), s["kind"])
    place = lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(kinds)]
    return found.select(
        "doc_id", *counts, F.size("spans").cast("long").alias("n_spans"), F.sha2(F.array_join(F.transform(base, place), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", place), ",").alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
