"""Sentences, chunks, spoken parts, amounts and personal data of a text, as Column expressions in the JVM.

Each is a fold or a rewrite over arrays of a row, so nothing leaves the executor's process. White space is
the six ASCII characters that Java's \\s takes. Nulls count as empty texts; every text is read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

STRINGS = "array<string>"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def full(parts: Column) -> Column:
    return F.filter(F.transform(parts, stripped), lambda p: p != "")


# What ends a sentence; a stop ends none after a short capitalised abbreviation before a lower-case letter or digit.
_ABBREVIATED = r"(?<!(?<![A-Za-z])[A-Z][A-Za-z]{0,2}\.)"
SENTENCE_END = rf"(?<=[!?।])\s++|(?<=\.){_ABBREVIATED}\s++|(?<=\.)\s++(?![a-z0-9])"


def sentences(text: Column) -> Column:
    return full(F.split(F.coalesce(text, F.lit("")), SENTENCE_END))


def greedy(parts: Column, fits: Callable[[Column, Column], Column], glue: str) -> Column:
    """Join each part to the one before while `fits(before, part)` holds."""
    start = F.struct(F.array().cast(STRINGS).alias("done"), F.lit(None).cast("string").alias("open"))

    def step(state: Column, part: Column) -> Column:
        held = state["open"].isNotNull()
        joins = held & fits(state["open"], part)
        done = F.when(held & ~joins, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.when(joins, F.concat(state["open"], F.lit(glue), part)).otherwise(part).alias("open"))

    return F.aggregate(parts, start, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def _within(limit: int, glue: str):
    return lambda before, part: F.length(before) + len(glue) + F.length(part) <= limit


TARGET, MOST, LEAST, OVERLAP = 620, 900, 120, 90  # fixed values of the chunker


def _opened(packed: Column) -> Column:
    """Each chunk but the first opens with the end of the one before, from a word's edge."""

    def lead(chunk: Column, i: Column) -> Column:
        tail = stripped(F.right(F.get(packed, i - 1), F.lit(OVERLAP)))
        tail = let(tail, lambda t: F.when(t.rlike(r"^[^ ]+ +[^ ]"), F.regexp_replace(t, r"^[^ ]+ ", "")).otherwise(t))
        return F.when(i == 0, chunk).otherwise(let(tail, lambda t: F.when(t == "", chunk).otherwise(F.concat(F.lit("…"), t, F.lit(" "), chunk))))

    return F.transform(packed, lead)


def chunks(text: Column) -> Column:
    """Paragraphs, long ones as sentences up to TARGET, packed to MOST characters; short chunks go unless all are short."""

    def cut(body: Column) -> Column:
        paragraphs = full(F.split(body, r"\n\s*\n"))
        blocks = F.transform(paragraphs, lambda p: F.when(F.length(p) <= TARGET, F.array(p)).otherwise(greedy(sentences(p), _within(TARGET, " "), " ")))
        return let(greedy(F.flatten(blocks), _within(MOST, "\n"), "\n"), _opened)

    def pick(made: Column) -> Column:
        long = F.filter(made, lambda c: F.length(c) >= LEAST)
        return F.when(F.size(long) > 0, long).otherwise(made)

    body = F.regexp_replace(stripped(F.coalesce(text, F.lit(""))), r"\n{3,}", "\n\n")
    return let(body, lambda b: F.when(b == "", F.array().cast(STRINGS)).when(F.length(b) <= MOST, F.array(b)).otherwise(let(cut(b), pick)))


SPOKEN, SHORT = 180, 24


def spoken_parts(text: Column, limit: int = SPOKEN, least: int = SHORT) -> Column:
    """Sentences; long ones cut after a comma or before a conjunction, or else between words; short parts join their neighbour."""
    clause_end = r"(?<=[,;:])\s+|\s+(?=(?:and|but|or|because|while)\s)"
    words = rf"(?s)\s*(.{{1,{limit}}}(?=\s|$)|.{{{limit}}})"
    narrow = lambda c: F.when(F.length(c) > limit, F.regexp_extract_all(c, F.lit(words), 1)).otherwise(F.array(c))
    clauses = lambda s: F.when(F.length(s) > limit, F.flatten(F.transform(F.split(s, clause_end), narrow))).otherwise(F.array(s))
    parts = full(F.flatten(F.transform(sentences(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), clauses)))
    short = lambda before, part: ((F.length(part) < least) | (F.length(before) < least)) & (F.length(before) + 1 + F.length(part) <= limit)
    return greedy(parts, short, " ")


# Scale words of Indian amounts, and the widest gap inside one amount.
SCALES = {
    "crore": 10**7, "crores": 10**7, "cr": 10**7, "lakh": 10**5, "lakhs": 10**5, "lac": 10**5, "lacs": 10**5, "million": 10**6, "thousand": 1000, "hundred": 100,
    "करोड़": 10**7, "करोड": 10**7, "कोटी": 10**7, "लाख": 10**5, "लक्ष": 10**5, "लक्ख": 10**5, "हज़ार": 1000, "हजार": 1000, "हजारा": 1000, "सहस्र": 1000, "सौ": 100, "हज़ारों": 1000,
}
GAP = 4
# runs of digits are possessive and start once, so a text of one long number is read once
_NUMBER = r"\d[\d,]*+(?:\.\d++)?"
_SCALED = rf"(?<!\d,{{0,4}})({_NUMBER})\s*+((?iu:{'|'.join(sorted(SCALES, key=len, reverse=True))}))(?![\p{{L}}\p{{N}}_])"
_BARE = r"\b(\d[\d,]*(?:\.\d+)?)\b"


def _whole(value: Column) -> Column:
    return F.format_string("%.0f", F.bround(value, 0))


def numbers(text: Column) -> Column:
    """The amounts that a text may mean, sorted: neighbouring scale phrases summed, bare numbers also as lakh and crore.

    Scale phrases and the gaps between them are two arrays; an amount begins where the gap before a phrase is wider
    than GAP. Each is a slice of the phrases, so work grows with the text. Amounts from 9e15 on are rounded as doubles
    are; of a malformed number like 1.2.3 lakh the phrase takes 2.3 and leaves 1."""
    scale = F.create_map(*[F.lit(x) for w, n in SCALES.items() for x in (w, float(n))])
    plain = lambda n: F.regexp_replace(n, ",", "")

    def bare(n: Column) -> Column:
        return let(F.struct(plain(n).alias("s"), plain(n).cast("double").alias("v")), lambda x: F.array(x["s"], _whole(x["v"]), _whole(x["v"] * 10**5), _whole(x["v"] * 10**7)))

    def both(x: Column) -> Column:
        values, gaps = x["values"], x["gaps"]
        opens = lambda i: (i == 0) | (F.length(F.get(gaps, i)) > GAP)
        starts = F.filter(F.transform(values, lambda v, i: F.when(opens(i), i)), lambda i: i.isNotNull())
        until = lambda k, at: F.coalesce(F.get(at, k + 1), F.size(values))
        totals = let(starts, lambda at: F.transform(at, lambda a, k: F.aggregate(F.slice(values, a + 1, until(k, at) - a), F.lit(0.0), lambda s, v: s + v)))
        outer = F.filter(gaps, lambda g, i: (i == F.size(values)) | opens(i))
        rest = F.regexp_extract_all(F.array_join(outer, "~"), F.lit(_BARE), 1)
        return F.array_sort(F.array_distinct(F.concat(F.transform(F.filter(totals, lambda t: t != 0), _whole), F.flatten(F.transform(rest, bare)))))

    body = F.coalesce(text, F.lit(""))
    said = lambda group: F.regexp_extract_all(body, F.lit(_SCALED), group)
    values = F.zip_with(said(1), said(2), lambda n, w: plain(n).cast("double") * F.element_at(scale, F.lower(w)))
    return let(F.struct(values.alias("values"), F.split(body, _SCALED, -1).alias("gaps")), both)


# Numbers that are never taken for invented amounts.
SAFE = [*map(str, range(1, 13)), "100", "2024", "2025", "2026", "2027"]


def telling(number: Column) -> Column:
    """Whether a number is neither safe nor a single digit nor a year."""
    return ~number.isin(SAFE) & (F.length(number) > 1) & ~number.rlike("^20[0-9]{2}$")


def ungrounded(answer: Column, context: Column) -> Column:
    """Amounts of the answer that the context does not hold, without safe ones, single digits and years."""
    return F.array_sort(F.filter(F.array_except(numbers(answer), numbers(context)), telling))


# Patterns of personal data in the order in which they are masked, the tail that is kept, and whether only digits count.
PII = [
    ("email", r"(?U)(?<![\w.+-])[\w.+-]++@[\w-]++\.[\w.-]{2,}", 2, False),
    ("url", r"https?://\S+|www\.\S+", 2, False),
    ("pan", r"\b[A-Z]{5}\d{4}[A-Z]\b", 2, False),
    ("phone", r"(?<!\d)(?:\+?91[-\s]?)?(?:[6-9]\d{4}[-\s]?\d{5})(?!\d)", 3, False),
    ("aadhaar", r"(?<!\d)\d{4}[\s-]?\d{4}[\s-]?\d{4}(?!\d)", 2, True),
    ("card", r"(?<!\d)(?:\d[ -]?){13,19}(?!\d)", 2, True),
]


def _covered(found: Column, label: str, keep: int, digits: bool) -> Column:
    value = F.regexp_replace(found, r"\D", "") if digits else stripped(found)
    stars = lambda v: F.repeat(F.lit("*"), F.when(F.length(v) > keep, F.length(v) - keep).otherwise(F.length(v)))
    tail = lambda v: F.when(F.length(v) > keep, F.right(v, F.lit(keep))).otherwise("")
    return let(value, lambda v: F.concat(F.lit(f"[{label}:"), stars(v), tail(v), F.lit("]")))


def _cover(label: str, pattern: str, keep: int, digits: bool) -> Callable[[Column], Column]:
    def cover(t: Column) -> Column:
        gaps, found = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), 0)
        turns = F.zip_with(gaps, found, lambda g, m: F.concat(g, F.when(m.isNull(), "").otherwise(_covered(m, label, keep, digits))))
        return F.when(t.rlike(pattern), F.array_join(turns, "")).otherwise(t)

    return cover


def masked(text: Column) -> Column:
    """Personal data as [label:***tail]: the gaps between matches and the covered matches take turns."""
    out = F.coalesce(text, F.lit(""))
    for rule in PII:
        out = let(out, _cover(*rule))
    return out


def found_hashes(text: Column, secret: str) -> Column:
    """Map of label to keyed hashes of what masked() would hide, each label read in the text as it stands."""
    keyed = lambda v: F.substring(F.sha2(F.concat(F.lit(f"{secret}:"), stripped(v)), 256), 1, 16)
    text = F.coalesce(text, F.lit(""))
    entries = [F.struct(F.lit(label).alias("key"), F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), keyed).alias("value")) for label, pattern, _, _ in PII]
    return F.map_filter(F.map_from_entries(F.array(*entries)), lambda k, v: F.size(v) > 0)
