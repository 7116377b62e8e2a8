"""Text functions as Column expressions: they stay in the JVM and inside code generation."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a question (English, romanised Hindi, Hindi).
STOPWORDS = (
    "a an the is are was were be been of for to in on at and or do does did i me my we you your please tell about what which how much many "
    "can could would should will there here it this that hai kya ka ki ke ko mein se par aur bhi mujhe muje bataye batao bataiye karna karein chahiye "
    "है हैं का की के को में और भी मुझे क्या बताइए बताओ बताएं करना चाहिए लिए या तो ही"
).split()

# Words left out of the key of a question.
KEY_STOPWORDS = "a an the is are do does of for to in at please tell me i want kya hai ki ka ke mujhe bataye batao about".split()

#: Our own synonym groups, neutral of any institution; a group is a feature beside its words.
SYNONYMS = {
    "price": ["fee", "fees", "cost", "price", "charges", "amount", "tuition"],
    "aid": ["scholarship", "waiver", "concession", "discount", "financial aid"],
    "lodging": ["hostel", "dormitory", "room", "accommodation"],
    "entry": ["admission", "apply", "application", "enrolment", "registration"],
    "deadline": ["deadline", "last date", "closing date"],
    "work": ["placement", "job", "salary", "recruiter"],
    "reach": ["phone", "email", "contact", "address"],
}


def token_groups(synonyms: dict[str, list[str]]) -> dict[str, str]:
    """Word -> group: members, and the parts of members of several words that no earlier member claims."""
    found: dict[str, str] = {}
    for group, members in synonyms.items():
        for member in map(str.lower, members):
            found[member] = group
            for part in re.split(r"[.\s]+", member):
                if len(part) > 1:
                    found.setdefault(part, group)
    return found


def phrases_of(synonyms: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(member, group) of the members that are more than one word."""
    return [(m.lower(), g) for g, ms in synonyms.items() for m in ms if " " in m or "." in m]


SINGLE = token_groups(SYNONYMS)
PHRASES = phrases_of(SYNONYMS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# a run of word characters from its first to its last one that is no underscore
TOKEN = r"([\p{L}\p{M}\p{N}](?:[\p{L}\p{M}\p{N}_]*[\p{L}\p{M}\p{N}])?)"


def tokenize(text: Column, keep_stopwords: bool = False) -> Column:
    """Lower-case words without edge underscores, single letters and stopwords; digits stay."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 1)
    keep = lambda w: (F.length(w) > 1) | w.between("0", "9")
    return F.filter(words, keep if keep_stopwords else lambda w: keep(w) & ~w.isin(STOPWORDS))


def phrase_marks(text: Column, synonyms: dict[str, list[str]] = SYNONYMS) -> Column:
    """`#g:group` for each member of several words that the text contains, in the order of the table."""
    low = F.lower(F.coalesce(text, F.lit("")))
    marks = [F.when(low.contains(m), F.lit(f"#g:{g}")) for m, g in phrases_of(synonyms)]
    return F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")


def compact(text: Column) -> Column:
    """Lower case without white space, for letter trigrams."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\x0B\f\r]+", "")


def expand(text: Column, synonyms: dict[str, list[str]] = SYNONYMS) -> Column:
    """Tokens, then `#g:group` of each known token and of its form without a plural s, then of each phrase."""
    own = token_groups(synonyms)
    known = F.create_map(*[F.lit(x) for w, g in own.items() for x in (w, f"#g:{g}")])
    named = sorted({*own, *(f"{w}s" for w in own if len(w) > 2)})  # few words are: only they are looked up
    stem = lambda t: F.when(t.endswith("s") & (F.length(t) > 3), F.element_at(known, F.substring(t, F.lit(1), F.length(t) - 1)))
    groups = lambda ts: F.flatten(F.transform(F.filter(ts, lambda t: t.isin(named)), lambda t: F.array_compact(F.array(F.element_at(known, t), stem(t)))))
    return F.concat(let(tokenize(text), lambda ts: F.concat(ts, groups(ts)) if own else ts), phrase_marks(text, synonyms))


def counted(features: Column) -> Column:
    """(term, tf) of each distinct feature: a sort inside the row, so that counting moves no words."""
    starts = lambda s: F.array_compact(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)))
    ended = lambda s, at, j: (F.coalesce(F.get(at, j + 1), F.size(s)) - F.get(at, j)).cast("long")
    runs = lambda s: let(starts(s), lambda at: F.transform(at, lambda a, j: F.struct(F.get(s, a).alias("term"), ended(s, at, j).alias("tf"))))
    return let(F.sort_array(features), runs)


def canonical_key(text: Column) -> Column:
    """Key that near-equal questions share: known fillers out, at most 8 words and 160 characters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    plain = F.regexp_replace(low, r"[^\p{L}\p{M}\p{N}\s]", " ")
    words = F.filter(F.split(plain, r"\s+"), lambda w: (w != "") & ~w.isin(KEY_STOPWORDS))
    key = F.substring(F.array_join(F.slice(words, 1, 8), " "), 1, 160)
    return F.when(key != "", key).otherwise(F.substring(low, 1, 60))


def money(value: Column) -> Column:
    """Amounts as spoken in India: crore from 1e7, lakh from 1e5, else with thousands separators.

    Places are rounded by the double's exact binary value, as C does: format_number does so, format_string rounds its decimal form half up."""
    two = lambda x: F.replace(F.format_number(x, 2), F.lit(","))
    whole = F.format_number(F.bround(value, 0).cast("bigint"), 0)
    return (
        F.when(value >= 1e7, F.concat(F.lit("INR "), two(value / 1e7), F.lit(" crore")))
        .when(value >= 1e5, F.concat(F.lit("INR "), two(value / 1e5), F.lit(" lakh")))
        .otherwise(F.concat(F.lit("INR "), whole))
    )


def parse_money(text: Column) -> Column:
    """'1.5 lakh', 'INR 6,00,000', '1.2 crore' as numbers; null if there is none."""
    low = F.regexp_replace(F.lower(F.trim(text.cast("string"))), ",|₹|inr", "")
    scale = F.when(low.rlike("crore| cr|cr$"), 1e7).when(low.rlike("lakh|lac"), 1e5).when(low.contains("thousand"), 1e3).otherwise(1.0)
    return F.nullif(F.regexp_extract(low, r"-?[0-9]+(\.[0-9]+)?", 0), F.lit("")).try_cast("double") * scale


def to_int(text: Column) -> Column:
    return text.try_cast("double").cast("bigint")


def to_list(text: Column) -> Column:
    """Parts between ; or |, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, "[;|]"), F.trim), lambda x: x != "")


def header(*parts: Column) -> Column:
    """Parts joined by a middle dot, without nulls and repeats, in order."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*parts))), " · ")


def list_join(items: Column, word: str = "and") -> Column:
    """'a, b and c'; items lose edge spaces and final stops, empty ones go."""
    clean = F.filter(F.transform(items, lambda x: F.trim(F.regexp_replace(F.trim(x), r"\.+$", ""))), lambda x: x != "")
    n = F.size(clean)
    return (
        F.when(n == 0, "")
        .when(n == 1, F.get(clean, F.lit(0)))
        .otherwise(F.concat(F.array_join(F.slice(clean, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(f" {word} "), F.element_at(clean, -1)))
    )


def sentence_join(items: Column) -> Column:
    ended = F.transform(F.filter(F.transform(items, F.trim), lambda x: x != ""), lambda x: F.when(x.rlike(r"[.!?।]$"), x).otherwise(F.concat(x, F.lit("."))))
    return F.array_join(ended, " ")


def tidy(text: Column) -> Column:
    """Single spaces, none before marks, no doubled marks."""
    out = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r\f]+", " "))
    out = F.regexp_replace(out, " +([.,!?;:।])", "$1")
    for mark in (".", "!", "?", "।"):
        out = F.regexp_replace(out, f"[{mark}]{{2,}}", mark)
    return F.trim(F.regexp_replace(out, r"\.।", "।"))


def clip(text: Column, limit: int) -> Column:
    """At most `limit` characters, cut at a word if one ends past the middle, with an ellipsis."""
    text = F.trim(F.coalesce(text, F.lit("")))
    head = F.substring(text, 1, limit)
    cut = F.length(head) - F.instr(F.reverse(head), " ")
    at = F.when((F.instr(head, " ") > 0) & (cut > limit // 2), cut).otherwise(limit)
    shorter = F.regexp_replace(F.substring(text, F.lit(1), at), "[ ,;:.]+$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(shorter, F.lit("…")))


def pseudonym(value: Column, secret: str) -> Column:
    """Keyed digest: the same value gives the same name, the value is not stored."""
    return F.substring(F.sha2(F.concat(F.lit(f"{secret}:"), F.trim(value)), 256), 1, 16)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 32)


def chunk_id(record: Column, position: Column, digest: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", record.cast("string"), position.cast("string"), digest)), 1, 28)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]{2,}"
PHONE = r"(\+?91[- ]?)?[6-9][0-9]{4}[- ]?[0-9]{5}"


def extract_email(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), f"({EMAIL})", 1)


def extract_phone(text: Column) -> Column:
    """A spoken Indian number as +91 and ten digits; else a run of 10 to 13 digits; else empty."""
    text = F.coalesce(text, F.lit(""))
    digits = F.regexp_replace(text, "[^0-9]", "")
    n = F.length(digits)
    local = F.when((n == 11) & digits.startswith("0"), F.substring(digits, 2, 10)).when((n == 12) & digits.startswith("91"), F.substring(digits, 3, 10)).otherwise(digits)
    return F.when(F.length(local) == 10, F.concat(F.lit("+91"), local)).otherwise(F.regexp_extract(text, r"(\+?[0-9]{10,13})", 1))


def looks_like_phone(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")).between(10, 13)


#: Markers of a label that is not a sentence: a few words and a colon at the end, or a bare key.
def is_label(text: Column) -> Column:
    return text.rlike(r"^[^.!?]{1,60}:$") | text.rlike(r"^[A-Za-z_]+: [^ ]+$")


UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "_ _ twenty thirty forty fifty sixty seventy eighty ninety".split()


def number_words(n: Column) -> Column:
    """English words with lakh and crore, for whole numbers from 0 below 1e9."""
    small = F.array(*[F.lit(u) for u in UNITS])
    tens = F.array(*[F.lit(t) for t in TENS])
    n = n.cast("bigint")

    def below_hundred(x: Column) -> Column:
        ten, one = F.floor(x / 10).cast("int"), (x % 10).cast("int")
        return F.when(x < 20, F.get(small, x.cast("int"))).otherwise(F.concat(F.get(tens, ten), F.when(one > 0, F.concat(F.lit(" "), F.get(small, one))).otherwise("")))

    parts = []
    for size, span, name in ((10**7, 100, "crore"), (10**5, 100, "lakh"), (10**3, 100, "thousand"), (10**2, 10, "hundred"), (1, 100, "")):
        x = F.floor(n / size) % span
        parts.append(F.when(x > 0, F.concat(below_hundred(x), F.lit(f" {name}" if name else ""))))
    return F.when(n == 0, "zero").otherwise(F.array_join(F.array_compact(F.array(*parts)), " "))


def spoken_money(value: Column) -> Column:
    return F.concat(number_words(value), F.lit(" rupees"))


def spoken_duration(years: Column) -> Column:
    return F.when(years == 1, "one year").otherwise(F.concat(number_words(years), F.lit(" years")))


def followup_body(lines: Column, most_lines: int = 12, most_chars: int = 1400) -> Column:
    """At most so many lines and characters; cut at a line end."""
    body = F.array_join(F.slice(F.filter(lines, lambda x: F.trim(x) != ""), 1, most_lines), "\n")
    head = F.substring(body, 1, most_chars)
    keep = F.length(head) - F.instr(F.reverse(head), "\n")
    return F.when(F.length(body) <= most_chars, body).when(F.instr(head, "\n") > 0, F.substring(head, F.lit(1), keep)).otherwise(head)


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])
