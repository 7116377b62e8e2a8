"""The reranker's rules as a table of conditions and amounts over candidate columns, compiled to one projection.

A candidate row has the question's side (asked, spoken, categories, language, intent, tokens, specialisations,
distinctive), the record's (title, body, category, lang, verified, stale, aliases, not_offered) and the scores of
fusion (rrf_norm, dense, lexical). `features` adds what the conditions name. Everything is a built-in expression over
the row: no join, no shuffle, and a hot record or question makes no difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.text import let

DEVANAGARI = "ऀ-ॿ"
#: What ends the name at the head of a "not offered" entry (fixed values).
ENDS = r"[(,/]|\s+(?:or|and|including|such as|with)\s+"

#: name, condition, amount (fixed values), in the order in which signals are listed.
RULES = [
    ("category", "array_contains(categories, category)", "0.10"),
    ("primary_category", "category = get(categories, 0)", "0.08"),
    ("language", "lang = language", "0.06"),
    ("verified", "verified", "0.05"),
    ("unverified", "NOT verified", "-0.06"),
    ("stale", "stale", "-0.07"),
    ("course_match", "course_hits > 0", "0.14 * course_hits"),
    ("degree_exact", "degree_exact", "0.25"),
    ("degree_prefix", "degree_prefix AND NOT combined", "0.18"),
    ("degree_combined", "degree_prefix AND combined", "0.04"),
    ("not_offered", "intercepts", "0.55"),
    ("specialisation_title", "title_spec", "0.45"),
    ("specialisation_body", "NOT title_spec AND body_spec", "0.04"),
    ("alias_dump", "dump", "-0.12"),
    ("alias", "NOT dump AND alias_words > 0", "least(0.30, 0.12 + 0.06 * (alias_words - 1))"),
    ("title_terms", "NOT dump AND alias_words = 0 AND term_hits > 0", "0.12 * least(2, term_hits)"),
    ("title_in_query", "title_asked", "0.18"),
    ("timely", "category = intent AND array_contains(timely, category)", "0.08"),
]
MOST_RULES = 1000


def programme(name: Column) -> Column:
    """A name without case, spaces and signs, so that 'B.Com' and 'bcom' are equal."""
    return F.regexp_replace(F.lower(name), f"[^0-9a-z{DEVANAGARI}]+", "")


def match_form(text: Column) -> Column:
    """Lower case, signs inside words dropped, others as single spaces: 'Wi-Fi' meets 'wifi', word edges stay."""
    joined = F.regexp_replace(F.lower(text), "[.\\-_/·'’&+]+", "")
    return F.trim(F.regexp_replace(joined, f"[^0-9a-z{DEVANAGARI}]+", " "))


def squashed(text: Column) -> Column:
    return F.replace(F.replace(F.trim(text), F.lit("."), F.lit("")), F.lit(" "), F.lit(""))


def whole_word(text: Column, term: Column) -> Column:
    """Whether the term stands in the text with no word character before or after it."""
    pattern = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.lower(F.trim(term)), F.lit(r"\E(?!\w)"))
    return (F.trim(term) != "") & F.regexp_like(text, pattern)


def _entries(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def features(rows: DataFrame, timely=("important_dates",)) -> DataFrame:
    """The rows with the columns that RULES name. Null texts and lists count as empty."""
    low, text = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))), lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = rows.withColumns({
        "title_low": low("title"), "asked_form": match_form(text("asked")), "title_form": match_form(text("title")),
        "codes": F.filter(F.transform(_entries("tokens"), lambda t: F.lower(F.replace(t, F.lit("."), F.lit("")))), lambda t: t != ""),
        "prefix": squashed(F.get(F.split(low("title"), "[(—–,]", 2), F.lit(0))),
        "bracketed": F.transform(F.regexp_extract_all(low("title"), F.lit(r"\(([^)]+)\)"), 1), squashed),
        "rest": F.ltrim(F.when(F.instr(low("body"), "\n") > 0, F.substring(low("body"), F.instr(low("body"), "\n") + 1, F.length(F.coalesce("body", F.lit(""))))).otherwise(""), F.lit(" \t\n\r")),
    })
    every = lambda holds: (F.size("codes") > 0) & F.forall("codes", holds)
    own = F.filter(F.concat(F.array("prefix"), F.col("bracketed")), lambda x: x != "")
    exact = let(own, lambda o: (F.size(o) > 0) & every(lambda c: F.array_contains(o, c)))
    heads = F.transform(_entries("not_offered"), lambda x: F.get(F.split(F.lower(x), ENDS, 2), F.lit(0)))
    named = F.concat(F.transform(_entries("aliases"), programme), F.transform(heads, programme), F.transform(heads, lambda h: programme(F.element_at(F.split(F.trim(h), r"\s+"), -1))))
    indic = lambda t: (F.length(t) >= 3) & t.rlike(f"[{DEVANAGARI}]") & F.contains(programme(text("asked")), t)
    intercepts = let(F.array_remove(named, ""), lambda ts: F.exists("codes", lambda c: F.array_contains(ts, programme(c))) | F.exists(ts, indic))
    said = F.filter(_entries("aliases"), lambda a: (F.length(match_form(a)) >= 4) & F.contains(F.col("asked_form"), match_form(a)))
    longest = F.aggregate(said, F.lit(""), lambda best, a: F.when(F.length(a) > F.length(best), a).otherwise(best))
    return rows.withColumns({
        "course_hits": F.size(F.filter("codes", lambda c: F.contains(F.replace(F.replace(F.col("title_low"), F.lit("."), F.lit("")), F.lit(" "), F.lit("")), c))),
        "degree_exact": exact,
        "degree_prefix": ~exact & (F.col("prefix") != "") & every(lambda c: F.startswith(F.col("prefix"), c)),
        "combined": F.concat_ws(" ", "prefix", "title_low").rlike(r"\+|dual|integrated"),
        "intercepts": (F.size(_entries("not_offered")) > 0) & (F.size("codes") > 0) & intercepts,
        "title_spec": F.exists(_entries("specialisations"), lambda s: whole_word(F.col("title_low"), s)),
        "body_spec": F.exists(_entries("specialisations"), lambda s: whole_word(low("body"), s)),
        "dump": F.col("rest").startswith("also known as:"),
        "alias_words": let(F.trim(longest), lambda a: F.when(a == "", 0).otherwise(F.size(F.split(a, r"\s+")))),
        "term_hits": F.size(F.filter(_entries("distinctive"), lambda t: whole_word(F.col("title_form"), t))),
        "title_asked": (F.length("title_low") > 4) & F.contains(low("asked"), F.col("title_low")),
        "timely": F.array(*map(F.lit, timely)).cast("array<string>"),
    })


def base_score(rrf_norm: Column, dense: Column, lexical: Column) -> Column:
    return 0.75 * rrf_norm + 0.25 * F.least(F.lit(1.0), dense) + 0.12 * F.least(F.lit(1.0), lexical / 8)


def rows_of(rules) -> list[tuple[str, str, str]]:
    """Rules as a list; a table of them (name, holds, amount) may have MOST_RULES rows."""
    if rules is None:
        return RULES
    if isinstance(rules, DataFrame):
        found = rules.select("name", "holds", F.col("amount").cast("string")).limit(MOST_RULES + 1).collect()
        if len(found) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules")
        return [tuple(r) for r in found]
    return [(name, holds, str(amount)) for name, holds, amount in rules]


def rerank(candidates: DataFrame, rules=None) -> DataFrame:
    """score = base and the amounts of the rules that hold, 0 at least, 4 places; `signals` names those rules."""
    score, signals = base_score(F.col("rrf_norm"), F.col("dense"), F.col("lexical")), []
    for name, holds, amount in rows_of(rules):
        holds = F.coalesce(F.expr(holds), F.lit(False))
        score = score + F.when(holds, F.expr(amount).cast("double")).otherwise(0.0)
        signals.append(F.when(holds, F.lit(name)))
    return candidates.withColumns({"score": F.round(F.greatest(F.lit(0.0), score), 4), "signals": F.array_join(F.array_compact(F.array(*signals)), ",")})


def title_terms(records: DataFrame, questions: DataFrame, record: str = "doc_id", question: str = "item_id") -> DataFrame:
    """question, distinctive: the words that the asker said and that few titles hold (at most 6 % of the records, or 2),
    without those that name a course. records: record, title; questions: question, spoken, tokens."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(match_form(F.coalesce(c, F.lit(""))), F.lit(f"([0-9a-z{DEVANAGARI}]{{3,}})"), 1))
    claimed = F.transform(_entries("tokens"), programme)
    said = questions.select(question, F.explode(F.filter(words(F.col("spoken")), lambda w: ~F.array_contains(claimed, w))).alias("word"))
    titled = records.select(F.explode(words(F.col("title"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    n = records.agg(F.count(F.lit(1)).alias("n"))  # one row
    rare = titled.join(said.select("word").distinct(), "word").join(F.broadcast(n)).filter(F.col("df") <= F.greatest(F.lit(2), F.bround(0.06 * F.col("n"), 0)))
    return said.join(rare.select("word"), "word").groupBy(question).agg(F.array_sort(F.collect_set("word")).alias("distinctive"))
