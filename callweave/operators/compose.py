"""Answers from merged facts: branches as a table in order of priority, parts chosen under a budget of characters.

A row has `intent`, `grounded`, `verified`, `stale`, the retrieval `score` and `facts`, a VARIANT. A branch is a name, a
condition and parts, all SQL over the row, in which `fact(...)` stands for a field of the facts. The first branch whose
condition holds speaks; its parts that are not null follow each other as sentences while they fit the budget, the first
always. Confidence is the score, less where the record is unverified (x 0.8 for prices) or stale (x 0.85), between 0.05
and 0.95. Everything is one projection. The default branches and their words are our own and neutral; pass others.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions.text import let

BUDGET, SHORT = 380, 320  # fixed values: characters of an answer, and of one that is spoken
LEAST, MOST, STALE, UNVERIFIED = 0.05, 0.95, 0.85, 0.8

#: name, condition, parts. fact(a.b) is text, num(a) a number, flag(a) a boolean, list(a) a list joined for speech.
BRANCHES: list[tuple[str, str, list[str]]] = [
    ("no_answer", "NOT grounded OR facts IS NULL", ["'I do not have that on record'", "'I can connect you to a person'"]),
    ("not_offered", "list(not_offered) IS NOT NULL", ["concat(list(not_offered), ' is not offered here')", "concat('Instead there is ', list(offered_instead))"]),
    ("comparison", "intent = 'comparison' AND num(fees.total) IS NOT NULL AND num(other.total) IS NOT NULL", ["concat('The first costs ', money(fees.total), ' and the second ', money(other.total))"]),
    ("price_both", "intent = 'price' AND num(fees.total) IS NOT NULL AND num(fees.annual) IS NOT NULL", ["concat('The fee is ', money(fees.annual), ' a year')", "concat(money(fees.total), ' in total')", "fact(fees.note)"]),
    ("price_annual", "intent = 'price' AND num(fees.annual) IS NOT NULL", ["concat('The fee is ', money(fees.annual), ' a year')", "fact(fees.note)"]),
    ("price_total", "intent = 'price' AND num(fees.total) IS NOT NULL", ["concat('The total fee is ', money(fees.total))", "fact(fees.note)"]),
    ("price_unpublished", "intent = 'price' AND flag(fees.published) = false", ["'The fee is not published yet'", "'The office can confirm it'"]),
    ("loan", "intent = 'loan' AND flag(loan_published) IS NOT NULL", ["if(flag(loan_published), 'Loans are described by the finance office', 'No loan details are published')"]),
    ("refund", "intent = 'refund' AND flag(refund_published) IS NOT NULL", ["if(flag(refund_published), 'The refund rules are published', 'No refund rules are published')"]),
    ("eligibility", "intent = 'eligibility' AND fact(eligibility) IS NOT NULL", ["fact(eligibility)"]),
    ("eligibility_which", "intent = 'eligibility'", ["'Which programme do you mean'"]),
    ("exam", "intent = 'exam' AND (list(tests) IS NOT NULL OR fact(entrance_exam) IS NOT NULL)", ["concat('Accepted tests are ', list(tests))", "fact(entrance_exam)"]),
    ("process", "intent = 'process' AND list(steps) IS NOT NULL", ["concat('The steps are ', list(steps))"]),
    ("dates", "intent = 'dates' AND list(important_dates) IS NOT NULL", ["concat('Dates to note are ', list(important_dates))"]),
    ("scholarship", "intent = 'scholarship' AND list(scholarship_types) IS NOT NULL", ["concat('There are scholarships for ', list(scholarship_types))"]),
    ("hostel", "intent = 'hostel' AND (flag(hostel_available) IS NOT NULL OR fact(hostel_status) IS NOT NULL)", ["if(flag(hostel_available), 'Rooms are available', 'There are no rooms')", "fact(hostel_status)"]),
    ("placement", "intent = 'placement' AND (num(package) IS NOT NULL OR list(recruiters) IS NOT NULL)", ["concat('The average package is ', money(package))", "concat('Recruiters include ', list(recruiters))"]),
    ("contact", "intent = 'contact' AND coalesce(fact(phone), fact(email), fact(address)) IS NOT NULL", ["concat('The phone number is ', fact(phone))", "concat('The email is ', fact(email))", "concat('The address is ', fact(address))"]),
    ("documents", "intent = 'documents' AND list(documents_required) IS NOT NULL", ["concat('You need ', list(documents_required))"]),
    ("transport", "intent = 'transport'", ["fact(by_rail)", "fact(by_air)", "concat('Distances by road are ', list(road_distances))", "concat('On site there are ', list(facilities))"]),
    ("catalogue", "intent = 'catalogue' AND list(programmes) IS NOT NULL", ["concat('You can choose from ', list(programmes))"]),
    ("overview", "true", ["fact(answer)", "concat('It takes ', fact(duration), ' years')", "concat('There are ', fact(seats), ' seats')", "concat('Fields are ', list(specialisations))"]),
]

_PLACE = r"\(([a-z_.]+)\)"


def sql_of(expression: str) -> str:
    """Facts by their kind in place of the short forms."""
    get = lambda path, kind: f"try_variant_get(facts, '$.{path}', '{kind}')"
    out = re.sub(r"\bfact" + _PLACE, lambda m: f"nullif(trim({get(m[1], 'string')}), '')", expression)
    out = re.sub(r"\bnum" + _PLACE, lambda m: get(m[1], "double"), out)
    out = re.sub(r"\bflag" + _PLACE, lambda m: get(m[1], "boolean"), out)
    out = re.sub(r"\bmoney" + _PLACE, lambda m: f"concat('INR ', format_number({get(m[1], 'double')}, 0))", out)
    return re.sub(r"\blist" + _PLACE, lambda m: f"nullif(array_join({get(m[1], 'array<string>')}, ', '), '')", out)


def compose(rows: DataFrame, branches=None, budget: int = BUDGET) -> DataFrame:
    """The rows with `branch`, `answer` and `confidence`; rows that no branch takes have an empty answer and no branch."""
    table = BRANCHES if branches is None else branches
    found = None
    for name, holds, parts in table:
        one = F.struct(F.lit(name).alias("branch"), F.array(*[F.expr(sql_of(p)).cast("string") for p in parts]).alias("parts"))
        holds = F.coalesce(F.expr(sql_of(holds)), F.lit(False))
        found = F.when(holds, one) if found is None else found.when(holds, one)

    def fitting(parts):
        said = F.transform(F.filter(parts, lambda p: F.trim(F.coalesce(p, F.lit(""))) != ""), lambda p: F.when(F.trim(p).rlike("[.!?।]$"), F.trim(p)).otherwise(F.concat(F.trim(p), F.lit("."))))
        fits = lambda acc, s: (F.length(acc) == 0) | (F.length(acc) + 1 + F.length(s) <= budget)
        # the first part that does not fit ends the answer
        step = lambda acc, s: F.when(acc["open"] & fits(acc["text"], s), F.struct(F.concat_ws(" ", F.nullif(acc["text"], F.lit("")), s).alias("text"), F.lit(True).alias("open"))).otherwise(F.struct(acc["text"].alias("text"), F.lit(False).alias("open")))
        return F.aggregate(said, F.struct(F.lit("").alias("text"), F.lit(True).alias("open")), step, lambda a: a["text"])

    chosen = rows.withColumn("__b", let(found, lambda b: F.struct(b["branch"].alias("branch"), F.coalesce(fitting(b["parts"]), F.lit("")).alias("answer"))))
    sure = F.coalesce("score", F.lit(0.0)) * F.when(F.col("__b.branch").startswith("price") & ~F.coalesce("verified", F.lit(False)), UNVERIFIED).otherwise(1.0) * F.when(F.coalesce("stale", F.lit(False)), STALE).otherwise(1.0)
    return chosen.withColumns({"branch": F.col("__b.branch"), "answer": F.col("__b.answer"), "confidence": F.round(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), sure)), 3)}).drop("__b")
