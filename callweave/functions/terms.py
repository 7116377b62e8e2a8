"""Many terms in one walk over a text: an Aho-Corasick automaton over a term table, in Arrow batches.

A term table is rows of (term, value); it is a parameter and has MOST_TERMS rows at most, so it travels with the task and
the automaton is built once in each. A text is read once whatever the number of terms. Text and terms are compared in
lower case. A hit counts by its edges: `any` place, a `left` word edge (inflected endings allowed), or a whole `word`.
With `longest`, hits that overlap give way to the one that starts first and, of those, the longest.
Null texts have no hits; of equal terms the first row counts; empty terms are left out.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import by_runs

MOST_TERMS = 200_000
HIT = "array<struct<term: string, value: string, start: int, place: int>>"


def table(rows: DataFrame | Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """Rows of (term, value) as a list; a table that is too large is refused, not cut."""
    if isinstance(rows, DataFrame):
        rows = [(r[0], r[1]) for r in rows.limit(MOST_TERMS + 1).collect()]
    found: dict[str, str] = {}
    for term, value in rows:
        if term:
            found.setdefault(term.lower(), value)
    if len(found) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return list(found.items())


def _inside(c: str) -> bool:
    return c.isalnum() or c == "_" or 0x0300 <= ord(c) <= 0x036F or 0x0900 <= ord(c) <= 0x0DFF  # letters, digits, and marks of Indic scripts


class Matcher:
    """The automaton of a term table."""

    def __init__(self, terms: list[tuple[str, str]], edge: str = "left", longest: bool = False):
        import ahocorasick

        self.terms, self.edge, self.longest = terms, edge, longest
        self.walk = ahocorasick.Automaton()
        for place, (term, _) in enumerate(terms):
            self.walk.add_word(term, place)
        if terms:
            self.walk.make_automaton()

    def hits(self, text: str | None) -> list[tuple[str, str, int, int]]:
        """(term, value, start, place in the table) in order of start; longer ones first."""
        if not text or not self.terms:
            return []
        low, found = text.lower(), []
        for end, place in self.walk.iter(low):
            term = self.terms[place][0]
            start = end + 1 - len(term)
            left = start == 0 or not _inside(low[start - 1])
            right = end + 1 == len(low) or not _inside(low[end + 1])
            if self.edge == "any" or left and (self.edge == "left" or right):
                found.append((start, -len(term), place))
        found.sort()
        out, free = [], 0
        for start, size, place in found:
            if not self.longest or start >= free:
                free = start - size
                out.append((*self.terms[place], start, place))
        return out


def find(text: Column, terms, edge: str = "left", longest: bool = False) -> Column:
    """Hits of the term table in a text, as an array of (term, value, start, place)."""
    terms, made = table(terms), []

    kind = pa.list_(pa.struct([("term", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("place", pa.int32())]))

    def walked(texts: pa.Array) -> pa.Array:
        starts, places, ends = array("i"), array("i"), [0]
        for one in texts:
            for hit in made[0].hits(one.as_py()):
                starts.append(hit[2])
                places.append(hit[3])
            ends.append(len(starts))
        place = pa.array(np.frombuffer(places, dtype=np.int32))
        columns = [made[1].take(place), made[2].take(place), pa.array(np.frombuffer(starts, dtype=np.int32)), place]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["term", "value", "start", "place"]))

    @F.arrow_udf(HIT)
    def walk(texts: pa.Array) -> pa.Array:
        if not made:
            made.extend((Matcher(terms, edge, longest), *(pa.array([t[i] for t in terms], pa.string()) for i in (0, 1))))
        return by_runs(walked, kind, texts)

    return walk(text)


#: Our own bridge from words of other scripts to the words that records use, and what replaces it under an intent.
BRIDGES = [
    ("बीटेक", "B.Tech"), ("एमबीए", "MBA"), ("नर्सिंग", "Nursing"), ("अभियांत्रिकी", "Engineering"), ("शुल्क", "Fees"), ("फी", "Fees"), ("प्रवेश", "Admission"), ("वसतिगृह", "Hostel"),
    ("शिष्यवृत्ती", "Scholarship"), ("परीक्षा", "Exam"), ("कागदपत्रे", "Documents"), ("दस्तावेज", "Documents"), ("precio", "price"), ("plazo", "deadline"), ("preis", "price"), ("frist", "deadline"), ("prix", "price"), ("délai", "deadline"),
]
UNDER_INTENT = {"dates": [("परीक्षा", "examination dates calendar"), ("सत्र", "calendar")]}


def augmented(text: Column, intent: Column, extra: Column, bridges=None, under_intent=None) -> Column:
    """The text, then what its words of other scripts mean, in the order of the tables and once each, then `extra`.

    A bridge of the text's intent replaces the general one of the same word; the intent's other words follow."""
    general, special = table(BRIDGES if bridges is None else bridges), UNDER_INTENT if under_intent is None else under_intent
    hits = find(text, general, "left")
    said = F.array_distinct(F.transform(F.array_sort(F.transform(hits, lambda h: F.struct(h["place"], h["term"], h["value"]))), lambda h: F.struct(h["term"], h["value"])))
    parts = F.transform(said, lambda h: h["value"])
    for name, rows in special.items():
        rows = table(rows)
        own = F.create_map(*[F.lit(x) for row in rows for x in row])
        known = {t for t, _ in general}
        more = find(text, [r for r in rows if r[0] not in known], "left")
        there = F.concat(F.transform(said, lambda h: F.coalesce(F.element_at(own, h["term"]), h["value"])), F.transform(F.array_sort(F.transform(more, lambda h: F.struct(h["place"], h["value"]))), lambda h: h["value"]))  # noqa: B023
        parts = F.when(intent == name, there).otherwise(parts)
    return F.array_join(F.array_distinct(F.concat(F.array(F.trim(F.coalesce(text, F.lit("")))), parts, F.coalesce(extra, F.array().cast("array<string>")))), " ")
