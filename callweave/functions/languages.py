"""Language identification with memory: scripts, marker words, named languages, fusion of votes, and a fold over turns.

Everything of a text is read in one pass: code points are sorted into the blocks of eleven scripts by a table, and all
marker words of all languages are found by one automaton (`terms.Matcher`). Tables are parameters; the defaults are our
own short ones. Scores of a language add up:

* 6 x the share of a script that it is written in, for scripts with a quarter of the letters or more;
* the weights of its marker words, for texts in its script;
* for Latin letters (or no known script): English markers x (1 + Latin share), romanised markers of another language x its
  factor a word, 6 for English words without any romanised marker, and 6 x the Latin share where it is 0.6 or more and
  nothing else speaks.

Confidence is min(0.98, 0.45 share + 0.4 margin + 0.35 evidence), evidence being the best score over 12 at most; equal
scores go to the preferred language, then to the first name. Empty texts are the default language with confidence 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_runs
from .terms import Matcher, table

# The blocks of the scripts.
BLOCKS = [
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("odia", 0x0B00, 0x0B7F), ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("arabic", 0x0600, 0x06FF), ("latin", 0x0041, 0x005A), ("latin", 0x0061, 0x007A), ("latin", 0x00C0, 0x024F),
]
SCRIPTS = list(dict.fromkeys(name for name, _, _ in BLOCKS))
# Fixed values of the rule: weights of the votes and of their fusion.
SCRIPT_VOTE, LEAST_SHARE, EVIDENCE = 6.0, 0.25, 12.0
LEXICAL, EXPLICIT, ACOUSTIC, AMBIGUOUS = 0.48, 1.0, 0.62, 0.12
SWITCH, STREAK = 0.75, 2


@dataclass
class Rules:
    """What is known of languages. Markers are (word, weight); romanised markers count weight x factor a word of the text."""

    default: str = "en-IN"
    preferred: str = "mr-IN"
    written: dict[str, list[str]] = field(default_factory=lambda: {"devanagari": ["hi-IN", "mr-IN"], "bengali": ["bn-IN"], "gurmukhi": ["pa-IN"], "gujarati": ["gu-IN"], "odia": ["or-IN"], "tamil": ["ta-IN"], "telugu": ["te-IN"], "kannada": ["kn-IN"], "malayalam": ["ml-IN"], "arabic": ["ur-IN"]})
    markers: dict[str, list[tuple[str, float]]] = field(default_factory=lambda: {"hi-IN": [("है", 3.0), ("हैं", 3.0), ("नहीं", 3.0), ("मुझे", 3.0), ("क्या", 2.0), ("का", 1.5), ("की", 1.5)], "mr-IN": [("आहे", 4.0), ("आहेत", 4.0), ("नाही", 3.0), ("मला", 3.0), ("काय", 3.0), ("चा", 2.0), ("ची", 2.0)]})
    english: list[tuple[str, float]] = field(default_factory=lambda: [(w, 2.0) for w in "the and of to in that is was with for what how".split()])
    romanised: dict[str, tuple[float, list[tuple[str, float]]]] = field(default_factory=lambda: {"hi-IN": (12.0, [(w, 2.0) for w in "hai kya mujhe nahi kaise batao chahiye".split()]), "mr-IN": (16.0, [(w, 3.0) for w in "mala aahe pahije kasa sanga".split()])})
    latin: dict[str, list[tuple[str, float]]] = field(default_factory=lambda: {"fr-FR": [(w, 2.0) for w in "le la les des est une dans que pour avec".split()], "de-DE": [(w, 2.0) for w in "der die das und ist nicht ein den mit von".split()], "es-ES": [(w, 2.0) for w in "el los las una del que por con para es".split()]})
    names: list[tuple[str, str]] = field(default_factory=lambda: [("english", "en-IN"), ("hindi", "hi-IN"), ("हिंदी", "hi-IN"), ("हिन्दी", "hi-IN"), ("marathi", "mr-IN"), ("मराठी", "mr-IN"), ("bengali", "bn-IN"), ("বাংলা", "bn-IN"), ("gujarati", "gu-IN"), ("ગુજરાતી", "gu-IN"), ("punjabi", "pa-IN"), ("tamil", "ta-IN"), ("தமிழ்", "ta-IN"), ("telugu", "te-IN"), ("kannada", "kn-IN"), ("malayalam", "ml-IN"), ("urdu", "ur-IN"), ("odia", "or-IN"), ("french", "fr-FR"), ("german", "de-DE"), ("spanish", "es-ES")])

    def codes(self) -> list[str]:
        return sorted({self.default, *self.markers, *self.romanised, *self.latin, *(c for cs in self.written.values() for c in cs)})


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Place of the script + 1 of each code point of the blocks, and whether it is a letter."""
    script, letter = np.zeros(0x10000, dtype=np.int8), np.array([chr(c).isalpha() for c in range(0x10000)])
    for name, low, high in BLOCKS:
        script[low : high + 1] = SCRIPTS.index(name) + 1
    return script, letter


def profile(text: str) -> dict[str, float]:
    """Share of each script among the letters of a text; letters outside the blocks count in the whole only."""
    script, letter = _classes()
    points = np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4"), 0xFFFF)
    found = script[points[letter[points]]]
    counts = np.bincount(found, minlength=len(SCRIPTS) + 1)
    return {s: counts[i + 1] / len(found) for i, s in enumerate(SCRIPTS) if counts[i + 1]} if len(found) else {}


class Identifier:
    """Scores, names and fusion under some rules."""

    def __init__(self, rules: Rules | None = None):
        self.rules = r = rules or Rules()
        self.weights: dict[str, list[tuple[str, str, float]]] = {}
        groups = [("script", c, 1.0, ms) for c, ms in r.markers.items()] + [("english", r.default, 1.0, r.english)] + [("latin", c, 1.0, ms) for c, ms in r.latin.items()]
        for kind, code, factor, ms in groups + [("roman", c, f, ms) for c, (f, ms) in r.romanised.items()]:
            for word, weight in ms:
                self.weights.setdefault(word.lower(), []).append((kind, code, factor * weight))
        self.marks = Matcher(table((w, "") for w in self.weights), "word")
        self.named = Matcher(table(r.names), "left")

    def scores(self, text: str) -> dict[str, float]:
        """Lexical scores of the languages, those that are 0 left out."""
        r, shares = self.rules, profile(text)
        latin, words = shares.get("latin", 0.0), max(1, len(text.split()))
        out: dict[str, float] = {}
        add = lambda code, x: out.__setitem__(code, out.get(code, 0.0) + x)
        strong = {s: x for s, x in shares.items() if s in r.written and x >= LEAST_SHARE}
        for s in strong:
            for code in r.written[s]:
                add(code, SCRIPT_VOTE * max(strong.values()))
        own = {c for s in strong for c in r.written[s]}
        sums: dict[str, float] = {}
        for word, _, _, _ in self.marks.hits(text):
            for kind, code, weight in self.weights[word]:
                sums[f"{kind} {code}"] = sums.get(f"{kind} {code}", 0.0) + weight
        for code in own:
            add(code, sums.get(f"script {code}", 0.0))
        if latin >= LEAST_SHARE or not strong:
            english = sums.get(f"english {r.default}", 0.0)
            roman = {c: sums.get(f"roman {c}", 0.0) for c in r.romanised}
            other = {c: sums.get(f"latin {c}", 0.0) for c in r.latin}
            add(r.default, english * (1 + latin))
            for c, x in roman.items():
                add(c, x / words)
            for c, x in other.items():
                add(c, x * (1 + latin))
            if english > 0 and not any(roman.values()) and not any(other.values()):
                add(r.default, 6.0)
            if latin >= 0.6 and not strong and not any(roman.values()) and not any(other.values()):
                add(r.default, 6.0 * latin)
        return {c: x for c, x in out.items() if x > 0}

    def ranked(self, scores: dict[str, float]) -> list[tuple[str, float]]:
        return sorted(scores.items(), key=lambda kv: (-kv[1], kv[0] != self.rules.preferred, kv[0]))

    def lexical(self, text: str | None) -> tuple[str, float]:
        """Language and confidence by the text alone."""
        scores = self.scores(text or "")
        if not (text or "").strip() or not scores:
            return self.rules.default, 0.0
        order = self.ranked(scores)
        total, best = sum(scores.values()), order[0][1]
        second = order[1][1] if len(order) > 1 else 0.0
        return order[0][0], round(min(0.98, 0.45 * best / total + 0.4 * (best - second) / total + 0.35 * min(1.0, best / EVIDENCE)), 3)

    def name(self, text: str | None) -> str | None:
        """The longest language name that the text holds at a word's edge."""
        hits = self.named.hits(text)
        return max(hits, key=lambda h: (len(h[0]), -h[3]))[1] if hits else None

    def fused(self, text: str | None, heard: str | None = None, certainty: float = 0.0) -> tuple[str, float]:
        """Language and confidence by a named language, the text, and a vote of another kind (`heard`, of some certainty).

        Where the text's own winner wins, its calibrated confidence counts and the other vote only moves it. A vote of no
        certainty still names the language where nothing else speaks; a negative certainty counts as 0."""
        scores = {c: x / EVIDENCE * LEXICAL for c, x in self.scores(text or "").items()}
        named, (own, sure) = self.name(text), self.lexical(text)
        if named:
            scores[named] = scores.get(named, 0.0) + 0.97 * EXPLICIT
        if heard:
            scores[heard] = scores.get(heard, 0.0) + max(0.0, certainty) * ACOUSTIC
        if not scores:
            return self.rules.default, 0.0
        order = self.ranked(scores)
        best, second = order[0][1], order[1][1] if len(order) > 1 else 0.0
        total = sum(scores.values()) or 1.0  # 0 where a vote of no certainty is all there is
        confidence = min(0.99, best / total * 0.75 + best / 1.6 * 0.45) * (0.85 if best - second < AMBIGUOUS else 1.0)
        if own == order[0][0] and (text or "").strip():
            confidence = max(sure, 0.97) if named == own else sure
            confidence = confidence if not heard else min(0.99, confidence + 0.08) if heard == own else confidence * 0.7
        return order[0][0], round(min(0.99, confidence), 3)


RESULT = "struct<language: string, confidence: double>"


def profiles(text) -> F.Column:
    """Column of script shares in the order of SCRIPTS."""

    def told(texts: pa.Array) -> pa.Array:
        found = [profile(one.as_py() or "") for one in texts]
        return pa.array([[p.get(s, 0.0) for s in SCRIPTS] for p in found], pa.list_(pa.float64()))

    @F.arrow_udf("array<double>")
    def shares(texts: pa.Array) -> pa.Array:
        return by_runs(told, pa.list_(pa.float64()), texts)

    return shares(text)


def identified(text, heard=None, certainty=None, rules: Rules | None = None) -> F.Column:
    """Column of (language, confidence): fused from the text and, where given, another vote and its certainty."""
    made: list[Identifier] = []

    kind = pa.struct([("language", pa.string()), ("confidence", pa.float64())])

    def judged(texts: pa.Array, votes: pa.Array, sure: pa.Array) -> pa.Array:
        rows = [made[0].fused(t.as_py(), v or None, 0.0 if c is None or c != c else c) for t, v, c in zip(texts, votes.to_pylist(), sure.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], fields=list(kind))

    @F.arrow_udf(RESULT)
    def judge(texts: pa.Array, votes: pa.Array, sure: pa.Array) -> pa.Array:
        if not made:
            made.append(Identifier(rules))
        return by_runs(judged, kind, texts, votes, sure)

    return judge(text, F.lit(None).cast("string") if heard is None else heard, F.lit(None).cast("double") if certainty is None else certainty)


class Memory:
    """The language of a conversation: the first sure one, then whatever is named, or heard on two turns running."""

    def __init__(self):
        self.language, self.streak, self.other = None, 0, None

    def hear(self, language: str, confidence: float, named: bool) -> str | None:
        if named or self.language is None:
            if named or confidence > 0:
                self.language, self.streak, self.other = language, 0, None
        elif language != self.language and confidence >= SWITCH:
            self.streak = self.streak + 1
            self.other = language
            if self.streak >= STREAK:
                self.language, self.streak, self.other = language, 0, None
        else:
            self.streak, self.other = 0, None
        return self.language


def followed(turns: DataFrame, rules: Rules | None = None, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """key, order, language, confidence, held: each turn's own language, and the one that the conversation is held in.

    A conversation streams through one `Memory` in order; nothing of it is gathered. Null keys are one conversation."""
    kinds = {c: turns.schema[c].dataType.simpleString() for c in (key, order)}
    dealt = turns.select(key, order, F.coalesce(F.col(text), F.lit("")).alias("text")).repartition(key).sortWithinPartitions(key, order, "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, memory, now = Identifier(rules), None, None
        for batch in batches:
            rows = []
            for k, said in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if memory is None or k != now:
                    memory, now = Memory(), k
                language, confidence = who.fused(said)
                rows.append((language, confidence, memory.hear(language, confidence, who.name(said) is not None)))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], [key, order, "language", "confidence", "held"])

    return dealt.mapInArrow(work, f"{key} {kinds[key]}, {order} {kinds[order]}, language string, confidence double, held string")
