"""Secret scan: fixed patterns, and a linear-chain CRF over white-space tokens with begin/inside/outside tags.

A token's score for each tag is the sum of weights of its own shape class and word, of those of its neighbours
(two before, one after) and of file features; tag pairs add transition weights; Viterbi decodes. A shape class
holds length, character mix, an assignment sign and whether the word names a credential; words of letters fall into
WORDS buckets by hash. The CRF is trained by gradient of the log-likelihood (forward-backward in
numpy, many windows at once) on a bounded sample: at most WINDOWS_PER_DOC windows of each of TRAIN_DOCS documents,
labelled by the patterns, and MADE_WINDOWS made lines. Those hold forms that no pattern knows (names joined to a
value by words or arrows, pass phrases, bearer values) and near misses (credential words in prose, addresses,
dates, long numbers, identifiers). Its weights have a fixed size, so the broadcast is bounded. Spans of the CRF
that touch no pattern span, and hold a token with digits or inner signs, are added as kind `crf`.

Whole texts are scanned. A document in which no token can beat `outside`, by an exact bound on scores,
skips Viterbi. Defined cases: a null or empty text has no spans; repeated rows give repeated rows, and count once
in training; null ids stay; ties of tags go to the first of outside, begin, inside; an empty table gives an empty
result; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_runs

TRAIN_DOCS, WINDOWS_PER_DOC, MADE_WINDOWS, WINDOW = 3000, 8, 2000, 12  # the bounds of the training sample
CONTEXTS = 400  # windows without a secret that lend made lines their ordinary words
WORDS_KEPT = 200_000
O, B, I = 0, 1, 2  # noqa: E741

_either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_KEYS = "|".join([*(_either(w) for w in ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
ASSIGN = re.compile(rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a run is taken whole, so a shorter one fails with all its parts
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ["assign", "access", "hex", "crf"]

#: Words that name a credential, as whole words or parts joined by _ - or .
NAMES = frozenset("password passwd pwd secret token apikey api_key key credential credentials passphrase auth bearer private".split())
_PARTS = re.compile(r"[^A-Za-z]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SIZES, MIXES, WORDS = 5, 8, 4096
CLASSES = 2 * 2 * SIZES * MIXES + 1  # the last class stands for "no neighbour"
FILES = 6
NONE = (CLASSES - 1) * WORDS  # code of a place beyond the text


def word_class(word: str) -> int:
    """Class of a token: names a credential, holds an assignment sign, length, character mix."""
    core = word.strip("\"'`,;()[]{}<>")
    parts = _PARTS.split(core.lower())
    named = any(p in NAMES for p in parts if p) or "apikey" in core.lower().replace("_", "").replace("-", "")
    sign = "=" in word or ":" in word
    n = len(core)
    size = 0 if n < 8 else 1 if n < 12 else 2 if n < 20 else 3 if n < 32 else 4
    digits = sum(c.isdigit() for c in core)
    upper = sum(c.isupper() for c in core)
    if not core or not any(c.isalnum() for c in core):
        mix = 0
    elif digits == 0:
        mix = 1 if upper in (0, n) or core.istitle() else 2
    elif digits == n:
        mix = 3
    elif "@" in core or "://" in core:
        mix = 4
    elif all(c in "0123456789abcdef" for c in core):
        mix = 5
    elif core.isascii() and len(set(core)) > 0.4 * n:
        mix = 6
    else:
        mix = 7
    return ((2 * named + sign) * SIZES + size) * MIXES + mix


def code_of(word: str) -> int:
    """Class and word bucket of a token as one number; words with digits or inner signs share the first bucket."""
    core = word.strip("\"'`,;:=()[]{}<>.!?*-").lower()
    plain = core.replace("_", "").replace("-", "").isalpha()
    return word_class(word) * WORDS + (1 + crc32(core.encode("utf-8", "replace")) % (WORDS - 1) if plain else 0)


class Codes(dict):
    """Codes of words, made when they are first asked for."""

    def __missing__(self, word: str) -> int:
        code = self[word] = code_of(word)
        return code

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def file_class(codes: np.ndarray) -> int:
    """File feature: whether a word names a credential, by a coarse length of the file."""
    named = bool((codes >= 2 * SIZES * MIXES * WORDS).any())
    return 3 * named + (0 if len(codes) < 200 else 1 if len(codes) < 2000 else 2)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


PLACES = ["own", "prev", "prev2", "next"]  # whose class and word a token's score reads


class Tagger:
    """Weights of the chain; scores are summed per tag."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        if weights is None:
            weights = {f"{p} class": np.zeros((CLASSES, 3)) for p in PLACES} | {f"{p} word": np.zeros((WORDS, 3)) for p in PLACES}
            weights |= {"file": np.zeros((FILES, 3)), "pair": np.zeros((3, 3))}
        self.w = weights

    @staticmethod
    def around(codes: np.ndarray) -> dict[str, np.ndarray]:
        """Codes at each place, for rows of codes along the last axis."""
        edge = np.full((*codes.shape[:-1], 2), NONE)
        prev2 = np.concatenate([edge, codes], axis=-1)
        return {"own": codes, "prev": prev2[..., 1:-1], "prev2": prev2[..., :-2], "next": np.concatenate([codes[..., 1:], edge[..., :1]], axis=-1)}

    def scores(self, codes: np.ndarray, file: np.ndarray | int) -> np.ndarray:
        out = self.w["file"][file]
        for place, at in self.around(codes).items():
            out = out + self.w[f"{place} class"][at // WORDS] + self.w[f"{place} word"][at % WORDS]
        return out

    def viterbi(self, unary: np.ndarray) -> np.ndarray:
        pair, n = self.w["pair"], len(unary)
        back = np.zeros((n, 3), dtype=np.int8)
        best = unary[0].copy()
        best[I] = -np.inf
        for t in range(1, n):
            step = best[:, None] + pair
            step[O, I] = -np.inf
            back[t] = step.argmax(axis=0)
            best = step.max(axis=0) + unary[t]
        tags = np.zeros(n, dtype=np.int8)
        tags[-1] = best.argmax()
        for t in range(n - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags

    def marginals(self, unary: np.ndarray, filled: np.ndarray):
        """Forward-backward over rows of tokens: tag probabilities, and tag-pair probabilities summed over each row."""
        pair = self.w["pair"].copy()
        pair[O, I] = -1e9
        a, b = np.zeros(unary.shape), np.zeros(unary.shape)
        a[:, 0] = unary[:, 0] + np.array([0, 0, -1e9])
        n = unary.shape[1]
        for t in range(1, n):
            a[:, t] = np.where(filled[:, t, None], _lse(a[:, t - 1, :, None] + pair, 1) + unary[:, t], a[:, t - 1])
        for t in range(n - 2, -1, -1):
            b[:, t] = np.where(filled[:, t + 1, None], _lse(pair + (unary[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
        z = _lse(a[:, -1], 1)
        pairs = np.zeros((len(unary), 3, 3))
        for t in range(1, n):
            both = np.exp(a[:, t - 1, :, None] + pair + (unary[:, t] + b[:, t])[:, None, :] - z[:, None, None])
            pairs += np.where(filled[:, t, None, None], both, 0)
        return np.where(filled[..., None], np.exp(a + b - z[:, None, None]), 0), pairs

    def fit(self, windows: list[tuple[np.ndarray, int, np.ndarray]], epochs: int = 12, size: int = 64, rate: float = 0.2, decay: float = 1e-5, seed: int = 7):
        """Adagrad over batches of windows (codes, file class, gold tags), which are padded to one length."""
        width = max(len(c) for c, _, _ in windows)
        codes, gold, filled = np.full((len(windows), width), NONE), np.zeros((len(windows), width), dtype=np.int64), np.zeros((len(windows), width), dtype=bool)
        for i, (c, _, g) in enumerate(windows):
            codes[i, : len(c)], gold[i, : len(g)], filled[i, : len(c)] = c, g, True
        files = np.array([f for _, f, _ in windows])
        seen = {name: np.full(w.shape, 1e-6) for name, w in self.w.items()}
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in np.array_split(order, max(1, len(order) // size)):
                tags, pairs = self.marginals(self.scores(codes[at], files[at][:, None]), filled[at])
                gap = np.where(filled[at][..., None], np.eye(3)[gold[at]], 0) - tags
                grad = {name: -decay * len(at) * w for name, w in self.w.items()}
                for place, near in self.around(codes[at]).items():
                    np.add.at(grad[f"{place} class"], near // WORDS, gap)
                    np.add.at(grad[f"{place} word"], near % WORDS, gap)
                np.add.at(grad["file"], files[at], gap.sum(axis=1))
                both = filled[at][:, 1:]
                np.add.at(grad["pair"], (gold[at][:, :-1][both], gold[at][:, 1:][both]), 1)
                grad["pair"] -= pairs.sum(axis=0)
                for name, g in grad.items():
                    seen[name] += g * g
                    self.w[name] += rate * g / np.sqrt(seen[name])
        return self


_TOKEN = re.compile(r"\S+")


def labelled(text: str) -> tuple[list[str], list[int]]:
    """Tokens and gold tags: tokens that a pattern span touches are begin, then inside."""
    spans, tokens, tags, at, inside = base_spans(text), [], [], 0, -1
    for m in _TOKEN.finditer(text):
        while at < len(spans) and spans[at][2] <= m.start():
            at += 1
        hit = at < len(spans) and spans[at][0] < m.end()
        tokens.append(m.group())
        tags.append((I if inside == at else B) if hit else O)
        inside = at if hit else -1
    return tokens, tags


# Forms of made lines: what names a secret, what joins it to its value, and near misses.
_NAMED = "password passwd pwd secret token apikey api_key client_secret access_key private_key passphrase credential credentials".split()
_JOINED = ["=", ":", "is", "was", "->", "=>", ":=", "is now", "set to", "reads"]
_PROSE = ["of the", "is required", "to success", "and the", "must be changed", "was forgotten", "for each user", "is shown below", "ring with"]


def made_windows(contexts: list[list[str]], count: int = MADE_WINDOWS, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """Made lines: in two of three a credential's name, a joint and a value between ordinary words, else a near miss."""
    pick = random.Random(seed)
    small, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    text = lambda chars, a, b: "".join(pick.choice(chars) for _ in range(pick.randint(a, b)))

    def mixed(chars: str, a: int, b: int) -> str:  # a digit and a letter at least
        return "".join(pick.sample(got := text(chars, a, b) + pick.choice(digits) + pick.choice(small), len(got)))

    value_of = [
        lambda: mixed("0123456789abcdef", 14, 62), lambda: mixed(small + small.upper() + digits + "+/", 14, 42), lambda: mixed(small + digits, 10, 30),
        lambda: mixed(small + small.upper() + digits + "#$%!_", 8, 18), lambda: f"{text(small, 2, 4)}_{mixed(small + small.upper() + digits, 16, 36)}",
    ]
    decoy_of = [
        lambda: f"{text(small, 2, 6)}{pick.randint(1, 99)}@mail{pick.randint(1, 9)}.example.com", lambda: f"http://site{pick.randint(1, 99)}.example.org/a/{pick.randint(1, 9999)}",
        lambda: str(pick.randint(10**6, 10**15)), lambda: f"{pick.randint(1990, 2030)}-0{pick.randint(1, 9)}-1{pick.randint(0, 9)}", lambda: f"({pick.randint(200, 999)}) 555-{pick.randint(1000, 9999)}",
        lambda: ".".join(str(pick.randint(0, 255)) for _ in range(4)), lambda: text(small, 9, 24), lambda: f"{text(small, 3, 8)}_{text(small, 3, 8)}.txt",
    ]
    out = []
    for i in range(count):
        before, after = (list(pick.choice(contexts)[: pick.randint(2, 8)]) if contexts else ["and"] for _ in range(2))
        name = pick.choice(_NAMED)
        name = pick.choice([name, name.upper(), name.capitalize(), f"--{name}", f"my_{name}"])
        if i % 3:
            value, quote = pick.choice(value_of)(), pick.choice(("", "", '"', "'"))
            value = f"{quote}{value}{quote}" + pick.choice(("", "", "", ",", "."))
            form = pick.randrange(8)
            if form == 0:
                middle = [f"{name}{pick.choice('=:')}{value}"]
            elif form == 1:
                middle = [pick.choice(("Authorization:", "authorization", "header")), pick.choice(("Bearer", "bearer", "Basic")), value]
            elif form == 2:
                middle = [name, value]
            else:
                middle = [name, *pick.choice(_JOINED).split(), value]
            tags = [B, *[I] * (len(middle) - 1)]
        else:
            middle = [[pick.choice(decoy_of)()], [pick.choice(before)] * pick.randint(3, 9), [name, *pick.choice(_PROSE).split()], [name, *pick.choice(_PROSE).split(), pick.choice(decoy_of)()], [pick.choice(value_of)()]][i // 3 % 5]
            middle = [w for m in middle for w in m.split()]
            tags = [O] * len(middle)
        out.append((before + middle + after, [O] * len(before) + tags + [O] * len(after)))
    return out


def windows_of(text: str) -> list[tuple[list[str], int, list[int]]]:
    """Tokens, file class and gold tags around a text's pattern spans (WINDOWS_PER_DOC of them by hash), or of its middle.

    A text that names a credential and matches no pattern says nothing for sure, so it gives no window."""
    tokens, tags = labelled(text)
    file, starts = file_class(Codes().of(tokens)), [i for i, t in enumerate(tags) if t == B]
    if not starts and file >= 3:
        return []
    starts = sorted(starts, key=lambda i: crc32(f"{i} {tokens[i]}".encode("utf-8", "replace")))[:WINDOWS_PER_DOC] or [len(tokens) // 2]
    return [(tokens[max(0, i - WINDOW) : i + WINDOW + 1], file, tags[max(0, i - WINDOW) : i + WINDOW + 1]) for i in sorted(starts)] if tokens else []


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample: int = TRAIN_DOCS) -> Tagger:
    """Fit on windows of at most `sample` documents, chosen by hash of id and text, and on made lines.

    A repeated row counts once; of an id with several texts, each text counts as a document.
    """
    own = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).withColumn("print", F.xxhash64("text"))
    chosen = own.select(F.col("doc_id").alias("id"), F.col("print").alias("its")).distinct().orderBy(F.xxhash64("id", "its"), "id", "its").limit(sample)
    part = own.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("print") == F.col("its")), "left_semi")
    part = part.dropDuplicates(["doc_id", "print"])  # at most `sample` rows

    def work(batches):
        for batch in batches:
            rows = [w for _, texts in text_runs(batch, 0) for text in texts for w in windows_of(text)]
            yield pa.RecordBatch.from_pydict(
                {"tokens": [r[0] for r in rows], "file": [r[1] for r in rows], "tags": [r[2] for r in rows]},
                schema=pa.schema([("tokens", pa.list_(pa.string())), ("file", pa.int64()), ("tags", pa.list_(pa.int64()))]),
            )

    rows = part.select("text").mapInArrow(work, "tokens array<string>, file long, tags array<long>").collect()  # at most WINDOWS_PER_DOC windows of 25 tokens a sampled document
    rows.sort(key=lambda r: (r.tokens, r.file))
    codes = Codes()
    windows = [(codes.of(r.tokens), r.file, np.array(r.tags)) for r in rows]
    plain = sorted((r.tokens for r in rows if not any(r.tags)), key=lambda t: crc32(" ".join(t).encode("utf-8", "replace")))[:CONTEXTS]
    for tokens, tags in made_windows(plain):
        made = codes.of(tokens)
        windows.append((made, file_class(made), np.array(tags)))
    return Tagger().fit(windows)


SCAN = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, tagger: Tagger, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: counts, checksum of the pattern spans, and all spans with the CRF's."""
    weights = tagger.w

    def work(batches):
        tagger, known = Tagger(weights), Codes()
        pair = weights["pair"]
        slack = 2 * max(0.0, float((pair - pair[O, O]).max()))

        def added(texts: list[str]) -> dict[int, list]:
            """Spans of the chain by text; texts are scored together, two empty places apart."""
            words = [t.split() for t in texts]
            codes = [known.of(w) for w in words]
            gap = np.full(2, NONE)
            files = np.repeat([file_class(c) for c in codes], [len(c) + 2 for c in codes])
            joined_codes = np.concatenate([x for c in codes for x in (c, gap)])
            unary = tagger.scores(joined_codes, files)
            can = (np.maximum(unary[:, B], unary[:, I]) - unary[:, O] + slack > 0) & (joined_codes != NONE)
            ends = np.cumsum([len(c) + 2 for c in codes])
            found = {}
            for i in sorted(set(np.searchsorted(ends, np.flatnonzero(can), side="right").tolist())):  # elsewhere no segment can beat outside
                tags = tagger.viterbi(unary[ends[i] - 2 - len(codes[i]) : ends[i] - 2])
                if tags.any():
                    bounds = [m.span() for m in _TOKEN.finditer(texts[i])]
                    for k in np.flatnonzero(tags == B):
                        j = k
                        while j + 1 < len(tags) and tags[j + 1] == I:
                            j += 1
                        if (codes[i][k : j + 1] % WORDS == 0).any():  # a value has digits or signs; plain words alone are none
                            found.setdefault(i, []).append((bounds[k][0], 3, bounds[j][1]))
            return found

        for batch in batches:
            for a, texts in text_runs(batch, 1):
                if len(known) > WORDS_KEPT:
                    known.clear()
                rows, found = [], added(texts)
                for i, text in enumerate(texts):
                    base = base_spans(text)
                    counts = [sum(k == n for _, k, _ in base) for n in range(3)]
                    more = [s for s in found.get(i, ()) if not any(x < s[2] and s[0] < y for x, _, y in base)]
                    rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more))))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 3 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(texts)), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return docs.selectExpr(f"cast(`{id_column}` as long) doc_id", f"cast(`{text_column}` as string) text").mapInArrow(work, SCAN)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
