"""Functions over whole Arrow batches, for what the built-in functions do not hold: Unicode forms, vectors, samples."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@cache
def _marks() -> dict[int, None]:
    """Combining characters, to be dropped by str.translate."""
    return dict.fromkeys(c for c in range(0x110000) if unicodedata.combining(chr(c)))


def slugs(texts: pd.Series) -> pd.Series:
    """Lower-case words joined by hyphens, without accents and signs, at most 140 characters; a hash where none is left."""
    plain = texts.fillna("").str.strip().str.lower().str.normalize("NFKD").str.translate(_marks())
    kept = plain.str.replace(r"[^\w\s-]", "", regex=True).str.replace(r"[\s_]+", "-", regex=True).str.strip("-").str[:140]
    return kept.where(kept != "", plain.map(lambda p: hashlib.sha1((p or "record").encode()).hexdigest()[:12]))


RUN = 1 << 20  # bytes of text that a task holds as Python strings at once; a longer text is a run of its own


def runs(texts: pa.Array, limit: int = RUN) -> Iterator[slice]:
    """Ranges of rows of about `limit` bytes of text, in order; Arrow holds a batch, Python only one range."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n + 64 > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n + 64
    if start < len(sizes):
        yield slice(start, len(sizes))


def by_runs(make: Callable[..., pa.Array], kind: pa.DataType, texts: pa.Array, *others: pa.Array) -> pa.Array:
    """make(texts, *others) of each run, put together."""
    return pa.concat_arrays([pa.array([], kind), *(make(*[x[r] for x in (texts, *others)]).cast(kind) for r in runs(texts))])


@F.arrow_udf(StringType())
def slugify(texts: pa.Array) -> pa.Array:
    return by_runs(lambda part: pa.array(slugs(pd.Series(part.to_pylist(), dtype=object)).tolist(), pa.string()), pa.string(), texts)


CELL, SIGN, GRAM = 0, 7, 3  # fixed values: salts of a feature's cell, of its sign and of a letter trigram's cell


def _blake2b(s: str, salt: int) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "big")


def _md5(texts: list[str], salt: int) -> np.ndarray:
    """The first two numbers of 32 bits of each text's digest."""
    found = b"".join([hashlib.md5(f"{salt}:{s}".encode(), usedforsecurity=False).digest() for s in texts])
    return np.frombuffer(found, dtype=">u4").reshape(-1, 4)[:, :2].astype(np.uint64)


def _trigram(packed: int) -> str:
    return "".join(chr(packed >> at & 0x1FFFFF) for at in (42, 21, 0))


SEEN = 1 << 16  # trigrams whose digest a worker keeps: most come again, words do not
_kept = lru_cache(maxsize=SEEN)

#: Numbers for the cell and the sign of each feature, and for the cell of a packed trigram. md5 is a form that SQL can restate.
DIGESTS = {
    "blake2b": (lambda ws: np.array([(_blake2b(w, CELL), _blake2b(w, SIGN)) for w in ws], dtype=np.uint64).reshape(-1, 2), _kept(lambda g: _blake2b(_trigram(g), GRAM))),
    "md5": (lambda ws: _md5(ws, CELL), _kept(lambda g: int(_md5([_trigram(g)], GRAM)[0, 0]))),
}


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code) of the letter trigrams that start at every second letter, and the packed trigrams by code."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    counts = np.maximum((sizes - 1) // 2, 0)
    starts, total = np.repeat(np.cumsum(sizes) - sizes, counts), int(counts.sum())
    starts += 2 * (np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts))
    own = np.zeros(int(letters.max(initial=0)) + 1, dtype=bool)
    own[letters] = True
    alphabet = np.flatnonzero(own)
    place = np.cumsum(own) - 1
    n = max(1, len(alphabet))
    x = place[letters]
    numbers = (x[starts] * n + x[starts + 1]) * n + x[starts + 2]
    if n**3 <= 1 << 20:  # few letters: trigrams are counted in place, not sorted
        held = np.zeros(n**3, dtype=bool)
        held[numbers] = True
        kinds, codes = np.flatnonzero(held), (np.cumsum(held) - 1)[numbers]
    else:
        kinds, codes = np.unique(numbers, return_inverse=True)
    packed = alphabet[kinds // n // n] << 42 | alphabet[kinds // n % n] << 21 | alphabet[kinds % n] if total else np.zeros(0, dtype=np.int64)
    return np.repeat(np.arange(len(texts)), counts), codes, packed


def hash_vectors(rows: np.ndarray, codes: np.ndarray, names: list[str], compacts: list[str], dims: int, digest: str = "blake2b") -> np.ndarray:
    """A unit vector for each of `compacts`, texts in lower case without white space.

    rows, codes: the features of the texts in order, by their place in `names`. Features of a row that share a cell add
    up to 1 + ln(count), with the sign of the last one; a trigram adds a quarter of its cell's sign (plus where the cell
    has none). A digest is taken once a distinct feature. Rows without features and trigrams stay zero."""
    (of_word, of_gram), size = DIGESTS[digest], len(compacts) * dims
    used, codes = np.unique(codes, return_inverse=True)
    drawn = of_word([names[c] for c in used.tolist()]) % np.uint64(dims)
    places, signs = drawn[:, 0].astype(np.int64), 1.0 - 2.0 * (drawn[:, 1] % np.uint64(2)).astype(np.float64)
    at, sign = rows * dims + places[codes] if len(codes) else np.zeros(0, dtype=np.int64), np.ones(size)
    sign[at] = signs[codes]  # the last of equal places stays
    counts = np.bincount(at, minlength=size)
    out = np.where(counts > 0, sign * (1 + np.log(np.maximum(counts, 1))), 0.0)
    row, gram, kinds = _grams(compacts)
    cells = np.array([of_gram(g) % dims for g in kinds.tolist()], dtype=np.int64)
    if len(gram):
        out += 0.25 * sign * np.bincount(row * dims + cells[gram], minlength=size)
    out = out.reshape(len(compacts), dims)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def hash_embed(features, compact, dims: int = 768, digest: str = "blake2b", kind: str = "float"):
    """Column of unit vectors from feature arrays (functions.text.expand) and compact texts (functions.text.compact)."""

    cell = np.float32 if kind == "float" else np.float64
    whole = pa.list_(pa.from_numpy_dtype(cell))

    def vectors(ts: pa.Array, fs: pa.Array) -> pa.Array:
        coded = fs.flatten().dictionary_encode()
        rows = np.repeat(np.arange(len(fs)), pc.fill_null(pc.list_value_length(fs), 0).to_numpy(zero_copy_only=False))
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        found = hash_vectors(rows, codes, coded.dictionary.to_pylist(), [t or "" for t in ts.to_pylist()], dims, digest).astype(cell)
        return pa.ListArray.from_arrays(np.arange(0, (len(ts) + 1) * dims, dims, dtype=np.int32), pa.array(found.ravel()))

    @F.arrow_udf(f"array<{kind}>")
    def embed(fs: pa.Array, ts: pa.Array) -> pa.Array:
        return by_runs(vectors, whole, ts, fs)

    return embed(features, compact)


SILENCE = -96.0


@F.arrow_udf(DoubleType())
def dbfs(samples: pa.Array) -> pa.Array:
    """RMS level of 16-bit samples against full scale; SILENCE where there is none."""

    def level(raw: bytes | None) -> float:
        pcm = np.frombuffer(raw or b"", dtype="<i2", count=len(raw or b"") // 2).astype(np.float64)
        power = float(pcm @ pcm) / max(1, len(pcm))
        return max(SILENCE, 10 * float(np.log10(power / 32768.0**2))) if power else SILENCE

    return by_runs(lambda part: pa.array(map(level, part.to_pylist()), pa.float64()), pa.float64(), samples)
