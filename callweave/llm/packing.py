"""Packing token sequences by Karmarkar-Karp multiway differencing.

Each document becomes its token ids and an end id. It is cut into full windows, which are sequences by
themselves, and a remainder, cut into pieces of at most PIECE tokens. Pieces are dealt by a hash of their
document, place and row number into bins of about GROUP pieces: the bin count follows the input, and equal
rows go to different bins, so no bin grows. In a bin, differencing starts
with a partial partition per piece and keeps merging the two with the largest imbalance, the fullest
window of one with the emptiest of the other, until one is left. The window count starts at
ceil(sum / capacity) and rises by one while any window exceeds the capacity.

Only piece lengths and checksums are shuffled, never ids. Defined cases: a null or empty text is the end
id alone; a null doc_id is kept; repeated rows are packed as documents of their own; an empty table gives
an empty result; extra columns are not read. Texts are tokenised whole.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table, text_runs

CAPACITY, PIECE, GROUP, END_ID = 2048, 512, 512, 1
WORDS_KEPT, RUN_BYTES = 400_000, 1 << 20  # words in a generation of a worker's cache; text encoded at once
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Characters that need no care: ASCII but the apostrophe, and the letters of Latin-1. Anything else, and
# the opening of a special token, sends its word to the tokenizer as it stands.
_CARE = re.compile("<\\||[^\t\n\x0b\x0c\r -&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
_SIGN = "[!-/:-@\\[-`{-~]"
_PIECE = re.compile(f"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|{_SIGN}+")
_SIGNS_MEET = re.compile(f"[.,]{_SIGN}|{_SIGN}[.,]")
_SPACE = re.compile("[ \t\n\x0b\x0c\r]+")


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The vocabulary lowers a text and cuts it at white space and between letters, single digits and runs of
    other signs before it merges anything. So ids are looked up by word, those of a new word by its pieces,
    and new pieces are encoded together. The cache keeps two generations: words used again move to the new
    one, the old one goes when that is full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.old = Tokenizer.from_file(path), {}, {}

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _words(self, text: str) -> list[str]:
        if _CARE.search(text):
            return [w if _CARE.search(w) else w.lower() for w in _SPACE.split(text)]
        text = text.lower()
        if not _SIGNS_MEET.search(text):  # stops and commas stand alone: cut them off, so that fewer words differ
            text = text.replace(",", " , ").replace(".", " . ")
        return text.split()

    def _encode(self, new: list[str]) -> None:
        """Encode pieces that the tokenizer takes for one word each."""
        for a in range(0, len(new), 50_000):
            part = new[a : a + 50_000]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            raw = np.asarray(found.ids, dtype="<u4").tobytes()
            ends = np.cumsum(np.bincount(np.asarray(found.word_ids, dtype=np.int64), minlength=len(part))) * 4
            start = 0
            for piece, end in zip(part, ends.tolist(), strict=True):
                self.known[piece] = raw[start:end]
                start = end

    def _missing(self, keys) -> list[str]:
        """Those of the keys that neither generation holds."""
        out, known, old = [], self.known, self.old
        for k in keys:
            if k in old:
                known[k] = old[k]
            elif k not in known:
                out.append(k)
        return out

    def _learn(self, new: set[str]) -> None:
        pieces, composed = [], []
        for w in self._missing(new):
            (pieces if w.isascii() and w.isalpha() else composed).append(w)
        parts = {w: _PIECE.findall(w) for w in composed if not _CARE.search(w)}
        self._encode(list(set(pieces).union(self._missing(set().union(*parts.values()).difference(self.known)))))
        known = self.known
        for w, p in parts.items():
            if w not in known:
                known[w] = b"".join([known[x] for x in p])
        for w in composed:
            if w not in known:
                known[w] = self._ids(w)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > WORDS_KEPT:
            self.known, self.old = {}, self.known
        split = [self._words(t) for t in texts]
        new: set[str] = set()
        for words in split:
            new |= set(words).difference(self.known)
        self._learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for a Python worker, whose cache serves all its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(tokens: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length): full windows, then a remainder in near-equal pieces of at most `piece`."""
    full = tokens // capacity * capacity
    out = [(s, capacity) for s in range(0, full, capacity)]
    if rest := tokens - full:
        n = -(-rest // piece)
        edges = [full + rest * i // n for i in range(n + 1)]
        out += [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return out


def difference(sizes: np.ndarray, windows: int) -> list[list[int]]:
    """Karmarkar-Karp: item indices of each of `windows` sets with near-equal sums."""
    heap = []
    for i, n in enumerate(sizes):  # sums ascend; only the filled end of a partial partition is held
        heap.append((-int(n), i, [int(n)], [[i]]))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, sums_a, sets_a = heapq.heappop(heap)
        _, _, sums_b, sets_b = heapq.heappop(heap)
        if len(sums_a) < len(sums_b):
            sums_a, sets_a, sums_b, sets_b = sums_b, sets_b, sums_a, sets_a
        # windows not listed hold nothing: the smaller's fullest meet the larger's empty ones first
        free = windows - len(sums_a)
        sums, sets = list(sums_a), list(sets_a)
        k = len(sums_b)
        low = [0] * min(free, k)
        for j in range(k):  # fullest of b against emptiest of a
            n, s = sums_b[k - 1 - j], sets_b[k - 1 - j]
            if j < len(low):
                sums.append(n)
                sets.append(s)
            else:
                at = j - len(low)
                sums[at] += n
                sets[at] = sets[at] + s
        order = np.argsort(sums, kind="stable")
        sums, sets = [sums[i] for i in order], [sets[i] for i in order]
        if len(sums) == windows and sums[0]:
            gap = sums[-1] - sums[0]
        else:
            gap = sums[-1]
        heapq.heappush(heap, (-gap, serial, sums, sets))
        serial += 1
    return heap[0][3] if heap else []


def pack_bin(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of item indices, none above the capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        sets = difference(sizes, windows)
        if max((int(sizes[s].sum()) for s in sets), default=0) <= capacity:
            return sets
        windows += 1


def pieces(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, deal (a hash that deals bins)."""
    path = path or vocabulary()

    def work(batches):
        encode, serial = encoder(path), 0
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for a, texts in text_runs(batch, 1, RUN_BYTES):
                at, starts, lengths, sums, totals, deals = [], [], [], [], [], []
                deal = batch.column(2).slice(a, len(texts)).to_pylist()
                for i, ids in enumerate(encode(texts)):
                    ids += end
                    tokens = len(ids) // 4
                    serial += 1
                    for start, n in cuts(tokens):
                        at.append(a + i)
                        starts.append(start)
                        lengths.append(n)
                        sums.append(zlib.crc32(ids[4 * start : 4 * (start + n)]))
                        totals.append(tokens)
                        deals.append((deal[i] * 31 + start * 0x9E3779B97F4A7C1 + serial * 0xD6E8FEB86659FD9) % (1 << 62))
                doc = batch.column(0).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [doc, *[pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals, deals)]],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"],
                )

    own = docs.selectExpr(f"cast(`{id_column}` as long) doc_id", f"cast(`{text_column}` as string) text").withColumn(
        "deal", F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(1 << 40))
    )
    return own.mapInArrow(work, PIECES)


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(key, bin_rows):
    order = np.lexsort([bin_rows.column(c).to_numpy() for c in ("start", "ids_crc32", "deal")])
    bin_rows = bin_rows.take(pa.array(order))
    sizes = bin_rows.column("length").to_numpy()
    sequence, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    number = key[0].as_py()
    for k, items in enumerate(pack_bin(sizes)):
        sequence[items] = 2 * (number << 24 | k) + 1  # odd; full windows take even numbers
        offset[items] = np.concatenate([[0], np.cumsum(sizes[items])[:-1]])
    kept = bin_rows.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))


def pack(docs: DataFrame, **options) -> DataFrame:
    """One row per piece, with the sequence that holds it and its offset there."""
    cut = materialise(pieces(docs, **options), "pack-pieces")
    full = cut.filter(F.col("length") == CAPACITY)
    rest = cut.filter(F.col("length") < CAPACITY)
    bins = max(1, math.ceil(rest.count() / GROUP))
    packed = rest.withColumn("bin", F.pmod(F.xxhash64("deal", "ids_crc32"), F.lit(bins))).groupBy("bin").applyInArrow(_pack, PACKED)
    whole = full.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (2 * F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return packed.unionByName(whole)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
