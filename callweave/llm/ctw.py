"""Language-model scoring by context-tree weighting over byte contexts.

A text is scored as its tokens: words `[^\\x20\\x09-\\x0D]+` with A-Z lowered, one space between them, and
one end byte. Every byte is eight binary decisions; a decision's context is the bits of the byte already
seen and the last 0 to DEPTH bytes. Each context has a Krichevsky-Trofimov estimate from training counts,
and the tree weighting mixes the estimates of all depths:

    P_w(s) = P_kt(s) / 2 + prod_c P_w(c) / 2        (P_w = P_kt at DEPTH)

so a decision's probability is a chain of posterior-weighted mixtures from the root to the leaf. The tree
is a table: counts of (context, byte) are summed over the whole corpus, subtrees are worked in buckets of
contexts, the levels above them by grouped sums and joins, and nothing of it is collected.

Texts are dealt by id and text into blocks of about BLOCK_BYTES. A block packs its distinct (context, byte) pairs, by
bucket of contexts, and its words, by bucket of words, into sorted and compressed runs; a bucket adds up the
runs of all blocks, and sends each block the scores of its own run. So a task needs the part of the model
that its own block uses, rows are runs and not single pairs, and no broadcast grows with the corpus.

Defined cases: a null or empty text is the end alone; a null id is a training document (crc32 of the empty
text mod FOLDS is 0), dealt by its text; repeated rows are scored alike and trained on as often as they come; an empty table
gives an empty result; extra columns are not read; without training documents every estimate is 1/2.
"""

from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

DEPTH, ROOT, FOLDS, HELD_OUT = 5, 3, 7, 2
BLOCK_BYTES, BUCKET_BYTES = 16 << 20, 2 << 20  # text of a block; text of the corpus for each bucket of pairs
END = 10  # the end byte; no word holds it
RUN_BYTES = 1 << 20
RUN = "block long, size long, items binary, amounts binary"
ENTRY = "bucket long, is_word boolean, " + RUN
WORD_RUN = RUN + ", n_all long, n_known long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"


def tokens(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes: lowers A-Z only, splits at the six white-space bytes only


def grams(texts_words: list[list[bytes]], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(DEPTH bytes of context, byte) of every byte as one number, and how many each text has.

    A text starts in the context of end bytes."""
    pad = bytes([END]) * depth
    texts = [b" ".join(w) for w in texts_words]
    sizes = np.array([len(t) + 1 for t in texts])
    raw = np.frombuffer(b"".join(x for t in texts for x in (pad, t, b"\n")), dtype=np.uint8).astype(np.int64)
    key = raw[depth:].copy()
    for back in range(1, depth + 1):
        key += raw[depth - back : len(raw) - back] << (8 * back)
    # window i ends at byte i + depth; the windows that end in a later text's padding go
    ends = np.cumsum(sizes + depth)
    keep = np.ones(len(key), dtype=bool)
    for j in range(depth):
        at = ends[:-1] + j - depth
        keep[at] = False
    return key[keep], sizes


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 1/2, by Stirling's series after a shift of 8."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    shift = np.log(np.prod([x + k for k in range(4)], axis=0)) + np.log(np.prod([x + k for k in range(4, 8)], axis=0))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


_SMALL = 64
_small: list[np.ndarray] = []


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a run with so many zeros and ones."""
    full = lambda z, o: _lgamma(z + 0.5) + _lgamma(o + 0.5) - math.log(math.pi) - _lgamma(z + o + 1.0)
    if not _small:
        grid = np.arange(_SMALL, dtype=np.float64)
        _small.append(full(*np.meshgrid(grid, grid, indexing="ij")))
    out = np.empty(len(zeros))
    low = (zeros < _SMALL) & (ones < _SMALL)
    out[low] = _small[0][zeros[low].astype(np.int64), ones[low].astype(np.int64)]
    out[~low] = full(zeros[~low], ones[~low])
    return out


def log_kt_column(zeros: Column, ones: Column) -> Column:
    """log_kt for the few nodes above the subtrees."""

    def lgamma(x: Column) -> Column:
        y = x + F.lit(8.0)
        shift = F.lit(0.0)
        for k in range(8):
            shift = shift + F.log(x + F.lit(float(k)))
        series = F.lit(1 / 12.0) / y - F.lit(1 / 360.0) / F.pow(y, F.lit(3.0)) + F.lit(1 / 1260.0) / F.pow(y, F.lit(5.0))
        return (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - shift

    return lgamma(zeros + F.lit(0.5)) + lgamma(ones + F.lit(0.5)) - F.lit(math.log(math.pi)) - lgamma(zeros + ones + F.lit(1.0))


def held_out_fold(column: str) -> Column:
    crc = F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
    return F.pmod(crc, F.lit(FOLDS)) == HELD_OUT


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 as compressed planes of their bytes."""
    from zstandard import ZstdCompressor

    planes = np.ascontiguousarray(numbers.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    from zstandard import ZstdDecompressor

    planes = np.frombuffer(ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


def turn(grams: np.ndarray, depth: int) -> np.ndarray:
    """Bytes of the context in the other order, so that sorting brings equal newest bytes together; its own inverse."""
    if not depth:
        return grams
    context = (grams >> 8).astype(np.uint64).byteswap() >> np.uint64(64 - 8 * depth)
    return context.astype(np.int64) << 8 | grams & 255


def pack_grams(turned: np.ndarray) -> bytes:
    return pack(np.diff(turned, prepend=0))


def unpack_grams(raw: bytes, depth: int) -> np.ndarray:
    return turn(np.cumsum(unpack(raw)), depth)


def _edges(buckets: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of the runs of equal values."""
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    edges = [0, *cuts.tolist(), len(buckets)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def block_counts(blocks: DataFrame, depth: int, root: int, buckets: int) -> DataFrame:
    """The distinct grams and words of each block in runs by bucket, with training counts (0 if only others hold them)."""

    def work(key, part):
        from zstandard import ZstdCompressor

        words, gram_parts = Counter(), []
        unseen: set[bytes] = set()
        held = part.column("held_out").to_pylist()
        texts = part.column("text")
        for a, b in _runs(texts):
            split = [tokens(t or "") for t in texts.slice(a, b - a).to_pylist()]
            keys, sizes = grams(split, depth)
            train = ~np.repeat(np.array(held[a:b], dtype=bool), sizes)
            codes, unique = pd.factorize(keys)
            gram_parts.append((unique, np.bincount(codes, weights=train, minlength=len(unique))))
            for w, h in zip(split, held[a:b], strict=True):
                if h:
                    unseen.update(w)
                else:
                    words.update(w)
        codes, unique = pd.factorize(np.concatenate([u for u, _ in gram_parts]))
        n = np.bincount(codes, weights=np.concatenate([c for _, c in gram_parts]), minlength=len(unique)).astype(np.int64)
        for w in unseen:
            words.setdefault(w, 0)
        rows = []
        turned = turn(unique, depth)
        # contexts of `root` bytes stay together: a subtree has one bucket
        dealt = ((turned >> 8 * (depth + 1 - root)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)
        order = np.lexsort((turned, dealt))
        turned, n, dealt = turned[order], n[order], dealt[order]
        for a, b in _edges(dealt):
            rows.append((int(dealt[a]), False, b - a, pack_grams(turned[a:b]), pack(n[a:b])))
        named = sorted(words)
        dealt = np.fromiter(map(crc32, named), np.int64, len(named)) % buckets
        order = np.argsort(dealt, kind="stable")
        dealt = dealt[order]
        amounts = np.fromiter(map(words.__getitem__, named), np.int64, len(named))[order]
        squeeze = ZstdCompressor(level=1).compress
        for a, b in _edges(dealt):
            rows.append((int(dealt[a]), True, b - a, squeeze(b" ".join([named[i] for i in order[a:b]])), pack(amounts[a:b])))
        bucket, is_word, size, items, counts = zip(*rows, strict=True)
        return pa.table({
            "bucket": pa.array(bucket, pa.int64()), "is_word": pa.array(is_word, pa.bool_()), "block": pa.array([key[0].as_py()] * len(rows), pa.int64()),
            "size": pa.array(size, pa.int64()), "items": pa.array(items, pa.binary()), "amounts": pa.array(counts, pa.binary()),
        })

    return blocks.groupBy("block").applyInArrow(work, ENTRY)


def word_counts(runs: DataFrame) -> DataFrame:
    """Runs of words with their counts over the corpus; n_all and n_known (of the bucket) stand in its first row."""

    def work(part):
        words = [split_words(x) for x in part.column("items").to_pylist()]
        amounts = np.concatenate([unpack(x) for x in part.column("amounts").to_pylist()])
        codes, unique = pd.factorize(np.array([w for run in words for w in run], dtype=object))
        n = np.bincount(codes, weights=amounts, minlength=len(unique)).astype(np.int64)
        sizes = part.column("size").to_numpy()
        per_run = [pack(x) for x in np.split(n[codes], np.cumsum(sizes)[:-1])]
        first = np.arange(len(sizes)) == 0
        return pa.table({
            "block": part.column("block"), "size": part.column("size"), "items": part.column("items"), "amounts": pa.array(per_run, pa.binary()),
            "n_all": pa.array(first * int(n.sum())), "n_known": pa.array(first * int(np.count_nonzero(n))),
        })

    return runs.groupBy("bucket").applyInArrow(work, WORD_RUN)


def split_words(raw: bytes) -> list[bytes]:
    from zstandard import ZstdDecompressor

    return ZstdDecompressor().decompress(raw).split(b" ")


def _runs(texts):
    import pyarrow.compute as pc

    from .common import runs

    return runs(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), RUN_BYTES)


def bit_nodes(gram: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Node (context, then 1 and the bits of the byte seen so far) and next bit of decision k."""
    return (gram >> 8 << 8) + (1 << k) + ((gram & 255) >> (8 - k)), gram >> (7 - k) & 1


def climb(nodes, zeros, ones, depth: int, root: int):
    """Levels of the tree over leaf nodes, from `depth` up to `root`: (nodes, zeros, ones, log_w, weight, parents)."""
    log_w, weight, levels = log_kt(zeros, ones), np.ones(len(nodes)), []
    for d in range(depth, root, -1):
        up, parents = np.unique(nodes & ((1 << (8 * d)) - 1), return_inverse=True)  # the oldest byte goes
        levels.append((nodes, zeros, ones, log_w, weight, parents))
        below = np.bincount(parents, weights=log_w, minlength=len(up))
        zeros, ones = np.bincount(parents, weights=zeros, minlength=len(up)), np.bincount(parents, weights=ones, minlength=len(up))
        own = log_kt(zeros, ones)
        nodes, log_w = up, np.logaddexp(own, below) - math.log(2)
        weight = np.exp(own - math.log(2) - log_w)
    levels.append((nodes, zeros, ones, log_w, weight, None))
    return levels


def descend(levels, total: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Probability of a one at each leaf; given, for each root node, the mixture above it and what is left of it."""
    for d in range(len(levels) - 1, -1, -1):
        _, zeros, ones, _, weight, parents = levels[d]
        if d < len(levels) - 1:
            total, rest = total[parents], rest[parents]
        total = total + rest * weight * (ones + 0.5) / (zeros + ones + 1.0)
        rest = rest * (1 - weight)
    return total


def _leaves(gram: np.ndarray, n: np.ndarray):
    parts = [bit_nodes(gram, k) for k in range(8)]
    nodes, codes = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    bits = np.concatenate([p[1] for p in parts])
    weights = np.tile(n, 8).astype(np.float64)
    ones = np.bincount(codes, weights=weights * bits, minlength=len(nodes))
    zeros = np.bincount(codes, weights=weights * (1 - bits), minlength=len(nodes))
    return nodes, zeros, ones, codes, bits


def _summed(part, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's runs: distinct grams, their counts, and the place of every item among them."""
    every = np.concatenate([unpack_grams(x, depth) for x in part.column("items").to_pylist()])
    amounts = np.concatenate([unpack(x) for x in part.column("amounts").to_pylist()])
    gram, codes = np.unique(every, return_inverse=True)
    return gram, np.bincount(codes, weights=amounts, minlength=len(gram)), codes


def gram_scores(bucketed: DataFrame, depth: int = DEPTH, root: int = ROOT) -> DataFrame:
    """Runs of grams -> the same runs, with log10 of the weighted probability of each byte in its context (4-byte floats).

    Subtrees below contexts of `root` bytes are worked in numpy, many to a bucket; the few levels above
    are built and walked by grouped sums and joins.
    """

    def roots(key, part):
        gram, n, _ = _summed(part, depth)
        nodes, zeros, ones, *_ = _leaves(gram, n)
        nodes, zeros, ones, log_w, weight, _ = climb(nodes, zeros, ones, depth, root)[-1]
        bucket = np.full(len(nodes), key[0].as_py(), dtype=np.int64)
        return pa.table({"bucket": bucket, "node": nodes, "zeros": zeros.astype(np.int64), "ones": ones.astype(np.int64), "log_w": log_w})

    level = materialise(bucketed.groupBy("bucket").applyInArrow(roots, "bucket long, node long, zeros long, ones long, log_w double"), "ctw-roots")
    top = level.select("bucket", "node")
    levels = []
    for d in range(root - 1, -1, -1):
        parent = F.col("node").bitwiseAND((1 << (8 * (d + 1))) - 1)
        sums = level.groupBy(parent.alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_w").alias("below"))
        own = log_kt_column(F.col("zeros"), F.col("ones"))
        up = sums.withColumn("own", own)
        high = F.greatest("own", "below")
        mixed = high + F.log(F.exp(F.col("own") - high) + F.exp(F.col("below") - high)) - math.log(2)
        up = up.withColumn("log_w", mixed).withColumn("weight", F.exp(F.col("own") - math.log(2) - F.col("log_w")))
        level = materialise(up.select("node", "zeros", "ones", "log_w", "weight"), "ctw-level")
        levels.append(level)
    estimate = F.col("weight") * (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)
    if levels:
        down = levels[-1].select("node", estimate.alias("total"), (1 - F.col("weight")).alias("rest"))
        for d in range(1, root):
            parent = F.col("node").bitwiseAND((1 << (8 * d)) - 1)
            at = levels[root - 1 - d].select(F.col("node").alias("at"), parent.alias("node"), estimate.alias("part"), "weight")
            down = at.join(down, "node").select(
                F.col("at").alias("node"), (F.col("total") + F.col("rest") * F.col("part")).alias("total"), (F.col("rest") * (1 - F.col("weight"))).alias("rest")
            )
        parent = F.col("node").bitwiseAND((1 << (8 * root)) - 1)
        above = top.select("bucket", F.col("node").alias("at"), parent.alias("node")).join(down, "node").select("bucket", F.col("at").alias("node"), "total", "rest")
    else:
        above = top.select("bucket", "node", F.lit(0.0).alias("total"), F.lit(1.0).alias("rest"))

    def work(part, above):
        gram, n, places = _summed(part, depth)
        nodes, zeros, ones, codes, bits = _leaves(gram, n)
        levels = climb(nodes, zeros, ones, depth, root)
        order = np.argsort(above.column("node").to_numpy())  # the same root nodes, in the order of climb()
        one = descend(levels, above.column("total").to_numpy()[order], above.column("rest").to_numpy()[order])[codes]
        logs = np.log10(np.where(bits == 1, one, 1 - one)).reshape(8, -1).sum(axis=0)
        per_run = [x.tobytes() for x in np.split(logs[places].astype("<f4"), np.cumsum(part.column("size").to_numpy())[:-1])]
        return pa.table({"block": part.column("block"), "size": part.column("size"), "items": part.column("items"), "amounts": pa.array(per_run, pa.binary())})

    return bucketed.groupBy("bucket").cogroup(above.groupBy("bucket")).applyInArrow(work, RUN)


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", depth: int = DEPTH) -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score, score and bits per byte."""
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, buckets = max(1, math.ceil(size / BLOCK_BYTES)), max(1, math.ceil(size / BUCKET_BYTES))
    root = min(ROOT, depth)
    own = own.withColumns({"held_out": held_out_fold("doc_id"), "block": F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks))})
    entries = materialise(block_counts(own, depth, root, buckets), "ctw-entries")
    words = materialise(word_counts(entries.filter("is_word")), "ctw-words")
    sums = words.agg(F.sum("n_all"), F.sum("n_known")).first()
    train_docs = own.filter(~F.col("held_out")).count()
    n_train, vocabulary = (sums[0] or 0) + train_docs, (sums[1] or 0) + (train_docs > 0)  # each training text ends once
    lp = gram_scores(entries.filter("not is_word").drop("is_word"), depth, root)
    columns = ["block", "size", "items", "amounts"]
    back = lp.select(F.lit(False).alias("is_word"), *columns).unionByName(words.select(F.lit(True).alias("is_word"), *columns))
    below = math.log10(n_train + vocabulary + 1)

    def work(texts, model):
        none = np.zeros(0, dtype=np.int64)
        pair_runs, lps, known = [none], [none.astype(np.float64)], {}
        for is_word, items, amounts in zip(*(model.column(c).to_pylist() for c in ("is_word", "items", "amounts")), strict=True):
            if is_word:
                known.update(zip(split_words(items), unpack(amounts).tolist(), strict=True))
            else:
                pair_runs.append(unpack_grams(items, depth))
                lps.append(np.frombuffer(amounts, "<f4").astype(np.float64))
        gram, lps = np.concatenate(pair_runs), np.concatenate(lps)
        order = np.argsort(gram)
        gram, lps = gram[order], lps[order]
        out, column = [], texts.column("text")
        for a, b in _runs(column):
            split = [tokens(t or "") for t in column.slice(a, b - a).to_pylist()]
            keys, sizes = grams(split, depth)
            codes, unique = pd.factorize(keys)
            per_byte = lps[np.searchsorted(gram, unique)][codes] if len(gram) else np.zeros(len(keys))
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            totals = np.add.reduceat(per_byte, starts)
            for i, w in enumerate(split):
                c = np.fromiter(map(known.__getitem__, w), np.float64, len(w))
                base = float(np.log10(c + 1).sum()) + math.log10(train_docs + 1) - (len(w) + 1) * below
                out.append((len(w) + 1, int((c > 0).sum()) + (train_docs > 0), base, float(totals[i]), int(sizes[i])))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        names = ["n_tokens", "n_known", "base_score", "score", "n_bytes"]
        return pa.table({"doc_id": column_of(texts, "doc_id"), "held_out": column_of(texts, "held_out")} | {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    def column_of(part, name):
        return part.column(name)

    scored = own.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(work, SCORES)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score",
        (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
