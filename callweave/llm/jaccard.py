"""N-gram Jaccard join as T-occurrence search over inverted lists (DivideSkip), and its components.

A document is its set of 5-word shingles; two link when their Jaccard similarity is 0.8 or more, that is
when they share at least T = ceil(80 * (|x| + |y|) / 180) shingles.

* Equal sets are one class first, so copies cost one row.
* Every document orders its shingles by one corpus-wide order, from short to long inverted lists. Lengths
  come from a count sketch of fixed size over all shingles; any fixed order gives exact results, the
  sketch only makes it a good one. The ceil(0.8 |x|) - 1 longest lists are set aside: whatever shares T
  shingles with x meets x in one of the others. Only those short lists are shuffled, as keys of KEY_BYTES
  bytes in packed runs by bucket. Shingles of equal keys share a list, which then names more members and no fewer.
* Lists name the members that have to be searched. A block of members is an inverted index inside its task
  (`Lists`), and a query is a T-occurrence search there: its short lists are merged by a heap that counts
  occurrences, members with T - L of them or more are probed in the L long lists by binary search, and
  those that reach T link.
* No list is expanded into pairs. First each list asks with one pivot (long lists: one for each of their
  salted parts, and these among one another) over blocks of its members, and links make components. Lists
  that still hold several components then ask with the members outside the largest one. Lists that begin
  with the same member go together; large ones are cut into blocks of queries and blocks of members, small
  ones share a block. Both times parity maps, an exact bound on the overlap, first say which rows of a block
  can link at all, so the texts that are sent follow the number of near copies.

Blocks carry texts, which are smaller than sets of hashes, and follow the number of members and the size of
their sets, so a very long text has a block of few others. Defined cases: a null text, or one without words,
is empty, links with nothing and is its own component; a text of fewer than 5 words is one shingle; a null
doc_id ranks after all others and stays null where it is alone; an id with several texts is as many
documents; repeated rows get the same values; an empty table gives an empty result; extra columns are not
read, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, runs, table, text_runs
from .exact_dedup import BROADCAST_BITS, MAP_BITS, bit, filter_bits, maps

WORDS, NEED = 5, 80  # words of a shingle; least similarity in hundredths
CELLS, SPAN = 1 << 20, 2048  # cells of a row of the sketch, and of what is summed together
PART = 4096  # members of a salted part of a long list, about
BLOCK, LARGEST, ITEMS = 128, 2048, 4 << 20  # members of a block: at least, at most for large groups; shingles of a block
SKIP, MERGED = 0.01, 2000  # DivideSkip's constant; postings beyond which further lists count as long
RUN_BYTES = 2 << 20
KEY_BYTES, BUCKET = 5, 1 << 17  # bytes of a list's key; entries of lists in a bucket, about
TRIED = 64  # members of a list whose pairs are held against positions, at most
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_TOP = np.uint64((1 << 63) - 1)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the text's shingles."""
    from xxhash import xxh3_64_intdigest

    words = text.encode().lower().split()  # bytes: lowers A-Z only, splits at the six white-space bytes only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < WORDS:
        return np.array([xxh3_64_intdigest(b"\0".join(words), len(words))], dtype=np.uint64) & _TOP
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    s = h[:n] * _M[0]
    for k in range(1, WORDS):
        s += h[k : k + n] * _M[k]
        s ^= s >> np.uint64(29)
        s *= _M[0]
    return np.unique((s ^ (s >> np.uint64(32))) & _TOP)


def _cells(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (s & np.uint64(CELLS - 1)).astype(np.int64), (s >> np.uint64(20) & np.uint64(CELLS - 1)).astype(np.int64)


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the counts of a span of cells over all tasks, batch by batch; its levels leave as a byte a cell."""
    counts = np.zeros(SPAN, dtype=np.int64)
    for batch in batches:
        span = batch.column("span")[0]
        for packed in batch.column("counts"):
            raw = np.frombuffer(pa.decompress(packed.as_buffer(), 4 * SPAN, codec="zstd"), np.uint8)
            counts += np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel()
    levels = np.minimum(255, 8 * np.log2(1 + counts)).astype(np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([span.as_py()], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([levels.tobytes()], pa.binary())], ["span", "total", "levels"])


def sketch(docs: DataFrame) -> tuple[np.ndarray, int]:
    """List lengths as 8 * log2(1 + count) for two rows of CELLS cells, and the value above which a list is long.

    Counts are summed in tasks, so the driver gets a byte a cell."""

    def work(batches):
        counts = np.zeros((2, CELLS), dtype=np.int64)
        for batch in batches:
            for _, texts in text_runs(batch, 0, RUN_BYTES):
                found = np.concatenate([shingles(t) for t in texts])
                for row, cells in enumerate(_cells(found)):
                    counts[row] += np.bincount(cells, minlength=CELLS)
        runs_of = counts.astype("<i4").reshape(-1, SPAN)
        used = np.flatnonzero(runs_of.any(axis=1))
        planes = [runs_of[i].view(np.uint8).reshape(-1, 4).T.tobytes() for i in used]  # high bytes are nearly all zero
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in planes], pa.binary())], ["span", "counts"])

    parts = docs.select("text").mapInArrow(work, "span long, counts binary")
    summed = parts.groupBy("span").applyInArrow(_levels, "span long, total long, levels binary").toArrow()  # 2 * CELLS bytes
    levels, total = np.zeros((2 * CELLS // SPAN, SPAN), dtype=np.uint8), 0
    for span, n, found in zip(*(summed.column(c) for c in ("span", "total", "levels")), strict=True):
        levels[span.as_py()] = np.frombuffer(found.as_buffer(), np.uint8)
        total += n.as_py()
    long = max(1000, 4 * (total // 2) // CELLS)  # both rows count every shingle
    return levels.reshape(2, CELLS), min(255, int(8 * np.log2(1 + long)))


def parity(s: np.ndarray, cells: int = 4) -> np.ndarray:
    """One bit for each of about so many cells a shingle, set where an odd number of the set's shingles falls.

    Two sets whose maps differ in d bits differ in d shingles at least, so they share (|x| + |y| - d) / 2 at most."""
    width = max(64, 1 << int(cells * len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s >> np.uint64(7) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Maps (one a row) narrowed to fewer words: cells that fall together add their parities."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def can_link(size_x, size_y, differ):
    """Whether sets whose maps differ in so many bits can share T shingles."""
    most = np.minimum((size_x + size_y - differ) // 2, np.minimum(size_x, size_y))
    return most * (100 + NEED) >= NEED * (size_x + size_y)


def pack(items: np.ndarray, long: np.ndarray) -> bytes:
    """Keys of the lists of some shingles: their low bits, and one bit for a long list."""
    keys = ((items << np.uint64(1)) | long.astype(np.uint64)).astype("<u8")
    return keys.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpack(keys: bytes) -> np.ndarray:
    out = np.zeros((len(keys) // KEY_BYTES, 8), dtype=np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(keys, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel().astype(np.int64)


CLASSES = "doc_id long, print long, digest binary, size long, common int, bits binary, short binary"


def class_rows(docs: DataFrame, lengths: np.ndarray, long: int) -> DataFrame:
    """Per document: a hash of its text, digest, size and parity map of its set, and the keys of its short lists in order."""

    def work(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            for a, texts in text_runs(batch, 1, RUN_BYTES):
                digests, sizes, commons, maps, shorts = [], [], [], [], []
                for t in texts:
                    s = shingles(t)
                    one, two = _cells(s)
                    q = np.minimum(lengths[0][one], lengths[1][two])
                    order = np.argsort(q, kind="stable")[: len(s) - -(-NEED * len(s) // 100) + 1] if len(s) else np.zeros(0, dtype=np.int64)
                    digests.append(xxh3_128_digest(s.tobytes()))
                    sizes.append(len(s))
                    commons.append(int(8 * q.mean()) if len(s) else 0)  # only an order: few bytes in the shuffle of lists
                    maps.append(parity(s, 1).tobytes())  # sets of 0.8 differ in a ninth of both sizes, others in half of the bits
                    shorts.append(pack(s[order], q[order] >= long))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, len(texts)), batch.column(2).slice(a, len(texts)), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(commons, pa.int32()), pa.array(maps, pa.binary()),
                        pa.array(shorts, pa.binary()),
                    ],
                    ["doc_id", "print", "digest", "size", "common", "bits", "short"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("print")).mapInArrow(work, CLASSES)


def _possible(size_a: Column, pos_a: Column, size_b: Column, pos_b: Column) -> Column:
    """Whether sets that share the shingle at these positions can share T."""
    most = F.least(pos_a, pos_b) + 1 + F.least(size_a - pos_a, size_b - pos_b) - 1
    return F.least(most, size_a, size_b) * (100 + NEED) >= NEED * (size_a + size_b)


def _can(size_a: np.ndarray, pos_a: np.ndarray, size_b: np.ndarray, pos_b: np.ndarray) -> np.ndarray:
    """The same for arrays."""
    most = np.minimum(pos_a, pos_b) + np.minimum(size_a - pos_a, size_b - pos_b)
    return np.minimum(most, np.minimum(size_a, size_b)) * (100 + NEED) >= NEED * (size_a + size_b)


def _asks(rows: DataFrame) -> DataFrame:
    """(asks, id, size): a pivot and a member of its list whose sets can share T. Without positions they can."""
    can = F.coalesce(_possible(F.col("a.size"), F.col("a.pos"), F.col("b.size"), F.col("b.pos")), F.lit(True))
    ok = (F.col("a.id") != F.col("b.id")) & can
    return rows.filter(ok).select(F.col("a.id").alias("asks"), F.col("b.id").alias("id"), F.col("b.size").alias("size"))


def _first(rows: DataFrame, *keys: str) -> DataFrame:
    """Give every member of a list its pivot: the set whose shingles lie in the longest lists on average.

    Edits make rare shingles, so the original of a group of near copies comes first and links to most of them."""
    over = Window.partitionBy(*keys)
    return rows.withColumns({"a": F.first("b").over(over.orderBy(F.col("b.common").desc(), "b.size", "b.id")), "members": F.count(F.lit(1)).over(over)})


ENTRY = np.dtype([("id", "<i8"), ("size", "<i4"), ("pos", "<i4"), ("common", "<i2")])
MEMBER = pa.struct([("id", pa.int64()), ("size", pa.int64()), ("common", pa.int32()), ("pos", pa.int32())])
OFFERED = "shingle long, salt int, b struct<id:long,size:long,common:int,pos:int>, a struct<id:long,size:long,common:int,pos:int>, members long, open boolean"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * _M[0]
    x = (x ^ (x >> np.uint64(32))) * _M[1]
    return x ^ (x >> np.uint64(29))


def _salts(keys: np.ndarray, ids: np.ndarray, salts: int) -> np.ndarray:
    """The part of its list that an entry belongs to: one of so many from 1 on for long lists, else 0."""
    return np.where(keys & 1, (_mixed(ids) % np.uint64(salts)).astype(np.int64) + 1, 0)


def _columns(entries: np.ndarray) -> bytes:
    """Entries byte by byte of every field, ids as steps: what hardly changes lies together."""
    steps = entries.copy()
    steps["id"] = np.diff(entries["id"], prepend=0)
    return pa.compress(steps.view(np.uint8).reshape(-1, ENTRY.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _entries(packed: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(packed, n * ENTRY.itemsize, codec="zstd", asbytes=True), np.uint8)
    out = raw.reshape(ENTRY.itemsize, n).T.copy(order="C").view(ENTRY).ravel()  # a single entry is contiguous as it is, but not writable
    out["id"] = np.cumsum(out["id"])
    return out


def offers(classes: DataFrame, salts: int) -> DataFrame:
    """The entries of every list (long ones in salted parts) that has two or more, or is long: key, salt, entry b, pivot a and length.

    An entry is open if by positions it can link with another one that is no pivot. The pivot is the set whose shingles lie in the longest lists on average, as in `_first`. A set that has two
    shingles of one key leaves the positions of that list unknown."""
    total = (classes.agg(F.sum(F.length("short"))).first()[0] or 0) // KEY_BYTES
    buckets = max(1, -(-total // BUCKET))

    def split(batches):
        for batch in batches:
            ids, sizes, commons = (batch.column(i).to_numpy() for i in range(3))
            shorts = [x.as_py() for x in batch.column(3)]
            for a, b in runs([len(x) for x in shorts], 8 << 20):
                keys = unpack(b"".join(shorts[a:b]))
                counts = np.array([len(x) // KEY_BYTES for x in shorts[a:b]])
                doc = np.repeat(np.arange(a, b), counts)
                entries = np.empty(len(keys), dtype=ENTRY)
                entries["id"], entries["size"], entries["common"] = ids[doc], sizes[doc], commons[doc]
                entries["pos"] = np.arange(len(keys)) - np.repeat(np.cumsum(counts) - counts, counts)
                bucket = (_mixed(keys + (_salts(keys, entries["id"], salts) << 40)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")  # documents stay in order
                found, starts = np.unique(bucket[order], return_index=True)
                raw = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
                parts = [order[i:j] for i, j in zip(starts, [*starts[1:], len(order)], strict=True)]
                for i in range(0, len(found), 1024):
                    some = parts[i : i + 1024]
                    columns = [pa.array(found[i : i + 1024]), pa.array([raw[x].tobytes() for x in some], pa.binary()), pa.array([_columns(entries[x]) for x in some], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["bucket", "keys", "entries"])

    def gather(key, part):
        blobs = [x.as_py() for x in part.column("keys")]
        keys = unpack(b"".join(blobs))
        entries = np.concatenate([_entries(x.as_py(), len(k) // KEY_BYTES) for x, k in zip(part.column("entries"), blobs, strict=True)])
        _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
        several = (n[at] > 1) | (keys & 1 == 1)
        keys, entries = keys[several], entries[several]
        salt = _salts(keys, entries["id"], salts)
        order = np.lexsort((entries["id"], entries["size"], -entries["common"].astype(np.int64), salt, keys))
        keys, salt, entries = keys[order], salt[order], entries[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (salt[1:] != salt[:-1])
        which, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        members = np.diff(np.append(starts, len(keys)))[which]
        twice = np.zeros(len(starts), dtype=bool)
        again = np.flatnonzero(~new[1:] & (entries["id"][1:] == entries["id"][:-1])) + 1
        twice[which[again]] = True
        is_open = (members > 2) & (twice[which] | (members > TRIED))
        ends = (starts[which] + members).astype(np.int64)
        sizes, places = entries["size"].astype(np.int64), entries["pos"].astype(np.int64)
        left = np.flatnonzero(~new & ~is_open)
        for step in range(1, TRIED):
            left = left[left + step < ends[left]]
            if not len(left):
                break
            can = _can(sizes[left], places[left], sizes[left + step], places[left + step])
            is_open[left[can]] = is_open[left[can] + step] = True

        def member(rows):
            fields = [pa.array(rows[f].astype(t)) for f, t in (("id", np.int64), ("size", np.int64), ("common", np.int32))]
            return pa.StructArray.from_arrays([*fields, pa.array(rows["pos"].astype(np.int32), mask=twice[which])], fields=list(MEMBER))

        return pa.table({"shingle": keys, "salt": salt.astype(np.int32), "b": member(entries), "a": member(entries[starts][which]), "members": members, "open": is_open})

    runs_of = classes.select("id", "size", "common", "short").mapInArrow(split, "bucket long, keys binary, entries binary")
    return runs_of.groupBy("bucket").applyInArrow(gather, OFFERED)


class Lists:
    """Inverted lists over the sets of a block, for T-occurrence search by DivideSkip."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        items = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
        order = np.argsort(items, kind="stable")  # members ascend within a list
        self.members = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.items, starts = np.unique(items[order], return_index=True)
        self.edges = np.append(starts, len(items))
        self.lengths = np.diff(self.edges)
        self.keys = np.repeat(np.arange(len(self.items)), self.lengths) * max(1, len(sets)) + self.members  # (list, member), sorted
        self.least = int(self.sizes.min()) if len(sets) else 0

    def search(self, query: np.ndarray) -> np.ndarray:
        """The members that share T or more shingles with the query."""
        none = np.zeros(0, dtype=np.int64)
        if not len(query) or not len(self.items):
            return none
        at = np.minimum(np.searchsorted(self.items, query), len(self.items) - 1)
        lists = at[self.items[at] == query]
        small = max(self.least, -(-NEED * len(query) // 100))  # no smaller set can link
        least = -(-NEED * (len(query) + small) // (100 + NEED))
        if len(lists) < least:
            return none
        lists = lists[np.argsort(self.lengths[lists], kind="stable")]
        n_long = min(least - 1, int(least / (SKIP * math.log2(max(2, int(self.lengths[lists[-1]]))) + 1)))
        merged = int(np.searchsorted(np.cumsum(self.lengths[lists]), MERGED, side="right"))
        n_short = max(len(lists) - least + 1, min(len(lists) - n_long, merged))
        short, long = lists[:n_short], lists[n_short:]
        heads = [self.members[a:b].tolist() for a, b in zip(self.edges[short].tolist(), self.edges[short + 1].tolist(), strict=True)]
        enough, found, shared = least - len(long), [], []
        for member, run in groupby(heapq.merge(*heads)):
            if (n := sum(1 for _ in run)) >= enough:
                found.append(member)
                shared.append(n)
        found, shared = np.array(found, dtype=np.int64), np.array(shared, dtype=np.int64)
        need = -(-NEED * (len(query) + self.sizes[found]) // (100 + NEED))
        for a in range(0, len(long), 256):  # a member leaves once the lists that are left cannot bring it to T
            part = long[a : a + 256]
            stays = shared + len(long) - a >= need
            found, shared, need = found[stays], shared[stays], need[stays]
            probe = part[:, None] * len(self.sizes) + found
            hit = self.keys[np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)] == probe
            shared = shared + hit.sum(axis=0)
        return found[shared >= need]


def marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows with `marked`: true where `print` is one of the wanted, and for some others. A bit map of bounded size is broadcast."""
    bits = min(BROADCAST_BITS, filter_bits(4 * wanted.count()))  # of the other rows a 32nd passes at most
    slot = F.pmod(F.col("print"), F.lit(bits))
    bitmaps = F.broadcast(maps(wanted.select(slot.alias("slot")), 0))
    held = rows.withColumn("slot", slot).withColumn("map0", F.floor(F.col("slot") / MAP_BITS)).join(bitmaps, "map0", "left")
    return held.select(*rows.columns, F.coalesce(bit(F.col("bits0"), F.col("slot")), F.lit(False)).alias("marked"))


def with_texts(rows: DataFrame, classes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (by `id`) with a text of their class, and the table behind them.

    A text meets all rows of its class in the one shuffle that makes texts distinct."""
    key = lambda doc, print_: [F.isnull(doc).alias("none"), F.coalesce(F.col(doc), F.lit(0)).alias("doc"), print_.alias("print")]
    wanted = materialise(rows.join(classes.select("id", "doc", "print"), "id").select(*rows.columns, *key("doc", F.col("print"))), "texts-wanted")
    row = F.xxhash64("none", "doc", "print").alias("print")  # copies of a wanted text under other ids stay out too
    held = docs.select("text", *key("doc_id", F.xxhash64("text"))).select("text", "none", "doc", F.col("print").alias("text_print"), row)
    held = marked(held, wanted.select(row).distinct()).filter("marked")  # most other texts stay out of the shuffle
    held = held.groupBy("none", "doc", F.col("text_print").alias("print")).agg(F.first("text").alias("text"))
    return held.join(wanted, ["none", "doc", "print"]).select(*rows.columns, "text"), wanted


def wanted_texts(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """id, text: one text of each of the given classes."""
    filled, wanted = with_texts(ids, classes, docs)
    texts = materialise(filled, "texts")
    discard(wanted)
    return texts


def occurrences(placed: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links x < y found by searching, in every block, the rows that ask among those that are indexed.

    placed: block, id, label, asks. Rows with equal labels are settled and give no link."""

    def search(key, part):
        own = {}
        for i, (n, label, asks) in enumerate(zip(*(part.column(c).to_pylist() for c in ("id", "label", "asks")), strict=True)):
            own.setdefault((n, asks), (i, label))
        text = part.column("text")
        indexed, asking = ([(n, *own[n, a]) for n, a in sorted(own) if a == kind] for kind in (False, True))
        lists = Lists([shingles(text[i].as_py()) for _, i, _ in indexed])
        ids, labels = np.array([n for n, _, _ in indexed], dtype=np.int64), np.array([m for _, _, m in indexed], dtype=np.int64)
        xs, ys = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for n, i, label in asking:
            hit = lists.search(shingles(text[i].as_py()))
            hit = ids[hit[labels[hit] != label]]
            xs.append(np.minimum(hit, n))
            ys.append(np.maximum(hit, n))
        return pa.table({"x": np.concatenate(xs), "y": np.concatenate(ys)})

    filled, wanted = with_texts(placed.select("block", "id", "label", "asks"), classes, docs)
    links = materialise(filled.groupBy("block").applyInArrow(search, "x long, y long").distinct(), "jaccard-links")
    discard(wanted)
    return links


def _blocks(count: Column, items: Column, block: Column | int = BLOCK) -> Column:
    """How many blocks hold so many members with so many shingles."""
    return F.greatest(F.ceil(count / block), F.ceil(items / ITEMS), F.lit(1)).cast("int")


def _bundled(rows: DataFrame, *keys: str) -> DataFrame:
    """Number blocks so that about BLOCK rows share a number."""
    n = max(1, -(-rows.count() // BLOCK))
    return rows.withColumn("block", F.pmod(F.xxhash64(*keys), F.lit(n)))


def _sized(classes: DataFrame, ids: DataFrame) -> DataFrame:
    """id, size, bits of the given ids and a few others."""
    held = marked(classes.select("id", "size", "bits", F.xxhash64("id").alias("print")), ids.select(F.xxhash64("id").alias("print")).distinct())
    return held.filter("marked").select("id", "size", "bits")


def searched(placed: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links found in blocks (block, id, label, asks, size, bits): maps say which rows can link, their texts which do."""
    open_rows = materialise(placed.groupBy("block").applyInArrow(_open, "block long, id long, label long, asks boolean"), "jaccard-open-rows")
    links = occurrences(_bundled(open_rows.withColumnRenamed("block", "of"), "of").groupBy("block", "id", "asks").agg(F.min("label").alias("label")), classes, docs)
    discard(open_rows)
    return links


def by_pivots(offered: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between each list's pivot and its members."""
    pivots = offered.filter((F.col("salt") > 0) & (F.col("a.id") == F.col("b.id"))).select("shingle", "b")
    asks = materialise(_asks(offered).union(_asks(_first(pivots, "shingle"))).distinct(), "jaccard-asks")
    parts = asks.groupBy("asks").agg(_blocks(F.count(F.lit(1)), F.sum("size")).alias("parts"))
    parts = materialise(parts, "jaccard-parts")
    dealt = asks.join(parts, "asks").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    dealt = materialise(_bundled(dealt, "asks", "part"), "jaccard-dealt")
    indexed = dealt.select("block", "id", F.col("id").alias("label"), F.lit(False).alias("asks"))
    asking = dealt.select("block", F.col("asks").alias("id"), F.col("asks").alias("label"), F.lit(True).alias("asks"))
    discard(asks, parts)
    placed = materialise(indexed.unionByName(asking).distinct(), "jaccard-placed")
    discard(dealt)
    links = searched(placed.join(_sized(classes, placed), "id"), classes, docs)
    discard(placed)
    return links


def across(offered: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Links between members of one list that lie in different components so far; None if no list holds several.

    Lists with the same first member are searched together. Queries are the members outside the largest
    component of such a group; every block of queries meets every block of its members. Parity maps, an exact
    bound on the overlap, first say which rows of a block can link at all; only their texts are sent.
    """
    rest = offered.filter((F.col("salt") > 0) | (F.col("open") & (F.col("a.id") != F.col("b.id"))))
    rest = rest.select("shingle", F.col("b.id").alias("id")).join(labels, "id", "left").select("shingle", "id", F.coalesce("label", "id").alias("label"))
    rest = materialise(rest, "jaccard-rest")
    lists = rest.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("id").alias("group")).filter("low < high")
    lists = materialise(lists.select("shingle", "group"), "jaccard-open")
    opened = materialise(rest.join(lists, "shingle").groupBy("group", "id").agg(F.min("label").alias("label")), "jaccard-opened")
    member = materialise(opened.join(_sized(classes, opened), "id"), "jaccard-members")
    discard(rest, lists, opened)
    if member.isEmpty():
        return None
    by_label = member.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("items"))
    groups = by_label.groupBy("group").agg(
        F.sum("n").alias("n"), F.sum("items").alias("items"), F.max_by("label", "n").alias("main"), F.max("n").alias("settled"), F.max_by("items", "n").alias("settled_items")
    )
    side = F.least(F.greatest(F.col("n") / 16, F.lit(BLOCK)), F.lit(LARGEST))
    rows, columns = _blocks(F.col("n"), F.col("items"), side), _blocks(F.col("n") - F.col("settled"), F.col("items") - F.col("settled_items"), side)
    groups = materialise(groups.select("group", "main", "n", (F.col("n") - F.col("settled")).alias("others"), rows.alias("rows"), columns.alias("columns")), "jaccard-groups")
    placed = member.join(groups, "group").withColumn("asks", F.col("label") != F.col("main"))
    hashed = F.xxhash64("id")
    row, column = F.pmod(hashed, F.col("rows")).cast("int"), F.pmod(hashed, F.col("columns")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = ["group", "id", "label", "size", "bits"]
    indexed = placed.select(*own, row.alias("row"), every("columns").alias("column"), F.lit(False).alias("asks"))
    asking = placed.filter("asks").select(*own, every("rows").alias("row"), column.alias("column"), F.lit(True).alias("asks"))
    placed_rows = groups.agg(F.sum(F.col("n") * F.col("columns") + F.col("others") * F.col("rows"))).first()[0]
    dealt = indexed.unionByName(asking).withColumn("block", F.pmod(F.xxhash64("group", "row", "column"), F.lit(max(1, -(-int(placed_rows) // BLOCK)))))
    links = searched(dealt, classes, docs)
    discard(member, groups)
    return links


def _open(key, part):
    """Of a block, the queries that can link by their maps, and the members that some query can link with."""
    asks = np.array(part.column("asks").to_pylist(), dtype=bool)
    ids, marks, sizes = (part.column(c).to_numpy() for c in ("id", "label", "size"))
    maps = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("bits")]
    width, stays = np.array([len(m) for m in maps]), np.zeros(len(ids), dtype=bool)
    for w in np.unique(width[~asks]):  # members that can link have maps of the same or the next width
        at = np.flatnonzero(~asks & (width == w))
        index = np.stack([maps[i] for i in at])
        for v in (w // 2, w, 2 * w):
            words = min(v, w)
            narrow = fold(index, words)
            for i in np.flatnonzero(asks & (width == v)):
                differ = np.bitwise_count(narrow ^ fold(maps[i], words)).sum(axis=1, dtype=np.int64)
                hit = at[can_link(sizes[i], sizes[at], differ) & (marks[at] != marks[i])]
                stays[hit] = True
                stays[i] |= len(hit) > 0
    keep = np.flatnonzero(stays)
    return pa.table({"block": np.full(len(keep), key[0].as_py(), dtype=np.int64), "id": ids[keep], "label": marks[keep], "asks": asks[keep]})


def components(links: DataFrame) -> DataFrame:
    """id -> least id reachable, for the ids that have links: labels travel along links, then along labels."""
    both = materialise(links.select(F.col("x").alias("id"), F.col("y").alias("to")).union(links.select(F.col("y"), F.col("x"))).distinct(), "links")
    labels = materialise(both.groupBy("id").agg(F.least("id", F.min("to")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), F.col("label").alias("near")), "to")
        best = near.groupBy("id").agg(F.min("near").alias("near")).join(labels, "id").select("id", F.least("label", "near").alias("label"))
        jump = materialise(best, "labels")
        nxt = jump.join(jump.select(F.col("id").alias("label"), F.col("label").alias("further")), "label", "left")
        nxt = materialise(nxt.select("id", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        moved = nxt.join(labels.withColumnRenamed("label", "before"), "id").filter(F.col("label") != F.col("before"))
        done = moved.isEmpty()
        discard(jump, labels)
        labels = nxt
        if done:
            discard(both)
            return labels


def near_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    lengths, long = sketch(docs)
    rows = materialise(class_rows(docs, lengths, long), "jaccard-rows")
    filled = rows.filter("size > 0")
    # sets that stand once are classes as they are; only rows of repeated sets are shuffled
    filled = filled.withColumn("text_print", F.col("print")).withColumn("print", F.xxhash64("digest"))
    again = materialise(filled.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.xxhash64("digest").alias("print")), "jaccard-again")
    held = marked(filled, again)
    own = ["digest", F.col("doc_id").alias("doc"), F.col("text_print").alias("print"), "size", "common", "bits", "short"]
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_print"))  # the row whose text stands for the class
    same = held.filter("marked").groupBy("digest").agg(one.alias("one"), F.first("size").alias("size"), F.first("common").alias("common"), F.first("bits").alias("bits"), F.first("short").alias("short"))
    same = same.select("digest", F.col("one.doc_id").alias("doc"), F.col("one.text_print").alias("print"), "size", "common", "bits", "short")
    classes = held.filter("NOT marked").select(*own).unionByName(same)
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "jaccard-classes")

    known = materialise(rows.select("doc_id", "size", "digest"), "jaccard-known")
    discard(rows, again)
    salts = max(1, -(-known.count() // PART))  # a list of a third of all rows has a third of these parts in use
    offered = materialise(offers(classes, salts), "jaccard-lists")
    short, classes = classes, materialise(classes.drop("short", "common"), "jaccard-sets")  # the lists are made
    discard(short)
    links = by_pivots(offered, classes, docs)
    labels = components(links)

    # members that no pivot has settled: lists of three or more, seen in different components
    more = across(offered, labels, classes, docs)
    if more is not None:
        discard(labels)
        labels = components(links.union(more))

    member = classes.select("id", "digest", "doc").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    least = member.groupBy("label").agg(F.min("doc").alias("component_id"))
    named = materialise(member.join(least, "label").select("digest", "component_id"), "jaccard-named")
    discard(classes, offered, links, labels, *([more] if more is not None else []))
    linked = known.filter("size > 0").join(named, "digest").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    return linked.union(known.filter("size = 0").select("doc_id", "size", "doc_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with the least doc_id of their component, with their own columns.

    Only dropped documents and a few others are shuffled with their texts (see `marked`), at every size."""
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = near_classes(docs).groupBy("doc_id").agg(F.bool_or(own).alias("kept")).filter("NOT kept").select("doc_id", F.xxhash64("doc_id").alias("print"))
    gone = materialise(gone, "jaccard-gone")
    key = docs["doc_id"].cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("id"), F.xxhash64(key).alias("print"))
    held = marked(rows, gone)
    stays = held.filter("marked").join(gone.select("doc_id"), F.col("id").eqNullSafe(F.col("doc_id")), "left_anti")
    return held.filter("NOT marked").select("row.*").unionByName(stays.select("row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


# Whole tables by an inverted join; fit for the driver's scale only.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, hash(list_sort(s)) AS h FROM g),
r AS (SELECT min(doc_id) AS doc_id, h, any_value(n) AS n FROM u WHERE n > 0 GROUP BY h),
e AS (SELECT r.doc_id, r.n, unnest(g.s) AS k FROM r JOIN g USING (doc_id)),
f AS (SELECT k FROM e GROUP BY k HAVING count(*) > 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.k = b.k AND a.doc_id < b.doc_id JOIN f ON f.k = a.k
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
c AS (SELECT doc_id, doc_id AS m FROM r UNION SELECT l.y, c.m FROM c JOIN l ON l.x = c.doc_id WHERE c.m < l.y),
m AS (SELECT doc_id, min(m) AS m FROM c GROUP BY 1)
SELECT u.doc_id, u.n AS n_shingles, CASE WHEN u.n = 0 THEN u.doc_id ELSE m.m END AS component_id
FROM u LEFT JOIN r USING (h) LEFT JOIN m ON m.doc_id = r.doc_id
"""
