"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets and star-shaped candidates.

A document is its set of 2-word shingles, hashed once each. The hash space is cut into BANDS * ROWS bins, and the
least hash of each bin is one value of the signature (one permutation serves all of them). An empty bin takes the
value of another, found by a probe sequence of its own until a filled bin is hit (optimal densification). ROWS values
make the key of a band, and documents with a common key share a bucket.

* Equal sets are one class first, so copies cost one row. Sets of 3 shingles or fewer link with equal sets only.
* A bucket gives edges from its least id, the centre, to its members: as many candidates as members, however many.
  Every edge is confirmed on full sets, best centres first; edges inside a component are settled without a look.
* A star alone could miss two members that link with each other and not with the centre. So buckets whose members
  end in several components are looked at again: the members outside the largest component meet all members in blocks.
  There sizes and parity maps, an exact bound on what two sets share, pick the pairs of different components that can
  link; little else than links passes it, and only those pairs are made and confirmed.

At the least similarity of 0.8 two sets of distinct bins miss each other with chance (1 - 0.8 ** ROWS) ** BANDS, 1e-11
for 48 bands of 4; at an agreement of 0.7, which uneven bins can bring, 2e-6. Links that are reported are exact.

Defined cases: a null text, or one without words, is empty, links with nothing and is its own component; a text of
one word is one shingle; a null doc_id ranks after all others and stays null where it is alone; an id with several
texts is as many documents; repeated rows get the same values; texts are read whole; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, table, text_runs
from .jaccard import can_link, components, fold, parity, wanted_texts

WORDS, NEED = 2, 80  # words of a shingle; least similarity in hundredths
BANDS, ROWS = 48, 4
BINS = BANDS * ROWS
BLOCK, SIDE, ITEMS = 96, 2048, 8 << 20  # members of a block of texts; of a block of maps; shingles of a block of maps
RUN_BYTES = 2 << 20
_TOP = np.uint64((1 << 63) - 1)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
EDGES = np.array([-(-(k << 63) // BINS) for k in range(BINS + 1)], dtype=np.uint64)
PROBES = np.random.default_rng(7).integers(0, BINS, (BINS, 1024), dtype=np.int64)  # the order in which an empty bin looks at others


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the text's shingles."""
    from xxhash import xxh3_64_intdigest

    words = text.encode().lower().split()  # bytes: lowers A-Z only, splits at the six white-space bytes only
    if len(words) < WORDS:
        return np.array([xxh3_64_intdigest(w, 1) for w in words], dtype=np.uint64) & _TOP
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    s = (h[:-1] * _MIX[0] ^ h[:-1] >> np.uint64(31)) + h[1:] * _MIX[1]
    s = (s ^ s >> np.uint64(29)) * _MIX[2]
    return np.unique((s ^ s >> np.uint64(32)) & _TOP)


def signature(s: np.ndarray) -> np.ndarray:
    """The least hash of each bin of a sorted set; empty bins take another's."""
    at = np.searchsorted(s, EDGES[:-1])
    least = s[np.minimum(at, len(s) - 1)]
    filled = (at < len(s)) & (least < EDGES[1:])
    empty, done = np.flatnonzero(~filled), 0
    while len(empty):
        tries = PROBES[empty, done : done + 64]
        if not tries.shape[1]:  # 1024 probes have missed: the next filled bin
            full = np.flatnonzero(filled)
            least[empty] = least[full[np.searchsorted(full, empty) % len(full)]]
            break
        hits = filled[tries]
        found = hits.any(axis=1)
        least[empty[found]] = least[tries[found, hits[found].argmax(axis=1)]]
        empty, done = empty[~found], done + 64
    return least


def band_keys(values: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64) * _MIX[3]
    for k in range(ROWS):
        key = (key ^ values[k::ROWS]) * _MIX[k % 4]
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two full sets are similar enough."""
    low, high = sorted((len(a), len(b)))
    if 100 * low < NEED * high:
        return False
    both = np.sort(np.concatenate((a, b)), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= NEED * (len(a) + len(b) - shared)


def set_rows(docs: DataFrame) -> DataFrame:
    """Per document: a hash of its text, digest and size of its set, band keys and parity map (from 4 shingles on)."""

    def work(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            for a, texts in text_runs(batch, 1, RUN_BYTES):
                sets = [shingles(t) for t in texts]
                keys = [band_keys(signature(s)) if len(s) > 3 else None for s in sets]
                bits = [parity(s).tobytes() if len(s) > 3 else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, len(texts)), batch.column(2).slice(a, len(texts)), pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary()),
                    ],
                    ["doc_id", "print", "digest", "size", "keys", "bits"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("print")).mapInArrow(work, "doc_id long, print long, digest binary, size long, keys array<long>, bits binary")


def stars(classes: DataFrame) -> DataFrame:
    """x (centre), y (member), n (buckets in common): one edge a member and bucket, from the bucket's least id."""
    placed = classes.select("id", F.explode("keys").alias("key"))
    centres = placed.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("last")).filter("x < last").select("key", "x")
    centres = materialise(centres, "minhash-centres")  # both sides are plain scans, so a hot bucket is split
    edges = placed.join(centres, "key").filter("id <> x").groupBy("x", F.col("id").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    edges = materialise(edges, "minhash-edges")
    discard(centres)
    return edges


def _sized(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs whose sizes let them link."""
    for c in ("x", "y"):
        pairs = pairs.join(sizes.select(F.col("id").alias(c), F.col("size").alias(f"size_{c}")), c)
    return pairs.filter(F.least("size_x", "size_y") * 100 >= F.greatest("size_x", "size_y") * NEED)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs x, y (with size_y), those whose full sets link. A centre's members are cut into blocks, small stars share one."""
    parts = pairs.groupBy("x").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size_y") / (1 << 20)), F.lit(1)).cast("int").alias("parts"))
    parts = materialise(parts, "minhash-parts")
    dealt = pairs.join(parts, "x").withColumn("part", F.pmod(F.xxhash64("y"), F.col("parts")))
    blocks = max(1, -(-pairs.count() // BLOCK))
    dealt = dealt.select("x", "y", F.pmod(F.xxhash64("x", "part"), F.lit(blocks)).alias("block"))
    members = dealt.groupBy("block", F.col("y").alias("id")).agg(F.collect_set("x").alias("centres"))
    rows = materialise(members.unionByName(dealt.select("block", F.col("x").alias("id"), F.array().cast("array<long>").alias("centres")).distinct()), "minhash-dealt")
    filled = rows.join(texts, "id")

    def compare(key, part):
        ids, centres, text = part.column("id").to_pylist(), part.column("centres").to_pylist(), part.column("text")
        known, xs, ys = {}, [], []

        def own(i):
            if ids[i] not in known:
                known[ids[i]] = shingles(text[i].as_py())
            return known[ids[i]]

        at = {n: i for i, n in enumerate(ids)}
        for i, n in enumerate(ids):
            for x in centres[i]:
                if linked(own(at[x]), own(i)):
                    xs.append(x)
                    ys.append(n)
        return pa.table({"x": pa.array(xs, pa.int64()), "y": pa.array(ys, pa.int64())})

    links = materialise(filled.groupBy("block").applyInArrow(compare, "x long, y long"), "minhash-links")
    discard(parts, rows)
    return links


def open_buckets(classes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """group, id, label, size, bits: members of buckets that hold several components; buckets with one centre are one group."""
    touched = edges.select(F.col("x").alias("id")).union(edges.select("y")).distinct()
    own = classes.join(touched, "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    own = materialise(own.select("id", "label", "size", "keys", "bits"), "minhash-touched")
    placed = own.select("id", "label", F.explode("keys").alias("key"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("id").alias("group"), F.count(F.lit(1)).alias("n"))
    mixed = materialise(mixed.filter("low < high and n > 2").select("key", "group"), "minhash-mixed")
    held = placed.join(mixed, "key").select("group", "id").distinct()
    member = materialise(held.join(own.drop("keys"), "id"), "minhash-open")
    discard(own, mixed)
    return member


def _possible(part: pa.Table, asks: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids with different labels whose sizes and parity maps let them link."""
    ids, labels, sizes = (part.column(c).to_numpy() for c in ("id", "label", "size"))
    maps = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("bits")]
    width = np.array([len(m) for m in maps])
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for w in np.unique(width[asked]):  # sets that can link have maps of the same or the next width
        at = asked[width[asked] == w]
        index = np.stack([maps[i] for i in at])
        for v in (w // 2, w, 2 * w):
            narrow = fold(index, min(v, w))
            for i in asks[width[asks] == v]:
                differ = np.bitwise_count(narrow ^ fold(maps[i], min(v, w))).sum(axis=1, dtype=np.int64)
                other = at[can_link(sizes[i], sizes[at], differ) & (labels[at] != labels[i])]
                left.append(np.minimum(ids[other], ids[i]))
                right.append(np.maximum(ids[other], ids[i]))
    return np.concatenate(left), np.concatenate(right)


def leftover(member: DataFrame) -> DataFrame:
    """Pairs x < y of open groups that can link: small groups in one task, others as members outside the largest component against all, in blocks."""
    by_label = member.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("items"))
    main = F.max_by(F.struct("label", "n", "items"), F.struct("n", "label")).alias("main")
    groups = by_label.groupBy("group").agg(F.sum("n").alias("n"), F.sum("items").alias("items"), main)
    parts = lambda n, items: F.greatest(F.ceil(n / SIDE), F.ceil(items / ITEMS), F.lit(1)).cast("int")
    columns = parts(F.col("n") - F.col("main.n"), F.col("items") - F.col("main.items"))
    groups = materialise(groups.select("group", F.col("main.label").alias("main"), parts(F.col("n"), F.col("items")).alias("rows"), columns.alias("columns")), "minhash-groups")
    placed = member.join(groups, "group")
    hashed = F.xxhash64("id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = ["group", "id", "label", "size", "bits"]
    asked = placed.select(*own, F.pmod(hashed, F.col("rows")).cast("int").alias("row"), every("columns").alias("column"), F.lit(False).alias("asks"))
    asking = placed.filter("label <> main").select(*own, every("rows").alias("row"), F.pmod(hashed, F.col("columns")).cast("int").alias("column"), F.lit(True).alias("asks"))

    def meet(key, part):
        asks = np.array(part.column("asks").to_pylist(), dtype=bool)
        x, y = _possible(part, np.flatnonzero(asks), np.flatnonzero(~asks))
        return pa.table({"x": x, "y": y})

    pairs = materialise(asked.unionByName(asking).groupBy("group", "row", "column").applyInArrow(meet, "x long, y long").distinct(), "minhash-pairs")
    discard(groups)
    return pairs


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    rows = materialise(set_rows(docs), "minhash-rows")
    filled = rows.filter("size > 0")
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "print"))  # the row whose text stands for the class
    classes = filled.groupBy("digest").agg(one.alias("one"), *[F.first(c).alias(c) for c in ("size", "keys", "bits")])
    classes = classes.select("digest", F.col("one.doc_id").alias("doc"), F.col("one.print").alias("print"), "size", "keys", "bits")
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "minhash-classes")

    edges = stars(classes)
    sizes = classes.select("id", "size")
    pairs = materialise(_sized(edges, sizes), "minhash-sized")
    ids = pairs.select(F.col("x").alias("id")).union(pairs.select("y"))
    texts = wanted_texts(ids.distinct(), classes, docs)

    best = pairs.groupBy("y").agg(F.max_by(F.struct("x", "size_y"), F.struct("n", -F.col("x"))).alias("b")).select("b.x", "y", "b.size_y")
    best = materialise(best, "minhash-best")
    links = confirmed(best, texts)
    labels = components(links)

    def apart(pairs, labels):
        """Pairs that no component has settled yet."""
        for c in ("x", "y"):
            pairs = pairs.join(labels.select(F.col("id").alias(c), F.col("label").alias(f"label_{c}")), c, "left")
        return pairs.filter(F.coalesce("label_x", "x") != F.coalesce("label_y", "y")).select("x", "y", "size_y")

    more = confirmed(materialise(apart(pairs.join(best, ["x", "y"], "left_anti"), labels), "minhash-apart"), texts)
    discard(labels)
    links = links.union(more)
    labels = components(links)

    # buckets that still hold several components: two of their members may link and not with their centre
    rest = _sized(leftover(open_buckets(classes, edges, labels)).join(edges, ["x", "y"], "left_anti"), sizes)
    rest = materialise(rest.select("x", "y", "size_y"), "minhash-rest")
    if not rest.isEmpty():
        discard(labels, texts)
        texts = wanted_texts(rest.select(F.col("x").alias("id")).union(rest.select("y")).distinct(), classes, docs)
        links = links.union(confirmed(rest, texts))
        labels = components(links)

    member = classes.select("id", "digest", "doc").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    least = member.groupBy("label").agg(F.min("doc").alias("component_id"))
    named = materialise(member.join(least, "label").select("digest", "component_id"), "minhash-named")
    discard(classes, edges, pairs, best, texts, labels, rest)
    out = filled.select("doc_id", "size", "digest").join(named, "digest").select("doc_id", "size", "component_id").union(rows.filter("size = 0").select("doc_id", "size", "doc_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


# Whole tables by an inverted join; fit for the driver's scale only.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS h FROM g),
r AS (SELECT min(doc_id) AS doc_id, h, any_value(n) AS n FROM u WHERE n > 0 GROUP BY h),
e AS (SELECT r.doc_id, r.n, unnest(g.s) AS k FROM r JOIN g USING (doc_id)),
f AS (SELECT doc_id, n, k, row_number() OVER (PARTITION BY doc_id ORDER BY c, k) AS i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM e)),
q AS (SELECT doc_id, n, k FROM f WHERE i <= n - ceil(0.8 * n) + 1),
p AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny FROM q a JOIN q b ON a.k = b.k AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
j AS (SELECT x, y FROM p JOIN e a ON a.doc_id = x JOIN e b ON b.doc_id = y AND b.k = a.k GROUP BY x, y, nx, ny HAVING 100 * count(*) >= 80 * (nx + ny - count(*))),
l AS (SELECT x, y FROM j UNION ALL SELECT y, x FROM j),
c AS (SELECT doc_id, doc_id AS m FROM r UNION SELECT l.y, c.m FROM c JOIN l ON l.x = c.doc_id WHERE c.m < l.y),
m AS (SELECT doc_id, min(m) AS m FROM c GROUP BY 1)
SELECT u.doc_id, u.n AS n_shingles, CASE WHEN u.n = 0 THEN u.doc_id ELSE m.m END AS component_id, u.doc_id IS NOT DISTINCT FROM CASE WHEN u.n = 0 THEN u.doc_id ELSE m.m END AS kept
FROM u LEFT JOIN r USING (h) LEFT JOIN m ON m.doc_id = r.doc_id
"""
