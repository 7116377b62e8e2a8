"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Texts are hashed once into a table of ids and SHA-256 digests. Pass 1 gives every digest a slot in each of two
rows and counts slots; a slot hit twice sets one bit of a "repeated" filter. Pass 2 probes both rows: a document
with an unset bit is certainly unique and goes straight through; only the rest (true repeats and about one in
seventy of the others) are grouped by digest. The filter has BITS_PER_ROW bits a document at every size. It is a
table of maps of MAP_BITS bits: up to BROADCAST_BITS a row it is broadcast, beyond that documents meet its maps
by a join on the map number, which moves digests and no texts.

Dropping copies works on the documents themselves: the filter of pass 2 then holds the digests that do repeat,
and only documents that meet it are shuffled with their texts (past BROADCAST_BITS, each is moved once to its map).

Defined cases: null text counts as empty; texts are hashed whole, however long; of equal texts the largest doc_id
stays (null lowest); rows that repeat a document (same doc_id and text) get the same values and the filter form
keeps one of them; an empty table gives an empty result; further columns keep their values, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, table

MAP_BITS = 32768  # bits of one map made by bitmap_construct_agg
BROADCAST_BITS = 1 << 28  # largest row of the filter that is broadcast: 32 MB
BITS_PER_ROW = 8


def _slots(digest: Column, bits: int) -> list[Column]:
    """Two slots from disjoint parts of the digest."""
    return [F.pmod(F.conv(F.substring(digest, p, 15), 16, 10).cast("long"), F.lit(bits)) for p in (1, 17)]


def bit(bitmap: Column, slot: Column) -> Column:
    at = F.pmod(slot, F.lit(MAP_BITS))
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))


def filter_bits(rows: int) -> int:
    return max(MAP_BITS, 1 << math.ceil(math.log2(max(1, rows * BITS_PER_ROW))))


def maps(slots: DataFrame, row: int) -> DataFrame:
    """map{row}, bits{row}: the filter's maps over a column of slots."""
    return slots.groupBy(F.floor(F.col("slot") / MAP_BITS).alias(f"map{row}")).agg(F.expr(f"bitmap_construct_agg(int(slot % {MAP_BITS}))").alias(f"bits{row}"))


def _probed(rows: DataFrame, bits: int, filters: list[DataFrame]) -> DataFrame:
    """Add `again`: whether both bits of the row's digest are set."""
    slots, own = _slots(F.col("digest"), bits), rows.columns
    for i, (slot, each) in enumerate(zip(slots, filters, strict=True)):
        # past the bound both sides are plain scans, so the join splits a map that a hot text asks for
        each = F.broadcast(each) if bits <= BROADCAST_BITS else materialise(each, f"exact-maps{i}")
        rows = rows.withColumn(f"map{i}", F.floor(slot / MAP_BITS)).join(each, f"map{i}", "left")
    return rows.select(*own, (bit(F.col("bits0"), slots[0]) & bit(F.col("bits1"), slots[1])).alias("again"))


def marked(hashed: DataFrame) -> DataFrame:
    """Add `again` to rows with a `digest`: false only if the digest certainly occurs once."""
    bits = filter_bits(hashed.count())
    twice = [hashed.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1") for slot in _slots(F.col("digest"), bits)]
    return _probed(hashed, bits, [maps(t, i) for i, t in enumerate(twice)])


def digest_of(text_column: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_column).cast("string"), F.lit("")), 256)


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    hashed = materialise(docs.select(F.col(id_column).alias("doc_id"), digest_of(text_column).alias("digest")), "exact-hashed")
    rows = materialise(marked(hashed), "exact-marked")
    discard(hashed)
    again = rows.filter("again")
    groups = materialise(again.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "exact-groups")
    # both sides are plain scans, so a group of a third of all rows is split by the skew join
    repeated = again.join(groups, "digest")
    single = rows.filter("not again").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")})
    columns = ["doc_id", "keep_id", "group_size", "digest"]
    return (
        single.select(columns)
        .unionByName(repeated.select(columns))
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))
    )


def drop_exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that stay, with their own columns. Unique texts never shuffle while the filter is broadcast."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest_of(text_column).alias("digest"))
    hashed = materialise(rows.select("digest"), "exact-digests")
    repeated = marked(hashed).filter("again").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    repeated = materialise(repeated, "exact-repeated")
    discard(hashed)
    bits = filter_bits(repeated.count())
    probed = _probed(rows, bits, [maps(repeated.select(slot.alias("slot")), i) for i, slot in enumerate(_slots(F.col("digest"), bits))])
    own_id = F.col("row").getField(id_column)
    best = probed.filter("again").groupBy("digest").agg(F.max_by("row", F.struct(own_id.isNotNull(), own_id)).alias("row"))
    return probed.filter("not again").select("row.*").unionByName(best.select("row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = """
WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM h JOIN g USING (text_sha256)
"""
