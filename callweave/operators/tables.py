"""Tables that take changes: upserts with history, verification, deletes with cascade, reviews, resolved backlog items.

A table is Parquet partitioned by `bucket`, a hash of its key. A change reads the buckets that its rows touch and no
others (partition pruning), joins by key, writes the new rows to a staging folder and then overwrites those partitions
alone (dynamic partition overwrite), so its cost follows the batch and not the table, and a lost executor reruns a task
and leaves the table as it was. Changes are idempotent: a batch that is applied again changes no row and adds no
history. History is written before the table and told apart by key and revision, so a batch that failed between the
two can be repeated. One writer at a time per table.

Null keys are refused: a row without a key cannot be addressed. Of several rows of a batch with one key, the last by
`order` counts. Columns of a table are the caller's, beside `bucket`, `revision`, `created_at` and `updated_at`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.sources.shared import new_folder

from .changes import fingerprint

BUCKETS = 64  # of a table, for its whole life


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def create(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Write a table. A bucket is a file for each task that holds rows of it, one after a shuffle by key."""
    rows.filter(F.col(key).isNotNull()).withColumn("bucket", bucket_of(key, buckets)).repartition("bucket").write.mode("errorifexists").partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def rewrite(spark: SparkSession, path: str, batch: DataFrame, key: str, change: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS, log: Callable[[DataFrame], None] | None = None) -> int:
    """Replace the touched buckets by change(rows of these buckets, batch); how many buckets that were.

    Both sides are dealt by bucket, so a change that joins by bucket and key, and the write, move no row again. What
    `change` gives is written once; `log` gets it, with columns that the table lacks, before the table is written."""
    batch = batch.filter(F.col(key).isNotNull()).withColumn("bucket", bucket_of(key, buckets))
    touched = sorted(r.bucket for r in batch.select("bucket").distinct().collect())  # `buckets` numbers at most
    if not touched:
        return 0
    now = read(spark, path)
    after = change(now.filter(F.col("bucket").isin(touched)).repartition("bucket"), batch.repartition("bucket"))
    stage = new_folder(spark, "stage")
    after.write.option("compression", "zstd").parquet(stage)
    made = spark.read.schema(after.schema).parquet(stage)
    if log:
        log(made)
    made = made.select(now.columns)
    empty = set(touched) - {r.bucket for r in made.select("bucket").distinct().collect()}
    made.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for b in empty:  # nothing is written where all rows went, so the old files are cleared by themselves
        made.limit(0).drop("bucket").write.mode("overwrite").parquet(f"{path}/bucket={b}")
    return len(touched)


def last_of(batch: DataFrame, key: str, order: str | None) -> DataFrame:
    """One row of each key, the last by `order`."""
    if order is None:
        return batch.dropDuplicates([key])
    whole = F.struct(*[F.col(f"`{c}`") for c in batch.columns])
    return batch.groupBy(F.col(key).alias("its")).agg(F.max_by(whole, F.struct(order, F.xxhash64(whole))).alias("row")).select("row.*")


def snapshot(columns: list[str]) -> Column:
    """The named columns as a VARIANT."""
    return F.parse_json(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def _differing(spark: SparkSession, path: str, batch: DataFrame, key: str, content: list[str], order: str | None, buckets: int) -> DataFrame:
    """The rows of a batch that the table lacks or holds with other content, the last of each key by `order`.

    Only keys and fingerprints meet the table; the texts of the rows that count follow."""
    dealt = batch.filter(F.col(key).isNotNull()).withColumns({"bucket": bucket_of(key, buckets), "__print": fingerprint(*[F.col(c) for c in content])})
    place = F.struct(*([F.col(order).alias("o")] if order else []), F.col("__print").alias("p"))
    last = dealt.groupBy("bucket", key).agg(F.max(place)["p"].alias("__print"))
    touched = [r.bucket for r in dealt.select("bucket").distinct().collect()]  # `buckets` numbers at most
    held = read(spark, path).filter(F.col("bucket").isin(touched)).select("bucket", key, fingerprint(*[F.col(c) for c in content]).alias("__held"))
    moved = last.join(held, ["bucket", key], "left").filter(F.col("__held").isNull() | (F.col("__held") != F.col("__print"))).select("bucket", key, "__print").distinct()
    stage = new_folder(spark, "moved")
    moved.write.parquet(stage)
    moved = spark.read.schema(moved.schema).parquet(stage)
    return dealt.join(moved, ["bucket", key, "__print"], "left_semi").select(key, *content).dropDuplicates([key])


def upsert(spark: SparkSession, path: str, history: str, batch: DataFrame, key: str, content: list[str], at: Column, by: str, order: str | None = None, note: str = "", buckets: int = BUCKETS) -> int:
    """Insert at revision 1, leave equal content alone, else update at the next revision; buckets without a change stay.

    History gets the created state, or the state before an update, as a VARIANT, with the revision that it led to."""
    batch = _differing(spark, path, batch.select(key, *content, *([order] if order and order not in (key, *content) else [])), key, content, order, buckets)

    def change(now: DataFrame, new: DataFrame) -> DataFrame:
        new = new.select("bucket", F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in content], F.lit(True).alias("__sent"))
        both = now.join(new, (now["bucket"] == new["bucket"]) & (now[key] == new["__key"]), "full_outer").withColumn("__bucket", F.coalesce(now["bucket"], new["bucket"])).drop("bucket")
        sent = F.coalesce("__sent", F.lit(False))
        differs = fingerprint(*[F.col(c) for c in content]) != fingerprint(*[F.col(f"__{c}") for c in content])
        both = both.withColumn("__action", F.when(F.col(key).isNull(), "create").when(sent & differs, "update").otherwise("keep"))
        moved = F.col("__action") != "keep"
        pick = [F.when(moved, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in content]
        rest = [F.col(c) for c in now.columns if c not in {key, *content, "bucket", "revision", "created_at", "updated_at"}]
        return both.select(
            F.coalesce(key, "__key").alias(key), *pick, *rest, F.when(moved, F.coalesce("revision", F.lit(0)) + 1).otherwise(F.col("revision")).cast("int").alias("revision"),
            F.coalesce("created_at", F.when(moved, at)).alias("created_at"), F.when(moved, at).otherwise(F.col("updated_at")).alias("updated_at"), F.col("__bucket").alias("bucket"),
            "__action", F.when(F.col("__action") == "update", F.struct(*content)).alias("__before"),
        )

    def log(made: DataFrame) -> None:
        state = F.when(F.col("__action") == "create", snapshot(content)).otherwise(snapshot([F.col(f"__before.{c}").alias(c) for c in content]))
        before = made.filter("__action <> 'keep'").select(key, "revision", F.col("__action").alias("action"), F.lit(by).alias("changed_by"), F.lit(note).alias("note"), at.alias("changed_at"), state.alias("snapshot"))
        before.write.mode("append").parquet(history)

    return rewrite(spark, path, batch, key, change, buckets, log) or _unchanged(spark, path, history, key, by, note, at, content)


def _unchanged(spark: SparkSession, path: str, history: str, key: str, by: str, note: str, at: Column, content: list[str]) -> int:
    """A change of no row leaves a history that can be read."""
    none = read(spark, path).limit(0).select(key, "revision", F.lit("").alias("action"), F.lit(by).alias("changed_by"), F.lit(note).alias("note"), at.alias("changed_at"), snapshot(content).alias("snapshot"))
    none.write.mode("append").parquet(history)
    return 0


def read_history(spark: SparkSession, history: str, key: str) -> DataFrame:
    """History, each key and revision once."""
    return spark.read.parquet(history).dropDuplicates([key, "revision"])


def verify(spark: SparkSession, path: str, history: str, keys: DataFrame, key: str, at: Column, by: str, buckets: int = BUCKETS) -> int:
    """Flag, actor, time and the next revision for rows that are not verified yet, with an audit row each."""

    held = read(spark, path).filter(~F.coalesce("verified", F.lit(False))).select("bucket", key)
    sent = keys.filter(F.col(key).isNotNull()).select(bucket_of(key, buckets).alias("bucket"), key).distinct()
    stage = new_folder(spark, "moved")
    sent.join(held, ["bucket", key], "left_semi").select(key).write.parquet(stage)  # keys alone meet the table first
    open_keys = spark.read.schema(sent.select(key).schema).parquet(stage)

    def change(now: DataFrame, new: DataFrame) -> DataFrame:
        both = now.join(new.select("bucket", key, F.lit(True).alias("__sent")), ["bucket", key], "left").withColumn("__hit", F.coalesce("__sent", F.lit(False)) & ~F.coalesce("verified", F.lit(False)))
        hit = lambda value, c: F.when(F.col("__hit"), value).otherwise(F.col(c)).alias(c)
        return both.drop("__sent").withColumns({"verified": hit(F.lit(True), "verified"), "verified_by": hit(F.lit(by), "verified_by"), "verified_at": hit(at, "verified_at"), "revision": hit((F.col("revision") + 1).cast("int"), "revision")})

    def log(made: DataFrame) -> None:
        own = [c for c in made.columns if c not in ("bucket", "revision", "verified", "verified_by", "verified_at", "created_at", "updated_at", "__hit")]
        audit = made.filter("__hit").select(F.col(key), "revision", F.lit("verify").alias("action"), F.lit(by).alias("changed_by"), F.lit("").alias("note"), at.alias("changed_at"), snapshot(own).alias("snapshot"))
        audit.write.mode("append").parquet(history)

    return rewrite(spark, path, open_keys, key, change, buckets, log) or _unchanged(spark, path, history, key, by, "", at, [key])


def delete(spark: SparkSession, path: str, keys: DataFrame, key: str, children: dict[str, str] | None = None, buckets: int = BUCKETS) -> int:
    """Remove rows, and from each child table (path -> its own key beside `key`) the rows that belong to them.

    A child table is bucketed by `key` as well, so the cascade reads the same buckets."""
    for child in children or {}:
        rewrite(spark, child, keys, key, lambda now, gone: now.join(gone.select("bucket", key).distinct(), ["bucket", key], "left_anti"), buckets)
    return rewrite(spark, path, keys, key, lambda now, gone: now.join(gone.select("bucket", key).distinct(), ["bucket", key], "left_anti"), buckets)


def append_reviews(spark: SparkSession, path: str, reviews: DataFrame, key: str, entry: list[str], column: str = "reviews", buckets: int = BUCKETS) -> int:
    """Append each review to its row's list, in order of the entry's fields; one that the list holds already is not added."""

    def change(now: DataFrame, new: DataFrame) -> DataFrame:
        added = new.groupBy("bucket", F.col(key)).agg(F.array_sort(F.collect_set(F.struct(*entry))).alias("__added"))  # the batch's reviews of one row
        held = F.coalesce(F.col(column), F.array().cast(now.schema[column].dataType))
        both = now.join(added, ["bucket", key], "left").withColumn("__new", F.coalesce("__added", F.array().cast(now.schema[column].dataType)))
        return both.withColumn(column, F.concat(held, F.array_except("__new", held)))

    return rewrite(spark, path, reviews, key, change, buckets)


def resolve(spark: SparkSession, path: str, items: DataFrame, key: str, at: Column, by: str, buckets: int = BUCKETS) -> int:
    """Mark open backlog items as resolved, with who, when and the `note` of the item."""

    def change(now: DataFrame, new: DataFrame) -> DataFrame:
        sent = new.groupBy("bucket", F.col(key)).agg(F.max("note").alias("__note"), F.lit(True).alias("__sent"))
        both = now.join(sent, ["bucket", key], "left").withColumn("__hit", F.coalesce("__sent", F.lit(False)) & ~F.coalesce("resolved", F.lit(False)))
        hit = lambda value, c: F.when(F.col("__hit"), value).otherwise(F.col(c)).alias(c)
        return both.withColumns({"resolved": hit(F.lit(True), "resolved"), "resolved_by": hit(F.lit(by), "resolved_by"), "resolved_at": hit(at, "resolved_at"), "note": hit(F.col("__note"), "note")})

    return rewrite(spark, path, items, key, change, buckets)
