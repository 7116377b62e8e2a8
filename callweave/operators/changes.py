"""Change data: fingerprints, upserts as planned changes, revisions, chunk differences, deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(*columns: Column) -> Column:
    """SHA-256 over the columns in the order given; null and empty stay apart."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in columns]), 256)


def plan_upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old (key, revision, print) against new (key, print): key, action, revision after.

    create at revision 1, skip where the print is equal, update at the next revision, keep where new lacks it.
    """
    a = old.select(key, F.col("revision").alias("__rev"), F.col("print").alias("__old"))
    b = new.select(key, F.col("print").alias("__new"))
    action = (
        F.when(F.col("__old").isNull(), "create").when(F.col("__new").isNull(), "keep").when(F.col("__old") == F.col("__new"), "skip").otherwise("update")
    )
    both = a.join(b, key, "full_outer").withColumn("action", action)
    revision = F.when(F.col("action") == "create", 1).when(F.col("action") == "update", F.col("__rev") + 1).otherwise(F.col("__rev"))
    return both.select(key, "action", revision.alias("revision"))


def report(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("rows"))


def chunk_changes(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """add, remove or keep for each key of two chunk tables."""
    keys = list(key)
    added = new.select(keys).distinct().join(old.select(keys), keys, "left_anti").withColumn("change", F.lit("add"))
    removed = old.select(keys).distinct().join(new.select(keys), keys, "left_anti").withColumn("change", F.lit("remove"))
    kept = new.select(keys).distinct().join(old.select(keys), keys, "left_semi").withColumn("change", F.lit("keep"))
    return added.unionByName(removed).unionByName(kept)


def replace_by_key(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new)


def delete_by(df: DataFrame, gone: DataFrame, *key: str) -> DataFrame:
    return df.join(gone.select(*key), list(key), "left_anti")


def new_or_old(new: Column, old: Column) -> Column:
    """Patch rule for text: an empty or missing new value keeps the old."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def backlog(asked: DataFrame) -> DataFrame:
    """Repeated questions by key: count, best score, first and last time, latest intent that is set."""
    return asked.groupBy("canonical_key").agg(
        F.count(F.lit(1)).alias("occurrences"), F.max("score").alias("best_score"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.max_by("intent", F.when(F.col("intent").isNotNull(), F.struct("ts", "id"))).alias("intent"),
    )
