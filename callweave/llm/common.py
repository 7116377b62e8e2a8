"""What the corpus operators share: the shared folder, cut lineage, and byte blocks inside tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_SHARED = "/tmp/callweave-shared"  # only where the session names no spark.checkpoint.dir, as in tests


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, as the session has it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or LOCAL_SHARED).rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write df as Parquet into the shared folder and read it back.

    A lost executor then costs a reread, not a recomputation, and the planner sees real sizes. Shuffle
    files of the write go with it. The folder lives as long as the cluster keeps spark.checkpoint.dir.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/callweave/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the tables of materialise() that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The given column names, each with underscores before it until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def runs(sizes: list[int], limit: int = 4 << 20):
    """Yield (start, stop) row ranges of about `limit` bytes each; a larger row makes a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_runs(batch, column: int, limit: int = 4 << 20):
    """Yield (start, list of texts, nulls as empty) over an Arrow batch, in runs of about `limit` bytes."""
    import pyarrow.compute as pc

    texts = batch.column(column)
    for a, b in runs(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), limit):
        yield a, [t or "" for t in texts.slice(a, b - a).to_pylist()]
