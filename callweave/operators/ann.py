"""Approximate nearest neighbours by an inverted file.

Centroids are spherical k-means means of a sample of at most SAMPLE vectors, chosen by hash. Every vector is indexed:
it belongs to the list of its nearest centroid, and `write` lays the lists out as partitions of a Parquet table, so a
search reads the probed lists alone. How many lists a query probes is learned on the sample: the fewest with which
`target` of the sample's own exact neighbours are found. Grouped vectors need few; vectors without any structure need
many, and no list layout changes that.

A search multiplies a block of queries with each Arrow batch of a list and keeps the k best of each query in a task
(`hybrid.Best`), so what is shuffled is tasks x queries x k rows and no pair is made. Zero vectors have no direction:
they sit in list 0, score 0 and are found by no query. Null vectors, and those of another length than the sample's
first, are not indexed; vec_id must be set.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hybrid import Best

SAMPLE, LISTS, ROUNDS = 20_000, 1024, 10  # bounds of the sample and of the number of lists; rounds of k-means
MOST_QUERIES = 2048  # of a block
MARGIN = 0.02  # by which the sample's recall must pass the target


def units(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


class Centroids:
    """Means of the lists and the number of lists to probe."""

    def __init__(self, means: np.ndarray, probes: int = 1):
        self.means, self.probes = means, probes

    def lists(self, rows: np.ndarray) -> np.ndarray:
        return (rows @ self.means.T).argmax(axis=1)

    def near(self, rows: np.ndarray) -> np.ndarray:
        """The lists that each query probes."""
        return np.argsort(-(rows @ self.means.T), axis=1, kind="stable")[:, : self.probes]


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return units(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def fit(vectors: DataFrame, k: int = 10, target: float = 0.95, sample: int = SAMPLE, seed: int = 5) -> Centroids:
    """Centroids of sqrt(rows) lists, LISTS at most, and the probes that reach `target` on the sample."""
    dims = F.size("embedding")
    chosen = vectors.filter(dims > 0).select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow().combine_chunks()
    held = [v for v in chosen.column("embedding").to_pylist() if None not in v] if chosen.num_rows else []
    rows = units(np.array([v for v in held if len(v) == len(held[0])], dtype=np.float64)) if held else np.zeros((1, 1))
    count = max(1, min(LISTS, len(rows), round(math.sqrt(vectors.count()))))
    rng = np.random.default_rng(seed)
    means = rows[rng.choice(len(rows), count, replace=False)]
    for _ in range(ROUNDS):
        own = (rows @ means.T).argmax(axis=1)
        sums = np.zeros_like(means)
        np.add.at(sums, own, rows)
        empty = np.bincount(own, minlength=count) == 0
        sums[empty] = rows[rng.choice(len(rows), int(empty.sum()))]
        means = units(sums)
    made = Centroids(means)
    made.probes = _calibrated(made, rows, k, target, rng)
    return made


def _calibrated(made: Centroids, rows: np.ndarray, k: int, target: float, rng) -> int:
    asked = rows[rng.choice(len(rows), min(200, len(rows)), replace=False)]
    scores, own = asked @ rows.T, made.lists(rows)
    true = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    order = np.argsort(-(asked @ made.means.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    needed = np.sort(np.take_along_axis(place, own[true], axis=1).ravel())  # probes beyond the first that each true neighbour takes
    at = min(len(needed) - 1, math.ceil((target + MARGIN) * len(needed)) - 1)
    return int(needed[at]) + 1


def indexed(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """list, vec_id, embedding of every vector that has the centroids' length."""
    width = centroids.means.shape[1]

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(centroids.lists(_matrix(batch.column(1)))), batch.column(0), batch.column(1)], ["list", "vec_id", "embedding"])

    kept = vectors.filter((F.size("embedding") == width) & ~F.exists("embedding", lambda x: x.isNull()) & F.col("vec_id").isNotNull())
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(work, "list long, vec_id long, embedding array<double>")


def write(vectors: DataFrame, centroids: Centroids, path: str) -> None:
    """Lay the lists out as partitions; a large list is as many files as tasks wrote to it."""
    indexed(vectors, centroids).write.mode("overwrite").partitionBy("list").parquet(path)


def search(index: DataFrame, centroids: Centroids, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, scanned: the k best of each query among the vectors of its lists in each task; rank them with `neighbours`."""
    blocks, found = max(1, -(-queries.count() // MOST_QUERIES)), []
    asked = queries.filter(F.size("embedding") == centroids.means.shape[1]).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    for b in range(blocks):
        table = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).toArrow().combine_chunks()
        if table.num_rows:
            batch = table.to_batches()[0]
            found.append(_scan(index, centroids, batch.column(0).to_numpy(), _matrix(batch.column(1)), k))
    return reduce(DataFrame.unionByName, found) if found else index.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, scanned long")


def _scan(index: DataFrame, centroids: Centroids, ids: np.ndarray, asked: np.ndarray, k: int) -> DataFrame:
    probed = np.zeros((centroids.means.shape[0], len(ids)), dtype=bool)
    np.put_along_axis(probed, centroids.near(asked).T, True, axis=0)
    wanted = np.flatnonzero(probed.any(axis=1)).tolist()

    def work(batches):
        best, scanned = Best(len(ids), k), 0
        for batch in batches:
            lists, vectors, own = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            for one in np.unique(lists):
                at, who = np.flatnonzero(lists == one), np.flatnonzero(probed[one])
                scanned += len(at) * len(who)
                scores = np.zeros((len(at), len(ids)))
                scores[:, who] = own[at] @ asked[who].T
                best.offer(vectors[at], scores)
        question, held, scores = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(ids[question], -1)), pa.array(np.append(held, -1)), pa.array(np.append(scores, -2.0)), pa.array(np.append(np.zeros(len(held), dtype=np.int64), scanned))], ["query_id", "vec_id", "score", "scanned"])

    # at most LISTS values: the scan of a written index reads these partitions only
    return index.filter(F.col("list").isin(wanted)).select(F.col("list").cast("long").alias("list"), "vec_id", "embedding").mapInArrow(work, "query_id long, vec_id long, score double, scanned long")


def neighbours(vectors: DataFrame, queries: DataFrame, k: int, path: str | None = None, centroids: Centroids | None = None) -> DataFrame:
    """query_id, vec_id, rank, score; with `path` through a written index."""
    from .search import top

    centroids = fit(vectors, k) if centroids is None else centroids
    if path is not None:
        write(vectors, centroids, path)
    index = indexed(vectors, centroids) if path is None else vectors.sparkSession.read.parquet(path)
    met = search(index, centroids, queries, k).filter("score > -2")
    return top(met, k, "query_id", tie="vec_id").select("query_id", "vec_id", "rank", F.round("score", 5).alias("score"))
