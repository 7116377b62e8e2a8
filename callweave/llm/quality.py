"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

Every word falls into one of BUCKETS rows and has a sparse random index vector; a row's context vector is
the sum of the index vectors of its neighbours (two on either side) over all texts of the corpus. The sums
are whole numbers, so their order does not matter. A document's features are the mean and the spread of
its words' unit context vectors and its log length. The network (tanh, then logistic) is trained by Adam
on at most TRAIN_ROWS labelled documents chosen by hash; a fourth of the labels' folds sets the
temperature that calibrates its probabilities. The word table has a fixed size, so its broadcast is bounded.

Defined cases: a null or empty text has zero features and the score the network gives them; without any
label of both classes, every score is the share of label 1 (0.5 without labels); of a document's repeated
labels the largest counts; repeated rows score alike and train once, and of an id with several texts each is
a document; an empty table gives an empty result; extra columns are not read and keep their values, one named
quality_score too; labels, lang, source and doc_id are no features. Whole texts are read, however long.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, table, text_runs

BUCKETS, DIMS, MARKS, REACH = 8192, 32, 4, 2
TRAIN_ROWS, HIDDEN, EPOCHS, SEED = 20_000, 24, 60, 5
FOLDS, HELD_OUT, CALIBRATION, ACCEPT = 4, 2, 3, 0.7
FEATURES = 2 * DIMS + 1

#: Letters of any script, digits, and runs of other signs; upper and lower case stay different words.
_WORD = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[!-/:-@\[-`{-~]+")
RUN_BYTES = 1 << 20


def word_rows(text: str) -> np.ndarray:
    found = _WORD.findall(text.encode())
    return np.fromiter(map(crc32, found), np.int64, len(found)) % BUCKETS


def index_vectors(seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of each row's MARKS non-zero entries."""
    rng = np.random.default_rng(seed)
    at = np.argsort(rng.random((BUCKETS, DIMS)), axis=1)[:, :MARKS]
    return at, rng.choice(np.array([-1.0, 1.0]), (BUCKETS, MARKS))


def context_vectors(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """BUCKETS x DIMS sums over the whole corpus."""

    def work(batches):
        at, sign = index_vectors()
        total = np.zeros(BUCKETS * DIMS)
        for batch in batches:
            for _, texts in text_runs(batch, 0, RUN_BYTES):
                gap = np.full(REACH, -1)  # keeps neighbours within their document
                words = np.concatenate([x for t in texts for x in (word_rows(t), gap)])
                for off in range(1, REACH + 1):
                    a, b = words[:-off], words[off:]
                    ok = (a >= 0) & (b >= 0)
                    a, b = a[ok], b[ok]
                    for centre, near in ((a, b), (b, a)):
                        for j in range(MARKS):
                            total += np.bincount(centre * DIMS + at[near, j], weights=sign[near, j], minlength=len(total))
        rows = total.reshape(BUCKETS, DIMS).astype(np.int64)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int64)), pa.FixedSizeListArray.from_arrays(pa.array(rows[used].ravel()), DIMS).cast(pa.list_(pa.int64()))],
            ["bucket", "sums"],
        )

    parts = docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(work, "bucket long, sums array<long>")
    summed = parts.groupBy("bucket").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(DIMS)]).alias("sums")).collect()  # at most BUCKETS rows
    out = np.zeros((BUCKETS, DIMS))
    for r in summed:
        out[r.bucket] = r.sums
    return out


def unit_vectors(sums: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Features of each text."""
    rows = [word_rows(t) for t in texts]
    counts = np.array([len(r) for r in rows])
    out = np.zeros((len(texts), FEATURES))
    if counts.sum():
        words = vectors[np.concatenate(rows)]
        full = np.flatnonzero(counts)
        starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        mean = np.add.reduceat(words, starts, axis=0, dtype=np.float64) / counts[full, None]
        square = np.add.reduceat(words * words, starts, axis=0, dtype=np.float64) / counts[full, None]
        out[full, :DIMS] = mean
        out[full, DIMS : 2 * DIMS] = np.sqrt(np.maximum(square - mean**2, 0))
    out[:, -1] = np.log1p(counts)
    return out


class Network:
    """Two layers, with standardised input and a temperature on the logit."""

    def __init__(self, constant: float | None = None):
        self.constant, self.temperature = constant, 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.std @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Network:
        """`held` rows only set the temperature."""
        rng = np.random.default_rng(SEED)
        self.mean, self.std = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-3
        self.w1, self.b1 = rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0
        names = ["w1", "b1", "w2", "b2"]
        m, v, turn = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
        a, t = (x[~held] - self.mean) / self.std, y[~held].astype(float)
        for _ in range(EPOCHS):
            order = rng.permutation(len(a))
            for part in np.array_split(order, max(1, len(a) // 128)):
                h = np.tanh(a[part] @ self.w1 + self.b1)
                gap = (1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30))) - t[part]) / len(part)
                back = np.outer(gap, self.w2) * (1 - h**2)
                grad = {"w1": a[part].T @ back + 1e-4 * self.w1, "b1": back.sum(axis=0), "w2": h.T @ gap + 1e-4 * self.w2, "b2": gap.sum()}
                turn += 1
                for n in names:
                    m[n], v[n] = 0.9 * m[n] + 0.1 * grad[n], 0.999 * v[n] + 0.001 * grad[n] ** 2
                    setattr(self, n, getattr(self, n) - 0.01 * (m[n] / (1 - 0.9**turn)) / (np.sqrt(v[n] / (1 - 0.999**turn)) + 1e-8))
        if held.sum() >= 20 and len(set(y[held])) == 2:
            z, t = self.logit(x[held]), y[held]
            tries = np.exp(np.linspace(-1.5, 2.5, 161))
            loss = [np.mean(np.logaddexp(0, np.where(t == 1, -z, z) / k)) for k in tries]
            self.temperature = float(tries[int(np.argmin(loss))])
        return self


def fold(column: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, train_rows: int = TRAIN_ROWS) -> Network:
    usable = labels.filter((fold() != HELD_OUT) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)

    def work(batches):
        for batch in batches:
            for a, texts in text_runs(batch, 1, RUN_BYTES):
                x = pooled(texts, vectors)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(texts)), batch.column(2).slice(a, len(texts)), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"]
                )

    part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("print")).join(F.broadcast(chosen), "doc_id")  # at most train_rows labels
    part = part.dropDuplicates(["doc_id", "print"]).orderBy(F.xxhash64("doc_id", "print"), "doc_id", "print").limit(train_rows)
    rows = part.select("doc_id", "text", F.col("quality").cast("long")).mapInArrow(work, "doc_id long, quality long, x array<double>").toArrow()  # at most train_rows
    if not rows.num_rows:
        return Network(constant=0.5)
    ids, y = rows.column("doc_id").to_numpy(), rows.column("quality").to_numpy()
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
    order = np.lexsort([*x.T[::-1], ids])  # the same order, however the rows came
    ids, y, x = ids[order], y[order], x[order]
    if len(set(y.tolist())) < 2:
        return Network(constant=float(y.mean()))
    held = np.array([crc32(str(i).encode()) % FOLDS == CALIBRATION for i in ids.tolist()])
    if held.all() or len(set(y[~held].tolist())) < 2:
        held[:] = False
    return Network().fit(x, y, held)


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    vectors = unit_vectors(context_vectors(docs))
    return vectors, train(docs, labels, vectors)


def score(docs: DataFrame, vectors: np.ndarray, network: Network, name: str = "quality_score") -> DataFrame:
    """The documents' columns and the score, as column `name`; docs must have no column of that name."""
    schema = docs.withColumn(name, F.lit(0.0)).schema
    at = docs.columns.index("text")

    def work(batches):
        for batch in batches:
            for a, texts in text_runs(batch, at, RUN_BYTES):
                scores = pa.array(network.score(pooled(texts, vectors)))
                part = batch.slice(a, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, scores], [*part.schema.names, name])

    return docs.mapInArrow(work, schema)


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their own columns."""
    (name,) = free_names(docs, "quality_score")
    return score(docs, *fitted(docs, labels), name).filter(F.col(name) >= ACCEPT).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, *fitted(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (fold() == HELD_OUT).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= ACCEPT).cast("int").alias("predicted")
    )
