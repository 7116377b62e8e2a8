"""Hybrid search of many questions over a whole table: a lexical and a dense list from one pass over the texts.

Documents are cut into features (words and synonym groups) in the JVM and reach Python as Arrow batches. Words are
coded once a batch, so everything per word happens once a distinct word: groups, hashed places, question terms.

* Dense: hashed unit vectors of a block of documents, multiplied with the matrix of the questions' vectors.
* Lexical: BM25 over expanded features. The same pass writes, for each document, its length and the asked terms it
  holds (`MET`); statistics and scores are read from that small table, so no text is cut twice.

Each task keeps the k best of each question and list (`Best`) and emits them at its end, so what is shuffled is
tasks x questions x k rows, whatever the number of documents that share a word. Questions travel in blocks of at most
MOST_QUESTIONS; each block is one more pass. Ties go to the smaller doc_id. Rows without a doc_id cannot be cited and
are left out; a null text has no features and is in no list.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions import batches
from callweave.functions.text import SYNONYMS, compact, phrase_marks, token_groups, tokenize
from callweave.sources.shared import new_folder

K1, B = 1.6, 0.72  # fixed values of the ranking function
MOST_QUESTIONS, ROWS = 2048, 1024  # of a block of questions; of a block of documents
BYTES, PAIRS = 1 << 22, 1 << 20  # text of a block of documents; pairs of a term and a question that are scored at once
MET = "doc_id long, length long, terms array<int>, times array<int>, question int, score double"


def feature_columns(text: str, synonyms=SYNONYMS) -> list:
    return [tokenize(F.col(text)).alias("tokens"), phrase_marks(F.col(text), synonyms).alias("phrases"), compact(F.col(text)).alias("compact")]


class Features:
    """The features of some rows as (row, code) pairs in the order tokens, groups, phrases; names by code."""

    def __init__(self, batch: pa.RecordBatch, groups: dict[str, str]):
        tokens, phrases = (batch.column(batch.schema.get_field_index(c)) for c in ("tokens", "phrases"))
        coded = tokens.flatten().dictionary_encode()
        self.names = coded.dictionary.to_pylist()
        marks = sorted({f"#g:{g}" for g in groups.values()})
        at = {m: len(self.names) + i for i, m in enumerate(marks)}
        group = lambda w: at[f"#g:{groups[w]}"] if w in groups else -1
        own = np.full((len(self.names), 2), -1, dtype=np.int64)
        few = pc.is_in(coded.dictionary, pa.array(sorted({*groups, *(f"{w}s" for w in groups)}), pa.string())).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(few).tolist():
            w = self.names[i]
            own[i] = group(w), group(w[:-1]) if len(w) > 3 and w.endswith("s") else -1
        rows = np.repeat(np.arange(len(batch)), _lengths(tokens))
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        grouped = own[codes].ravel()
        held = grouped >= 0
        said = np.array([at.get(p, -1) for p in phrases.flatten().to_pylist()], dtype=np.int64)
        self.names += marks
        self.rows = np.concatenate([rows, np.repeat(rows, 2)[held], np.repeat(np.arange(len(batch)), _lengths(phrases))])
        self.codes = np.concatenate([codes, grouped[held], said])
        self.lengths = np.maximum(np.bincount(self.rows, minlength=len(batch)), 1)


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, dtype=np.int64)


class Asked:
    """A block of questions: their terms, which of them ask a term, and their vectors."""

    def __init__(self, ids: list, features: Features, compacts: list[str], dims: int, digest: str):
        self.ids, n = ids, len(ids)
        pairs = np.unique(features.codes * n + features.rows)
        codes, questions = np.divmod(pairs, max(1, n))
        kept, starts = np.unique(codes, return_index=True)
        self.terms = [features.names[c] for c in kept]
        self.code = {t: i for i, t in enumerate(self.terms)}
        self.starts, self.questions = np.append(starts, len(pairs)), questions
        self.vectors = batches.hash_vectors(features.rows, features.codes, features.names, compacts, dims, digest) if dims else None

    def held(self, features: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, times) of the asked terms in some documents."""
        known = np.array([self.code.get(x, -1) for x in features.names], dtype=np.int64)[features.codes]
        pairs, times = np.unique(features.rows[known >= 0] * len(self.terms) + known[known >= 0], return_counts=True)
        rows, terms = np.divmod(pairs, max(1, len(self.terms)))
        return rows, terms, times

    def lexical(self, rows: np.ndarray, terms: np.ndarray, times: np.ndarray, lengths: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
        """BM25 of some documents (rows) for each question (columns), from the asked terms that they hold."""
        part = idf[terms] * times * (K1 + 1) / (times + K1 * (1 - B + B * lengths[rows] / mean))
        counts = np.diff(self.starts)[terms]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(self.starts[terms], counts)
        n = len(self.ids)
        cells = np.repeat(rows, counts) * n + self.questions[at]
        return np.bincount(cells, weights=np.repeat(part, counts), minlength=len(lengths) * n).reshape(-1, n)


class Best:
    """The k best documents of each question seen so far, by score (9 places, above `floor`) and then by smaller id."""

    def __init__(self, questions: int, k: int, floor: float = 0.0):
        self.k, self.floor, self.least = k, floor, np.full(questions, floor)
        self.held = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)]
        self.most = max(1 << 16, 4 * questions * k)

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        row, question = np.nonzero((scores > self.floor) & (scores >= self.least - 1e-9))
        self.add(question, ids[row], scores[row, question])

    def add(self, question: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.held = [np.concatenate(x) for x in zip(self.held, (question, ids, scores), strict=True)]
        if len(self.held[0]) > self.most:
            self.cut()

    def cut(self) -> list[np.ndarray]:
        question, ids, scores = self.held
        order = np.lexsort((ids, -np.round(scores, 9), question))
        question, ids, scores = question[order], ids[order], scores[order]
        place = np.arange(len(question)) - np.searchsorted(question, question)
        kept = place < self.k
        last = place == self.k - 1
        self.least[question[last]] = scores[last]
        self.held = [question[kept], ids[kept], scores[kept]]
        return self.held


def _question_blocks(questions: DataFrame, key: str, text: str, synonyms, most: int):
    """Blocks of at most about `most` questions, one in the driver at a time."""
    blocks = max(1, -(-questions.count() // most))
    for b in range(blocks):
        part = questions if blocks == 1 else questions.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        table = part.select(F.col(key).alias("id"), *feature_columns(text, synonyms)).toArrow().combine_chunks()
        if table.num_rows:
            yield table.to_batches()[0]


def ranked(docs: DataFrame, questions: DataFrame, lexical: int = 24, dense: int = 48, key: str = "item_id", synonyms=SYNONYMS, dims: int = 768, digest: str = "blake2b", doc: str = "doc_id", text: str = "text", asks: str = "text") -> DataFrame:
    """key, doc_id, list ('lexical' or 'dense'), rank, score: the best of each question in each list that has a size."""
    from .search import top

    groups, kind = token_groups(synonyms), questions.schema[key].dataType.simpleString()
    columns = feature_columns(text, synonyms)
    words = spread(docs.filter(F.col(doc).isNotNull()).select(doc, text)).select(F.col(doc).cast("long").alias("doc_id"), *columns[: 3 if dense else 2])
    found = []
    for block in _question_blocks(questions, key, asks, synonyms, MOST_QUESTIONS):
        asked = Asked(block.column(0).to_pylist(), Features(block, groups), block.column(3).to_pylist(), dims if dense else 0, digest)
        found.append(_scored(words, asked, groups, lexical, dense, key, kind, dims, digest))
    if not found:
        return docs.sparkSession.createDataFrame([], f"{key} {kind}, doc_id long, list string, rank int, score double")
    most = F.when(F.col("list") == "lexical", lexical).otherwise(dense)
    return top(reduce(DataFrame.unionByName, found), max(lexical, dense), [key, "list"]).filter(F.col("rank") <= most)


def spread(docs: DataFrame) -> DataFrame:
    """Deal the rows out where the scan has fewer parts than the session has cores: one file of one row group, say."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def _cut(sizes: np.ndarray, limit: int):
    """(start, stop) of runs of at most ROWS rows and about `limit` in size; a larger row is a run of its own."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = int(np.searchsorted(ends, limit + (ends[start - 1] if start else 0), side="right"))
        stop = min(max(stop, start + 1), start + ROWS)
        yield start, stop
        start = stop


def _parts(parts):
    """Blocks of documents, by their words and letters: what Python holds of a text at once is bounded, whatever the batch."""
    for batch in parts:
        sizes = 8 * _lengths(batch.column(1)) + 64
        if batch.num_columns > 3:
            sizes = np.maximum(sizes, pc.fill_null(pc.binary_length(batch.column(3)), 0).to_numpy(zero_copy_only=False))
        for a, b in _cut(sizes, BYTES):
            yield batch.slice(a, b - a)


def _scored(words: DataFrame, asked: Asked, groups, lexical: int, dense: int, key: str, kind: str, dims: int, digest: str) -> DataFrame:
    of = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def rows_of(name: str, question, ids, scores) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([asked.ids[q] for q in question], of), pa.array(ids), pa.array([name] * len(ids), pa.string()), pa.array(scores)], [key, "doc_id", "list", "score"])

    def meet(parts):
        """The asked terms that each document holds, and the task's best by vectors."""
        best = Best(len(asked.ids), dense)
        for part in _parts(parts):
            features, ids = Features(part, groups), part.column(0)
            if dense:
                best.offer(ids.to_numpy(), batches.hash_vectors(features.rows, features.codes, features.names, part.column(3).to_pylist(), dims, digest) @ asked.vectors.T)
            rows, terms, times = asked.held(features)
            edges = pa.array(np.searchsorted(rows, np.arange(len(part) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (terms, times)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(features.lengths.astype(np.int64)), *lists, pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.float64())], names)
        question, ids, scores = best.cut()
        empty = [pa.nulls(len(ids), t) for t in (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([pa.array(ids), *empty, pa.array(question.astype(np.int32)), pa.array(scores)], names)

    def by_vectors(parts):
        best = Best(len(asked.ids), dense)
        for part in _parts(parts):
            features = Features(part, groups)
            best.offer(part.column(0).to_numpy(), batches.hash_vectors(features.rows, features.codes, features.names, part.column(3).to_pylist(), dims, digest) @ asked.vectors.T)
        yield rows_of("dense", *best.cut())

    names, spark, out = [c.split()[0] for c in MET.split(", ")], words.sparkSession, f"{key} {kind}, doc_id long, list string, score double"
    if not lexical:
        return words.mapInArrow(by_vectors, out)
    path = new_folder(spark, "met")
    words.mapInArrow(meet, MET).write.parquet(path)
    met = spark.read.schema(MET).parquet(path)
    held = met.filter("question is null")
    n, length = held.agg(F.count(F.lit(1)), F.sum("length")).first()
    mean, df = (length or 0) / max(1, n), np.zeros(len(asked.terms))
    for r in held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():  # asked terms only
        df[r.term] = r.df
    idf, asks = np.log(1 + (n - df + 0.5) / (df + 0.5)), np.diff(asked.starts)

    def score(parts):
        best = Best(len(asked.ids), lexical)
        for batch in parts:
            ids, lengths = (batch.column(c).to_numpy() for c in (0, 1))
            counts, terms, times = _lengths(batch.column(2)), *(batch.column(c).flatten().to_numpy() for c in (2, 3))
            rows, ends = np.repeat(np.arange(len(ids)), counts), np.append(0, np.cumsum(counts))
            for a, b in _cut(np.bincount(rows, weights=asks[terms], minlength=len(ids)), PAIRS):
                x = slice(ends[a], ends[b])
                best.offer(ids[a:b], asked.lexical(rows[x] - a, terms[x], times[x], lengths[a:b], idf, mean))
        yield rows_of("lexical", *best.cut())

    def named(parts):
        for batch in parts:
            yield rows_of("dense", batch.column(1).to_pylist(), batch.column(0), batch.column(2))

    found = held.filter(F.size("terms") > 0).select("doc_id", "length", "terms", "times").mapInArrow(score, out)
    return found.unionByName(met.filter("question is not null").select("doc_id", "question", "score").mapInArrow(named, out)) if dense else found
