"""An index for BM25 that takes additions and removals: segments with tombstones.

Added documents make a segment: a row for each with its length and postings (doc_id, len, terms) and, beside them, its
sums (term, df) and its number of documents and words. A document's words are counted inside its row, so adding shuffles
ids and sums only. A removal is a tombstone (doc_id, below): it hides the document in segments below that number; adding
a document again hides its older self the same way. Ids that no segment holds get none. What is live is a left-anti join with the tombstones;
statistics are the segments' sums less those of hidden postings, so reading them does not read the whole index.
`compact` writes the live part of the small segments as one.

Each step writes new files and becomes visible by one append to the log, so a lost executor reruns tasks and readers
see whole segments. One writer at a time. Rows without a doc_id are left out; of several rows of a batch with one doc_id, the one with the longest text stays.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions.text import counted, expand

from .hybrid import spread
from .search import by_repeats

POSTINGS = "doc_id long, len long, terms array<struct<term:string,tf:bigint>>, seg long"
SUMS = "term string, df long, docs long, words long, seg long"
DEAD = "doc_id long, below long"
LOG = "seg long, docs long, kind string"


class Segments:
    """The index under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self) -> list:
        """Rows of the log, one a segment or tombstone batch; a step becomes visible by one append to it."""
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log").collect()
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return []

    def _commit(self, *rows: tuple) -> None:
        self.spark.createDataFrame(list(rows), LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _live(self) -> list:
        log = self._log()
        gone = {r.seg for r in log if r.kind == "merged"}
        return [r for r in log if r.kind == "segment" and r.seg not in gone]

    def _next(self) -> int:
        return 1 + max([0, *(r.seg for r in self._log())])

    def _table(self, name: str, schema: str) -> DataFrame:
        segs = [r.seg for r in self._live()]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").filter(F.col("seg").isin(segs)) if segs else self.spark.createDataFrame([], schema)

    def _put(self, name: str, rows: DataFrame, seg: int) -> DataFrame:
        """Write a segment's folder; as all its rows go there, none are sorted by segment first."""
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/seg={seg}")
        return self.spark.read.schema(POSTINGS if name == "postings" else SUMS).parquet(f"{self.path}/{name}").filter(F.col("seg") == seg)

    def _segment(self, postings: DataFrame, seg: int) -> tuple:
        """Write a segment's postings and sums; its row of the log. A document without features has no terms."""
        own = self._put("postings", postings.select("doc_id", "len", "terms"), seg)
        whole = own.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("words"))
        by_term = own.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        zero = F.lit(0).cast("long")
        sums = by_term.withColumns({"docs": zero, "words": zero}).unionByName(whole.withColumns({"term": F.lit(None).cast("string"), "df": zero}))
        made = self._put("sums", sums.select("term", "df", "docs", "words"), seg)
        return seg, made.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0], "segment"

    def _bury(self, ids: DataFrame, below: int) -> None:
        gone = ids.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        gone = gone.join(self._table("postings", POSTINGS).select("doc_id"), "doc_id", "left_semi")
        gone.withColumn("below", F.lit(below).cast("long")).write.mode("append").parquet(f"{self.path}/dead")

    def add(self, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> int:
        """Add documents as a new segment; those that the index holds are replaced. A batch that failed is added again."""
        seg = self._next()
        own = docs.filter(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        once, more = by_repeats(own)
        one = once if more is None else once.unionByName(more.groupBy("doc_id").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text")))
        words = spread(one).select("doc_id", expand(F.col("text")).alias("fs"))
        row = self._segment(words.select("doc_id", F.greatest(F.size("fs"), F.lit(1)).cast("long").alias("len"), counted(F.col("fs")).alias("terms")), seg)
        self._bury(own, seg)
        self._commit(row)
        return seg

    def remove(self, ids: DataFrame) -> None:
        below = self._next()
        self._bury(ids, below)
        self._commit((below, 0, "dead"))

    def _dead(self) -> DataFrame:
        if not self._log():
            return self.spark.createDataFrame([], DEAD)
        return self.spark.read.schema(DEAD).parquet(f"{self.path}/dead").groupBy("doc_id").agg(F.max("below").alias("below"))

    def _met(self, how: str) -> DataFrame:
        """Rows of the segments that tombstones hide ('left_semi') or do not ('left_anti')."""
        gone = self._dead().withColumnRenamed("doc_id", "its")
        return self._table("postings", POSTINGS).join(gone, (F.col("doc_id") == F.col("its")) & (F.col("seg") < F.col("below")), how)

    def postings(self) -> DataFrame:
        """Live postings: doc_id, term, tf, len, seg."""
        rows = self._met("left_anti").select("doc_id", "len", "seg", F.explode_outer("terms").alias("p"))
        return rows.select("doc_id", "p.term", "p.tf", "len", "seg")

    def statistics(self) -> tuple[DataFrame, DataFrame]:
        """(term, df), and one row (docs, words): sums of the segments less the hidden postings'."""
        sums, hidden = self._table("sums", SUMS), self._met("left_semi")
        minus = hidden.select(F.explode("terms.term").alias("term")).groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
        df = sums.filter("term is not null").select("term", "df").unionByName(minus).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        lost = hidden.agg((-F.count(F.lit(1))).alias("docs"), (-F.coalesce(F.sum("len"), F.lit(0))).alias("words"))
        total = sums.select("docs", "words").unionByName(lost).agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
        return df, total

    def compact(self, most_docs: int) -> int | None:
        """Put the live part of the segments of at most `most_docs` documents into one; its number, None where fewer than two are small.

        A live row's tombstones lie at or below its segment, so it stays live under the higher number."""
        small = [r.seg for r in self._live() if r.docs <= most_docs]
        if len(small) < 2:
            return None
        seg = self._next()
        row = self._segment(self._met("left_anti").filter(F.col("seg").isin(small)), seg)
        self._commit(row, *[(s, 0, "merged") for s in small])
        return seg

    def scored(self, questions: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
        """key, doc_id, score (BM25) of the live documents that share a feature with a question."""
        from .hybrid import B, K1

        df, total = self.statistics()
        asked = questions.select(F.col(key), F.explode(F.array_distinct(expand(F.col(text)))).alias("term"))
        known = asked.join(df, "term").join(F.broadcast(total))  # one row
        part = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") * F.col("docs") / F.col("words")))
        return self.postings().join(known, "term").groupBy(key, "doc_id").agg(F.sum(part).alias("score"))
