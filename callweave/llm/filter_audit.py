"""Filter interaction audit over failing-id relations, in DataFrame functions only.

Each filter's failing rows are stored as a table of row ids. A row passes a prefix of filters when its id is in
none of their tables: `survivors` carries every row once for each of the 32 sets of applied filters and takes the
rows out by one left-anti join a filter, so five joins serve the prefixes of all 120 orders, because survivors
depend on which filters ran and not on their order. What the next filter removes is a left-semi join of the
survivors with its id table, counted together with label losses by part. Ids are dealt by row id once; all joins
then meet in place, and no key can be hot because a row id is unique.

Counts that follow: a filter's removals after no other filter are all its failures, so `redundant` is that minus
the removals at the step; its removals after the other four are its unique failures; `shapley` sums its removals
over all orders.

Defined cases: null text is empty (0 words: fails A only, and E if a smaller doc_id is empty too); a null lang is
the part ''; a null doc_id is never smaller than another, fails no E and has no labels; rows that repeat a doc_id
count each, and equal texts under one doc_id do not fail E; a document with several label rows is good (toxic) if
one of them says so; texts are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, table

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
SPACE = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ["rows", "good", "toxic"]


def _mask(letters: str) -> int:
    return sum(1 << FILTERS.index(x) for x in letters)


def text_failures(text: Column) -> dict[str, Column]:
    """Filters that a text fails by itself; E needs the table."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    return {
        "A": n < 100,
        "B": F.size(F.array_distinct(words)) * 100 < n * 80,
        "C": (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) * 100 > F.length(text) * 10,
        "D": text.rlike(r"[#$%&*|]"),
    }


def failing_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The rows (id, part, good, toxic) and, for each filter, the table of ids that fail it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), *[c.alias(k) for k, c in text_failures(text).items()])
    facts = materialise(own.withColumn("id", F.monotonically_increasing_id()), "audit-facts")
    groups = facts.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    groups = materialise(groups.select("digest", "least"), "audit-groups")  # two plain scans, so a hot text is split
    marks = labels.groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(t) for c, t in (("quality", "good"), ("toxic", "toxic"))])
    rows = facts.select("id", "doc_id", "part").join(marks, "doc_id", "left").select("id", "part", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")])
    ids = {k: facts.filter(k).select("id") for k in FILTERS[:4]}
    ids["E"] = facts.select("id", "doc_id", "digest").join(groups, "digest").filter("doc_id > least").select("id")
    out = materialise(rows, "audit-rows"), {k: materialise(v, f"audit-fails-{k}") for k, v in ids.items()}
    discard(facts, groups)
    return out


def survivors(rows: DataFrame, fails: dict[str, DataFrame], but: str = "") -> DataFrame:
    """Every row under each set of filters (bits of `applied`) that it survives; sets with the filter `but` are left out."""
    sets = [s for s in range(ALL + 1) if not s & _mask(but)]
    left = rows.repartition("id").withColumn("applied", F.explode(F.array(*map(F.lit, sets))))
    for k in FILTERS:
        if k != but:
            ids = fails[k].withColumnRenamed("id", "failing")
            left = left.join(ids, (F.col("id") == F.col("failing")) & (F.col("applied").bitwiseAND(F.lit(_mask(k))) != 0), "left_anti")
    return left


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("applied", "part").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in COUNTS[1:]])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    spark = docs.sparkSession
    rows, fails = failing_rows(docs, labels)
    kept = materialise(_counted(survivors(rows, fails)), "audit-kept")  # at most 32 rows a part
    removed = None
    for k in FILTERS:
        one = _counted(survivors(rows, fails, k).join(fails[k], "id", "left_semi")).withColumn("filter", F.lit(k))
        removed = one if removed is None else removed.unionByName(one)
    removed = materialise(removed, "audit-removed")  # at most 80 rows a part
    discard(rows, *fails.values())

    steps = [("".join(o), i + 1, o[i], _mask(o[:i]), _mask(o[: i + 1])) for o in permutations(FILTERS) for i in range(len(FILTERS))]
    orders = spark.createDataFrame(steps, "filter_order string, step int, filter string, before int, after int")  # 600 rows at every size
    parts = kept.filter("applied = 0").select("part", F.explode(F.array(*map(F.lit, range(ALL + 1)))).alias("applied"))
    total = parts.join(kept, ["part", "applied"], "left").select("part", "applied", F.coalesce("rows", F.lit(0)).alias("rows"))
    ways = F.array(*[F.lit(factorial(i) * factorial(4 - i)) for i in range(5)])  # orders in which a given set of i filters comes right before
    sums = removed.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("applied") == 0, F.col("rows"))).alias("fails"),
        F.sum(F.when(F.bit_count("applied") == len(FILTERS) - 1, F.col("rows"))).alias("unique_fails"),
        F.sum(F.col("rows") * F.element_at(ways, F.bit_count("applied") + 1)).alias("shapley"),
    )
    out = total.select("part", F.col("applied").alias("after"), F.col("rows").alias("kept"))
    out = out.join(F.broadcast(orders), "after")
    out = out.join(removed.withColumnRenamed("applied", "before"), ["part", "before", "filter"], "left").join(sums, ["part", "filter"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "part", "filter_order", "step", F.col("kept").cast("long").alias("kept"), zero(F.col("rows")).alias("removed"), (zero(F.col("fails")) - zero(F.col("rows"))).alias("redundant"),
        zero(F.col("unique_fails")).alias("unique_fails"), zero(F.col("good")).alias("good_lost"), zero(F.col("toxic")).alias("toxic_lost"), zero(F.col("shapley")).alias("shapley"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS ws, min(doc_id) OVER (PARTITION BY x) AS least FROM t),
g AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END ||
  CASE WHEN 100 * len(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * len(x) THEN 'C' ELSE '' END ||
  CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN g USING (doc_id)),
n AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS k, left(filter_order, step - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, k,
  sum(CASE WHEN translate(fails, before || k, '') = fails THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN translate(fails, before, '') = fails AND contains(fails, k) THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN translate(fails, before, '') <> fails AND contains(fails, k) THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails = k THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN translate(fails, before, '') = fails AND contains(fails, k) THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN translate(fails, before, '') = fails AND contains(fails, k) THEN toxic ELSE 0 END) AS toxic_lost
  FROM n, s GROUP BY ALL)
SELECT part, filter_order, step::int AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails,
  good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::bigint AS shapley
FROM r
"""
