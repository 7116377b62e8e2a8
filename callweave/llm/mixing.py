"""Mixing by iterative proportional fitting, in DataFrame functions only.

Documents fall into cells (source, language, topic). Cell token counts are raked: each round scales the
cells so that one marginal after the other (source, language, topic) meets its target. Rounds go on, ROUNDS
at a time, until the last one moves no cell's share by more than GAP, or there were MOST_ROUNDS (targets that
no weights can meet have no limit to reach). A document's sampling probability is its
cell's raked weight over its observed weight, scaled so that the largest is 1, and the document stays when a
uniform number made from its id lies below it. Probabilities are used as they are and reported to 6 places.

Targets are shares tempered by a power of the observed shares (1 keeps them, 0 levels them), or given
as {value: weight}; a value without a given weight gets weight 0 and its documents are dropped.

Defined cases: a null source or language is the value '(none)'; a null or empty text has no tokens, takes
its cell's probability, and a cell without any token has probability 1; a null id draws the number of the
empty string; repeated rows draw alike, and so do ties; texts are read whole, however long; an empty table gives
an empty result; extra columns keep their values, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, table

ROUNDS, MOST_ROUNDS, GAP = 10, 50, 1e-4
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
SMALL_CELLS = 100_000  # a cell table of at most so many rows is raked in one partition and broadcast
WORD = r"[^ \t\n\r]+"
MARKS, CAPITALS = "[#*|]", "[A-Z]"


def topic_of(tokens: Column, chars: Column, marks: Column, capitals: Column) -> Column:
    """A topic by the make-up of the text, marks and capitals in thousandths of its characters: marked-up or listed
    text, headings and short sentences, prose of long sentences, other prose."""
    return (
        F.when(tokens == 0, "none").when(1000 * marks >= 20 * chars, "marked").when(1000 * capitals >= 22 * chars, "headed")
        .when(1000 * capitals < 14 * chars, "flowing").otherwise("plain")
    )


def uniform(id_column: Column) -> Column:
    """52 bits of the id's MD5, as a number from 0 up to 1."""
    return F.conv(F.substring(F.md5(F.coalesce(id_column.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _target(cells: DataFrame, axis: str, powers: dict, targets: dict) -> Column:
    if axis in targets:
        given = targets[axis]
        total = float(sum(given.values()))
        value = F.lit(0.0)
        for k, v in given.items():
            value = F.when(F.col(axis) == k, v / total).otherwise(value)
        return value
    return F.pow(F.col(f"share_{axis}"), F.lit(float(powers[axis]))) / F.col(f"norm_{axis}")


def _targeted(cells: DataFrame, powers: dict, targets: dict, small: bool) -> DataFrame:
    """Cells with total, weight and a target share on each axis."""
    total = cells.agg(F.sum("tokens").cast("double").alias("total"))
    cells = materialise(cells.join(F.broadcast(total)).withColumn("weight", F.col("tokens").cast("double")), "mix-weights")  # one row
    out = cells
    for a in powers:
        shares = materialise(cells.groupBy(a).agg((F.sum("tokens") / F.first("total")).alias(f"share_{a}")), "mix-shares")
        norm = shares.agg(F.sum(F.pow(F.col(f"share_{a}"), F.lit(float(powers[a])))).alias(f"norm_{a}"))
        shares = shares.join(F.broadcast(norm)).withColumn(f"target_{a}", _target(shares, a, powers, targets)).select(a, f"target_{a}")  # one row
        out = out.join(F.broadcast(shares) if small else materialise(shares, "mix-targets"), a)
    return out.select(*powers, "tokens", "total", "weight", *[f"target_{a}" for a in powers])


def _scaled(cells: DataFrame, axis: str, small: bool) -> DataFrame:
    """Cells scaled to meet the targets of one axis."""
    if small:  # one partition: every window finds its rows in place
        at = F.sum("weight").over(Window.partitionBy(axis))
        return cells.withColumn("weight", F.when(at > 0, F.col("weight") * F.col(f"target_{axis}") * F.col("total") / at).otherwise(0.0))
    sums = materialise(cells.groupBy(axis).agg(F.sum("weight").alias("at")), "mix-sums")  # sums meet their cells by a join that splits hot values
    scaled = F.when(F.col("at") > 0, F.col("weight") * F.col(f"target_{axis}") * F.col("total") / F.col("at")).otherwise(0.0)
    return materialise(cells.join(sums, axis).withColumn("weight", scaled).drop("at"), "mix-cells")


def rake(cells: DataFrame, powers: dict = POWERS, targets: dict | None = None, rounds: int = ROUNDS, small: bool = True) -> DataFrame:
    """Cells with observed `tokens` and raked `weight`."""
    axes, done = list(powers), 0
    cells = materialise(_targeted(cells, powers, targets or {}, small), "mix-targeted")
    while True:
        held = cells.coalesce(1) if small else cells
        for turn in range(rounds):
            if turn == rounds - 1:
                held = held.withColumn("before", F.col("weight"))
            for a in axes:
                held = _scaled(held, a, small)
        nxt = materialise(held, "mix-raked")
        discard(cells)
        moved = nxt.agg(F.max(F.abs(F.col("weight") - F.col("before")) / F.col("total"))).first()[0]
        cells, done = nxt.drop("before"), done + rounds
        cells._written = nxt._written
        if done >= MOST_ROUNDS or (moved or 0.0) <= GAP:
            return cells.select(*axes, "tokens", "weight")


def with_cells(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """row (all columns of docs), source, lang, topic and tokens."""
    text = F.col(text_column)
    count = lambda pattern: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")
    counts = F.struct(count(WORD).alias("tokens"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("chars"), count(MARKS).alias("marks"), count(CAPITALS).alias("capitals"))
    # through a lambda, so that each count is made once a row however often the topic asks for it
    made = F.get(F.transform(F.array(counts), lambda m: F.struct(topic_of(m["tokens"], m["chars"], m["marks"], m["capitals"]).alias("topic"), m["tokens"].alias("tokens"))), F.lit(0))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce("source", F.lit("(none)")).alias("source"), F.coalesce("lang", F.lit("(none)")).alias("lang"), made["topic"].alias("topic"), made["tokens"].alias("tokens"),
    )


def sampled(docs: DataFrame, id_column: str = "doc_id", powers: dict = POWERS, targets: dict | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Every document: row (its own columns), source, lang, topic, tokens, prob and kept."""
    named, axes = with_cells(docs), list(powers)
    cells = materialise(named.groupBy(*axes).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    small = cells.count() <= SMALL_CELLS
    raked = rake(cells, powers, targets, rounds, small)
    raked = raked.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")))
    top = raked.agg(F.max("ratio").alias("top"))
    probs = raked.join(F.broadcast(top)).select(*axes, F.coalesce(F.col("ratio") / F.col("top"), F.lit(1.0)).alias("prob"))  # one row
    probs = materialise(probs, "mix-probs")
    joined = named.join(F.broadcast(probs) if small else probs, axes)
    return joined.withColumn("kept", uniform(F.col("row").getField(id_column)) < F.col("prob"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The sampled documents, with the input's columns."""
    return sampled(docs, **options).filter("kept").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sampled(docs).select(
        F.col("row.doc_id").alias("doc_id"), "source", "lang", "topic", F.col("tokens").alias("n_tokens"), F.round("prob", 6).alias("sample_prob"), "kept"
    )


def oracle(source: str = "documents", rounds: int = ROUNDS, powers: dict = POWERS) -> str:
    """The same rounds as chained DuckDB views; one set of ROUNDS, which is enough for the driver's tables."""
    axes = list(powers)
    steps = [
        f"""m AS (SELECT *, coalesce(source, '(none)') AS s, coalesce(lang, '(none)') AS l, coalesce(length(text), 0) AS chars,
  coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS n,
  coalesce(len(regexp_extract_all(text, '{MARKS}')), 0) AS marks, coalesce(len(regexp_extract_all(text, '{CAPITALS}')), 0) AS capitals FROM {source})""",
        """d AS (SELECT *, CASE WHEN n = 0 THEN 'none' WHEN 1000 * marks >= 20 * chars THEN 'marked' WHEN 1000 * capitals >= 22 * chars THEN 'headed'
  WHEN 1000 * capitals < 14 * chars THEN 'flowing' ELSE 'plain' END AS t FROM m)""",
        "c0 AS (SELECT s AS source, l AS lang, t AS topic, sum(n)::DOUBLE AS tokens FROM d GROUP BY 1, 2, 3)",
        "tot AS (SELECT sum(tokens) AS total FROM c0)",
    ]
    for a in axes:
        steps.append(f"t_{a} AS (SELECT {a}, pow(sum(tokens) / any_value(total), {float(powers[a])}) AS p FROM c0, tot GROUP BY {a})")
        steps.append(f"g_{a} AS (SELECT {a}, p / (SELECT sum(p) FROM t_{a}) AS target_{a} FROM t_{a})")
    steps.append("w0 AS MATERIALIZED (SELECT c0.*, total, target_source, target_lang, target_topic, tokens AS weight FROM c0 CROSS JOIN tot JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic))")
    k = 0
    for _ in range(rounds):
        for a in axes:
            steps.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(weight) OVER (PARTITION BY {a}) > 0 THEN weight * target_{a} * total / sum(weight) OVER (PARTITION BY {a}) ELSE 0 END AS weight) FROM w{k})")
            k += 1
    steps.append(f"r AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN weight / tokens END AS ratio FROM w{k})")
    steps.append("p AS (SELECT source, lang, topic, coalesce(ratio / (SELECT max(ratio) FROM r), 1.0) AS prob FROM r)")
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT doc_id, p.source, p.lang, p.topic, n AS n_tokens, round(prob, 6) AS sample_prob, "
        "('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < prob AS kept "
        "FROM d JOIN p ON d.s = p.source AND d.l = p.lang AND d.t = p.topic"
    )


ORACLE = oracle()
