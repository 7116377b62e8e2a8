"""Call reports at full width. Tables are the caller's, by these columns:

calls: call_id, started, status, escalated, resolved, duration, turn_count, barge_ins, response_ms, first_audio_ms
turns: call_id, role, text, language, asr_ms, retrieval_ms, llm_ms, tts_ms, total_ms, first_audio_ms, provider, grounded, fallback, confidence, warnings
escalations: id, call_id, reason, outcome, target_type, wait, requested
followups: status, channel

Reports of one row are a map side aggregate and one small shuffle; counts by value come as rows (measure, key, n).
Averages of nothing and percentiles of nothing are 0. Nulls count as missing: they are in no average, and as
`unknown` among values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.text import canonical_key

from .percentiles import nearest_rank

UNKNOWN = "unknown"


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 3)).otherwise(0.0)


def mean(value: str, places: int = 1, zeros: bool = False) -> Column:
    """Average over values that are set and, unless `zeros`, not 0."""
    return F.round(F.coalesce(F.avg(F.col(value) if zeros else F.nullif(F.col(value), F.lit(0))), F.lit(0.0)), places)


def _p(rows: DataFrame, value: str, ps: dict[str, float]) -> DataFrame:
    """One row of percentiles, zeros and missing values left out."""
    found = nearest_rank(rows.filter(F.col(value) != 0), [], value, ps)
    return found.select(*[F.round(F.coalesce(F.max(n), F.lit(0.0)), 1).alias(n) for n in ps])


def overview(calls: DataFrame, backlog: DataFrame, records: DataFrame) -> DataFrame:
    """One row. backlog: occurrences; records: verified."""
    n, yes = F.count(F.lit(1)), lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    escalated, resolved = F.coalesce(F.col("escalated"), F.lit(False)), F.coalesce(F.col("resolved"), F.lit(False))
    one = calls.agg(
        n.alias("calls"), yes(resolved & ~escalated).alias("resolved"), yes(escalated).alias("escalated"), yes(F.col("status") == "failed").alias("failed"), yes(F.col("status") == "abandoned").alias("abandoned"),
        rate(yes(resolved & ~escalated), n).alias("resolution_rate"), rate(yes(escalated), n).alias("escalation_rate"), mean("duration").alias("avg_duration"),
        F.round(F.coalesce(F.avg(F.coalesce("turn_count", F.lit(0))), F.lit(0.0)), 2).alias("avg_turns"), F.coalesce(F.sum("barge_ins"), F.lit(0)).cast("long").alias("barge_ins"),
        mean("response_ms").alias("avg_response"), mean("first_audio_ms").alias("avg_first_audio"),
    )
    asked = backlog.agg(F.coalesce(F.sum("occurrences"), F.lit(0)).cast("long").alias("unanswered"))
    kb = records.agg(n.alias("kb_records"), yes(F.col("verified")).alias("kb_verified"), rate(yes(F.col("verified")), n).alias("verification_rate"))
    parts = [asked, kb, _p(calls, "response_ms", {"p95_response": 0.95}), _p(calls, "first_audio_ms", {"p95_first_audio": 0.95})]
    for part in parts:  # one row each
        one = one.join(F.broadcast(part))
    return one


STAGES = ["asr", "retrieval", "llm", "tts", "total"]


def latency(turns: DataFrame) -> DataFrame:
    """A row a stage: turns, avg, p50, p95, max. Missing times count as 0, but first_audio leaves zeros out."""
    own = turns.filter("role = 'assistant'")
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), F.coalesce(F.col(f"{s}_ms"), F.lit(0.0)).cast("double").alias("v")) for s in STAGES], F.struct(F.lit("first_audio").alias("stage"), F.nullif(F.col("first_audio_ms").cast("double"), F.lit(0.0)).alias("v")))
    long = own.select(F.explode(stages).alias("s")).select("s.*").filter("v is not null")
    sums = long.groupBy("stage").agg(F.count(F.lit(1)).alias("turns"), F.round(F.avg("v"), 1).alias("avg"), F.round(F.max("v"), 1).alias("max"))
    ranks = nearest_rank(long, ["stage"], "v", {"p50": 0.5, "p95": 0.95})
    return sums.join(ranks, "stage").select("stage", "turns", "avg", F.round("p50", 1).alias("p50"), F.round("p95", 1).alias("p95"), "max")


def histogram(rows: DataFrame, **columns: str) -> DataFrame:
    """measure, key, n: counts of each named column by value, from one pass."""
    values = F.array(*[F.struct(F.lit(m).alias("measure"), F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias("key")) for m, c in columns.items()])
    return rows.select(F.explode(values).alias("v")).groupBy("v.measure", "v.key").agg(F.count(F.lit(1)).alias("n"))


def providers(turns: DataFrame) -> DataFrame:
    return histogram(turns.filter("role = 'assistant'"), provider="provider")


def top_queries(turns: DataFrame, order: list[str], limit: int = 25, role: str = "user") -> DataFrame:
    """Questions by canonical key: count, at most three distinct examples in `order`, languages as a map, and the numbers of keys and of questions.

    Examples are found among distinct texts of a key by their first place, so a hot key is not gathered."""
    from pyspark.sql import Window

    asked = turns.filter((F.col("role") == role) & (F.length(F.trim("text")) >= 4)).withColumn("key", canonical_key(F.col("text")))
    texts = asked.groupBy("key", F.substring("text", 1, 160).alias("example")).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*order, "text")).alias("first"))
    counts = texts.groupBy("key").agg(F.sum("c").alias("count"))
    totals = counts.agg(F.count(F.lit(1)).alias("distinct"), F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
    best = counts.orderBy(F.col("count").desc(), "key").limit(limit)  # `limit` rows
    three = texts.join(F.broadcast(best.select("key")), "key").withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("first"))).filter("i <= 3")
    examples = three.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "example"))), lambda x: x["example"]).alias("examples"))
    spoken = asked.join(F.broadcast(best.select("key")), "key").groupBy("key", F.coalesce("language", F.lit(UNKNOWN)).alias("language")).agg(F.count(F.lit(1)).alias("n"))
    languages = spoken.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "language", F.col("n").cast("string")))), ",").alias("languages"))
    return best.join(examples, "key").join(languages, "key").join(F.broadcast(totals))


def escalations(events: DataFrame) -> DataFrame:
    """One row: total, avg and p95 of the waits that are not 0."""
    return events.agg(F.count(F.lit(1)).alias("total"), mean("wait").alias("avg_wait")).join(F.broadcast(_p(events, "wait", {"p95_wait": 0.95})))


def escalation_counts(events: DataFrame, followups: DataFrame) -> DataFrame:
    by = histogram(events, reason="reason", outcome="outcome", target_type="target_type")
    return by.unionByName(histogram(followups, followup_status="status", followup_channel="channel"))


def recent_escalations(events: DataFrame, n: int = 20) -> DataFrame:
    return events.orderBy(F.col("requested").desc_nulls_first(), "id").limit(n)


def quality(turns: DataFrame, calls: DataFrame) -> DataFrame:
    """One row of rates over assistant turns, and the calls with interruptions."""
    n, yes = F.count(F.lit(1)), lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    one = turns.filter("role = 'assistant'").agg(
        n.alias("assistant_turns"), yes("grounded").alias("grounded"), rate(yes("grounded"), n).alias("grounded_rate"), yes("fallback").alias("fallback"), rate(yes("fallback"), n).alias("fallback_rate"), mean("confidence", 3).alias("avg_confidence"),
    )
    barge = calls.agg(F.count_if(F.col("barge_ins") > 0).alias("calls_with_barge_in"), F.coalesce(F.sum("barge_ins"), F.lit(0)).cast("long").alias("barge_in_total"))
    return one.join(F.broadcast(barge))


def warnings(turns: DataFrame, limit: int = 15) -> DataFrame:
    said = turns.filter("role = 'assistant'").select(F.explode("warnings").alias("w")).select(F.substring("w", 1, 80).alias("warning"))
    return said.groupBy("warning").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "warning").limit(limit)
