"""Full-width reports: orders are calls, conversations are turns, events are escalations and follow-ups, documents the records."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.operators import percentiles, reports

from .catalog import query
from .language import KEY_SQL

CALLS_SQL = """calls AS (SELECT o_orderkey AS call_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'abandoned' END AS status, o_orderpriority = '1-URGENT' AS escalated, o_orderstatus = 'F' AS resolved,
 CASE WHEN o_custkey % 10 = 0 THEN 0 ELSE o_totalprice / 1000 END AS duration, o_custkey % 9 AS turn_count, o_orderkey % 4 AS barge_ins, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice / 100 END AS response_ms, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_totalprice / 200 END AS first_audio_ms FROM orders)"""
TURNS_SQL = """turns AS (SELECT conv_id, turn, role, text, CASE WHEN conv_id % 6 = 5 THEN NULL ELSE 'l' || (conv_id % 3)::VARCHAR END AS language, CASE WHEN turn % 3 = 0 THEN NULL ELSE length(text)::DOUBLE END AS asr_ms, (conv_id % 50)::DOUBLE AS retrieval_ms,
 (length(text) * 3 % 700)::DOUBLE AS llm_ms, 0.0::DOUBLE AS tts_ms, length(text) / 4 AS total_ms, (length(text) % 5 * 100)::DOUBLE AS first_audio_ms, CASE WHEN conv_id % 4 = 0 THEN NULL ELSE 'p' || (conv_id % 4)::VARCHAR END AS provider,
 length(text) % 3 <> 0 AS grounded, length(text) % 11 = 0 AS fallback, (length(text) % 7 / 7)::DOUBLE AS confidence, [left(text, 3), left(text, 100)] AS warnings FROM conversations)"""
RANK_SQL = "round(coalesce(list_sort(list({v}) FILTER ({v} <> 0))[1 + round_even({p} * (count({v}) FILTER ({v} <> 0) - 1), 0)::BIGINT], 0), 1)"


def _calls(t):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    return t.orders.select(
        key.alias("call_id"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("abandoned").alias("status"), (F.col("o_orderpriority") == "1-URGENT").alias("escalated"),
        (F.col("o_orderstatus") == "F").alias("resolved"), F.when(F.col("o_custkey") % 10 == 0, 0).otherwise(price / 1000).alias("duration"), (F.col("o_custkey") % 9).alias("turn_count"), (key % 4).alias("barge_ins"),
        F.when(key % 7 != 0, price / 100).alias("response_ms"), F.when(key % 5 == 0, 0).otherwise(price / 200).alias("first_audio_ms"),
    )


def _turns(t):
    n, conv = F.length("text"), F.col("conv_id")
    return t.conversations.select(
        "conv_id", "turn", "role", "text", F.when(conv % 6 != 5, F.concat(F.lit("l"), (conv % 3).cast("string"))).alias("language"), F.when(F.col("turn") % 3 != 0, n.cast("double")).alias("asr_ms"), (conv % 50).cast("double").alias("retrieval_ms"),
        (n * 3 % 700).cast("double").alias("llm_ms"), F.lit(0.0).alias("tts_ms"), (n / 4).alias("total_ms"), (n % 5 * 100).cast("double").alias("first_audio_ms"), F.when(conv % 4 != 0, F.concat(F.lit("p"), (conv % 4).cast("string"))).alias("provider"),
        (n % 3 != 0).alias("grounded"), (n % 11 == 0).alias("fallback"), (n % 7 / 7).alias("confidence"), F.array(F.substring("text", 1, 3), F.substring("text", 1, 100)).alias("warnings"),
    )


def _escalations(t):
    return t.events.filter("event_type in ('error', 'click')").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("call_id"), (F.col("user_id") % 5).cast("string").alias("reason"), "event_type", F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("outcome"),
        F.when(F.col("user_id") % 2 == 0, "queue").otherwise("number").alias("target_type"), F.when(F.col("event_id") % 6 == 0, 0.0).otherwise(F.col("value")).alias("wait"), F.col("ts").alias("requested"),
    )


ESCALATIONS_SQL = """x AS (SELECT event_id AS id, user_id AS call_id, (user_id % 5)::VARCHAR AS reason, CASE WHEN event_id % 9 <> 0 THEN event_type END AS outcome, CASE WHEN user_id % 2 = 0 THEN 'queue' ELSE 'number' END AS target_type,
 CASE WHEN event_id % 6 = 0 THEN 0 ELSE value END AS wait, ts AS requested FROM events WHERE event_type IN ('error', 'click'))"""


@query(
    "report_overview",
    f"""WITH {CALLS_SQL},
a AS (SELECT count(*) AS calls, count(*) FILTER (resolved AND NOT escalated) AS resolved, count(*) FILTER (escalated) AS escalated, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'abandoned') AS abandoned,
 round(count(*) FILTER (resolved AND NOT escalated) / count(*), 3) AS resolution_rate, round(count(*) FILTER (escalated) / count(*), 3) AS escalation_rate, round(avg(nullif(duration, 0)), 1) AS avg_duration, round(avg(turn_count), 2) AS avg_turns, sum(barge_ins)::BIGINT AS barge_ins,
 round(avg(response_ms), 1) AS avg_response, round(avg(nullif(first_audio_ms, 0)), 1) AS avg_first_audio, {RANK_SQL.format(v="response_ms", p=0.95)} AS p95_response, {RANK_SQL.format(v="first_audio_ms", p=0.95)} AS p95_first_audio FROM calls),
b AS (SELECT sum(k)::BIGINT AS unanswered FROM (SELECT count(*) AS k FROM events WHERE event_type = 'error' GROUP BY user_id)),
r AS (SELECT count(*) AS kb_records, count(*) FILTER (q = 1) AS kb_verified, round(count(*) FILTER (q = 1) / count(*), 3) AS verification_rate FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) USING (doc_id))
SELECT * FROM a, b, r""",
)
def report_overview(t):
    verified = t.labels.groupBy("doc_id").agg((F.max("quality") == 1).alias("verified"))
    backlog = t.events.filter("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("occurrences"))
    return reports.overview(_calls(t), backlog, t.documents.join(verified, "doc_id", "left"))


_STAGE = "SELECT '{s}' AS stage, coalesce({s}_ms, 0) AS v FROM turns WHERE role = 'assistant'"


@query(
    "report_latency",
    f"WITH {TURNS_SQL}, s AS ({' UNION ALL '.join(_STAGE.format(s=s) for s in reports.STAGES)} UNION ALL SELECT 'first_audio', first_audio_ms FROM turns WHERE role = 'assistant' AND first_audio_ms <> 0) "
    "SELECT stage, count(*) AS turns, round(avg(v), 1) AS avg, round(list_sort(list(v))[1 + round_even(0.5 * (count(*) - 1), 0)::BIGINT], 1) AS p50, round(list_sort(list(v))[1 + round_even(0.95 * (count(*) - 1), 0)::BIGINT], 1) AS p95, round(max(v), 1) AS max FROM s GROUP BY 1",
)
def report_latency(t):
    return reports.latency(_turns(t))


@query("report_providers", f"WITH {TURNS_SQL} SELECT 'provider' AS measure, coalesce(provider, 'unknown') AS key, count(*) AS n FROM turns WHERE role = 'assistant' GROUP BY 2")
def report_providers(t):
    return reports.providers(_turns(t))


@query(
    "report_top_queries",
    f"""WITH {TURNS_SQL}, k AS (SELECT *, {KEY_SQL.format(c='text')} AS key FROM turns WHERE role = 'user' AND length(trim(text)) >= 4),
e AS (SELECT key, left(text, 160) AS example, count(*) AS c, min((conv_id, turn, text)) AS first FROM k GROUP BY 1, 2),
n AS (SELECT key, sum(c)::BIGINT AS count, list(example ORDER BY first)[1:3] AS examples FROM e GROUP BY 1),
l AS (SELECT key, string_agg(language || ':' || n::VARCHAR, ',' ORDER BY language || ':' || n::VARCHAR) AS languages FROM (SELECT key, coalesce(language, 'unknown') AS language, count(*) AS n FROM k GROUP BY 1, 2) GROUP BY 1)
SELECT key, count, array_to_string(examples, '|') AS examples, languages, (SELECT count(*) FROM n) AS "distinct", (SELECT sum(count)::BIGINT FROM n) AS total FROM n JOIN l USING (key) ORDER BY count DESC, key LIMIT 25""",
)
def report_top_queries(t):
    return reports.top_queries(_turns(t), ["conv_id", "turn"]).withColumn("examples", F.array_join("examples", "|"))


@query("report_escalations", f"WITH {ESCALATIONS_SQL} SELECT count(*) AS total, round(avg(nullif(wait, 0)), 1) AS avg_wait, {RANK_SQL.format(v='wait', p=0.95)} AS p95_wait FROM x")
def report_escalations(t):
    return reports.escalations(_escalations(t))


@query(
    "report_escalation_counts",
    f"WITH {ESCALATIONS_SQL}, h AS (SELECT 'reason' AS measure, reason AS key FROM x UNION ALL SELECT 'outcome', outcome FROM x UNION ALL SELECT 'target_type', target_type FROM x UNION ALL SELECT 'followup_status', o_orderstatus FROM orders UNION ALL SELECT 'followup_channel', o_orderpriority FROM orders) "
    "SELECT measure, coalesce(key, 'unknown') AS key, count(*) AS n FROM h GROUP BY 1, 2",
)
def report_escalation_counts(t):
    return reports.escalation_counts(_escalations(t), t.orders.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("channel")))


@query("report_recent_escalations", f"WITH {ESCALATIONS_SQL} SELECT id, call_id, reason, outcome, target_type, wait FROM x ORDER BY requested DESC NULLS FIRST, id LIMIT 20")
def report_recent_escalations(t):
    return reports.recent_escalations(_escalations(t)).select("id", "call_id", "reason", "outcome", "target_type", "wait")


@query(
    "report_quality",
    f"WITH {TURNS_SQL}, {CALLS_SQL}, b AS (SELECT count(*) FILTER (barge_ins > 0) AS calls_with_barge_in, sum(barge_ins)::BIGINT AS barge_in_total FROM calls) "
    "SELECT count(*) AS assistant_turns, count(*) FILTER (grounded) AS grounded, round(count(*) FILTER (grounded) / count(*), 3) AS grounded_rate, count(*) FILTER (fallback) AS fallback, round(count(*) FILTER (fallback) / count(*), 3) AS fallback_rate, "
    "round(avg(nullif(confidence, 0)), 3) AS avg_confidence, any_value(calls_with_barge_in) AS calls_with_barge_in, any_value(barge_in_total) AS barge_in_total FROM turns, b WHERE role = 'assistant'",
)
def report_quality(t):
    return reports.quality(_turns(t), _calls(t))


@query("report_warnings", f"WITH {TURNS_SQL} SELECT left(w, 80) AS warning, count(*) AS n FROM (SELECT unnest(warnings) AS w FROM turns WHERE role = 'assistant') GROUP BY 1 ORDER BY n DESC, warning LIMIT 15")
def report_warnings(t):
    return reports.warnings(_turns(t))


@query("latency_sketch", "SELECT event_type, count(*) AS n, max(value) AS most, true AS p50_near, true AS p95_near, true AS p99_near FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_sketch(t):
    """Sketches by day and type, merged over the days; each quantile's exact rank is within one in a hundred of what was asked."""
    ps = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    daily = percentiles.rollup(t.events.withColumn("day", F.to_date("ts")), ["day", "event_type"], "value")
    by = percentiles.quantiles(percentiles.merged(daily, ["event_type"]), ps).drop("sketch")
    known = t.events.filter("value is not null").join(by, "event_type")
    near = [(F.abs(F.avg((F.col("value") <= F.col(n)).cast("int")) - p) <= 0.01).alias(f"{n}_near") for n, p in ps.items()]
    return known.groupBy("event_type", "n", "most").agg(*near)


@query(
    "exact_percentiles",
    "SELECT l_returnflag, " + ", ".join(f"list_sort(list(l_extendedprice))[1 + round_even({p} * (count(*) - 1), 0)::BIGINT] AS {n}" for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))) + " FROM lineitem GROUP BY 1",
)
def exact_percentiles(t):
    """Nearest-rank percentiles: sketches bracket them, only values inside a bracket are put in order."""
    return percentiles.nearest_rank(t.lineitem, ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
