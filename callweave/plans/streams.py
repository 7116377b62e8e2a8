"""Streaming queries in their batch form, over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.streaming import calls, machine

from .catalog import query


def _events(t):
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_hourly", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def stream_hourly(t):
    return calls.per_hour(_events(t))


@query("dedup_stream", "SELECT DISTINCT user_id, event_type FROM events")
def dedup_stream(t):
    return calls.distinct_events(_events(t).select("user_id", "event_type"), "user_id", "event_type")


_MOVE = "CASE " + " ".join(f"WHEN a.state = '{s}' AND e.event_type = '{k}' THEN '{n}'" for (s, k), n in calls.MOVES.items()) + " ELSE a.state END"


@query(
    "fsm",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id, event_type) AS k FROM events),
a AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 'started' AS state, 0::BIGINT AS steps FROM e
 UNION ALL SELECT a.user_id, e.k, {_MOVE} AS state, a.steps + CASE WHEN {_MOVE} <> a.state THEN 1 ELSE 0 END FROM a JOIN e ON e.user_id = a.user_id AND e.k = a.k + 1)
SELECT user_id, arg_max(state, k) AS state, arg_max(steps, k) AS steps FROM a GROUP BY 1""",
)
def fsm(t):
    return calls.final_states(t.events)


def _calls(t):
    """Events as calls: a user's events of a month, an hour as a second, opened before the first one; kinds and their fields follow type, value and props."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = (
        F.when(F.col("event_type").isin("signup", "click"), "turn").when(F.col("event_type") == "view", F.when(k % 3 == 0, "turn").otherwise("heard"))
        .when(F.col("event_type") == "purchase", F.element_at(F.array(*map(F.lit, ("yes", "no", "destination", "connected"))), k % 4 + 1)).otherwise(F.when(k % 5 == 0, "error").when(k % 5 == 1, "hangup").otherwise("unclear"))
    )
    detail = F.element_at(F.array(*map(F.lit, ("", "", "person", "followup", "escalate", "name", "", "resolved"))), k % 8 + 1)
    code = F.element_at(F.array(*map(F.lit, ("en-IN", "hi-IN", "mr-IN", "", "fr-FR"))), k % 5 + 1)
    made = t.events.filter(k.isNotNull() & F.col("ts").isNotNull()).select(
        (F.col("user_id") * 100 + F.month("ts")).alias("call_id"), "event_id", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 3600).alias("at"), kind.alias("kind"), (F.col("value") % 1).alias("conf"), code.alias("code"), detail.alias("detail"),
    )
    opened = made.groupBy("call_id").agg(F.lit(-1).cast("long").alias("event_id"), (F.min("at") - 1).alias("at"))
    return made.unionByName(opened.withColumns({"kind": F.lit("open"), "conf": F.lit(0.0), "code": F.lit(""), "detail": F.lit("")}))


@query("call_states", None)
def call_states(t):
    """The whole machine with its timers, each call at the time of the table's last event."""
    events = _calls(t)
    until = events.agg(F.max("at")).first()[0]
    return machine.final_calls(events, machine.NEVER - 1 if until is None else until)


@query("live_gauge", None)
def live_gauge(t):
    """How many calls are in each state in the middle of the table's time."""
    events = _calls(t)
    low, high = events.agg(F.min("at"), F.max("at")).first()
    return machine.gauge(machine.final_calls(events, machine.NEVER - 1 if low is None else (low + high) // 2))


@query("vad", None)
def vad(t):
    """Speech spans of a made level track per user: each event is a loud or quiet stretch of 50 frames."""
    level = F.when(F.col("event_type") == "click", -20.0).otherwise(-60.0)
    return calls.speech_spans(t.events.select(F.col("user_id").alias("stream_id"), (F.col("event_id") * 50).alias("frame"), level.alias("level"), F.lit(50).alias("count")))
