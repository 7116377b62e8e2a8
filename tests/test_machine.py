"""The call machine: every move, its timers, and the stream against the batch with late and repeated events."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from callweave.streaming import machine
from callweave.streaming.machine import Call, Event, follow

OPEN = ("open",)
READY = [OPEN, ("heard", 0.9, "mr-IN")]


def played(*events, until=None, gap=1000):
    """Events a second apart (or at a given time as the last field) -> the call."""
    made, at = [], 0
    for i, e in enumerate(events):
        kind, conf, code, detail, when = (*e, *(None,) * (5 - len(e)))
        at = when if when is not None else at + gap
        made.append(Event(i, at, kind, conf or 0.0, code or "", detail or ""))
    return follow(Call(), made, at if until is None else until)


@pytest.mark.parametrize(
    ("events", "state", "language", "reason"),
    [
        ([OPEN], "language_prompt", "", ""),
        ([OPEN, ("heard", 0.82, "hi-IN")], "conversation", "hi-IN", ""),
        ([OPEN, ("heard", 0.1, "hi-IN", "explicit")], "conversation", "hi-IN", ""),
        ([OPEN, ("heard", 0.0, "mr-IN", "dtmf")], "conversation", "mr-IN", ""),
        ([OPEN, ("heard", 0.7, "hi-IN")], "language_confirm", "", ""),
        ([OPEN, ("heard", 0.7, "hi-IN"), ("yes",)], "conversation", "hi-IN", ""),
        ([OPEN, ("heard", 0.7, "hi-IN"), ("no",)], "language_reprompt", "", ""),
        ([OPEN, ("heard", 0.7, "hi-IN"), ("unclear",)], "language_reprompt", "", ""),
        ([OPEN, ("heard", 0.7, "hi-IN"), ("heard", 0.9, "mr-IN")], "conversation", "mr-IN", ""),
        ([OPEN, ("heard", 0.3, "hi-IN")], "language_reprompt", "", ""),
        ([OPEN, *[("heard", 0.3, "hi-IN")] * 5], "language_reprompt", "", ""),
        ([OPEN, ("heard", 0.9, "fr-FR")], "conversation", "hi-IN", ""),
        ([*READY, ("turn", 0.9, "hi-IN", "name")], "conversation", "hi-IN", ""),
        ([*READY, ("turn", 0.8, "hi-IN")], "conversation", "mr-IN", ""),
        ([*READY, ("turn", 0.8, "hi-IN"), ("turn", 0.8, "hi-IN")], "conversation", "hi-IN", ""),
        ([*READY, ("turn", 0.8, "hi-IN"), ("turn", 0.5, "hi-IN"), ("turn", 0.8, "hi-IN")], "conversation", "mr-IN", ""),
        ([*READY, ("turn", 0, "", "person")], "escalating", "mr-IN", "caller_request"),
        ([*READY, ("turn", 0, "", "person"), ("connected",)], "transferred", "mr-IN", "caller_request"),
        ([*READY, ("turn", 0, "", "followup")], "followup_offer", "mr-IN", ""),
        ([*READY, ("turn", 0, "", "escalate")], "escalating", "mr-IN", "low_confidence"),
        ([*READY, ("turn", 0, "", "followup"), ("no",)], "conversation", "mr-IN", ""),
        ([*READY, ("turn", 0, "", "followup"), ("yes",)], "followup_destination", "mr-IN", ""),
        ([*READY, ("turn", 0, "", "followup"), ("yes",), ("destination",)], "followup_destination", "mr-IN", ""),
        ([*READY, ("turn", 0, "", "followup"), ("yes",), ("destination", 0, "", "+91")], "conversation", "mr-IN", ""),
        ([*READY, ("hangup", 0, "", "resolved")], "ended", "mr-IN", "completed"),
        ([*READY, ("hangup",), ("turn", 0, "", "person")], "ended", "mr-IN", "abandoned"),
        ([*READY, ("error",)], "failed", "mr-IN", "error"),
        ([*READY, ("error", 0, "", "turn")], "escalating", "mr-IN", "error"),
    ],
)
def test_moves(events, state, language, reason):
    call = played(*events)
    assert (call.state, call.language, call.reason) == (state, language, reason)


def test_silence_reprompts_then_speaks_the_default_language():
    assert [played(OPEN, until=1000 + t).state for t in (6999, 7000, 14_000, 20_999, 21_000)] == ["language_prompt", "language_reprompt", "language_reprompt", "language_reprompt", "conversation"]
    assert played(OPEN, until=22_000).language == "en-IN"


def test_third_silence_ends_or_escalates_a_talk():
    assert played(*READY, until=2000 + 20_999).state == "conversation"
    quiet = played(*READY, until=2000 + 21_000)
    assert (quiet.state, quiet.reason) == ("escalating", "silence_timeout")
    spoke = played(*READY, ("turn",), until=3000 + 21_000)
    assert (spoke.state, spoke.reason) == ("ended", "silence_timeout")
    again = played(*READY, ("turn",), ("turn", 0, "", "", 3000 + 20_000), until=3000 + 40_000)
    assert again.state == "conversation" and again.silences == 2


def test_longest_call_and_pending_transfer():
    talk = [*READY, *[("turn", 0, "", "", 2000 + k * 6000) for k in range(1, 160)]]
    long = played(*talk)
    assert (long.state, long.reason, long.changed) == ("ended", "max_duration", 1000 + 15 * 60_000)
    choosing = [OPEN, *[("yes", 0, "", "", 1000 + k * 6000) for k in range(1, 160)]]
    assert (played(*choosing).state, played(*choosing).reason) == ("escalating", "max_duration")
    wait = [*READY, ("turn", 0, "", "person")]
    assert played(*wait, until=3000 + 599_999).state == "escalating"
    assert played(*wait, until=3000 + 600_000).reason == "transfer_expired"


def made_events(calls=12, seed=1):
    rng, out, n = random.Random(seed), [], 0
    kinds = ["heard", "turn", "turn", "turn", "yes", "no", "unclear", "destination", "error", "connected", "hangup"]
    for call in range(calls):
        at = rng.randrange(60_000)
        for k in range(rng.randrange(1, 25)):
            kind = "open" if k == 0 else rng.choice(kinds[: 8 if k < 12 else 11])
            detail = rng.choice(["", "", "person", "followup", "escalate", "name", "turn", "resolved"]) if kind in ("turn", "error", "hangup", "destination") else ""
            out.append((call, n, at, kind, rng.random(), rng.choice(["", "hi-IN", "mr-IN", "en-IN", "fr-FR"]), detail))
            n, at = n + 1, at + rng.choice([500, 2000, 5000, 6999, 9000, 30_000])
    return out


def test_batch_equals_a_plain_fold(spark):
    rows = made_events(40)
    for until in (100_000, machine.NEVER - 1):
        want = {}
        for call in {r[0] for r in rows}:
            events = sorted((Event(*r[1:]) for r in rows if r[0] == call and r[2] <= until), key=lambda e: (e.at, e.event_id))
            if events:
                want[call] = machine._shown(call, follow(Call(), events, until))
        frame = spark.createDataFrame(rows + rows[:30] + [(None, 1, 1, "open", None, None, None), (7, 1, None, None, None, None, None)], machine.EVENT)
        assert {r.call_id: tuple(r) for r in machine.final_calls(frame.repartition(5), until).collect()} == want
    assert machine.final_calls(spark.createDataFrame([], machine.EVENT)).count() == 0
    live = machine.final_calls(frame, 100_000)
    assert sum(r.calls for r in machine.gauge(live).collect()) == live.filter("state not in ('ended', 'failed', 'transferred')").count()


def test_stream_equals_batch(spark, tmp_path):
    """Shuffled within half a minute, with repeats over batches; a last event far ahead lets every timer fire and empties the state."""
    rng, rows = random.Random(3), made_events(8)
    rows.sort(key=lambda r: r[2] + rng.randrange(30_000))
    rows += [(999, 10**6, 10**8, "open", 0.0, "", ""), (999, 10**6 + 1, 2 * 10**8, "hangup", 0.0, "", "")]
    folder, done = str(tmp_path / "in"), str(tmp_path / "out")
    cuts = [rows[a : a + 40] + rows[max(0, a - 10) : a] for a in range(0, len(rows) - 2, 40)] + [rows[-2:-1], rows[-1:], rows[-1:]]
    schema = machine.EVENT + ", ts timestamp"
    for i, part in enumerate(cuts):
        stamped = [(*r, datetime.fromtimestamp(r[2] / 1000, timezone.utc)) for r in part]
        spark.createDataFrame(stamped, schema).coalesce(1).write.parquet(f"{folder}/{i:03d}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
        seen = []
        query = machine.live_calls(live, "1 minute").writeStream.outputMode("update").option("checkpointLocation", done).foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
        left = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = {}
    for row in seen:
        if row[0] not in last or row[6] >= last[row[0]][6]:
            last[row[0]] = row
    want = {r.call_id: tuple(r) for r in machine.final_calls(spark.createDataFrame(rows, machine.EVENT)).collect() if r.call_id != 999}
    last.pop(999, None)
    moved = {k: v for k, v in want.items()}
    assert {k: v[:4] + v[6:] for k, v in last.items()} == {k: v[:4] + v[6:] for k, v in moved.items()}
    assert left[-1] < max(left) / 4
