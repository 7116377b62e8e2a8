"""The call state machine with its timers: silence, longest duration, pending transfers.

`Call` is the state of one call. `follow` takes events in order of time and fires, before each of them, the timers that
are due; both forms use it. The batch form streams a call's events, sorted in the shuffle, through one `Call`, so a call
of any length needs its state only. The streaming form is a `transformWithState` processor: events wait in a list state
until the watermark passes them, so late ones within the watermark take their place in time, a map state of event ids
drops repeats, event-time timers wake the call for events and timeouts, and a call that ended is cleared.

Times are milliseconds. An event has kind, conf, code and detail:

| kind | meaning of the fields |
|---|---|
| open | the line is open |
| heard | a language choice: code, conf, detail `explicit` or `dtmf` where it is certain |
| yes, no, unclear | answers to a question of the machine |
| turn | a caller's turn: code and conf of its language; detail `person`, `followup`, `escalate`, `name` (a bare language name: code) or nothing |
| destination | where to send details: detail is what was parsed, empty if nothing |
| connected | the transfer was answered |
| hangup | detail `resolved` or nothing |
| error | detail `turn` for an error while answering |
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Seconds of the timers, and the confidences of a language choice.
SILENCE_MS, LONGEST_MS, TRANSFER_MS, FORGET_MS = 7_000, 15 * 60_000, 600_000, 600_000
SURE, MAYBE, SWITCH = 0.82, 0.62, 0.75
REPROMPTS, ATTEMPTS, STREAK = 2, 2, 2
CHOOSING = {"language_prompt", "language_reprompt", "language_confirm", "language_unsupported"}
TALKING = {"menu", "conversation", "followup_offer", "followup_destination"}
OVER = {"ended", "failed", "transferred"}
DEFAULT, FALLBACK = "en-IN", "hi-IN"
SUPPORTED = frozenset({"en-IN", "hi-IN", "mr-IN"})
EVENT = "call_id long, event_id long, at long, kind string, conf double, code string, detail string"
NEVER = 1 << 62


@dataclass
class Call:
    state: str = "started"
    language: str = ""
    candidate: str = ""
    attempts: int = 0
    silences: int = 0
    turns: int = 0
    streak: int = 0
    moves: int = 0
    reason: str = ""
    opened: int = -1
    active: int = -1
    waiting: int = -1  # since when a transfer is pending
    changed: int = -1

    def to(self, state: str, at: int, reason: str = "") -> None:
        if state != self.state:
            self.state, self.moves, self.changed = state, self.moves + 1, at
        self.reason = reason or self.reason

    def adopt(self, code: str, at: int) -> None:
        self.language, self.candidate, self.streak = code, "", 0
        self.to("menu", at)
        self.to("conversation", at)

    def escalate(self, at: int, reason: str) -> None:
        self.waiting = at
        self.to("escalating", at, reason)

    def reprompt(self, at: int) -> None:
        """Two attempts by voice; from the third on the keypad is offered and the state stays."""
        self.attempts, self.candidate = self.attempts + 1, ""
        self.to("language_reprompt", at)

    def choose(self, e) -> None:
        if e.code and e.code not in SUPPORTED:
            self.to("language_unsupported", e.at)
            self.adopt(FALLBACK, e.at)
        elif e.detail in ("explicit", "dtmf") or (e.code and e.conf >= SURE):
            self.adopt(e.code or DEFAULT, e.at)
        elif e.code and e.conf >= MAYBE:
            self.candidate = e.code
            self.to("language_confirm", e.at)
        else:
            self.reprompt(e.at)

    def answer(self, e) -> None:
        """A caller's turn in conversation; a language name, another language twice, a person, a follow-up, in this order."""
        self.turns += 1
        if e.detail == "name":
            self.choose(e)
            return
        other = bool(e.code) and e.code != self.language and e.code in SUPPORTED and e.conf >= SWITCH
        self.streak = self.streak + 1 if other else 0
        if self.streak >= STREAK:
            self.adopt(e.code, e.at)
        if e.detail == "person":
            self.escalate(e.at, "caller_request")
        elif e.detail == "followup":
            self.to("followup_offer", e.at)
        elif e.detail == "escalate":
            self.escalate(e.at, "low_confidence")

    def take(self, e) -> None:
        if self.state in OVER:
            return
        self.active, self.silences = e.at, 0
        if e.kind == "open" and self.state == "started":
            self.opened = e.at
            self.to("greeting", e.at)
            self.to("language_prompt", e.at)
        elif e.kind == "hangup":
            self.to("ended", e.at, "completed" if e.detail == "resolved" else "abandoned")
        elif e.kind == "error":
            self.escalate(e.at, "error") if e.detail == "turn" else self.to("failed", e.at, "error")
        elif e.kind == "connected" and self.state == "escalating":
            self.to("transferred", e.at)
        elif self.state in CHOOSING:
            confirming = self.state == "language_confirm"
            if e.kind == "heard":
                self.choose(e)
            elif confirming and e.kind == "yes":
                self.adopt(self.candidate, e.at)
            elif confirming and e.kind in ("no", "unclear"):
                self.reprompt(e.at)
        elif self.state == "followup_offer" and e.kind in ("yes", "no"):
            self.to("followup_destination" if e.kind == "yes" else "conversation", e.at)
        elif self.state == "followup_destination" and e.kind == "destination":
            if e.detail:
                self.to("conversation", e.at)
        elif self.state in TALKING and e.kind == "turn":
            self.answer(e)

    def due(self) -> tuple[int, str]:
        """The next timer and what it is; of equal times the longest duration, then the transfer, then silence."""
        if self.state in OVER or self.active < 0:
            return NEVER, ""
        timers = [(self.opened + LONGEST_MS, "a longest")] if self.opened >= 0 and self.state != "escalating" else []
        if self.state == "escalating":
            timers.append((self.waiting + TRANSFER_MS, "b transfer"))
        elif self.state != "started":
            timers.append((self.active + SILENCE_MS, "c silence"))
        return min(timers, default=(NEVER, ""))

    def fire(self, at: int, which: str) -> None:
        if which == "a longest":
            self.to("ended", at, "max_duration") if self.state in TALKING else self.escalate(at, "max_duration")
        elif which == "b transfer":
            self.to("ended", at, "transfer_expired")
        else:
            self.active, self.silences = at, self.silences + 1
            if self.state in CHOOSING:
                self.adopt(DEFAULT, at) if self.silences > REPROMPTS else self.reprompt(at)
            elif self.silences > REPROMPTS:
                self.to("ended", at, "silence_timeout") if self.turns else self.escalate(at, "silence_timeout")


def follow(call: Call, events: Iterable, until: int) -> Call:
    """Events in order of time, each after the timers that are due by then; at last the timers due by `until`."""
    for e in events:
        _timers(call, e.at)
        call.take(e)
    _timers(call, until)
    return call


def _timers(call: Call, until: int) -> None:
    while (timer := call.due())[0] <= until:
        call.fire(*timer)


@dataclass
class Event:
    event_id: int
    at: int
    kind: str
    conf: float
    code: str
    detail: str


SHOWN = ["state", "language", "attempts", "turns", "silences", "moves", "reason", "changed"]
ROW = "call_id long, state string, language string, attempts long, turns long, silences long, moves long, reason string, changed long"


def _shown(call_id: int, call: Call) -> tuple:
    return call_id, *(getattr(call, c) for c in SHOWN)


def final_calls(events: DataFrame, until: int = NEVER - 1) -> DataFrame:
    """Batch form: the state of each call at the time `until`. Repeated event ids of a call count once, ties in time go by event id.

    Null fields are empty or 0; rows without a call or a time are left out."""
    sure = events.filter(F.col("call_id").isNotNull() & F.col("at").isNotNull()).na.fill({"event_id": 0, "conf": 0.0, "kind": "", "code": "", "detail": ""})
    once = sure.filter(F.col("at") <= until).select(*[c.split()[0] for c in EVENT.split(", ")]).dropDuplicates(["call_id", "event_id"])
    dealt = once.repartition("call_id").sortWithinPartitions("call_id", "at", "event_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, call, done = None, None, []
        for batch in batches:
            for call_id, *event in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # in the order of EVENT
                if call is None or call_id != now:
                    if call is not None:
                        done.append(_shown(now, follow(call, (), until)))
                    now, call = call_id, Call()
                e = Event(*event)
                follow(call, (e,), e.at)
            yield _batch(done)
            done = []
        yield _batch([_shown(now, follow(call, (), until))] if call is not None else [])

    return dealt.mapInArrow(work, ROW)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in ROW.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["call_id", *SHOWN])


def live_calls(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """Streaming form: a row of a call whenever its state moved. `events` is a stream with `ts` beside the fields of EVENT.

    Rows older than the watermark are dropped by it; a call is cleared FORGET_MS after it ended."""
    from pyspark.sql.streaming import StatefulProcessor

    class Machine(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            fields = "state string, language string, candidate string, attempts long, silences long, turns long, streak long, moves long, reason string, opened long, active long, waiting long, changed long"
            self.call = handle.getValueState("call", fields)
            self.pending = handle.getListState("pending", "event_id long, at long, kind string, conf double, code string, detail string")
            self.seen = handle.getMapState("seen", "event_id long", "at long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            for part in rows:
                for e in part[["event_id", "at", "kind", "conf", "code", "detail"]].itertuples(index=False):
                    if not self.seen.containsKey((e.event_id,)):
                        self.seen.updateValue((e.event_id,), (e.at,))
                        self.pending.appendValue((int(e.event_id), int(e.at), e.kind or "", float(e.conf or 0.0), e.code or "", e.detail or ""))
                        self.handle.registerTimer(int(e.at))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            until = timerValues.getCurrentWatermarkInMs()  # nothing older comes any more, so all timers up to here are settled at once
            call = Call(*self.call.get()) if self.call.exists() else Call()
            held = sorted((Event(*e) for e in self.pending.get()), key=lambda e: (e.at, e.event_id))
            ready, later = [e for e in held if e.at <= until], [e for e in held if e.at > until]
            if call.state in OVER and not held and until >= call.changed + FORGET_MS:
                self.call.clear(), self.pending.clear(), self.seen.clear()
                return iter(())
            before = call.moves
            follow(call, ready, until)
            if ready:
                self.pending.clear()
                if later:
                    self.pending.put([tuple(asdict(e).values()) for e in later])
            self.call.update(tuple(asdict(call).values()))
            wake = call.changed + FORGET_MS if call.state in OVER else call.due()[0]
            if until < wake < NEVER:
                self.handle.registerTimer(wake)
            return iter([pd.DataFrame([_shown(key[0], call)], columns=["call_id", *SHOWN])] if call.moves > before else [])

        def close(self) -> None:
            pass

    kept = events.filter(F.col("call_id").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    return kept.groupBy("call_id").transformWithStateInPandas(Machine(), ROW, "update", "EventTime")


def gauge(calls: DataFrame) -> DataFrame:
    """How many calls are in each state; ended ones are not live."""
    return calls.filter(~F.col("state").isin(*OVER)).groupBy("state").agg(F.count(F.lit(1)).alias("calls"))
