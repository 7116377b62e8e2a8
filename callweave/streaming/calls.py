"""Streams of events: windowed counts, backlog upserts, de-duplication, the call state machine, voice activity.

Each streaming form has a batch twin over the same rows, and tests hold one against the other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def per_hour(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts per hour and type; on a stream, rows later than `late` behind the newest are dropped."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    counts = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n")


def distinct_events(events: DataFrame, *keys: str, late: str = "10 minutes") -> DataFrame:
    """One row of each key; a stream remembers a key as long as `late`."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    by = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return by.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


#: (state, event) -> state. Other pairs leave the state as it is; ended states stay.
MOVES = {
    ("started", "signup"): "greeting",
    ("greeting", "view"): "conversation",
    ("started", "view"): "conversation",
    ("conversation", "click"): "followup_offer",
    ("followup_offer", "view"): "conversation",
    ("followup_offer", "purchase"): "completed",
    ("conversation", "purchase"): "completed",
    ("conversation", "error"): "escalating",
    ("escalating", "view"): "transferred",
    ("greeting", "error"): "failed",
}
ENDED = {"completed", "transferred", "failed"}
STATE = "user_id long, state string, steps long"


def walk(state: str, events: list[str]) -> tuple[str, int]:
    steps = 0
    for e in events:
        nxt = state if state in ENDED else MOVES.get((state, e), state)
        steps += nxt != state
        state = nxt
    return state, steps


STATES = sorted({s for (a, _), b in MOVES.items() for s in (a, b)})
KINDS = sorted({kind for _, kind in MOVES})
NEXT = [STATES.index(s if s in ENDED else MOVES.get((s, kind), s)) for s in STATES for kind in KINDS]
SPAN = 100_000  # width of a range of event ids; a call has at most so many events in one


def final_states(events: DataFrame, span: int = SPAN) -> DataFrame:
    """Batch twin: fold each call's events in order of event_id, then kind; events of no known kind change nothing.

    A call's events are folded by ranges of ids, for every state it may be in at the start of a range, and the
    few results are joined in order: a call that holds a third of all events is spread over as many tasks.
    """
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")).cast("int") - 1
    seen = F.collect_list(F.when(kind >= 0, F.struct("event_id", kind.alias("kind"))))
    parts = events.groupBy("user_id", F.floor(F.col("event_id") / span).alias("part")).agg(F.array_sort(seen).alias("seen"))
    table, start = F.array(*map(F.lit, NEXT)), lambda s: F.struct(s.alias("state"), F.lit(0).cast("long").alias("steps"))

    def step(acc, event):
        new = F.get(table, acc["state"] * len(KINDS) + event["kind"])
        return F.struct(new.alias("state"), (acc["steps"] + (new != acc["state"]).cast("long")).alias("steps"))

    fold = [start(F.lit(i)) if s in ENDED else F.aggregate("seen", start(F.lit(i)), step) for i, s in enumerate(STATES)]
    by_call = parts.select("user_id", F.struct("part", F.array(*fold).alias("ends")).alias("p")).groupBy("user_id").agg(F.array_sort(F.collect_list("p")).alias("parts"))

    def follow(acc, part):
        end = F.get(part["ends"], acc["state"])
        return F.struct(end["state"].alias("state"), (acc["steps"] + end["steps"]).alias("steps"))

    last = F.aggregate("parts", start(F.lit(STATES.index("started"))), follow)
    return by_call.select("user_id", last.alias("f")).select("user_id", F.get(F.array(*map(F.lit, STATES)), F.col("f.state")).alias("state"), "f.steps")


def follow_states(events: DataFrame, forget_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Streaming form: the state of each call is kept between batches and given out when it has events.

    A call without events for `forget_ms` of processing time is forgotten, so state follows the calls in hand."""

    def update(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, steps = state.get if state.exists else ("started", 0)
        rows = pd.concat(list(parts)).sort_values(["event_id", "event_type"])
        now, moved = walk(now, rows.event_type.tolist())
        state.update((now, steps + moved))
        state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame({"user_id": [key[0]], "state": [now], "steps": [steps + moved]})

    by = events.select("user_id", "event_id", "event_type").groupBy("user_id")
    return by.applyInPandasWithState(update, STATE, "state string, steps long", "update", "ProcessingTimeTimeout")


def merge_backlog(spark: SparkSession, path: str):
    """foreachBatch writer: adds a batch's question counts to the snapshot under `path`, one folder a batch."""

    def write(batch: DataFrame, number: int) -> None:
        new = batch.groupBy("canonical_key").agg(F.count(F.lit(1)).alias("occurrences"), F.max("score").alias("best_score"))
        if number:
            old = spark.read.parquet(f"{path}/{number - 1}")
            new = old.unionByName(new).groupBy("canonical_key").agg(F.sum("occurrences").alias("occurrences"), F.max("best_score").alias("best_score"))
        new.write.mode("overwrite").parquet(f"{path}/{number}")  # a repeated batch gives the same folder

    return write


class Voice:
    """Speech on a track of levels: energy over a floor that follows quiet frames, with hysteresis. Feed it pieces in order."""

    def __init__(self, frame_ms: int = 20, above_db: float = 9.0, on_ms: int = 140, off_ms: int = 650):
        self.above, self.on, self.off = above_db, -(-on_ms // frame_ms), -(-off_ms // frame_ms)
        self.floor, self.speaking, self.run, self.start, self.at = None, False, 0, 0, 0

    def feed(self, levels: Iterable[float]) -> list[tuple[int, int]]:
        """(start frame, end frame) of the spans that end in this piece."""
        out = []
        for level in levels:
            self.floor = level if self.floor is None else self.floor
            loud = level > self.floor + self.above
            if not loud:
                self.floor = 0.95 * self.floor + 0.05 * level
            self.run = self.run + 1 if loud != self.speaking else 0
            if not self.speaking and self.run >= self.on:
                self.speaking, self.start, self.run = True, self.at - self.run + 1, 0
            elif self.speaking and self.run >= self.off:
                out.append((self.start, self.at - self.run + 1))
                self.speaking, self.run = False, 0
            self.at += 1
        return out

    def end(self) -> list[tuple[int, int]]:
        """The span that the end of the track cuts."""
        return [(self.start, self.at)] if self.speaking else []


def voice_activity(levels: np.ndarray, **settings) -> list[tuple[int, int]]:
    """(start frame, end frame) of speech on a whole track."""
    voice = Voice(**settings)
    return voice.feed(np.asarray(levels, dtype=float).tolist()) + voice.end()


def speech_spans(frames: DataFrame) -> DataFrame:
    """stream_id, frame, level -> spans of speech per stream, in places of the stream's frames.

    A column `count`, where there is one, says for how many frames from `frame` on the level holds.
    Streams are read in order of frames, a batch at a time; only a detector's state stays in memory."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, voice, found = None, None, []

        def close():
            if voice is not None:
                found.extend((stream, *s) for s in voice.end())

        for batch in batches:
            ids, levels = np.array(batch.column("stream_id").to_pylist(), dtype=object), batch.column("level").to_numpy(zero_copy_only=False)
            counts = batch.column("count").to_numpy()
            edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if voice is None or ids[a] != stream:
                    close()
                    stream, voice = ids[a], Voice()
                found.extend((stream, *s) for s in voice.feed(np.repeat(levels[a:b], counts[a:b]).tolist()))
            yield _spans(found)
            found.clear()
        close()
        yield _spans(found)

    dealt = frames.select(F.col("stream_id").cast("long").alias("stream_id"), "frame", F.col("level").cast("double").alias("level"), (F.col("count") if "count" in frames.columns else F.lit(1)).cast("int").alias("count"))
    return dealt.repartition("stream_id").sortWithinPartitions("stream_id", "frame").mapInArrow(spans, "stream_id long, start long, end long")


def _spans(found: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([row[i] for row in found], pa.int64()) for i in range(3)]
    return pa.RecordBatch.from_arrays(columns, ["stream_id", "start", "end"])
