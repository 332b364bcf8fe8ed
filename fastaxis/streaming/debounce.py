"""The keyed debounce: each key fires once, a fixed time after it was first seen, with its latest payload and companion."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "key string, payload string, companion string, first_seen long, n_updates long, late long"
PENDING, COMPANION = "payload string, sent long, first_seen long, n long, fired long, late long", "payload string, sent long"
KEEP_MS = 7 * 86_400_000
#: What a message without a time of its own counts as: older than all others, so that arrival decides.
UNSENT = -(1 << 62)


class Debounce(StatefulProcessor):
    """Rows (key, opens, object_id, payload, sent) of two kinds of object.

    An object that opens (an event) starts its key's window when the key is first seen; updates
    don't extend it, and the one that was sent last counts, on ties the one that arrived last. The
    others (origins of the event) are held by their ids, each in its latest version, for
    ``keep_ms`` after its last update; they open nothing. When the window ends, the key fires with
    the event's payload and the origin that the payload names; if it names none, with the one sent last.

    A key that has fired is remembered for ``keep_ms`` and further events are dropped, so a replayed
    batch fires it no second time; after that its state goes. Keys of the initial state have fired.
    """

    def __init__(self, wait_ms: int, keep_ms: int = KEEP_MS, named: str = "origin_id"):
        self.wait_ms, self.keep_ms, self.named = wait_ms, keep_ms, named

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", PENDING)
        self.companions = handle.getMapState("companions", "object_id string", COMPANION, ttlDurationMs=self.keep_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        now = timerValues.getCurrentProcessingTimeInMs()
        if not self.pending.exists():
            self.pending.update((None, UNSENT, now, 0, 1, 0))
            self.handle.registerTimer(now + self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        there = self.pending.exists()
        payload, last, first, n, fired, late = self.pending.get() if there else (None, UNSENT, now, 0, 0, 0)
        opened = False
        for pdf in rows:
            for opens, object_id, text, sent in zip(pdf["opens"], pdf["object_id"], pdf["payload"], pdf["sent"], strict=True):
                sent = UNSENT if pd.isna(sent) else int(sent)
                if not opens:
                    held = self.companions.getValue((object_id or "",))
                    if held is None or sent >= held[1]:
                        self.companions.updateValue((object_id or "",), (text, sent))
                elif fired:
                    opened, late = True, late + 1
                else:
                    opened, n = True, n + 1
                    if sent >= last:
                        payload, last = text, sent
        if opened and not there:
            self.handle.registerTimer(first + self.wait_ms)
        if opened:
            self.pending.update((payload, last, first, n, fired, late))
        return iter([])

    def _companion(self, payload: str | None) -> str | None:
        """The held object that a payload names; the one sent last if it names none."""
        try:
            wanted = json.loads(payload or "{}").get(self.named)
        except (ValueError, AttributeError):
            wanted = None
        if wanted is not None:
            held = self.companions.getValue((str(wanted),))
            return held[0] if held else None
        return max(((v[1], k[0], v[0]) for k, v in self.companions.iterator()), key=lambda x: x[:2], default=(0, "", None))[2]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.pending.exists():
            return
        payload, last, first, n, fired, late = self.pending.get()
        if fired:
            self.pending.clear()
            return
        self.pending.update((payload, last, first, n, 1, late))
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        yield pd.DataFrame({"key": [key[0]], "payload": [payload], "companion": [self._companion(payload)], "first_seen": [first], "n_updates": [n], "late": [late]})

    def close(self) -> None:
        pass


def debounced(stream: DataFrame, wait_s: float, kind: str = "Event", companion: str = "Origin", handled: DataFrame | None = None, keep_s: float = KEEP_MS / 1000) -> DataFrame:
    """OUTPUT of a stream of (kind, key, payload), and (object_id, sent_at) if it has them: only objects of the first kind open a window.

    Objects of the second kind have the key of the event they belong to. ``handled`` (key) are
    keys that fired before this stream's state began, as Outbox.handled() knows them.
    """
    has = lambda c, t: F.col(c).cast(t) if c in stream.columns else F.lit(None).cast(t)
    sent = F.unix_micros(has("sent_at", "timestamp"))
    rows = stream.filter(F.col("kind").isin(kind, companion) & F.col("key").isNotNull()).select(F.col("key").cast("string").alias("key"), (F.col("kind") == kind).alias("opens"), has("object_id", "string").alias("object_id"), F.col("payload").cast("string").alias("payload"), sent.alias("sent"))
    initial = None if handled is None else handled.select(F.col("key").cast("string").alias("key")).filter("key is not null").distinct().groupBy("key")
    return rows.groupBy("key").transformWithStateInPandas(Debounce(int(wait_s * 1000), int(keep_s * 1000)), OUTPUT, "Append", "ProcessingTime", initialState=initial)


def debounced_batch(rows: DataFrame, wait_s: float, salts: int = 1) -> DataFrame:
    """The same over a table (event_id, ts, key, payload) in event time: the first window of each key, and what came too late.

    With several salts the rows of one key meet its first time in so many tasks, and are
    combined there before they come together: a key may hold any share of the rows.
    """
    first = rows.groupBy("key").agg(F.min("ts").alias("first_seen"))
    on = ["key"]
    if salts > 1:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("ts", "event_id"), F.lit(salts)))
        first, on = first.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["key", "_salt"]
    inside = F.unix_micros(F.col("ts").cast("timestamp")) < F.unix_micros(F.col("first_seen").cast("timestamp")) + int(wait_s * 1e6)
    marked = rows.join(first, on).withColumn("inside", inside)
    order = F.when(F.col("inside"), F.struct("ts", "event_id"))
    return marked.groupBy("key", "first_seen").agg(F.max_by("payload", order).alias("payload"), F.count_if("inside").alias("n_updates"), F.count_if(~F.col("inside")).alias("late"))


def run_batches(events: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second"):
    """Starts a query that hands each batch of fired events to ``process``; the checkpoint makes a restart go on where it was."""
    return events.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()


def drain(query, wait_s: float, poll_s: float = 0.2) -> None:
    """Stops a query of debounced events when its input is read and all windows have fired.

    Timers keep such a query busy for ever, so that it has no end of its own: the end is a batch
    without input that began when the windows of all earlier input were over.
    """
    due, seen = time.time() + wait_s, None
    while query.isActive:
        p = query.lastProgress
        if p is not None and p["timestamp"] != seen:
            seen, began = p["timestamp"], datetime.fromisoformat(p["timestamp"].replace("Z", "+00:00")).timestamp()
            if p["numInputRows"]:
                due = time.time() + wait_s
            elif began > due:
                query.stop()
        time.sleep(poll_s)
    if (failure := query.exception()) is not None:
        raise failure
