"""Follow-up triggers as keyed state with timers: each trigger sends itself again, every month while its gap is open.

The batch form (``operators.state``) merges a run of gaps into the whole state and looks through it for what is due. Here every
trigger is a key of its own: a row about it changes its state, and a timer sends it again when the interval has passed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import timedelta
from typing import NamedTuple

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.dates import RETRIGGER_DAYS
from ..operators.state import CLOSED, TRIGGER_KEY

ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STATE = "status string, last_ms long, trigger_count long, seen_ms long, timer_ms long, auto_followup boolean"
ACTIONS = (
    "tenant_id string, registration_gstin string, counterparty_gstin string, invoice_no string, bucket string, "
    "step long, at_ms long, action string, status string, trigger_count long")
ACTION_NAMES = (*TRIGGER_KEY, "step", "at_ms", "action", "status", "trigger_count")
LATE = "1 hour"

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package


class Trigger(NamedTuple):
    status: str
    last_ms: int | None = None
    trigger_count: int = 0
    seen_ms: int = 0
    timer_ms: int | None = None
    auto_followup: bool = False

    def sends(self, bucket: str) -> bool:
        """Whether it may be sent: what the client is asked for once approved, what vendors are asked for by policy."""
        if bucket == "not_in_books":
            return self.status in ("approved", "sent")
        return self.status in ("queued", "sent") and self.auto_followup


def first_status(bucket: str, require_review: bool) -> str:
    if bucket == "not_in_books":
        return "pending_review" if require_review else "approved"
    return "queued"


def moved(now: Trigger | None, bucket: str, row) -> tuple[Trigger | None, str | None]:
    """The trigger after a row about it, and what that was; a row that changes nothing has no name."""
    if row.event == "open":
        if now is None:
            return Trigger(first_status(bucket, row.require_review)), "created"
        return (now._replace(status=first_status(bucket, row.require_review)), "reopened") if now.status == "resolved" else (now, None)
    if now is None:
        return None, None
    if row.event == "gone" and now.status not in CLOSED:
        return now._replace(status="resolved"), "resolved"
    if row.event in ("approve", "reject") and bucket == "not_in_books" and now.status == "pending_review":
        status = {"approve": "approved", "reject": "rejected"}[row.event]
        return now._replace(status=status), status
    return now, None


class FollowUp(StatefulProcessor):
    """One trigger a key. ``processing`` takes the time of the machine; otherwise rows carry the time in ``at``."""

    def __init__(self, every: timedelta, processing: bool):
        self.every_ms = int(every / timedelta(milliseconds=1))
        self.processing = processing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("trigger", STATE)

    def _sent_until(self, now: Trigger, bucket: str, until_ms: int, out: list) -> Trigger:
        """Everything that fell due up to a time: as many times as the interval has passed."""
        while now.sends(bucket) and now.last_ms is not None and now.last_ms + self.every_ms <= until_ms:
            now = self._sent(now, now.last_ms + self.every_ms, out)
        return now

    def _sent(self, now: Trigger, at_ms: int, out: list) -> Trigger:
        now = now._replace(status="sent", last_ms=at_ms, trigger_count=now.trigger_count + 1)
        out.append((at_ms, "sent", now.status, now.trigger_count))
        return now

    def _keep(self, now: Trigger, bucket: str) -> None:
        """Store the trigger, with one timer for its next sending or none."""
        due = now.last_ms + self.every_ms if now.sends(bucket) and now.last_ms is not None else None
        if due != now.timer_ms:
            if now.timer_ms is not None:
                self.handle.deleteTimer(now.timer_ms)
            if due is not None:
                self.handle.registerTimer(due)
        self.state.update(tuple(now._replace(timer_ms=due)))

    def _load(self) -> Trigger | None:
        kept = self.state.get()
        return Trigger(*kept) if kept is not None else None

    def _rows(self, key, out: list) -> Iterator[Row]:
        for i, x in enumerate(out):
            yield Row(*ACTION_NAMES)(*key, i, *x)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        bucket, now, out = key[-1], self._load(), []
        for row in sorted(rows, key=lambda r: (r.at_us, r.seq)):
            own_ms = timerValues.getCurrentProcessingTimeInMs() if self.processing else row.at_us // 1000
            at_ms = max(own_ms, now.seen_ms) if now else own_ms  # a late row counts from when it came
            if now:
                now = self._sent_until(now, bucket, at_ms, out)
            now, action = moved(now, bucket, row)
            if now is None:
                continue
            now = now._replace(seen_ms=at_ms, auto_followup=bool(row.auto_followup))
            if action:
                out.append((at_ms, action, now.status, now.trigger_count))
            if now.sends(bucket) and (now.last_ms is None or at_ms - now.last_ms >= self.every_ms):
                now = self._sent(now, at_ms, out)
        if now is not None:
            self._keep(now, bucket)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        bucket, now, out = key[-1], self._load(), []
        if now is not None and now.timer_ms is not None:
            # time may have gone on by several intervals since the timer was due
            reached = timerValues.getCurrentProcessingTimeInMs() if self.processing else timerValues.getCurrentWatermarkInMs()
            now = self._sent_until(now._replace(timer_ms=None), bucket, max(reached, expiredTimerInfo.getExpiryTimeInMs()), out)
            self._keep(now, bucket)
        yield from self._rows(key, out)


def trigger_actions(events: DataFrame, every: timedelta = timedelta(days=RETRIGGER_DAYS), processing: bool = False, late: str = LATE) -> DataFrame:
    """What happens to triggers, as a stream: created, reopened, approved, rejected, resolved and sent, with the time of each.

    ``events`` has the trigger's key, ``event`` (open, gone, approve, reject), ``at``, ``seq``, ``require_review`` and ``auto_followup``.
    With event time a sending is dated to the end of its interval, whenever the timer fires, so results don't depend on batches.
    """
    timed = events.withColumn("at", F.col("at").cast("timestamp")).withColumn("at_us", F.unix_micros("at"))
    if not processing:
        timed = timed.withWatermark("at", late)
    # a trigger has few rows: they come as rows, as a frame for each key takes longer than its work
    moves = timed.groupBy(*TRIGGER_KEY).transformWithState(
        statefulProcessor=FollowUp(every, processing), outputStructType=ACTIONS, outputMode="Append",
        timeMode="ProcessingTime" if processing else "EventTime")
    return moves.select(*TRIGGER_KEY, "step", F.timestamp_millis("at_ms").alias("at"), "action", "status", "trigger_count")


def use_timers(spark: SparkSession) -> None:
    """Timers need a state store with column families."""
    spark.conf.set(*ROCKSDB)
