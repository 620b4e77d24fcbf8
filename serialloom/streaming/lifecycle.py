"""An extension: the life of novels as a stateful stream.

Events say that a chapter was fetched, that a site's label was seen, or that a
backfill has caught up. A novel's state follows from the latest of each, whatever
the order of arrival, and from the time that has passed: a live title that is
labelled completed becomes likely complete when nothing has come for the grace
period. That is a timer in event time, so that it fires without an event; a later
chapter makes the title live again.

The state of a novel is three times and a label, whatever the number of its events.
Needs the RocksDB state store (:func:`states` sets it).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENTS = "novel_id bigint, ts timestamp, kind string, label string"
STATES = "novel_id bigint, state string, at timestamp"
FETCHED, LABELLED, CAUGHT_UP = "fetched", "labelled", "caught_up"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_of(caught_up: bool, label: str | None, latest_ms: int, at_ms: int, grace_ms: int) -> str:
    if not caught_up:
        return "backfilling"
    return "likely_complete" if label == "completed" and at_ms - latest_ms >= grace_ms else "live"


class QuietGrace(StatefulProcessor):
    """Gives a row whenever a novel's state is another than the one it gave last."""

    def __init__(self, grace_days: int):
        self.grace_ms = grace_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "caught_up boolean, label string, label_ms bigint, latest_ms bigint, timer_ms bigint")
        self.told = handle.getValueState("told", "state string")

    def _tell(self, key, known: tuple, at_ms: int) -> Iterator[Row]:
        caught, label, _, latest, _ = known
        state = state_of(caught, label, latest, at_ms, self.grace_ms)
        if not self.told.exists() or self.told.get()[0] != state:
            self.told.update((state,))
            yield Row(novel_id=key[0], state=state, at_ms=at_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        caught, label, label_ms, latest, timer = self.seen.get() if self.seen.exists() else (False, None, -1, 0, -1)
        for r in rows:
            if r["kind"] == CAUGHT_UP:
                caught = True
            elif r["kind"] == FETCHED:
                latest = max(latest, r["ms"])
            elif (r["ms"], r["label"] or "") > (label_ms, label or ""):  # of labels at one time, the greater
                label_ms, label = r["ms"], r["label"]
        due = latest + self.grace_ms if caught and label == "completed" else -1
        if due != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if due >= 0:
                self.handle.registerTimer(due)
        known = (caught, label, label_ms, latest, due)
        self.seen.update(known)
        yield from self._tell(key, known, max(timerValues.getCurrentWatermarkInMs(), 0))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.seen.exists():
            yield from self._tell(key, self.seen.get(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


def states(events: DataFrame, grace_days: int = 30, late: str = "2 days") -> DataFrame:
    """novel_id, state and at (event time) of every change of state; ``events`` is a stream of EVENTS, rows without a time or novel are left out."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = events.filter("ts IS NOT NULL AND novel_id IS NOT NULL").withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    out = rows.groupBy("novel_id").transformWithState(QuietGrace(grace_days), "novel_id bigint, state string, at_ms bigint", "Update", "EventTime")
    return out.select("novel_id", "state", F.timestamp_millis("at_ms").alias("at"))


def states_at(events: DataFrame, at, grace_days: int = 30) -> DataFrame:
    """novel_id and state by all of these events, as seen at a time; the same for a table."""
    of = lambda kind: F.col("kind") == kind
    label = F.max(F.when(of(LABELLED), F.struct("ts", F.coalesce("label", F.lit("")).alias("label"))))
    seen = events.filter("ts IS NOT NULL AND novel_id IS NOT NULL").groupBy("novel_id").agg(F.bool_or(of(CAUGHT_UP)).alias("caught"), label.alias("l"), F.coalesce(F.max(F.when(of(FETCHED), F.unix_millis("ts"))), F.lit(0)).alias("latest"))
    quiet = F.unix_millis(F.lit(at).cast("timestamp")) - F.col("latest") >= grace_days * 86_400_000
    over = F.coalesce((F.col("l.label") == "completed") & quiet, F.lit(False))
    return seen.select("novel_id", F.when(~F.col("caught"), "backfilling").when(over, "likely_complete").otherwise("live").alias("state"))
