"""Conversations that close in time: event-time timers over the state of each station.

``timed_conversations`` gives what ``conversations`` gives, and closes a conversation with the reason ``idle`` once the
stream's watermark has passed its end by ``idle_s``, whether or not its station says anything more. A station of which
nothing has come for ``keep_s`` loses its state altogether; if it comes back, it begins anew (numbers of its session that
were seen are then not known any more). Both waits are measured in event time, so a replay closes the same conversations
for the same reasons.

Rows later than the watermark are dropped by the engine; ``batches.admitted`` before it puts them aside instead. The state
is kept in the RocksDB store: set ``spark.sql.streaming.stateStore.providerClass`` (``PROVIDER``) on the session.

``class_windows`` counts a stream's segments by tumbling windows and class.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from murmur.streaming.conversations import CLOSED, STATE, Limits, Station, cleaned, spelled, uuid5

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COLUMNS = [c.split()[0] for c in CLOSED.split(", ")]


class Stations(StatefulProcessor):
    """State and timer of each station; one timer at a time, for the next thing that time alone may bring."""

    def __init__(self, limits: Limits, idle_s: float, keep_s: float):
        self.limits, self.idle_ms, self.keep_ms = limits, int(idle_s * 1000), int(keep_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("station", STATE)

    def _load(self) -> Station:
        return Station(self.limits, tuple(self.held.get()) if self.held.exists() else None)

    def _settle(self, station: Station, now: int) -> None:
        """Stores the state and sets its timer: idle while a conversation is open, else the end of the state."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        wait = self.idle_ms if station.members else self.keep_ms
        self.held.update(station.saved())
        self.handle.registerTimer(max(station.end // 1000 + wait, now + 1))

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows)).sort_values(["started_at", "sequence"], kind="stable")
        station, out = self._load(), []
        for r in frame.itertuples(index=False):
            out += station.observe(key[0], r.session_id, r.kind, [int(r.sequence), int(r.started_at), int(r.ended_at), int(r.n_matches), r.text])
        if station.end is not None:
            self._settle(station, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        station, out = self._load(), []
        if station.members:
            out = list(station.close(key[0], "idle"))
            self._settle(station, expiredTimerInfo.getExpiryTimeInMs())
        else:
            self.held.clear()
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def timed_conversations(segments: DataFrame, limits: Limits = Limits(), delay: str = "60 seconds", idle_s: float = 60, keep_s: float = 86_400) -> DataFrame:
    """Closed conversations of a stream of segments (see ``conversations``), idle ones too."""
    rows = cleaned(segments).withColumnRenamed("class", "kind").withColumn("at", F.timestamp_micros("ended_at")).withWatermark("at", delay)
    closed = rows.groupBy("station_id").transformWithStateInPandas(Stations(limits, idle_s, keep_s), CLOSED, "Append", "EventTime")
    return spelled(closed.withColumn("conversation_id", uuid5(F.concat_ws(":", "session_id", F.col("first_sequence").cast("string")))))


def class_windows(segments: DataFrame, window_s: int = 3, delay: str = "60 seconds") -> DataFrame:
    """Segments of each station, class and tumbling window by their start: station_id, class, from_at, n_segments,
    n_matches, once the watermark has passed the window."""
    rows = cleaned(segments).withColumn("at", F.timestamp_micros("started_at")).withWatermark("at", delay)
    held = rows.groupBy("station_id", "class", F.window("at", f"{window_s} seconds").alias("w")).agg(F.count("*").alias("n_segments"), F.sum("n_matches").alias("n_matches"))
    return held.select("station_id", "class", F.col("w.start").alias("from_at"), "n_segments", "n_matches")
