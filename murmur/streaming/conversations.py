"""Conversations from a stream of transcribed segments: one bounded state a station.

A segment whose number in its session was seen or passed is dropped. A conversation opens on a segment with matches and
reaches back over the segments that ended shortly before; it closes when the session changes (``disconnect``), when the
pause to the next segment is long enough (``music`` or ``silence``, by the next segment's class), or when it is too long
(``max_duration``). There is no idle timer here: what is still open stays in the checkpointed state (``timed`` has one). A new session begins
with an empty look-back and its own numbers.

A micro-batch sorts one station's new segments in memory, so ``maxFilesPerTrigger`` bounds what a task holds; a station's
state holds ``most_before`` + ``most_segments`` segments at most. Missing numbers are kept as gaps (first, last), however
wide: ``closed`` gives them so, for sinks; ``spelled`` lists each number. Rows without station, session, number or times
are dropped; a null text is empty, a null match count is zero.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMESPACE = "6f9619ff-8b86-d011-b42d-00c04fc964ff"  # fixed value: ids must agree with those already stored
CLOSED = "station_id string, session_id string, close_reason string, first_sequence long, last_sequence long, started_us long, ended_us long, n_segments long, n_matches long, gaps array<struct<first:long,last:long>>, text string"
STATE = "session string, last_sequence long, last_end long, missing string, before string, members string"


@dataclass(frozen=True)
class Limits:
    pause_s: float = 12
    before_s: float = 30
    longest_s: float = 300
    most_segments: int = 200
    most_before: int = 40


class Station:
    """The state of one station; members and before are lists of (sequence, start, end, matches, text)."""

    def __init__(self, limits: Limits, saved: tuple | None):
        self.limits = limits
        self.session, self.last, self.end = saved[:3] if saved else (None, None, None)
        self.missing, self.before, self.members = map(json.loads, saved[3:]) if saved else ([], [], [])
        self.missing = [m if isinstance(m, list) else [m, m] for m in self.missing]  # states of old list single numbers

    def saved(self) -> tuple:
        return self.session, self.last, self.end, *map(json.dumps, (self.missing, self.before, self.members))

    def close(self, station: str, reason: str) -> Iterator[tuple]:
        if self.members:
            first, last = self.members[0], self.members[-1]
            words = " ".join(t for m in self.members if (t := m[4].strip()))
            yield station, self.session, reason, first[0], last[0], first[1], last[2], len(self.members), sum(m[3] for m in self.members), [{"first": a, "last": b} for a, b in self.missing], words
        self.members, self.missing = [], []

    def observe(self, station: str, session: str, kind: str, segment: list) -> Iterator[tuple]:
        sequence, start, end, matches, _ = segment
        us = 1_000_000
        if session != self.session:
            yield from self.close(station, "disconnect")
            self.session, self.last, self.end, self.before = session, None, None, []
        elif sequence <= self.last:
            return
        if self.members and start - self.end >= self.limits.pause_s * us:
            yield from self.close(station, "music" if kind in ("music", "singing") else "silence")
        if self.last is not None:
            self.missing += [[self.last + 1, sequence - 1]] if sequence > self.last + 1 and (self.members or matches) else []
        self.last, self.end = sequence, end
        if self.members:
            self.members.append(segment)
        else:
            reach = (start if matches else end) - self.limits.before_s * us
            self.before = [b for b in self.before if b[2] >= reach]
            if matches:
                self.members, self.before = [*self.before, segment], []
            else:
                self.before = [*self.before, segment][-self.limits.most_before :]
        if self.members and (end - self.members[0][1] >= self.limits.longest_s * us or len(self.members) >= self.limits.most_segments):
            yield from self.close(station, "max_duration")


def uuid5(name: Column) -> Column:
    """The name-based UUID (version 5) of a string in the fixed namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(uuid.UUID(NAMESPACE).hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def cleaned(segments: DataFrame) -> DataFrame:
    """The columns of segments with times in microseconds and without nulls; rows that lack a key or time go."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return segments.select(F.col("station_id").cast("string"), F.col("session_id").cast("string"), F.col("sequence").cast("long"), us("started_at"), us("ended_at"), F.coalesce("class", F.lit("")).alias("class"), F.coalesce(F.col("n_matches").cast("long"), F.lit(0)).alias("n_matches"), F.coalesce("text", F.lit("")).alias("text")).dropna()


def closed(segments: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Closed conversations of a stream with station_id, session_id, sequence, started_at, ended_at, class, n_matches,
    text. The conversation's id depends on its session and first segment only, so a replay writes the same keys. What is
    missing is told by gaps (first, last)."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        rows = pd.concat(list(frames)).sort_values(["started_at", "sequence"], kind="stable")
        held = Station(limits, state.get if state.exists else None)
        out = []
        for r in rows.itertuples(index=False):
            out += held.observe(key[0], r.session_id, r[5], [int(r.sequence), int(r.started_at), int(r.ended_at), int(r.n_matches), r.text])
        state.update(held.saved())
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CLOSED.split(", ")])

    found = cleaned(segments).groupBy("station_id").applyInPandasWithState(step, CLOSED, STATE, "append", GroupStateTimeout.NoTimeout)
    return found.withColumn("conversation_id", uuid5(F.concat_ws(":", "session_id", F.col("first_sequence").cast("string"))))


def spelled(found: DataFrame) -> DataFrame:
    """Closed conversations with each ``missing`` number in place of the gaps."""
    numbers = F.flatten(F.transform("gaps", lambda g: F.sequence(g["first"], g["last"])))
    return found.select(*[numbers.alias("missing") if c == "gaps" else c for c in found.columns])


def conversations(segments: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Closed conversations of a stream (``closed``) with the list of their missing numbers."""
    return spelled(closed(segments, limits))


def send_once(messages: DataFrame, at: str = "sent_at", keys: tuple = ("queue", "dedup_id"), span: str = "300 seconds") -> DataFrame:
    """A stream of messages without those whose keys were sent within the span before."""
    return messages.withWatermark(at, span).dropDuplicatesWithinWatermark(list(keys))


def drained(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over what has arrived, into a table under path, and returns the table. The sink's log of committed
    batches makes a repeat after a failure exactly-once."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/log").option("path", f"{path}/rows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
