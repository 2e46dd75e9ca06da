"""Stream operators on ``transformWithStateInPandas``: value and list state and event-time timers.

Rows that come out of order wait in a list until a timer at their time goes off, that is, until the watermark has passed them; then they are taken
in order, one state at a time. Nothing but what waits and the state itself is held for a key, however long its history. The session of
the stream needs the RocksDB state store (``state_session``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import as_ms, from_ms

# Metres before the end of a section from which on it is over, and share of it that must have been ridden.
END_M, DONE_SHARE = 10.0, 0.5


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with the state store that these operators need; the caller's settings stay as they are."""
    session = spark.newSession()
    for key in ("spark.checkpoint.dir", "spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        value = spark.conf.get(key, None)
        if value is not None and spark.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return session


class InOrder(StatefulProcessor):
    """Takes the rows of a key in the order of their times, each once the watermark has passed it.

    Subclasses say which columns wait (``waits``, the first is at_ms, none null), what state they keep (``keeps``), and what a row does to it.
    """

    waits = "at_ms long"
    keeps = "seq long"
    out: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waits)
        self.kept = handle.getValueState("kept", self.keeps)

    def rows_of(self, frame: pd.DataFrame) -> list[tuple]:
        """Waiting rows of a batch."""
        raise NotImplementedError

    def take(self, key: tuple, state: tuple | None, row: tuple) -> tuple[tuple, list]:
        """State after a row, and the rows that it gives."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            come = self.rows_of(frame)
            if come:
                self.waiting.appendList(come)
                self.handle.registerTimer(min(r[0] for r in come))  # each timer that goes off sets the next one
        yield pd.DataFrame(columns=self.out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted(map(tuple, self.waiting.get())) if self.waiting.exists() else []
        ready = [r for r in held if r[0] <= mark]
        state, out = tuple(self.kept.get()) if self.kept.exists() else None, []
        for row in ready:
            state, told = self.take(key, state, row)
            out += told
        if len(ready) < len(held):
            self.waiting.put(held[len(ready) :])
            self.handle.registerTimer(held[len(ready)][0])
        elif held:
            self.waiting.clear()
        if ready:
            self.kept.update(state)
        yield pd.DataFrame(out, columns=self.out)

    def close(self) -> None:
        pass


class Sequenced(InOrder):
    """Samples of several sensors in one order, with a running number."""

    waits = "at_ms long, kind string, value double"

    def __init__(self, names: list[str]) -> None:
        self.out = names

    def rows_of(self, frame: pd.DataFrame) -> list[tuple]:
        return list(zip(as_ms(frame[self.out[2]]).tolist(), frame["kind"].tolist(), frame["value"].astype(float).tolist()))

    def take(self, key: tuple, state: tuple | None, row: tuple) -> tuple[tuple, list]:
        seq = state[0] if state else 0
        return (seq + 1,), [[key[0], seq, from_ms(row[0]), row[1], row[2]]]


def in_order(samples: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Rows (key, at, kind, value) of several sensors in event-time order within each key, with a running ``seq``."""
    schema = f"{key} {dict(samples.dtypes)[key]}, seq long, {at} timestamp, kind string, value double"
    return samples.withWatermark(at, late).groupBy(key).transformWithStateInPandas(Sequenced([key, "seq", at, "kind", "value"]), schema, "Append", "EventTime")


class TrailWatch(InOrder):
    """Follows a ride over the trail sections of its route and tells the end of each one that was really ridden."""

    waits = "at_ms long, along_m double, arrived boolean, speed_mps double, section_id long, start_m double, end_m double"
    keeps = "section_id long, start_m double, end_m double, entered_ms long, entered_m double, most double"
    #: State off all sections; ids count from 0, and a negative speed is unknown.
    off = (-1, 0.0, 0.0, 0, 0.0, -1.0)
    out = ["ride_id", "section_id", "entered_at", "ended_at", "ridden_m", "max_speed_mps"]

    def rows_of(self, frame: pd.DataFrame) -> list[tuple]:
        told = frame[frame["along_m"].notna()]
        numbers = [told[c].astype(float).fillna(-1.0).tolist() for c in ("speed_mps", "start_m", "end_m")]
        sections = told["section_id"].astype(float).fillna(-1).astype(int).tolist()
        return list(zip(as_ms(told["at"]).tolist(), told["along_m"].astype(float).tolist(), told["arrived"].fillna(False).astype(bool).tolist(), numbers[0], sections, *numbers[1:]))

    def take(self, key: tuple, state: tuple | None, row: tuple) -> tuple[tuple, list]:
        at, along, arrived, speed, section, start, end = row
        run = state if state and state[0] >= 0 else None
        if run and along < run[1]:
            run = None  # back before its head
        elif run and (along >= run[2] - END_M or arrived or section != run[0]):
            to = min(along, run[2])
            done = to - run[4] >= (run[2] - run[1]) * DONE_SHARE
            return self.off, [[key[0], run[0], from_ms(run[3]), from_ms(at), to - run[4], None if run[5] < 0 else run[5]]] if done else []
        if not run and section >= 0 and end > start and not arrived and along < end - END_M:
            run = (section, start, end, at, along, -1.0)
        if run and math.isfinite(speed):
            run = (*run[:5], max(run[5], speed))
        return run or self.off, []


def trails_done(fixes: DataFrame, late: str) -> DataFrame:
    """ride_id, section_id, entered_at, ended_at, ridden_m, max_speed_mps of each trail section that a ride has finished.

    ``fixes`` are (ride_id, at, along_m, arrived, speed_mps, and section_id (0 and up), start_m, end_m of the section at that place, or null). A section is
    over near its end, on arrival, or where another or none follows; it counts if half of it was ridden. A ride back before its head
    is forgotten. The fix that ends a section begins none. Fixes without a place are left out; equal times are taken by place.
    """
    schema = f"ride_id {dict(fixes.dtypes)['ride_id']}, section_id long, entered_at timestamp, ended_at timestamp, ridden_m double, max_speed_mps double"
    return fixes.withWatermark("at", late).groupBy("ride_id").transformWithStateInPandas(TrailWatch(), schema, "Append", "EventTime")
