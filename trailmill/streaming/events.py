"""Stream operators: windows with a watermark, debounced sessions, late reports, prompts, chunks, ordered merging.

Each takes and returns a streaming DataFrame; custom state lives in Spark's state store and is kept small: a few numbers, or
what came within the wait for late rows. Times of state are milliseconds of event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, at: str, keys: list[str], size: str, late: str, aggregates: list[Column]) -> DataFrame:
    """Aggregates of tumbling windows, each emitted once the watermark has passed its end."""
    found = events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), *keys).agg(*aggregates)
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in found.columns if c != "w"])


def first_only(events: DataFrame, at: str, key: str, late: str) -> DataFrame:
    """Rows whose key was not seen before within the watermark: replays of a client id change nothing."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def once_per_session(events: DataFrame, at: str, keys: list[str], late: str) -> DataFrame:
    """The first notice of each session and buddy."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def as_ms(times: pd.Series) -> pd.Series:
    return (times.astype("datetime64[ns]").astype("int64") // 1_000_000).astype("int64")


def from_ms(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


def debounced(events: DataFrame, key: str, at: str, sender: str, gap_ms: int, cap_ms: int, late: str) -> DataFrame:
    """key, first_at, due_at, events, senders: sessions that are due ``gap`` after their last event, ``cap`` after their first at most.

    Events of a batch are taken in event time. A session is emitted when an event comes at or after its due time, or when
    the watermark passes it. Senders are kept in the order of their first event.
    """
    kind = dict(events.dtypes)[key]
    out = f"{key} {kind}, first_at timestamp, due_at timestamp, events long, senders array<string>"

    def row(own: tuple, s: tuple) -> pd.DataFrame:
        return pd.DataFrame([[own[0], from_ms(s[0]), from_ms(s[1]), s[2], list(s[3])]], columns=[key, "first_at", "due_at", "events", "senders"])

    def step(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield row(own, state.get)
            state.remove()
            return
        now = state.get if state.exists else None
        pdf = pd.concat(list(batches)).sort_values(at, kind="stable")
        for t, who in zip(as_ms(pdf[at]).tolist(), pdf[sender].astype(str).tolist()):
            if now is not None and t >= now[1]:
                yield row(own, now)
                now = None
            if now is None:
                now = (t, min(t + gap_ms, t + cap_ms), 1, [who])
            else:
                now = (now[0], min(t + gap_ms, now[0] + cap_ms), now[2] + 1, list(now[3]) + ([who] if who not in now[3] else []))
        state.update((now[0], now[1], now[2], list(now[3])))
        state.setTimeoutTimestamp(max(now[1], state.getCurrentWatermarkMs() + 1))

    return events.withWatermark(at, late).groupBy(key).applyInPandasWithState(step, out, "first_ms long, due_ms long, n long, senders array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def changes(reports: DataFrame, key: str, at: str, status: str) -> DataFrame:
    """Reports whose status differs from the last one of their key; a report older than the last one is ignored."""
    kind = dict(reports.dtypes)[key]
    out = f"{key} {kind}, {at} timestamp, before string, {status} string"

    def step(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else (-1, None)
        rows = []
        pdf = pd.concat(list(batches)).sort_values(at, kind="stable")
        for t, now in zip(as_ms(pdf[at]).tolist(), pdf[status].tolist()):
            if t < last[0]:
                continue
            if now != last[1]:
                rows.append([own[0], from_ms(t), last[1], now])
            last = (t, now)
        state.update(last)
        yield pd.DataFrame(rows, columns=[key, at, "before", status])

    return reports.groupBy(key).applyInPandasWithState(step, out, "at_ms long, status string", "append", GroupStateTimeout.NoTimeout)


def prompts(fixes: DataFrame, near_m: float = 20.0, accuracy_m: float = 30.0, apart_m: float = 25.0) -> DataFrame:
    """ride_id, trail_id, at: asks about a trail once, after two accurate fixes near it in a row that are far enough apart.

    ``fixes`` are (ride_id, at, x, y, acc_m, trail_id, distance_m), the nearest trail of each fix beside it.
    """
    kind = dict(fixes.dtypes)
    out = f"ride_id {kind['ride_id']}, trail_id {kind['trail_id']}, at timestamp"

    def step(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_trail, last_x, last_y, asked = state.get if state.exists else (None, 0.0, 0.0, [])
        asked, rows = list(asked), []
        for r in pd.concat(list(batches)).sort_values("at", kind="stable").itertuples(index=False):
            trail = None if pd.isna(r.trail_id) else str(r.trail_id)
            good = trail is not None and r.distance_m <= near_m and (pd.isna(r.acc_m) or r.acc_m <= accuracy_m)
            if good and trail == last_trail and trail not in asked and ((r.x - last_x) ** 2 + (r.y - last_y) ** 2) ** 0.5 >= apart_m:
                asked.append(trail)
                rows.append([own[0], r.trail_id, r.at])
            if not good:
                last_trail = None
            elif trail != last_trail:
                last_trail, last_x, last_y = trail, r.x, r.y
        state.update((last_trail, float(last_x), float(last_y), asked))
        yield pd.DataFrame(rows, columns=["ride_id", "trail_id", "at"])

    return fixes.groupBy("ride_id").applyInPandasWithState(step, out, "trail string, x double, y double, asked array<string>", "append", GroupStateTimeout.NoTimeout)


def off_route(fixes: DataFrame, far_m: float = 30.0, arrive_m: float = 30.0) -> DataFrame:
    """ride_id, at, event: ``off`` after two fixes in a row far from the route, ``back`` on return, ``arrived`` once near its end.

    ``fixes`` are (ride_id, at, distance_m, left_m).
    """
    kind = dict(fixes.dtypes)["ride_id"]

    def step(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        far, off, arrived = state.get if state.exists else (0, False, False)
        rows = []
        for r in pd.concat(list(batches)).sort_values("at", kind="stable").itertuples(index=False):
            far = far + 1 if r.distance_m > far_m else 0
            if far >= 2 and not off:
                off = True
                rows.append([own[0], r.at, "off"])
            elif far == 0 and off:
                off = False
                rows.append([own[0], r.at, "back"])
            if not arrived and not off and far == 0 and r.left_m <= arrive_m:
                arrived = True
                rows.append([own[0], r.at, "arrived"])
        state.update((far, off, arrived))
        yield pd.DataFrame(rows, columns=["ride_id", "at", "event"])

    return fixes.groupBy("ride_id").applyInPandasWithState(step, f"ride_id {kind}, at timestamp, event string", "far int, off boolean, arrived boolean", "append", GroupStateTimeout.NoTimeout)


def reassembled(chunks: DataFrame, at: str, late: str) -> DataFrame:
    """message_id, body: messages whose ``parts`` chunks (message_id, part, parts, body) have all come; repeats do not count twice."""
    kind = dict(chunks.dtypes)["message_id"]

    def step(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        numbers, bodies, done = state.get if state.exists else ([], [], False)
        have = dict(zip(numbers, bodies))
        for pdf in batches:
            for part, parts, body in zip(pdf["part"].tolist(), pdf["parts"].tolist(), pdf["body"].tolist()):
                have.setdefault(int(part), body)
                if not done and len(have) == parts:
                    done = True
                    yield pd.DataFrame([[own[0], "".join(have[k] for k in sorted(have))]], columns=["message_id", "body"])
        state.update(([] if done else list(have), [] if done else list(have.values()), done))

    return chunks.groupBy("message_id").applyInPandasWithState(step, f"message_id {kind}, body string", "numbers array<int>, bodies array<string>, done boolean", "append", GroupStateTimeout.NoTimeout)


def in_order(samples: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Rows (key, at, kind, value) of several sensors in event-time order within each key: each waits until the watermark has passed it.

    Rows later than the watermark were given up on; those of one release are emitted in order with a running ``seq``.
    """
    kind = dict(samples.dtypes)[key]
    out = f"{key} {kind}, seq long, {at} timestamp, kind string, value double"

    def step(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, kinds, values, seq = state.get if state.exists else ([], [], [], 0)
        rows = list(zip(times, kinds, values))
        if not state.hasTimedOut:
            for pdf in batches:
                rows += zip(as_ms(pdf[at]).tolist(), pdf["kind"].tolist(), pdf["value"].astype(float).tolist())
        rows.sort()
        mark = state.getCurrentWatermarkMs()
        ready = [r for r in rows if r[0] <= mark]
        rest = rows[len(ready) :]
        if ready:
            yield pd.DataFrame([[own[0], seq + k, from_ms(t), s, v] for k, (t, s, v) in enumerate(ready)], columns=[key, "seq", at, "kind", "value"])
        if rest:
            state.update(([r[0] for r in rest], [r[1] for r in rest], [r[2] for r in rest], seq + len(ready)))
            state.setTimeoutTimestamp(max(rest[0][0], mark + 1))
        elif state.exists or ready:
            state.update(([], [], [], seq + len(ready)))

    return samples.withWatermark(at, late).groupBy(key).applyInPandasWithState(step, out, "times array<long>, kinds array<string>, vals array<double>, seq long", "append", GroupStateTimeout.EventTimeTimeout)


def presence(fixes: DataFrame, now: Column, fresh_s: int = 120, keep_s: int = 900) -> DataFrame:
    """The last fix of each account with its ``freshness``: live, seen or none after that. For one batch, as in ``foreachBatch``."""
    last = fixes.groupBy("account").agg(F.max_by(F.struct(*[c for c in fixes.columns if c != "account"]), "at").alias("f")).select("account", "f.*")
    age = F.unix_timestamp(now) - F.unix_timestamp("at")
    return last.withColumn("freshness", F.when(age <= fresh_s, "live").when(age <= keep_s, "seen")).filter("freshness is not null")
