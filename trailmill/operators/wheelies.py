"""Wheelies over a rolling riding position.

The riding position is the componentwise median of the last samples that were ridden level, so each sample's part in it depends on all
before. Rides are dealt to partitions and sorted; each task passes over its samples in Arrow batches and hands a small state
from batch to batch, so memory is bounded by the window, whatever the length of a ride, and batch ends change nothing.
"""

from __future__ import annotations

import bisect
import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Speed in km/h above which one rides, degrees below the start limit at which a wheelie ends, samples (of 0.1 s) of the window, before
# the first position and between two, and seconds after which the mount has slipped.
RIDING_KMH, RELEASE_DEG, WINDOW, WARM_UP, EVERY, LONGEST_S = 8.0, 5.0, 600, 100, 10, 60.0


class RollingMedian:
    """Median of the last ``size`` values, kept sorted: a value comes and goes with one binary search each."""

    def __init__(self, size: int) -> None:
        self.size, self.queue, self.sorted = size, deque(), []

    def add(self, value: float) -> None:
        if len(self.queue) == self.size:
            self.sorted.pop(bisect.bisect_left(self.sorted, self.queue.popleft()))
        self.queue.append(value)
        bisect.insort(self.sorted, value)

    def median(self) -> float:
        n = len(self.sorted)
        return (self.sorted[(n - 1) // 2] + self.sorted[n // 2]) / 2 if n % 2 == 0 else self.sorted[n // 2]


def unit(v: tuple[float, ...]) -> tuple[float, ...]:
    """The vector at length 1; zero stays."""
    length = math.sqrt(sum(x * x for x in v))
    return tuple(x / length for x in v) if length else (0.0, 0.0, 0.0)


def degrees_between(a: tuple[float, ...], b: tuple[float, ...]) -> float:
    """Angle between two unit vectors."""
    return math.degrees(math.acos(max(-1.0, min(1.0, sum(p * q for p, q in zip(a, b))))))


class Rider:
    """State of one ride: the riding position and its samples, and the wheelie that is going on."""

    def __init__(self, tilt: float, least_s: float, window: int, warm_up: int, every: int, longest_s: float) -> None:
        self.tilt, self.least_s, self.longest_s = tilt, least_s, longest_s
        self.window, self.warm_up, self.every = window, warm_up, every
        self.start: float | None = None
        self.forget()

    def forget(self) -> None:
        """Learn the riding position anew."""
        self.axes, self.base, self.since = [RollingMedian(self.window) for _ in range(3)], None, 0

    def learn(self, v: tuple[float, ...]) -> None:
        """One more level sample."""
        for median, x in zip(self.axes, v):
            median.add(x)
        if len(self.axes[0].queue) >= self.warm_up:
            self.since += 1
            if self.base is None or self.since >= self.every:
                self.since, self.base = 0, unit(tuple(m.median() for m in self.axes))

    def ended(self) -> list:
        """t, duration, length_m and peak of the wheelie that ends now, if it counts."""
        start, self.start = self.start, None
        long = self.last - start
        return [start, long, self.speeds / self.n * long, self.peak] if long >= self.least_s else []

    def sample(self, t: float, v: tuple[float, ...], kmh: float) -> list:
        """The next sample; a wheelie that ends with it."""
        riding = not math.isnan(kmh) and kmh > RIDING_KMH
        angle = 0.0 if self.base is None else degrees_between(unit(v), self.base)
        release = self.tilt - RELEASE_DEG
        if self.start is not None:
            if not (riding and angle >= release):
                return self.ended()
            self.last, self.peak, self.speeds, self.n = t, max(self.peak, angle), self.speeds + kmh / 3.6, self.n + 1
            if t - self.start > self.longest_s:  # a slipped mount
                self.start = None
                self.forget()
        elif riding and self.base is not None and angle >= self.tilt:
            self.start = self.last = t
            self.peak, self.speeds, self.n = angle, kmh / 3.6, 1
        elif riding and angle < release:
            self.learn(v)
        return []


def wheelies(samples: DataFrame, tilt_deg: float = 15.0, least_s: float = 0.5, window: int = WINDOW, warm_up: int = WARM_UP, every: int = EVERY, longest_s: float = LONGEST_S) -> DataFrame:
    """ride_id, t, duration, length_m, max_deg of each wheelie of the smoothed samples (ride_id, t, x, y, z, speed_kmh).

    One starts at ``tilt_deg`` off the riding position and ends 5 degrees below that or below riding speed, which is the last known speed (null: not
    riding); one that still goes on at the end of a ride does not count, nor one longer than ``longest_s``, after which the position is learnt
    anew. Samples of equal times are taken in the order of x, y, z; rows with a null ride, time or axis are left out.
    """
    kind = dict(samples.dtypes)["ride_id"]
    whole = samples.select("ride_id", *[samples[c].cast("double").alias(c) for c in ("t", "x", "y", "z", "speed_kmh")]).dropna(subset=["ride_id", "t", "x", "y", "z"])
    columns = ["ride_id", "t", "duration", "length_m", "max_deg"]

    def through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ride, rider = None, None
        for batch in batches:
            out = []
            for own, t, x, y, z, kmh in zip(batch["ride_id"].tolist(), *[batch[c].tolist() for c in ("t", "x", "y", "z", "speed_kmh")]):
                if rider is None or own != ride:
                    ride, rider = own, Rider(tilt_deg, least_s, window, warm_up, every, longest_s)
                found = rider.sample(t, (x, y, z), math.nan if kmh is None else kmh)
                if found:
                    out.append([own, *found])
            yield pd.DataFrame(out, columns=columns)

    return whole.repartition("ride_id").sortWithinPartitions("ride_id", "t", "x", "y", "z").mapInPandas(through, f"ride_id {kind}, t double, duration double, length_m double, max_deg double")
