"""Sensor streams: flights, pocket windows, labels against detections, out-of-order merging.

Samples are rows (ride_id, kind, t in seconds, and x, y, z); fixes are (ride_id, t, speed_kmh).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sequences import as_of

# Standard gravity; limits of a flight in g and seconds; window after it; plausible speed in km/h and g.
G, FLIGHT_G, FLIGHT_S, LANDING_S, NEAR_S, RIDING_KMH, PEAK_G = 9.80665, 0.3, 0.15, 0.3, 3.0, 10.0, 8.0
# Pocket windows in seconds, samples and speed that a window needs, calm vibration, windows, rotation.
POCKET_S, POCKET_SAMPLES, POCKET_KMH, CALM, CALM_WINDOWS, ROTATION, SMOOTH_S = 10, 100, 8.0, 4.0, 12, 0.35, 0.15


def norm(x: str = "x", y: str = "y", z: str = "z") -> Column:
    """Length of a vector."""
    return F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y) + F.col(z) * F.col(z))


def flights(samples: DataFrame, fixes: DataFrame, g_limit: float = FLIGHT_G, least_s: float = FLIGHT_S) -> DataFrame:
    """ride_id, t, duration, peak_g, plausible: runs of accelerations below the limit.

    A flight lasts until the first sample after it (or its own last one); the landing peak is the most within the window after
    that; it is plausible if the ride went on before and after and the peak is below ``PEAK_G``.
    """
    over = W.partitionBy("ride_id").orderBy("t")
    low = samples.withColumn("g", norm() / G).withColumn("low", F.col("g") < g_limit).withColumn("next_t", F.lead("t").over(over))
    runs = low.withColumn("new", (F.col("low") & ~F.coalesce(F.lag("low").over(over), F.lit(False))).cast("int")).withColumn("run", F.sum("new").over(over.rowsBetween(W.unboundedPreceding, 0)))
    found = runs.filter("low").groupBy("ride_id", "run").agg(F.min("t").alias("t"), F.coalesce(F.max_by("next_t", "t"), F.max("t")).alias("end")).withColumn("duration", F.col("end") - F.col("t"))
    long = found.filter(F.col("duration") >= least_s).drop("run")
    bucket = lambda c: F.floor(c / LANDING_S)
    after = long.withColumn("b", F.explode(F.sequence(bucket(F.col("end")), bucket(F.col("end") + LANDING_S))))
    peaks = after.join(low.select("ride_id", F.col("t").alias("st"), "g", bucket(F.col("t")).alias("b")), ["ride_id", "b"]).filter((F.col("st") >= F.col("end")) & (F.col("st") <= F.col("end") + LANDING_S)).groupBy("ride_id", "t").agg(F.max("g").alias("peak_g"))
    with_peak = long.join(peaks, ["ride_id", "t"], "left").withColumn("peak_g", F.coalesce("peak_g", F.lit(0.0)))
    before = least_speed(with_peak, fixes, F.col("t") - NEAR_S, F.col("t")).withColumnRenamed("least_kmh", "before_kmh")
    both = least_speed(before, fixes, F.col("end"), F.col("end") + NEAR_S).withColumnRenamed("least_kmh", "after_kmh")
    riding = lambda c: F.coalesce(F.col(c) >= RIDING_KMH, F.lit(False))
    return both.select("ride_id", "t", "duration", "peak_g", (riding("before_kmh") & riding("after_kmh") & (F.col("peak_g") < PEAK_G)).alias("plausible"))


def least_speed(events: DataFrame, fixes: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Events (ride_id, t) with the least speed of fixes between two times, by an equi-join on time buckets."""
    bucket = lambda c: F.floor(c / NEAR_S)
    spread = events.select("ride_id", "t", start.alias("s"), stop.alias("e")).withColumn("b", F.explode(F.sequence(bucket(F.col("s")), bucket(F.col("e")))))
    met = spread.join(fixes.select("ride_id", F.col("t").alias("ft"), "speed_kmh", bucket(F.col("t")).alias("b")), ["ride_id", "b"]).filter(F.col("ft").between(F.col("s"), F.col("e")))
    return events.join(met.groupBy("ride_id", "t").agg(F.min("speed_kmh").alias("least_kmh")), ["ride_id", "t"], "left")


def low_passed(samples: DataFrame, columns: list[str], smooth_s: float = SMOOTH_S) -> DataFrame:
    """First-order low pass over irregular times: each step mixes min(1, dt / smooth) of the new value.

    The recursion is folded over the ordered samples of one window each (ride_id, window), which are some thousands.
    """
    rows = F.sort_array(F.collect_list(F.struct("t", *columns)))
    groups = samples.groupBy("ride_id", "window").agg(rows.alias("rows"))
    zero = F.struct(F.lit(None).cast("double").alias("t"), *[F.lit(0.0).alias(c) for c in columns], F.expr("cast(array() as array<double>)").alias("out"))

    def step(s: Column, r: Column) -> Column:
        k = F.when(s["t"].isNull(), 1.0).otherwise(F.least(F.lit(1.0), (r["t"] - s["t"]) / smooth_s))
        mixed = [s[c] + k * (r[c] - s[c]) for c in columns]
        squares = mixed[0] * mixed[0]
        for m in mixed[1:]:
            squares = squares + m * m
        return F.struct(r["t"].cast("double").alias("t"), *[m.alias(c) for c, m in zip(columns, mixed)], F.concat(s["out"], F.array(squares)).alias("out"))

    squares = F.aggregate("rows", zero, step, lambda s: s["out"])
    mean = F.aggregate(squares, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(squares), F.lit(0))
    return groups.select("ride_id", "window", F.sqrt(mean).alias("rotation"), F.size("rows").alias("gyro_samples"))


def pocket_windows(accel: DataFrame, gyro: DataFrame, fixes: DataFrame) -> DataFrame:
    """ride_id, window, vibration, rotation, calm: ten-second windows with enough samples of both sensors at speed at both ends."""
    window = F.floor(F.col("t") / POCKET_S)
    shaken = accel.withColumn("window", window).groupBy("ride_id", "window").agg(F.stddev_pop(norm()).alias("vibration"), F.count("*").alias("accel_samples"))
    turned = low_passed(gyro.withColumn("window", window), ["x", "y", "z"])
    both = shaken.join(turned, ["ride_id", "window"]).filter((F.col("accel_samples") > POCKET_SAMPLES) & (F.col("gyro_samples") > POCKET_SAMPLES))
    speeds = fixes.select("ride_id", "t", "speed_kmh")
    at_start = as_of(both.withColumn("t", (F.col("window") * POCKET_S).cast("double")), speeds, "ride_id", "t", "speed_kmh", "clamp").withColumnRenamed("speed_kmh_at", "start_kmh").drop("t")
    at_end = as_of(at_start.withColumn("t", ((F.col("window") + 1) * POCKET_S).cast("double")), speeds, "ride_id", "t", "speed_kmh", "clamp").withColumnRenamed("speed_kmh_at", "end_kmh").drop("t", "speed_kmh")
    return at_end.filter((F.col("start_kmh") > POCKET_KMH) & (F.col("end_kmh") > POCKET_KMH)).select("ride_id", "window", "vibration", "rotation", (F.col("vibration") < CALM).alias("calm"))


def in_pocket(windows: DataFrame) -> DataFrame:
    """Calm windows with ``pocket``: does the median rotation of the last twelve calm windows exceed the limit?"""
    over = W.partitionBy("ride_id").orderBy("window").rowsBetween(-(CALM_WINDOWS - 1), 0)
    last = F.sort_array(F.collect_list("rotation").over(over))
    n = F.size(last)
    median = (F.get(last, F.floor((n - 1) / 2).cast("int")) + F.get(last, F.floor(n / 2).cast("int"))) / 2
    return windows.filter("calm").withColumn("pocket", F.when(n >= CALM_WINDOWS, median > ROTATION))


def matched_labels(found: DataFrame, labelled: DataFrame) -> DataFrame:
    """ride_id, found_start, label_start: detections (start, stop) and labels that overlap, each used once at most.

    A pair holds if each is the other's first overlapping partner in time; chains beyond that are resolved in further rounds by calling again
    with what is left.
    """
    a = found.select("ride_id", F.col("start").alias("found_start"), F.col("stop").alias("found_stop"))
    b = labelled.select("ride_id", F.col("start").alias("label_start"), F.col("stop").alias("label_stop"))
    met = a.join(b, "ride_id").filter((F.col("found_start") <= F.col("label_stop")) & (F.col("label_start") <= F.col("found_stop")))
    first_label = F.row_number().over(W.partitionBy("ride_id", "found_start").orderBy("label_start"))
    first_found = F.row_number().over(W.partitionBy("ride_id", "label_start").orderBy("found_start"))
    return met.withColumns({"__a": first_label, "__b": first_found}).filter("__a = 1 and __b = 1").select("ride_id", "found_start", "label_start")


def event_values(events: DataFrame, sections: DataFrame) -> DataFrame:
    """ride_id, first_t, last_t with jumps, air, longest and wheelies of events (kind, t, seconds, plausible) inside, ends included."""
    met = sections.join(events, "ride_id").filter(F.col("t").between(F.col("first_t"), F.col("last_t")))
    jump = (F.col("kind") == "jump") & F.col("plausible")
    sums = met.groupBy("ride_id", "first_t", "last_t").agg(F.count_if(jump).alias("jumps"), F.coalesce(F.sum(F.when(jump, F.col("seconds"))), F.lit(0.0)).alias("air"), F.max(F.when(jump, F.col("seconds"))).alias("longest"), F.count_if(F.col("kind") == "wheelie").alias("wheelies"))
    return sections.join(sums, ["ride_id", "first_t", "last_t"], "left")
