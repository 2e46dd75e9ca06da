"""What kind a recorded track is, by its times and heights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.groups import upper_median

# Speed above which a track was planned and never ridden; lengths of fragments and rides; quality by source.
PLANNED_KMH, FRAGMENT_M, RIDE_M = 60.0, 50.0, 8000.0
QUALITY = {"app": 0.6, "import": 0.4, "planned": 0.1}


def looks_planned(stamps: Column, median_kmh: Column) -> Column:
    """Fewer than two distinct time stamps, or faster than anyone rides."""
    return (F.coalesce(stamps, F.lit(0)) < 2) | F.coalesce(median_kmh > PLANNED_KMH, F.lit(False))


def track_kind(length: Column, gain: Column, loss: Column, planned: Column) -> Column:
    """fragment, planned, trail (mostly downhill) or ride."""
    return F.when(length < FRAGMENT_M, "fragment").when(planned, "planned").when((length < RIDE_M) & (loss > 2 * gain), "trail").otherwise("ride")


def quality_of(source: Column) -> Column:
    """How much a recording of this source is trusted."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in QUALITY.items() for x in pair]), source)


def speed_medians(points: DataFrame, key: str, at: str, km: Column) -> DataFrame:
    """key, stamps, median_kmh from points with the distance ``km`` to the one before and its time in seconds ``at``."""
    from pyspark.sql import Window as W

    hours = (F.col(at) - F.lag(at).over(W.partitionBy(key).orderBy(at))) / 3600
    steps = points.withColumns({"__h": hours, "__km": km})
    return steps.groupBy(key).agg(F.count_distinct(at).alias("stamps"), upper_median(F.when(F.col("__h") > 0, F.col("__km") / F.col("__h"))).alias("median_kmh"))
