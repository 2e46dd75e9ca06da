"""Ordered-sequence operators: islands, intervals, as-of joins, moving statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: Sequence[str], position: str, gap: int = 1, step: int = 1) -> DataFrame:
    """Runs of positions with holes of at most ``gap - 1`` steps: adds ``island``, numbered from 0 in each group."""
    over = W.partitionBy(*keys).orderBy(position)
    new = F.when(F.col(position) - F.lag(position).over(over) > gap * step, 1).otherwise(0)
    return df.withColumn("__new", new).withColumn("island", F.sum("__new").over(over.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def value_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Maximal runs of equal values: adds ``run``, numbered from 0 in each group."""
    over = W.partitionBy(*keys).orderBy(*order)
    new = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(over))).cast("int"), F.lit(0))
    first = F.row_number().over(over) == 1
    return df.withColumn("__new", F.when(first, 0).otherwise(new)).withColumn("run", F.sum("__new").over(over.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def id_ranges(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Ranges of consecutive distinct positions: keys, first, last, n."""
    distinct = df.select(*keys, position).distinct()
    row = F.row_number().over(W.partitionBy(*keys).orderBy(position))
    return distinct.withColumn("__base", F.col(position) - row).groupBy(*keys, "__base").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n")).drop("__base")


def merged_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Unions of overlapping or touching intervals: keys, start, end, parts."""
    over = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(over.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(0)))
    numbered = marked.withColumn("__no", F.sum("__new").over(over.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__no").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("__no")


def free_ranges(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Gaps between the intervals of each group: keys, free_from, free_to (both exclusive)."""
    merged = merged_intervals(df, keys, start, end)
    before = F.lag(end).over(W.partitionBy(*keys).orderBy(start))
    return merged.withColumn("free_from", before).filter(F.col("free_from").isNotNull()).select(*keys, "free_from", F.col(start).alias("free_to"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, flavour: str = "hold", bucket: float | None = None, tie: str | None = None) -> DataFrame:
    """The right side's value at the time of each left row, in one pass over both sides together.

    ``hold``: the last one at or before, else null. ``clamp``: before the first one, the first. ``linear``: interpolated
    between neighbours, clamped at both ends. Times are numbers; of equal right times the last in the order of ``tie`` counts, before
    and after a left row, without it the greatest value before and the least after.
    With a ``bucket`` of time, keys are split into buckets, and what was known before and after each bucket is carried in from a
    table of one row a bucket, so that a hot key is no single task.
    """
    of_tie = dict(right.dtypes)[tie] if tie else "double"
    a = left.withColumns({"__side": F.lit(1), "__value": F.lit(None).cast("double"), "__tie": F.lit(None).cast(of_tie)})
    b = right.select(F.col(key), F.col(at), F.lit(0).alias("__side"), F.col(value).cast("double").alias("__value"), F.col(tie or value).cast(of_tie).alias("__tie"))
    both = a.unionByName(b, allowMissingColumns=True)
    known = F.when(F.col("__side") == 0, F.struct(F.col(at).cast("double").alias("t"), F.col("__value").alias("v")))
    keys = [key] if bucket is None else [key, "__bucket"]
    none = F.lit(None).cast("struct<t:double,v:double>")
    if bucket is None:
        both = both.withColumns({"__carried": none, "__coming": none})
    else:
        both = both.withColumn("__bucket", F.floor(F.col(at) / bucket))
        placed = F.when(F.col("__side") == 0, F.struct(F.col(at).alias("t"), F.col("__tie").alias("tie")))
        back = F.when(F.col("__side") == 0, F.struct((-F.col(at)).alias("t"), F.col("__tie").alias("tie")))
        sums = both.groupBy(*keys).agg(F.max_by(known, placed).alias("__last"), (F.min(known) if tie is None else F.max_by(known, back)).alias("__first"))
        line = W.partitionBy(key).orderBy("__bucket")
        carried = F.last("__last", True).over(line.rowsBetween(W.unboundedPreceding, -1))
        coming = F.first("__first", True).over(line.rowsBetween(1, W.unboundedFollowing))
        both = both.join(sums.select(*keys, carried.alias("__carried"), coming.alias("__coming")), keys)
    over = W.partitionBy(*keys).orderBy(at, "__side", "__tie")
    both = both if tie is None else both.withColumn("__again", (F.lead(at).over(over) == F.col(at)) & (F.lead("__side").over(over) == 0))
    last = known if tie is None else F.when(~F.coalesce("__again", F.lit(False)), known)
    both = both.withColumns(
        {
            "__before": F.coalesce(F.last(known, True).over(over.rowsBetween(W.unboundedPreceding, 0)), "__carried"),
            "__after": F.coalesce(F.first(last, True).over(over.rowsBetween(0, W.unboundedFollowing)), "__coming"),
        }
    )
    held, nxt = F.col("__before.v"), F.col("__after.v")
    share = (F.col(at) - F.col("__before.t")) / (F.col("__after.t") - F.col("__before.t"))
    found = {
        "hold": held,
        "clamp": F.coalesce(held, nxt),
        "linear": F.coalesce(F.when(F.col("__before.t") == F.col(at), held), held + (nxt - held) * share, held, nxt),
    }[flavour]
    return both.withColumn(f"{value}_at", found).filter("__side = 1").drop("__side", "__value", "__before", "__after", "__carried", "__coming", "__bucket", "__tie", "__again")


def near_in_time(left: DataFrame, right: DataFrame, key: str, at: str, reach: float, left_id: str, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates over right rows within ``reach`` of each left row: an equi-join on time buckets, then the exact test."""
    bucket = F.floor(F.col(at) / reach)
    a = left.select(left_id, key, F.col(at).alias("__t"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("__b"))
    b = right.withColumn("__b", bucket)
    near = a.join(b, [key, "__b"]).filter(F.abs(F.col(at) - F.col("__t")) <= reach)
    found = near.groupBy(left_id).agg(*aggregates)
    return left.join(found, left_id, "left")


def moving_median(value: Column, keys: Sequence[str], order: Sequence[str], reach: int = 3) -> Column:
    """The true median of the 2 * reach + 1 rows around each row, fewer at the ends."""
    around = F.sort_array(F.collect_list(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(-reach, reach)))
    n = F.size(around)
    return (F.get(around, F.floor((n - 1) / 2).cast("int")) + F.get(around, F.floor(n / 2).cast("int"))) / 2


def moving_mean(value: Column, keys: Sequence[str], order: Sequence[str], reach: int = 1) -> Column:
    """The mean of the rows around each row, fewer at the ends."""
    return F.avg(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(-reach, reach))


def is_peak(value: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Is a value strictly above both its neighbours?"""
    over = W.partitionBy(*keys).orderBy(*order)
    return F.coalesce((F.col(value) > F.lag(value).over(over)) & (F.col(value) > F.lead(value).over(over)), F.lit(False))


def thinned(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: int) -> DataFrame:
    """Every ``step``-th row of each group and its last one."""
    over = W.partitionBy(*keys).orderBy(*order)
    at = F.row_number().over(over) - 1
    return df.withColumns({"__at": at, "__n": F.count("*").over(W.partitionBy(*keys))}).filter((F.col("__at") % step == 0) | (F.col("__at") == F.col("__n") - 1)).drop("__at", "__n")


def direction_shares(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Steps of each group and how many go up; ``direction`` is same at 0.7 up or more, reversed at 0.3 or less, else mixed.

    Fewer than three steps are mixed.
    """
    step = F.col(value) - F.lag(value).over(W.partitionBy(*keys).orderBy(*order))
    counted = df.withColumn("__step", step).groupBy(*keys).agg(F.count("__step").alias("steps"), F.count_if(F.col("__step") > 0).alias("ups"))
    share = F.col("ups") / F.col("steps")
    return counted.withColumn("direction", F.when(F.col("steps") < 3, "mixed").when(share >= 0.7, "same").when(share <= 0.3, "reversed").otherwise("mixed"))


def capped_sessions(df: DataFrame, key: str, at: str, tie: str, gap: float, cap: float) -> DataFrame:
    """Debounced sessions: an event joins the open session while it comes before min(last + gap, first + cap).

    Adds ``session``, numbered from 0 in each group. Quiet times of ``gap`` end a session in any case, so each key is first split
    there; only the events of one unquiet stretch are folded in order with the state (first, last).
    """
    over = W.partitionBy(key).orderBy(at, tie)
    quiet = F.coalesce((F.col(at) - F.lag(at).over(over) >= gap).cast("int"), F.lit(0))
    stretches = df.withColumn("__quiet", quiet).withColumn("__stretch", F.sum("__quiet").over(over.rowsBetween(W.unboundedPreceding, 0)))
    events = stretches.groupBy(key, "__stretch").agg(F.sort_array(F.collect_list(F.struct(F.col(at).cast("double").alias("t"), F.col(tie).alias("tie")))).alias("__events"))
    zero = F.struct(
        F.lit(None).cast("double").alias("first"),
        F.lit(-1).cast("long").alias("no"),
        F.expr(f"cast(array() as array<struct<tie:{dict(df.dtypes)[tie]},no:bigint>>)").alias("out"),
    )

    def step(s: Column, e: Column) -> Column:
        same = F.coalesce(e["t"] < s["first"] + cap, F.lit(False))
        no = F.when(same, s["no"]).otherwise(s["no"] + 1)
        return F.struct(F.when(same, s["first"]).otherwise(e["t"]).alias("first"), no.alias("no"), F.concat(s["out"], F.array(F.struct(e["tie"].alias("tie"), no.alias("no")))).alias("out"))

    folded = events.select(key, "__stretch", F.aggregate("__events", zero, step, lambda s: s["out"]).alias("__out"))
    before = F.coalesce(F.sum(F.element_at("__out", -1)["no"] + 1).over(W.partitionBy(key).orderBy("__stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = folded.withColumn("__before", before).select(key, "__before", F.explode("__out").alias("__o"))
    return df.join(numbered.select(key, F.col("__o.tie").alias(tie), (F.col("__before") + F.col("__o.no")).alias("session")), [key, tie])
