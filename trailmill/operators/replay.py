"""Recordings contributed one after another, replayed in parallel with the result of the sequential run.

Each recording joins the trail that it matches best among those that earlier ones have made, or begins a trail; so its choice depends on
all choices before it. The replay guesses all choices, lets every recording choose again against the others' last choices, and repeats until
nothing changes. A choice only reads earlier ones, so the first recording is right after one round, and what depends on right choices is
right a round later: the end is the sequential run, and there is only one such end. Rounds follow the depth of the choices that really hang on each
other, since pools of representatives soon stand still, and areas without a change leave the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import saved
from .graphs import component_labels
from .groups import in_order_of_all


def earlier_pairs(places: DataFrame, pairs: DataFrame) -> DataFrame:
    """place, target, score: each recording with each earlier one that is the same line; ``pairs`` are (a, b, score), once in any order."""
    at = places.select("recording_id", "place")
    met = pairs.join(at.toDF("a", "__a"), "a").join(at.toDF("b", "__b"), "b")
    return met.filter("__a <> __b").groupBy(F.greatest("__a", "__b").alias("place"), F.least("__a", "__b").alias("target")).agg(F.max("score").alias("score"))


def in_pool(state: DataFrame, earlier: DataFrame) -> DataFrame:
    """reps, place, trail, target, score: earlier recordings that stand for their trail when a recording comes; both tables have ``reps``.

    The ``reps`` best of a trail do, by quality, older first (0: all). Only the first ``reps`` of each quality of a trail ever can,
    so a pool holds at most ``reps`` rows for each quality, whatever the size of the trail.
    """
    columns = ["reps", "place", "trail", "target", "score"]
    all_of_them = state.filter("reps = 0").select("reps", F.col("place").alias("target"), "trail")
    nth = F.row_number().over(W.partitionBy("reps", "trail", "quality").orderBy("place"))
    heads = state.filter("reps > 0").select("reps", "trail", "quality", F.col("place").alias("target"), F.col("place")).withColumn("nth", nth).filter(F.col("nth") <= F.col("reps")).drop("place")
    pools = heads.groupBy("reps", "trail").agg(F.collect_list(F.struct("quality", "target")).alias("pool"))
    met = earlier.filter("reps > 0").join(heads.join(pools, ["reps", "trail"]), ["reps", "target"])
    better = F.size(F.filter("pool", lambda p: (p["quality"] > F.col("quality")) & (p["target"] < F.col("place"))))
    few = met.filter(F.col("nth") + better <= F.col("reps")).select(columns)
    return few.unionByName(earlier.filter("reps = 0").join(all_of_them, ["reps", "target"]).select(columns))


def choices(pooled: DataFrame) -> DataFrame:
    """reps, node, target: the recording through which each one joins a trail; of equal scores the older trail, of its recordings the oldest."""
    by_trail = pooled.groupBy("reps", "place", "trail").agg(F.max("score").alias("score"), F.min("target").alias("target"))
    best = F.max_by("target", F.struct("score", (-F.col("trail")).alias("t")))
    return by_trail.groupBy("reps", F.col("place").alias("node")).agg(best.alias("target"))


def led_to(chosen: DataFrame, state: DataFrame, jumps: int = 3) -> DataFrame:
    """reps, place, trail of all that chose: 2^jumps choices on at most, to their end, or to the trail that the row there had before."""
    far, at = chosen, ["reps", "target"]
    for _ in range(jumps):
        far = far.join(far.select("reps", F.col("node").alias("target"), F.col("target").alias("__on")), at, "left").select("reps", "node", F.coalesce("__on", "target").alias("target"))
    going = chosen.select("reps", F.col("node").alias("target"), F.lit(True).alias("__going"))
    known = state.select("reps", F.col("place").alias("target"), F.col("trail").alias("__known"))
    ends = far.join(known, at).join(going, at, "left")
    return ends.select("reps", F.col("node").alias("place"), F.when(F.col("__going"), F.col("__known")).otherwise(F.col("target")).alias("trail"))


def settled(rows: DataFrame, earlier: DataFrame, reps: list[int]) -> DataFrame:
    """reps, place, quality, trail (place of its first recording) of all rows (place, quality), as the run in order gives them for each of ``reps``.

    All runs go through the same rounds; a run without a change in an area leaves it.
    """
    areas, each = component_labels(earlier.select(F.col("place").alias("a"), F.col("target").alias("b"))), F.explode(F.array(*map(F.lit, reps)))
    state = saved(rows.join(areas.toDF("place", "area"), "place", "left").select(each.alias("reps"), "place", "quality", F.coalesce("area", "place").alias("area"), F.col("place").alias("trail")), "replay")
    links = saved(earlier.join(areas.toDF("place", "area"), "place").select(each.alias("reps"), "place", "target", "score", "area"), "replay-links")
    finished = []
    while True:
        chosen = saved(choices(in_pool(state, links)), "replay-chosen")
        after = saved(state.withColumnRenamed("trail", "before").join(led_to(chosen, state), ["reps", "place"], "left").withColumn("trail", F.coalesce("trail", "place")), "replay")
        moved = saved(after.filter("trail <> before").select("reps", "area").distinct(), "replay-moved")
        finished.append(after.join(moved, ["reps", "area"], "left_anti").select("reps", "place", "quality", "trail"))
        if moved.isEmpty():
            return saved(reduce(DataFrame.unionByName, finished), "replayed")
        state = saved(after.drop("before").join(moved, ["reps", "area"], "left_semi"), "replay")
        links = saved(links.join(moved, ["reps", "area"], "left_semi"), "replay-links")


def replayed_each(recordings: DataFrame, pairs: DataFrame, order: list[Column], reps: list[int | None]) -> list[tuple[DataFrame, DataFrame]]:
    """What contributing recordings (recording_id, quality and more) in an order makes of them, and the trails that each one matched, for each of ``reps``.

    ``pairs`` (a, b, score) are recordings of the same line. The first table has recording_id, place, trail_id (the first recording of the
    trail) beside the recordings' columns, the second place and trail (its place). Quality takes few values, such as kinds of source. A
    recording joins the trail of the best score among the ``reps`` best recordings (None: all) of each trail before it.
    """
    rows = saved(in_order_of_all(recordings, order).withColumnRenamed("__place", "place"), "replay-rows")
    earlier = saved(earlier_pairs(rows, pairs), "replay-pairs")
    told = settled(rows.select("place", "quality"), earlier, [n or 0 for n in reps])
    first = rows.select(F.col("place").alias("trail"), F.col("recording_id").alias("trail_id"))
    out = []
    for n in reps:
        own = told.filter(F.col("reps") == (n or 0))
        found = rows.join(own.select("place", "trail"), "place").join(first, "trail")
        out.append((found, in_pool(own, earlier.withColumn("reps", F.lit(n or 0))).select("place", "trail").distinct()))
    return out


def replayed(recordings: DataFrame, pairs: DataFrame, order: list[Column], reps: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``replayed_each`` for one number of representatives."""
    return replayed_each(recordings, pairs, order, [reps])[0]


def replay_statistics(found: DataFrame, matched: DataFrame, name: str) -> DataFrame:
    """contributed, trails, attached, twin_events, twin_pairs, name_groups, name_split of one replay.

    A twin event is a recording that matches two or more trails, a twin pair two trails so matched. Of each name on two or more recordings,
    those on another trail than its first one are split.
    """
    counts = found.agg(F.count("*").alias("contributed"), F.count_if(F.col("trail") == F.col("place")).alias("trails"), F.count_if(F.col("trail") < F.col("place")).alias("attached"))
    events = matched.groupBy("place").count().filter("count > 1").agg(F.count("*").alias("twin_events"))
    both = matched.join(matched.toDF("place", "other"), "place").filter("trail < other").select("trail", "other").distinct().agg(F.count("*").alias("twin_pairs"))
    named = found.groupBy(name).agg(F.count("*").alias("n"), F.min_by("trail", "place").alias("first")).filter("n > 1")
    groups = named.agg(F.count("*").alias("name_groups"))
    split = found.select(name, "trail").join(named, name).agg(F.count_if(F.col("trail") != F.col("first")).alias("name_split"))
    return reduce(lambda a, b: a.join(F.broadcast(b)), [counts, events, both, groups, split])  # one row each
