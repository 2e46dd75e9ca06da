"""Accounts: messages and devices, claims, limits and cascades, orphaned objects, statistics of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .groups import true_median_of_groups
from .setops import label_counts, symmetric


def taken(queue: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(what is left of a queue, rows whose keys were in it): keys without a row stay."""
    keys = queue.select(key).distinct()
    return queue.join(rows.select(key), key, "left_anti"), rows.join(keys, key, "left_semi")


def per_device(payload: DataFrame, devices: DataFrame, texts: dict[str, Column], fallback: str) -> DataFrame:
    """One row for each device (user_id, token, locale) of each payload row (user_id, ...), with ``title`` in its language."""
    title = texts[fallback]
    for locale, text in texts.items():
        title = F.when(F.col("locale") == locale, text).otherwise(title)
    return payload.join(devices, "user_id").withColumn("title", title)


def grouped_claims(claims: DataFrame) -> DataFrame:
    """trail_id, same_as, reversed (of the first claim), by_users in the order of their claims."""
    rows = F.sort_array(F.collect_list(F.struct("created_at", "user_id")))  # friends who claim one pair are few
    return claims.groupBy("trail_id", "same_as").agg(F.min_by("reversed", F.struct("created_at", "user_id")).alias("reversed"), F.transform(rows, lambda r: r["user_id"]).alias("by_users"))


def moved_bests(bests: DataFrame, aliases: DataFrame) -> DataFrame:
    """Bests (user_id, trail_id, air, longest, month) after trails became others' aliases (user_id, trail_id, same_as).

    Both maxima count; the month is that of the greater air, and the kept trail's own where they are equal.
    """
    moved = bests.join(aliases, ["user_id", "trail_id"], "left").withColumn("own", F.col("same_as").isNull())
    told = moved.withColumn("trail_id", F.coalesce("same_as", "trail_id"))
    return told.groupBy("user_id", "trail_id").agg(F.max("air").alias("air"), F.max("longest").alias("longest"), F.max_by("month", F.struct("air", "own")).alias("month"))


def within_limit(known: DataFrame, new: DataFrame, user: str, order: list[Column], most: int) -> DataFrame:
    """New rows that a user may still add: known ones and those before them count."""
    have = known.groupBy(user).agg(F.count("*").alias("__have"))
    at = F.row_number().over(W.partitionBy(user).orderBy(*order))
    return new.withColumn("__at", at).join(have, user, "left").filter(F.col("__at") + F.coalesce("__have", F.lit(0)) <= most).drop("__at", "__have")


def without_friends(rows: DataFrame, ended: DataFrame, a: str, b: str) -> DataFrame:
    """Rows between two accounts without those whose friendship (requester_id, addressee_id) has ended, in either direction."""
    return rows.join(symmetric(ended, "requester_id", "addressee_id").toDF(a, b), [a, b], "left_anti")


def sweepable(objects: DataFrame, live: DataFrame, key: str, age_hours: str, grace_hours: float) -> DataFrame:
    """Objects without a live row, but for fresh ones; an unknown age counts as old."""
    return objects.join(live.select(key).distinct(), key, "left_anti").filter(F.coalesce(F.col(age_hours) >= grace_hours, F.lit(True)))


def choosers(prefs: DataFrame, friends: DataFrame, me: Column) -> DataFrame:
    """Accounts (user_id) that chose one (buddy_id, chosen, hidden) as theirs, if they are friends (user_id, buddy_id)."""
    return prefs.filter((F.col("buddy_id") == me) & F.col("chosen") & ~F.col("hidden")).join(friends, ["user_id", "buddy_id"], "left_semi").select("user_id")


def conversation(messages: DataFrame, a: Column, b: Column) -> DataFrame:
    """Messages (sender_id, recipient_id, created_at, id) between two accounts, with their ``place`` by time."""
    own = messages.filter(((F.col("sender_id") == a) & (F.col("recipient_id") == b)) | ((F.col("sender_id") == b) & (F.col("recipient_id") == a)))
    pair = W.partitionBy(F.least("sender_id", "recipient_id"), F.greatest("sender_id", "recipient_id"))
    return own.withColumn("place", F.row_number().over(pair.orderBy("created_at", "id")))


def start_choices(points: DataFrame, last_key: Column) -> DataFrame:
    """Start points (user_id, key, name, d) with ``place``: the last used first, then the nearest, then by name."""
    order = W.partitionBy("user_id").orderBy(F.coalesce(F.col("key") == last_key, F.lit(False)).desc(), F.col("d").asc_nulls_last(), F.lower("name"), "key")
    return points.withColumn("place", F.row_number().over(order))


def matcher_statistics(recordings: DataFrame, overlaps: DataFrame) -> DataFrame:
    """label, n: figures of recordings (trail_id, user_id, source) and overlaps (a, b, ab, ba) between trails that have some."""
    trails = recordings.groupBy("trail_id").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("source") == "app").alias("app"))
    alive = trails.select("trail_id")
    edges = overlaps.join(alive.toDF("a"), "a", "left_semi").join(alive.toDF("b"), "b", "left_semi").withColumn("low", F.least("ab", "ba"))
    several = trails.filter("n >= 2").select("trail_id")
    twins = edges.filter("low >= 0.5")
    at_several = twins.join(several.toDF("a"), "a", "left_semi").select("a", "b").unionByName(twins.join(several.toDF("b"), "b", "left_semi").select("a", "b")).distinct()
    count = lambda df, cond="true": df.agg(F.count_if(F.expr(cond)).alias("n"))
    return label_counts(
        users=recordings.agg(F.count_distinct("user_id").alias("n")),
        recordings=count(recordings),
        app=count(recordings, "source = 'app'"),
        planned=count(recordings, "source = 'planned'"),
        trails=count(trails),
        single=count(trails, "n = 1"),
        double=count(trails, "n = 2"),
        several=count(trails, "n >= 3"),
        shared=count(trails, "users >= 2"),
        several_app=count(trails, "n >= 2 and app >= 1"),
        most=trails.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")),
        edges=count(edges),
        twins=count(twins),
        twins_at_several=count(at_several),
    )


def tracks_report(tracks: DataFrame, bounds: list[float]) -> DataFrame:
    """band, n, downhill, middle of tracks (length, gain, loss) by bands of length: how many lose more than twice what they gain, and the median length."""
    band = F.lit(0)
    for k, bound in enumerate(bounds):
        band = F.when(F.col("length") >= bound, k + 1).otherwise(band)
    banded = tracks.withColumn("band", band)
    sums = banded.groupBy("band").agg(F.count("*").alias("n"), F.count_if(F.col("loss") > 2 * F.col("gain")).alias("downhill"))
    return sums.join(true_median_of_groups(banded, ["band"], "length"), "band", "left").withColumnRenamed("median", "middle")


def name_confusion(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """class, same_name, n: classes of pairs (a, b, class) by whether both tracks (line_id, name_key) have one name."""
    both = pairs.join(names.toDF("a", "__a"), "a").join(names.toDF("b", "__b"), "b")
    return both.groupBy("class", (F.col("__a") == F.col("__b")).alias("same_name")).agg(F.count("*").alias("n"))
