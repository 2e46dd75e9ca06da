"""The trail network: contributions become trails, trails become a mart, duplicates are merged, old rows are swept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import line_length
from . import groups as G
from .graphs import resolved_chains, without_cycles
from .matching import OVERLAP, covered_pairs, matched_pairs

# Least length of a recording, contributions a day, days that rows are kept, days until a warning is asked about again.
LEAST_M, DAILY, KEEP_DAYS, CONTENT_DAYS, ASK_DAYS, SNOOZE_DAYS, FRESH_DAYS = 50.0, 500, 90, 180, 30, 14, 7


def accepted_recordings(known: DataFrame, new: DataFrame) -> DataFrame:
    """New recordings (recording_id, user_id, client_id, created_at, points) that count, without repeated points.

    A client id that is known or came before counts once; a user has so many a day; short ones do not count.
    """
    once = new.filter("client_id is null").unionByName(G.best_per_group(new.filter("client_id is not null"), ["user_id", "client_id"], [F.asc("created_at"), F.asc("recording_id")]))
    fresh = once.join(known.filter("client_id is not null").select("user_id", "client_id").distinct(), ["user_id", "client_id"], "left_anti")
    at = F.row_number().over(W.partitionBy("user_id", F.to_date("created_at")).orderBy("created_at", "recording_id"))
    allowed = fresh.withColumn("__at", at).filter(F.col("__at") <= DAILY).drop("__at")
    clean = F.filter("points", lambda p, k: (k == 0) | (p["x"] != F.get("points", k - 1)["x"]) | (p["y"] != F.get("points", k - 1)["y"]))
    return allowed.withColumn("points", clean).filter((F.size("points") >= 2) & (line_length(F.col("points")) >= LEAST_M)).select(*new.columns)


def placed_recordings(known: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placements, overlaps) of new recordings against known ones (recording_id, trail_id, user_id, quality, created_at, reversed, points).

    Placements are recording_id, trail_id, reversed, is_new: the trail whose representative matches with the largest smaller coverage,
    with the directions combined, or else a trail of its own. Overlaps are the edges of new trails to trails they share a part
    with. Recordings of one batch do not see each other; batches follow each other.
    """
    best = G.best_per_group(known, ["trail_id"], [F.desc("quality"), F.asc("created_at"), F.asc("recording_id")])
    lines = best.select(F.concat(F.lit("k|"), "recording_id").alias("line_id"), "points").unionByName(new.select(F.concat(F.lit("n|"), "recording_id").alias("line_id"), "points"))
    # "k|" sorts before "n|", so that a is the known one
    pairs = matched_pairs(lines).filter("a like 'k|%' and b like 'n|%'")
    bare = lambda c: F.substring(c, 3, 1 << 20)
    told = pairs.select(bare("b").alias("recording_id"), bare("a").alias("known_id"), "class", F.least("cov_ab", "cov_ba").alias("score"), F.greatest("cov_ab", "cov_ba").alias("most"), "cov_ab", "cov_ba")
    told = told.join(best.select(F.col("recording_id").alias("known_id"), "trail_id", F.col("reversed").alias("__known"), "created_at"), "known_id")
    same = told.filter("class in ('same', 'same-reversed')")
    hit = G.best_per_group(same, ["recording_id"], [F.desc("score"), F.asc("created_at"), F.asc("known_id")]).select("recording_id", "trail_id", ((F.col("class") == "same-reversed") != F.coalesce("__known", F.lit(False))).alias("reversed"))
    placed = new.select("recording_id").join(hit, "recording_id", "left").select("recording_id", F.coalesce("trail_id", F.concat(F.lit("t-"), "recording_id")).alias("trail_id"), F.coalesce("reversed", F.lit(False)).alias("reversed"), F.col("trail_id").isNull().alias("is_new"))
    apart = told.filter(F.col("most") >= OVERLAP).join(placed.filter("is_new").select("recording_id", F.col("trail_id").alias("new_trail")), "recording_id")
    overlaps = G.best_per_group(apart, ["new_trail", "trail_id"], [F.asc("recording_id")]).select(F.col("new_trail").alias("a"), F.col("trail_id").alias("b"), F.col("cov_ba").alias("coverage_ab"), F.col("cov_ab").alias("coverage_ba"))
    return placed, overlaps


def trail_mart(recordings: DataFrame, details: DataFrame, reports: DataFrame, viewer: str) -> DataFrame:
    """One row for each trail: best recording, grades, rating, two-way, traits, name, status and condition.

    recordings (trail_id, recording_id, user_id, quality, created_at), details (trail_id, user_id, name, grade, traits, rating,
    two_way, created_at), reports (trail_id, id, kind, status, condition, confirmed, reported_at).
    """
    best = G.best_per_group(recordings, ["trail_id"], [F.desc("quality"), F.asc("created_at"), F.asc("recording_id")]).select("trail_id", F.col("recording_id").alias("best_recording"))
    first = recordings.groupBy("trail_id", "user_id").agg(F.min("created_at").alias("__first"))
    mine = F.col("user_id") == viewer
    votes = details.groupBy("trail_id").agg(
        F.min("grade").alias("grade_min"), F.max("grade").alias("grade_max"), G.upper_median(F.col("grade")).alias("grade"), G.upper_median(F.col("rating")).alias("rating"), G.own_or_majority(F.col("two_way"), mine).alias("two_way"), F.count("*").alias("contributors")
    )  # contributors of one trail are few
    traits = G.top_categories(details.select("trail_id", F.explode("traits").alias("trait")), ["trail_id"], "trait", F.asc("trait")).groupBy("trail_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "trait"))), lambda s: s["trait"]).alias("traits"))
    named = details.join(first, ["trail_id", "user_id"], "left").withColumn("__at", F.coalesce("__first", "created_at"))
    names = G.display_name(named, "trail_id", "name", mine, "__at", "user_id")
    shown = G.shown_reports(reports, ["trail_id", "kind"], "reported_at", "id", F.col("confirmed"))
    sure = shown.filter("confirmed").groupBy("trail_id").agg(F.max(F.when(F.col("kind") == "status", F.col("status"))).alias("status"), F.max(F.when(F.col("kind") == "condition", F.col("condition"))).alias("condition"))
    out = best
    for part in (votes, traits, names, sure):
        out = out.join(part, "trail_id", "left")
    return out.withColumn("status", F.coalesce("status", F.lit("open")))


def chosen_merges(edges: DataFrame) -> DataFrame:
    """node, target, flip: one merge for each duplicate, own ones before those folded from others, without cycles.

    edges (node, target, flip, own, by_users, created_at): of several the one with most users, then the older, then the smaller target.
    """
    best = G.best_per_group(edges, ["node"], [F.desc("own"), F.desc("by_users"), F.asc("created_at"), F.asc("target")])
    return without_cycles(best.select("node", "target", "flip"), F.col("node"))


def relabelled(children: DataFrame, merges: DataFrame) -> DataFrame:
    """Child rows (trail_id, reversed) moved to where their trail's chain of merges ends, with the directions combined."""
    ends = resolved_chains(merges)
    moved = children.join(ends.select(F.col("node").alias("trail_id"), "root", F.col("flip").alias("__flip")), "trail_id", "left")
    return moved.withColumn("reversed", F.coalesce("reversed", F.lit(False)) != F.coalesce("__flip", F.lit(False))).withColumn("trail_id", F.coalesce("root", "trail_id")).drop("root", "__flip")


def merged_details(kept: DataFrame, dropped: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Details of a kept trail filled up, field by field, with those of a dropped one."""
    other = dropped.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    both = kept.join(other, key, "full_outer")
    return both.select(key, *[F.coalesce(f, f"__{f}").alias(f) for f in fields])


def merge_candidates(shares: DataFrame, contributors: DataFrame, least: float = 0.5) -> DataFrame:
    """a, b, share, keep: pairs near enough to be declared one trail; the one with more contributors, or else the older, is kept."""
    c = contributors.select("trail_id", "contributors", "first_at")
    x = shares.filter(F.col("share") >= least).join(c.toDF("a", "na", "ta"), "a").join(c.toDF("b", "nb", "tb"), "b")
    keep_a = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & ((F.col("ta") < F.col("tb")) | ((F.col("ta") == F.col("tb")) & (F.col("a") < F.col("b")))))
    return x.select("a", "b", "share", F.when(keep_a, F.col("a")).otherwise(F.col("b")).alias("keep"))


def attached_heights(recordings: DataFrame, heights: DataFrame, reach: float = 0.05) -> DataFrame:
    """recording_id, ele of recordings whose points all lie within ``reach`` of a height series of as many points.

    Both sides are (recording_id, points of x and y); heights have ``ele``.
    """
    other = heights.select("recording_id", F.col("points").alias("__p"), "ele")
    fits = (F.size("points") == F.size("__p")) & F.forall(F.zip_with("points", "__p", lambda a, b: F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2) <= reach), lambda ok: ok)
    return recordings.join(other, "recording_id").filter(fits).select("recording_id", "ele")


def without_contribution(tables: dict[str, DataFrame], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables (trail_id, user_id, ...) without the rows of withdrawn contributions, and how many went: table, n."""
    kept = {name: df.join(gone, ["trail_id", "user_id"], "left_anti") for name, df in tables.items()}
    counts = None
    for name, df in tables.items():
        n = df.join(gone, ["trail_id", "user_id"], "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        counts = n if counts is None else counts.unionByName(n)
    return kept, counts


def questions_due(reports: DataFrame, viewer: str, now: Column, snoozed: DataFrame) -> DataFrame:
    """trail_id, kind of one's own latest warnings that are still shown, 30 days old, and not snoozed within 14 days.

    reports (trail_id, id, user_id, kind, warns, confirmed, reported_at), snoozed (trail_id, kind, at).
    """
    shown = G.shown_reports(reports, ["trail_id", "kind"], "reported_at", "id", F.col("confirmed")).select("trail_id", "kind", "id")
    own = G.best_per_group(reports.filter(F.col("user_id") == viewer), ["trail_id", "kind"], [F.desc("reported_at"), F.asc("id")])
    days = lambda n: F.expr(f"interval {n} days")
    due = own.filter(F.col("warns") & (F.col("reported_at") <= now - days(ASK_DAYS))).join(shown, ["trail_id", "kind", "id"], "left_semi")
    return due.join(snoozed.filter(F.col("at") > now - days(SNOOZE_DAYS)), ["trail_id", "kind"], "left_anti").select("trail_id", "kind")


def fresh_notes(notes: DataFrame, viewer: str, seen: DataFrame, now: Column) -> DataFrame:
    """Notes (id, user_id, created_at) of others of the last seven days that were not seen."""
    return notes.filter((F.col("user_id") != viewer) & (F.col("created_at") >= now - F.expr(f"interval {FRESH_DAYS} days"))).join(seen.select("id"), "id", "left_anti")


def swept(rows: DataFrame, keys: list[str], at: str, tie: str, now: Column, days: int = KEEP_DAYS) -> DataFrame:
    """Rows without those that are too old, but the newest of each key always stays."""
    row = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie)))
    return rows.withColumn("__row", row).filter((F.col("__row") == 1) | (F.col(at) >= now - F.expr(f"interval {days} days"))).drop("__row")


def prefilled(own: DataFrame, mart: DataFrame, fields: list[str]) -> DataFrame:
    """trail_id and the fields of one's own contribution, filled up from the mart."""
    other = mart.select("trail_id", *[F.col(f).alias(f"__{f}") for f in fields])
    return other.join(own.select("trail_id", *fields), "trail_id", "left").select("trail_id", *[F.coalesce(f, f"__{f}").alias(f) for f in fields])


def trim_candidates(lines: DataFrame) -> DataFrame:
    """a, b: line a wholly contains b, but not the other way round."""
    pairs = covered_pairs(lines)
    found = lambda a, b: F.when((F.col(a) >= 0.8) & (F.col(b) < 0.8), True)
    way = lambda when, a, b: F.when(when, F.struct(F.col(a).alias("a"), F.col(b).alias("b")))
    inside = F.coalesce(way(found("cov_ab", "cov_ba"), "b", "a"), way(found("cov_ba", "cov_ab"), "a", "b"))
    return pairs.select(inside.alias("p")).filter("p is not null").select("p.a", "p.b")
