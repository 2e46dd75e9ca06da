"""Who sees what: rows visible to viewers, given as data and never taken from a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .setops import symmetric


def accepted(friendships: DataFrame) -> DataFrame:
    """viewer, owner: both directions of accepted friendships (requester, addressee, status)."""
    return symmetric(friendships.filter("status = 'accepted'"), "requester", "addressee").toDF("viewer", "owner")


def visible_owners(viewers: DataFrame, friendships: DataFrame, private: DataFrame) -> DataFrame:
    """viewer, owner: themselves, and accepted friends whose contribution is not private (a missing one is shared)."""
    own = viewers.select("viewer", F.col("viewer").alias("owner"))
    friends = accepted(friendships).join(viewers, "viewer", "left_semi").join(private.select("owner").distinct(), "owner", "left_anti")
    return own.unionByName(friends.select("viewer", "owner")).distinct()


def visible_to(viewers: DataFrame, rows: DataFrame, friendships: DataFrame, private: DataFrame) -> DataFrame:
    """Rows (with an owner) beside each viewer (viewer) who sees them."""
    return visible_owners(viewers, friendships, private).join(rows, "owner")


def visible_notes(viewers: DataFrame, notes: DataFrame, trails: DataFrame, friendships: DataFrame, private: DataFrame) -> DataFrame:
    """Notes (owner, trail_id): one's own, or a sharing friend's on a trail (owner, trail_id) that the viewer sees as well."""
    seen = visible_to(viewers, trails, friendships, private).select("viewer", "trail_id").distinct()
    found = visible_to(viewers, notes, friendships, private)
    own = found.filter("viewer = owner")
    return own.unionByName(found.filter("viewer <> owner").join(seen, ["viewer", "trail_id"], "left_semi").select(*own.columns))


def not_blocked(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (viewer, owner) where neither blocks the other (blocker_id, blocked_id)."""
    either = symmetric(blocks, "blocker_id", "blocked_id").toDF("viewer", "owner")
    return rows.join(either, ["viewer", "owner"], "left_anti")


def unexpired(at: Column, now: Column) -> Column:
    """Is a row with an expiry date still there? Without a date it is."""
    return at.isNull() | (at > now)


def may_message(pending: DataFrame, messages: DataFrame, most: int = 3) -> DataFrame:
    """sender_id, recipient_id, left: what each sender may still send while the request is pending."""
    sent = messages.groupBy("sender_id", "recipient_id").agg(F.count("*").alias("__sent"))
    return pending.join(sent, ["sender_id", "recipient_id"], "left").select("sender_id", "recipient_id", F.greatest(F.lit(0), F.lit(most) - F.coalesce("__sent", F.lit(0))).cast("int").alias("left"))


def connection_summary(mine: DataFrame, theirs: DataFrame, known: DataFrame, private: DataFrame) -> DataFrame:
    """One row: trails that both have, those new from the buddy (not known before), those new for the buddy (not private)."""
    a, b = mine.select("trail_id").distinct(), theirs.select("trail_id").distinct()
    shared = a.join(b, "trail_id", "left_semi").agg(F.count("*").alias("shared"))
    fresh = b.join(a, "trail_id", "left_anti").join(known.select("trail_id"), "trail_id", "left_anti").agg(F.count("*").alias("new_from_buddy"))
    given = a.join(b, "trail_id", "left_anti").join(private.select("trail_id"), "trail_id", "left_anti").agg(F.count("*").alias("new_for_buddy"))
    return shared.crossJoin(fresh).crossJoin(given)
