"""Set operators on keys: differences, pair keys, table comparison, inventory states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pair_key(a: str, b: str) -> list[Column]:
    """An unordered pair as (pair_low, pair_high)."""
    return [F.least(a, b).alias("pair_low"), F.greatest(a, b).alias("pair_high")]


def symmetric(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of undirected edges, once each."""
    return edges.select(a, b).unionByName(edges.select(F.col(b).alias(a), F.col(a).alias(b))).distinct()


def without_pairs(pairs: DataFrame, *vetoes: DataFrame) -> DataFrame:
    """Pairs (pair_low, pair_high) that no veto table holds."""
    for veto in vetoes:
        pairs = pairs.join(veto, ["pair_low", "pair_high"], "left_anti")
    return pairs


def orphans(df: DataFrame, key: str, *children: tuple[DataFrame, str]) -> DataFrame:
    """Rows whose key occurs in none of the child tables."""
    for child, column in children:
        df = df.join(child.select(F.col(column).alias(key)).distinct(), key, "left_anti")
    return df


def wanted_but_missing(wanted: DataFrame, published: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Wanted keys that are published and not stored yet."""
    return wanted.select(key).distinct().join(published, key, "left_semi").join(stored, key, "left_anti")


def compared(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, old, new, state (added, removed, same, changed) of every key of either table."""
    a = old.select(*keys, F.col(value).alias("old"), F.lit(True).alias("__a"))
    b = new.select(*keys, F.col(value).alias("new"), F.lit(True).alias("__b"))
    state = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return a.join(b, list(keys), "full_outer").withColumn("state", state).drop("__a", "__b")


def build_states(builds: DataFrame, family: str, build: str, current: Column) -> DataFrame:
    """State of each build in its family: current, previous (the newest older one), orphan (newer), stale, unnamed."""
    over = W.partitionBy(family)
    now = F.max(F.when(current, F.col(build))).over(over)
    marked = builds.withColumn("__now", now)
    previous = F.max(F.when(F.col(build) < F.col("__now"), F.col(build))).over(over)
    state = (
        F.when(F.col("__now").isNull(), "unnamed")
        .when(F.col(build) == F.col("__now"), "current")
        .when(F.col(build) > F.col("__now"), "orphan")
        .when(F.col(build) == F.col("__previous"), "previous")
        .otherwise("stale")
    )
    return marked.withColumn("__previous", previous).withColumn("state", state).drop("__now", "__previous")


def prunable(states: DataFrame, age_hours: str, grace_hours: float = 48) -> DataFrame:
    """Builds to delete: stale ones now, previous and orphan ones after a grace (an unknown age counts as old)."""
    old = F.coalesce(F.col(age_hours) > grace_hours, F.lit(True))
    return states.filter((F.col("state") == "stale") | (F.col("state").isin("previous", "orphan") & old))


def duplicates(df: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    """Keys that occur more than once, with their sorted units: keys, n, units."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_set(unit)).alias("units")).filter("n > 1")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order: deduplication with a defined survivor."""
    at = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__at", at).filter("__at = 1").drop("__at")


def label_counts(**counts: DataFrame) -> DataFrame:
    """One row (label, n) for each named one-column aggregate."""
    parts = [df.select(F.lit(label).alias("label"), df[df.columns[0]].cast("long").alias("n")) for label, df in counts.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
