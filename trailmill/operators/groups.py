"""Group operators: the best row, votes, the shown report, ranks, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import saved


def best_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in an order, which should end in a unique column."""
    at = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__at", at).filter("__at = 1").drop("__at")


def upper_median(value: Column) -> Column:
    """Aggregate: element n // 2 of the n sorted non-null values (of an even number the upper middle one)."""
    ordered = F.sort_array(F.collect_list(value))
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def upper_median_of_groups(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, median: the upper median by counting equal values first, so that no group is gathered."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    group = W.partitionBy(*keys)
    upto = F.sum("__n").over(group.orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("__n").over(group)
    placed = counts.withColumns({"__upto": upto, "__total": total})
    return placed.filter(F.floor(F.col("__total") / 2) < F.col("__upto")).groupBy(*keys).agg(F.min(value).alias("median"))


def true_median_of_groups(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, median: the mean of both middle values, by counting equal values first and then rows of coarse ranges of the value.

    A group's values are dealt to ranges by the exponent and six bits of their size; running sums go over the few ranges, and only the rows of
    the ranges that hold a middle row are put in order, so no group is gathered.
    """
    size = F.when(F.col(value) == 0, F.lit(0.0)).otherwise(F.signum(value) * (F.floor(F.log2(F.abs(value)) * 64) + 100_000))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n")).withColumn("__range", size)
    order = W.partitionBy(*keys)
    upto = lambda by: F.sum("__n").over(order.orderBy(by).rowsBetween(W.unboundedPreceding, 0))
    ranges = counts.groupBy(*keys, "__range").agg(F.sum("__n").alias("__n")).withColumns({"__upto": upto("__range"), "__total": F.sum("__n").over(order)})
    low, high = F.floor((F.col("__total") + 1) / 2), F.floor(F.col("__total") / 2) + 1
    held = ranges.withColumns({"__low": low, "__high": high, "__before": F.col("__upto") - F.col("__n")})
    held = held.filter((F.col("__before") < F.col("__high")) & (F.col("__upto") >= F.col("__low"))).select(*keys, "__range", "__before", "__low", "__high")
    inside = W.partitionBy(*keys, "__range").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    placed = counts.join(held, [*keys, "__range"]).withColumn("__upto", F.col("__before") + F.sum("__n").over(inside))
    middle = placed.filter((F.col("__upto") >= F.col("__low")) & (F.col("__upto") - F.col("__n") < F.col("__high")))
    return middle.groupBy(*keys).agg(((F.min(value) + F.max(value)) / 2).alias("median"))


def true_median(value: Column) -> Column:
    """Aggregate: the mean of both middle values where their number is even."""
    return F.percentile(value, F.lit(0.5))


def strict_majority(vote: Column) -> Column:
    """Aggregate: do more than half of the non-null votes hold?"""
    return F.count_if(vote) * 2 > F.count(vote)


def own_or_majority(vote: Column, mine: Column) -> Column:
    """Aggregate: one's own vote, else the strict majority."""
    return F.coalesce(F.bool_or(F.when(mine, vote)), strict_majority(vote))


def top_categories(df: DataFrame, keys: Sequence[str], category: str, rank_of: Column, k: int = 2) -> DataFrame:
    """The k most frequent categories of each group, ties in the order of ``rank_of``: keys, category, n, place."""
    counts = df.filter(F.col(category).isNotNull()).groupBy(*keys, category).agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), rank_of))
    return counts.withColumn("place", place).filter(F.col("place") <= k)


def vote_range(value: Column) -> list[Column]:
    """Aggregates: least, greatest and number of non-null votes."""
    return [F.min(value).alias("least"), F.max(value).alias("greatest"), F.count(value).alias("votes")]


def shown_reports(df: DataFrame, keys: Sequence[str], at: str, tie: str, confirmed: Column) -> DataFrame:
    """For each group the latest confirmed report, and the latest unconfirmed one if it is strictly newer.

    Of equal times the smallest ``tie`` counts. Adds ``confirmed`` to the columns of ``df``.
    """
    marked = df.withColumn("confirmed", F.coalesce(confirmed, F.lit(False)))
    latest = best_per_group(marked, [*keys, "confirmed"], [F.desc(at), F.asc(tie)])
    sure = F.max(F.when(F.col("confirmed"), F.col(at))).over(W.partitionBy(*keys))
    return latest.withColumn("__sure", sure).filter(F.col("confirmed") | F.col("__sure").isNull() | (F.col(at) > F.col("__sure"))).drop("__sure")


def competition_rank(keys: Sequence[str], order: Sequence[Column]) -> Column:
    """Rank with equal places for ties and gaps after them."""
    return F.rank().over(W.partitionBy(*keys).orderBy(*order))


def ranking_shown(df: DataFrame, keys: Sequence[str], order: Sequence[Column], tie: Sequence[Column], mine: Column, top: int = 3) -> DataFrame:
    """The first ``top`` rows of each ranking and one's own, with their competition rank as ``place``."""
    row = F.row_number().over(W.partitionBy(*keys).orderBy(*order, *tie))
    return df.withColumns({"place": competition_rank(keys, order), "__row": row}).filter((F.col("__row") <= top) | mine).drop("__row")


def king_counts(df: DataFrame, group: str, player: str, value: str, least_players: int = 2) -> DataFrame:
    """How often each player leads a group of at least so many players: player, crowns."""
    best = df.groupBy(group, player).agg(F.max(value).alias("__best"))
    over = W.partitionBy(group)
    ranked = best.withColumns({"__place": F.rank().over(over.orderBy(F.desc("__best"))), "__players": F.count("*").over(over)})
    return ranked.filter((F.col("__place") == 1) & (F.col("__players") >= least_players)).groupBy(player).agg(F.count("*").alias("crowns"))


def greatest_upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], best: str, dated: str, other: str) -> DataFrame:
    """Merge personal bests: ``best`` and ``other`` keep their maximum each, ``dated`` follows ``best`` if strictly greater.

    Adds ``changed``: does the new table improve the row?
    """
    a = old.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in (best, dated, other)])
    b = new.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in (best, dated, other)])
    both = a.join(b, list(keys), "full_outer")
    better = F.coalesce(F.col(f"__new_{best}") > F.col(f"__old_{best}"), F.col(f"__old_{best}").isNull())
    longer = F.coalesce(F.col(f"__new_{other}") > F.col(f"__old_{other}"), F.col(f"__old_{other}").isNull())
    return both.select(
        *keys,
        F.greatest(f"__old_{best}", f"__new_{best}").alias(best),
        F.when(better, F.col(f"__new_{dated}")).otherwise(F.col(f"__old_{dated}")).alias(dated),
        F.greatest(f"__old_{other}", f"__new_{other}").alias(other),
        (better | longer).alias("changed"),
    )


def superseded(df: DataFrame, keys: Sequence[str], at: str, tie: str, before: Column) -> DataFrame:
    """Rows older than a date that have a newer row of the same key; the newest of a key always stays."""
    row = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie)))
    return df.withColumn("__row", row).filter((F.col("__row") > 1) & (F.col(at) < before)).drop("__row")


def changed_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before in their group; the first row of a group stays."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(*order))
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1
    return df.withColumns({"__before": before, "__first": first}).filter(F.col("__first") | ~F.col(value).eqNullSafe(F.col("__before"))).drop("__before", "__first")


def first_and_last_events(df: DataFrame, keys: Sequence[str], at: str, tie: str, first: Column, last: Column) -> DataFrame:
    """For each group when it was first asked and what was answered last (of equal times the later row)."""
    return df.groupBy(*keys).agg(
        F.min(F.when(first, F.col(at))).alias("asked_at"),
        F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.when(last, F.struct(at, tie))).alias("answer"),
    )


def limit_by_running_sum(df: DataFrame, order: Sequence[Column], weight: str, limit: Column | float) -> DataFrame:
    """Rows that lie within a budget in an order (least recently used ones go): a running sum over all rows."""
    return in_order_of_all(df, order, weight).filter(F.col("__upto") <= limit).drop("__upto", "__place")


def in_order_of_all(df: DataFrame, order: Sequence[Column], weight: str | None = None) -> DataFrame:
    """Rows with ``__place`` (1 and up) and, for a weight, ``__upto`` (its running sum) in an order of the whole table.

    Rows are dealt to ranges of the order; the sums of the ranges, one row for each, go to the driver, and each range goes on
    from the sum of those before it.
    """
    own = F.monotonically_increasing_id()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.col(weight) if weight else F.lit(0)
    ranged = saved(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", own), "ordered")
    ranged = ranged.withColumn("__range", F.shiftright("__at", 33))
    before, rows, offsets = 0, 0, []
    for part, n, total in sorted(ranged.groupBy("__range").agg(F.count("*"), F.sum(value)).collect()):
        offsets.append((part, rows, before))
        rows, before = rows + n, before + (total or 0)
    kind = ranged.select(F.sum(value).alias("s")).schema["s"].dataType.simpleString()
    table = df.sparkSession.createDataFrame(offsets, f"__range long, __rows long, __sum {kind}")
    inside = W.partitionBy("__range").orderBy("__at").rowsBetween(W.unboundedPreceding, 0)
    told = ranged.join(F.broadcast(table), "__range").withColumn("__place", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__rows") + 1)
    if weight:
        told = told.withColumn("__upto", F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("__sum"))
    return told.drop("__at", "__range", "__rows", "__sum")


def pairs_within(df: DataFrame, key: str, item: str, block: int = 1024) -> DataFrame:
    """key, a, b: each two items of a key, a < b, once. Keys of many items are dealt to blocks, and each two blocks meet in a task of their own."""
    sizes = df.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("__blocks"))
    sized = df.select(key, item).join(sizes, key)
    own, every = F.pmod(F.xxhash64(item), "__blocks").cast("int"), F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))
    a = sized.select(key, F.col(item).alias("a"), own.alias("__i"), every.alias("__j"))
    b = sized.select(key, F.col(item).alias("b"), own.alias("__j"), every.alias("__i"))
    return a.join(b, [key, "__i", "__j"]).filter("a < b").select(key, "a", "b")


def display_name(df: DataFrame, key: str, name: str, mine: Column, first_at: str, tie: str) -> DataFrame:
    """Each group's name: one's own, else that of the oldest contributor who has one; key, name, other_names."""
    named = df.filter(F.nullif(F.trim(name), F.lit("")).isNotNull())
    shown = best_per_group(named.withColumn("__mine", mine), [key], [F.desc("__mine"), F.asc(first_at), F.asc(tie)]).select(key, F.col(name).alias("name"))
    names = named.groupBy(key).agg(F.sort_array(F.collect_set(name)).alias("__names"))
    return shown.join(names, key).select(key, "name", F.array_except("__names", F.array("name")).alias("other_names"))


def digest_of_senders(df: DataFrame, keys: Sequence[str], sender: str, at: str, tie: str) -> DataFrame:
    """Events, first and last time and the senders in the order of their first event, for each recipient."""
    firsts = df.groupBy(*keys, sender).agg(F.min(F.struct(at, tie)).alias("__first"), F.count("*").alias("__n"), F.max(at).alias("__last"))
    return firsts.groupBy(*keys).agg(
        F.sum("__n").alias("events"),
        F.min("__first." + at).alias("first_at"),
        F.max("__last").alias("last_at"),
        F.transform(F.sort_array(F.collect_list(F.struct("__first", sender))), lambda s: s[sender]).alias("senders"),
    )
