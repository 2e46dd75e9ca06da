"""Sharding by a minimax contiguous partition of ordered atoms.

Rows of equal texts form a group, and groups never part. Groups lie in the order of a 16-bit hash of
their text; all groups of one hash value make an atom, so that the ordered atom sizes are at most
65,536 numbers at any corpus size. The smallest feasible shard capacity is found by binary search with a
greedy check over the atoms' prefix sums, and shards are cut there. An atom larger than the mean of
what is left (a hot group of copies) takes a shard of its own, and the rest is cut afresh.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import saved
from .text import partitions, text_or_empty

ATOMS = 1 << 16
#: Bytes that a row counts beside its text.
ROW_BYTES = 16


def feasible(ends: list[int], capacity: int, shards: int) -> bool:
    """Greedy check: do ``shards`` contiguous runs of at most ``capacity`` cover all atoms?"""
    start = 0
    for _ in range(shards):
        at = bisect_right(ends, start + capacity) - 1
        if at == len(ends) - 1:
            return True
        start = ends[at] if at >= 0 else start
    return False


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity for which ``feasible`` holds."""
    if not sizes:
        return 0
    ends = list(accumulate(sizes))
    low, high = max([*sizes, -(-sum(sizes) // shards)]), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(ends, middle, shards) else (middle + 1, high)
    return low


def cut(sizes: list[int], shards: int) -> list[int]:
    """Positions before which shards 1, 2, ... begin; no shard exceeds the smallest capacity.

    Of the positions that the capacity allows, each is the one closest to an even share.
    """
    capacity, before = smallest_capacity(sizes, shards), [0, *accumulate(sizes)]
    earliest, at = [0] * (shards + 1), len(sizes)
    for shard in range(shards - 1, 0, -1):  # how early each shard may begin, seen from the end
        at = earliest[shard] = bisect_left(before, before[at] - capacity)
    cuts, at = [], 0
    for shard in range(1, shards):
        latest = bisect_right(before, before[at] + capacity) - 1
        share = before[at] + (before[-1] - before[at]) / (shards - shard + 1)
        near = bisect_left(before, share)
        if near and share - before[near - 1] < before[min(near, len(sizes))] - share:
            near -= 1
        at = max(earliest[shard], min(near, latest), at)
        cuts.append(at)
    return cuts


@dataclass
class ShardPlan:
    """Where atoms go: hot atoms to a shard of their own, others by cuts in atom order."""

    hot: list[int] = field(default_factory=list)
    cuts: list[int] = field(default_factory=list)

    def shard(self, atom: Column) -> Column:
        """The shard of an atom, as an expression without a join."""
        place = F.lit(len(self.hot))
        for at in self.cuts:
            place = place + (atom >= at).cast("int")
        for shard, hot in enumerate(self.hot):
            place = F.when(atom == hot, shard).otherwise(place)
        return place.cast("int")


def plan_shards(sizes: dict[int, int], shards: int, atoms: int = ATOMS) -> ShardPlan:
    """The plan for atom sizes given by atom number."""
    left, hot = sum(sizes.values()), []
    for atom in sorted(sizes, key=lambda a: (-sizes[a], a)):
        if len(hot) == shards - 1 or sizes[atom] * (shards - len(hot)) <= left:
            break
        hot.append(atom)
        left -= sizes[atom]
    apart = set(hot)
    ordered = [0 if atom in apart else sizes.get(atom, 0) for atom in range(atoms)]
    return ShardPlan(hot, cut(ordered, shards - len(hot)) if left else [])


def shard_documents(docs: DataFrame, shards: int = 40, atoms: int = ATOMS) -> DataFrame:
    """Put every row into a shard and number the rows of each shard without gaps.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard, atom. Null and empty texts count
    ``ROW_BYTES`` and form one group; repeated rows each get a slot; an empty table gives no rows;
    other columns are not read. Slots follow doc_id within a shard (null first).
    """
    spark = docs.sparkSession
    text = text_or_empty(docs["text"])
    rows = saved(
        docs.select(
            docs["doc_id"].alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.pmod(F.xxhash64(text), F.lit(atoms)).cast("int").alias("atom"),
        ),
        "shard-rows",
    )
    sizes = {r[0]: r[1] for r in rows.groupBy("atom").agg(F.sum("size")).collect()}  # at most one row an atom
    plan = plan_shards(sizes, shards, atoms)
    placed = rows.withColumn("shard", plan.shard(F.col("atom")))
    numbered = saved(numbered_by_partition(placed, "shard", "doc_id", "text_crc32"), "shard-slots")
    return with_slots(numbered, spark)


def numbered_by_partition(rows: DataFrame, *order: str) -> DataFrame:
    """Range-partitioned rows with their partition and their place in it."""
    spread = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    return spread.withColumn("place", place).withColumn("part", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1))


def with_slots(numbered: DataFrame, spark: SparkSession) -> DataFrame:
    """Slots from places: a shard's rows in earlier partitions come first.

    The runs (one for each partition and each shard in it) number at most partitions + shards.
    """
    runs = sorted(numbered.groupBy("shard", "part").agg(F.min("place"), F.count("*")).collect())
    before, last, offsets = 0, None, []
    for shard, part, first, n in runs:
        before = before if shard == last else 0
        offsets.append((shard, part, before - first))
        before, last = before + n, shard
    table = spark.createDataFrame(offsets, "shard int, part long, offset long")
    return numbered.join(F.broadcast(table), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") + F.col("offset")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "atom"
    )


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
