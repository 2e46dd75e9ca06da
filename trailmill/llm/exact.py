"""Exact deduplication through an extendible-hash index on shared files.

A text's key is a 64-bit hash of its normalised bytes. A directory over the leading key bits maps to
buckets; it doubles where a bucket holds more keys than its capacity, which splits the bucket by the next bit. Buckets
are ranges of keys, and the task that owns a bucket gets its texts, sorts them by key, compares the bytes of neighbours under one
key and numbers the different texts as a chain: one entry each, with its copies counted and the smallest id
found. Entries are written to shared files, and rows find theirs by bucket, key and digest. Texts of hot keys are combined
in the tasks that read them before they go to the owner.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import saved
from .text import one_spaced, partitions

#: Keys are counted by so many leading bits; a bucket that is still overfull then stays whole with its owner.
MAX_DEPTH = 16
#: Keys in a bucket; fewer where an owner would have under 16 buckets, more where there would be over 2**(MAX_DEPTH - 1) of them.
BUCKET_KEYS = 4096
#: Keys of more rows than HOT_ROWS and this share of all are hot; there are 1 / HOT_SHARE of them at most.
HOT_SHARE, HOT_ROWS = 1e-4, 256


def split_buckets(counts: dict[int, int], capacity: int = BUCKET_KEYS, max_depth: int = MAX_DEPTH) -> list[tuple[int, int]]:
    """Buckets as (prefix, depth), in key order; ``counts`` holds keys by leading ``max_depth`` bits.

    Starts with one bucket and splits overfull ones until all fit or the bits are used up.
    """
    held = {(prefix, max_depth): n for prefix, n in counts.items()}
    for depth in range(max_depth, 0, -1):
        for (prefix, at), n in [x for x in held.items() if x[0][1] == depth]:
            held[prefix >> 1, depth - 1] = held.get((prefix >> 1, depth - 1), 0) + n
    done, todo = [], [(0, 0)]
    while todo:
        prefix, depth = todo.pop()
        if held.get((prefix, depth), 0) > capacity and depth < max_depth:
            todo += [(prefix << 1 | 1, depth + 1), (prefix << 1, depth + 1)]
        else:
            done.append((prefix, depth))
    return done


def directory_of(buckets: list[tuple[int, int]]) -> tuple[int, list[int]]:
    """The global depth, and the bucket number of each of its 2**depth slots."""
    depth = max(d for _, d in buckets)
    return depth, [number for number, (_, d) in enumerate(buckets) for _ in range(1 << (depth - d))]


def owners_of(buckets: list[tuple[int, int]], counts: dict[int, int], tasks: int) -> list[int]:
    """The task that owns each bucket; tasks own ranges of buckets with about as many keys each."""
    total, at, out = sum(counts.values()), 0, []
    found = sorted(counts.items())
    keys, ends = 0, [((prefix + 1) << (MAX_DEPTH - depth)) for prefix, depth in buckets]
    for end in ends:
        out.append(min(tasks - 1, keys * tasks // max(1, total)))
        while at < len(found) and found[at][0] < end:
            keys += found[at][1]
            at += 1
    return out


@dataclass
class ExactIndex:
    """Entries on shared files, the directory that finds a key's bucket and its owner, and how many rows make an entry hot."""

    entries: DataFrame
    directory: DataFrame
    depth: int
    bar: float

    def bucketed(self, rows: DataFrame) -> DataFrame:
        """Add the bucket of column ``key`` and its owner; the directory's size is bounded, so it is broadcast."""
        return rows.withColumn("slot", leading_bits(F.col("key"), self.depth)).join(F.broadcast(self.directory), "slot").drop("slot")


def leading_bits(key: Column, bits: int) -> Column:
    """The leading bits of a 64-bit key, as a number."""
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


def keyed(docs: DataFrame, key_bits: int = 64) -> DataFrame:
    """doc_id, normalised text and its key, of which ``key_bits`` leading bits count."""
    key = F.xxhash64("norm")
    return docs.select(docs["doc_id"].alias("doc_id"), one_spaced(docs["text"]).alias("norm")).withColumn("key", key if key_bits == 64 else key.bitwiseAND(F.lit(-1 << (64 - key_bits))))


def sha256(norm: Column) -> Column:
    """SHA-256 as bytes."""
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def build_index(docs: DataFrame, rows: DataFrame, capacity: int = BUCKET_KEYS, key_bits: int = 64) -> ExactIndex:
    """Index all normalised texts of ``docs``, whose keys are in ``rows``."""
    spark = docs.sparkSession
    keys = saved(rows.groupBy("key").agg(F.count("*").alias("n")), "exact-keys")
    counts = {r[0]: r[1] for r in keys.groupBy(leading_bits(F.col("key"), MAX_DEPTH)).count().collect()}  # at most 2**MAX_DEPTH rows
    total = sum(counts.values())
    buckets = split_buckets(counts, max(min(capacity, total // (16 * partitions(spark))), total >> (MAX_DEPTH - 1), 1))
    depth, slots = directory_of(buckets)
    owners = owners_of(buckets, counts, partitions(spark))
    bar = max(HOT_ROWS, (keys.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE)
    index = ExactIndex(rows, spark.createDataFrame([(slot, b, owners[b]) for slot, b in enumerate(slots)], "slot int, bucket int, owner int"), depth, bar)
    hot = F.broadcast(keys.filter(F.col("n") > bar).select("key"))  # at most 1 / HOT_SHARE keys
    texts = keyed(docs, key_bits)
    copies = texts.join(hot, "key", "left_semi").groupBy("key", "norm").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    others = texts.join(hot, "key", "left_anti").select("key", "norm", F.col("doc_id").alias("least"), F.lit(1).cast("long").alias("n"))
    owned = index.bucketed(others.unionByName(copies)).repartitionById(partitions(spark), F.col("owner"))
    under_key = W.partitionBy("owner", "bucket", "key").orderBy("norm")
    head = F.lag("norm").over(under_key).isNull() | (F.lag("norm").over(under_key) != F.col("norm"))
    chained = owned.withColumn("head", head).withColumn("chain", F.sum(F.col("head").cast("int")).over(under_key.rowsBetween(W.unboundedPreceding, 0)) - 1)
    entries = chained.groupBy("owner", "bucket", "key", "chain").agg(F.max(F.when(F.col("head"), sha256(F.col("norm")))).alias("sha"), F.min("least").alias("keep_id"), F.sum("n").alias("group_size")).drop("owner")
    index.entries = saved(entries.sortWithinPartitions("bucket", "key", "chain"), "exact-index")
    return index


def look_up(rows: DataFrame, index: ExactIndex) -> DataFrame:
    """Each row (doc_id, key, sha) with its entry; hot entries come by broadcast."""
    hot = F.col("group_size") > index.bar
    own = index.bucketed(rows)
    by = ["bucket", "key", "sha"]
    cold = own.join(F.broadcast(index.entries.filter(hot).select(by)), by, "left_anti")
    return own.join(F.broadcast(index.entries.filter(hot)), by).unionByName(cold.join(index.entries.filter(~hot), by, "left"))


def exact_dedup(docs: DataFrame, capacity: int = BUCKET_KEYS, key_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, bucket, chain: one row for each row of ``docs``.

    Null texts count as empty. Of equal texts the smallest doc_id stays (null ids only if a group has
    no other); rows that repeat that id and text are kept alike. An empty table gives no rows. Fewer ``key_bits`` make
    longer chains of different texts and change nothing else.
    """
    rows = saved(keyed(docs, key_bits).select("doc_id", "key", sha256(F.col("norm")).alias("sha")), "exact-rows")
    found = look_up(rows, build_index(docs, rows, capacity, key_bits))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "bucket", "chain")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, one for each distinct text.

    Rows that repeat both id and text are reduced to one by the same partitioning as the join.
    """
    keep = exact_dedup(docs).filter("kept").select(id_key(F.col("doc_id")).alias("__keep_key"), F.col("text_sha256").alias("__keep_text")).distinct()
    keys = docs.withColumns({"__keep_key": id_key(docs["doc_id"]), "__keep_text": F.sha2(one_spaced(docs["text"]).cast("binary"), 256)})
    return keys.join(keep, ["__keep_key", "__keep_text"], "left_semi").dropDuplicates(["__keep_key", "__keep_text"]).drop("__keep_key", "__keep_text")


def id_key(doc_id: Column) -> Column:
    """A doc_id as a key that is never null."""
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy of its text that stays."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""
