"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has 64 bits, each the majority over the hashes of a text's word shingles. Fingerprints
at most ``radius`` bits apart link, and links make components.

Candidates come from blocks: the bits fall into ``BLOCKS`` blocks, and two fingerprints within the
radius agree on all but ``radius`` of them, so each distinct fingerprint is dealt once by every choice of
agreeing blocks and meets all its partners. Within such a bucket, fingerprints are compared as bit planes:
64 differences stand in one machine word a plane, carry-save counters add all planes to many
distances at once, and a block of 64 pairs is abandoned once all of them exceed the radius. Pairs that are
already connected are not compared again, an overfull bucket is dealt afresh by its remaining bits,
and a bucket passes on a spanning star and never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..scratch import saved
from .graph import components
from .text import HOT_SHARE, partitions, slices

SEED = 42
BITS = 64
BLOCKS = 6
#: Buckets with more fingerprints than this are dealt afresh by their free bits.
DIRECT = 4096


def fingerprint(text: bytes | None, words: int) -> int:
    """SimHash of a text in UTF-8; zero without words."""
    parts = (text or b"").lower().split()  # on bytes both act on ASCII alone
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate(([0], ends[:-words])).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    shingles = [joined[a:b] for a, b in zip(starts, stops)]
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), "<u8", len(shingles))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    counts = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        counts += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and fp (a signed 64-bit number) of each row."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            texts = batch.column(1).cast(pa.binary() if batch.schema.field(1).type == pa.string() else pa.large_binary()).to_pylist()
            prints = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])

    return rows.mapInArrow(batches, "doc_id long, fp long")


def planes_of(x: np.ndarray) -> np.ndarray:
    """Bit planes (64, n / 64) of n words: bit t of word w in plane b is bit b of x[64 w + t]."""
    a = x.reshape(-1, BITS).copy()
    shift, mask = 32, 0xFFFFFFFF
    while shift:
        pairs = a.reshape(len(a), BITS // (2 * shift), 2, shift)
        low, high = pairs[:, :, 0, :], pairs[:, :, 1, :]
        t = ((low >> np.uint64(shift)) ^ high) & np.uint64(mask)
        high ^= t
        low ^= t << np.uint64(shift)
        shift >>= 1
        mask ^= (mask << shift) & 0xFFFFFFFFFFFFFFFF
    return a.T


def exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Bit by bit: is the counted distance larger than the radius?"""
    more, same = over.copy(), ~over
    for level in reversed(range(len(counters))):
        if radius >> level & 1:
            same &= counters[level]
        else:
            more |= same & counters[level]
            same &= ~counters[level]
    return more


def within(differences: np.ndarray, radius: int) -> np.ndarray:
    """For each XOR of two fingerprints: has it at most ``radius`` bits?"""
    n = len(differences)
    planes = planes_of(np.concatenate((differences, np.zeros(-n % BITS, np.uint64))))
    blocks = planes.shape[1]
    levels = max(1, radius.bit_length())
    alive, result = np.arange(blocks), np.zeros(blocks, np.uint64)
    counters, over = [np.zeros(blocks, np.uint64) for _ in range(levels)], np.zeros(blocks, np.uint64)
    for b in range(BITS):
        carry = planes[b]
        for level in range(levels):
            counters[level], carry = counters[level] ^ carry, counters[level] & carry
        over = over | carry
        if b % 8 == 7:
            live = exceeds(counters, over, radius) != np.uint64(0xFFFFFFFFFFFFFFFF)
            if not live.all():
                alive, planes, over = alive[live], planes[:, live], over[live]
                counters = [c[live] for c in counters]
                if not len(alive):
                    break
    result[alive] = ~exceeds(counters, over, radius)
    return np.unpackbits(result.view(np.uint8), bitorder="little")[:n].astype(bool)


def join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the label sets of linked rows; a label is the smallest row of its set."""
    while len(i):
        low = np.minimum(labels[i], labels[j])
        np.minimum.at(labels, labels[i], low)
        np.minimum.at(labels, labels[j], low)
        while not np.array_equal(flat := labels[labels], labels):
            labels[:] = flat
        apart = labels[i] != labels[j]
        i, j = i[apart], j[apart]


def compare_runs(fps: np.ndarray, rows: np.ndarray, starts: np.ndarray, labels: np.ndarray, radius: int) -> None:
    """Link rows within the radius in each run of ``rows`` (runs begin at ``starts``)."""
    sizes = np.diff(np.append(starts, len(rows)))
    room = np.repeat(starts + sizes, sizes) - np.arange(len(rows))  # rows from here to the run's end
    at = np.arange(len(rows))
    for step in range(1, int(sizes.max(initial=0))):
        at = at[room[at] > step]
        i, j = rows[at], rows[at + step]
        apart = labels[i] != labels[j]
        i, j = i[apart], j[apart]
        if len(i):
            near = within(fps[i] ^ fps[j], radius)
            join_labels(labels, i[near], j[near])


def link_bucket(fps: np.ndarray, rows: np.ndarray, labels: np.ndarray, free: int, radius: int) -> None:
    """Link the rows of one bucket, whose fingerprints differ only in the bits of ``free``."""
    positions = [b for b in range(BITS) if free >> b & 1]
    if len(rows) < 2 or (labels[rows] == labels[rows[0]]).all():
        return
    if len(rows) <= DIRECT or len(positions) <= radius + 1:
        compare_runs(fps, rows, np.array([0]), labels, radius)
        return
    for part in np.array_split(np.array(positions), radius + 1):
        mask = sum(1 << int(b) for b in part)
        keys = fps[rows] & np.uint64(mask)
        order = np.argsort(keys, kind="stable")
        bounds = np.flatnonzero(np.diff(keys[order])) + 1
        for run in np.split(rows[order], bounds):
            link_bucket(fps, run, labels, free & ~mask, radius)


def link_sorted(masks: np.ndarray, combo: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (fingerprint, fingerprint) of rows that are sorted by combo and masked bits."""
    keys = fps & masks[combo]
    starts = np.concatenate(([0], np.flatnonzero((np.diff(combo) != 0) | (np.diff(keys) != 0)) + 1)) if len(fps) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(fps)))
    labels, all_rows = np.arange(len(fps)), np.arange(len(fps))
    small = (sizes > 1) & (sizes <= DIRECT)
    picked = np.repeat(small, sizes)
    if picked.any():
        compare_runs(fps, all_rows[picked], np.concatenate(([0], np.cumsum(sizes[small])[:-1])), labels, radius)
    for k in np.flatnonzero(sizes > DIRECT):
        run = all_rows[starts[k] : starts[k] + sizes[k]]
        link_bucket(fps, run, labels, int(~masks[combo[starts[k]]]), radius)
    hung = np.flatnonzero(labels != all_rows)
    return fps[hung], fps[labels[hung]]


def agreeing_masks(radius: int, blocks: int = BLOCKS) -> list[int]:
    """Masks of the bits on which a pair within the radius agrees for at least one mask."""
    widths = [len(x) for x in np.array_split(np.arange(BITS), blocks)]
    block, at = [], 0
    for w in widths:
        block.append(((1 << w) - 1) << at)
        at += w
    return [sum(block[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def dealt_by_masks(prints: DataFrame, masks: list[int], radius: int) -> tuple[DataFrame, list[int]]:
    """combo, key, fp: each fingerprint dealt by the bits of every mask; and all masks, of which a combo is the number.

    A bucket of too many rows is dealt afresh by its free bits, in ``radius`` + 1 parts on one of which a pair agrees, as often as it
    takes. There are 1 / HOT_SHARE such buckets at most, so they are broadcast.
    """
    masks, out = list(masks), []
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m)
    rows = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(signed(m)) for m in masks])).alias("combo", "key"))
    while True:
        counts = saved(rows.groupBy("combo", "key").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-buckets")
        bar = max(DIRECT, int((counts.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE))
        combos = sorted(r[0] for r in counts.filter(F.col("n") > bar).select("combo").distinct().collect())
        finer = {c: parts for c in combos if len(parts := finer_masks(masks[c], radius)) > 1}
        hot = F.broadcast(counts.filter((F.col("n") > bar) & F.col("combo").isin(list(finer))).select("combo", "key"))
        out.append(rows.join(hot, ["combo", "key"], "left_anti") if finer else rows)
        if not finer:
            break
        deal = F.lit(None).cast("array<struct<combo:int,key:bigint>>")
        for c, parts in finer.items():
            each = F.array(*[F.struct(F.lit(len(masks) + k).alias("combo"), F.col("fp").bitwiseAND(signed(m)).alias("key")) for k, m in enumerate(parts)])
            deal, masks = F.when(F.col("combo") == c, each).otherwise(deal), masks + parts
        rows = rows.join(hot, ["combo", "key"], "left_semi").select("fp", F.explode(deal).alias("d")).select("fp", "d.combo", "d.key")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found, masks


def finer_masks(mask: int, radius: int) -> list[int]:
    """The mask with each of ``radius`` + 1 parts of its free bits; fewer than two if no more bits are free than that."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(1 << int(b) for b in part) for part in np.array_split(np.array(free), radius + 1)] if len(free) > radius + 1 else []


def links(prints: DataFrame, radius: int, blocks: int = BLOCKS) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints (column fp), found in every bucket."""
    rows, masks = dealt_by_masks(prints, agreeing_masks(radius, blocks), radius)
    dealt = rows.repartition(partitions(prints.sparkSession), "combo", "key").sortWithinPartitions("combo", "key")
    unsigned = np.array(masks, dtype=np.uint64)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n, enough = 0, 65536
        for pdf in it:
            held.append((pdf["combo"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64).view(np.uint64)))
            n += len(pdf)
            if n < enough:
                continue
            combo, fps = (np.concatenate(x) for x in zip(*held))
            keys = fps & unsigned[combo]
            new = np.flatnonzero((np.diff(combo) != 0) | (np.diff(keys) != 0))
            if len(new):
                done = new[-1] + 1  # the last bucket may go on in the next batch
                yield made(combo[:done], fps[:done])
                held = [(combo[done:], fps[done:])]
                n = len(fps) - done
            enough = max(65536, 2 * n)
        if held:
            yield made(*(np.concatenate(x) for x in zip(*held)))

    def made(combo: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
        a, b = link_sorted(unsigned, combo, fps, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.select("combo", "fp").mapInPandas(batches, "a long, b long")


def simhash_components(docs: DataFrame, words: int = 5, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id: one row for each row of ``docs``.

    Null, empty and blank texts have fingerprint zero and link like any other. The component is named
    by its smallest doc_id (null if it has none but null). Repeated rows stay repeated; an empty table
    gives no rows. ``radius`` must be under ``BLOCKS``.
    """
    if not 0 <= radius < BLOCKS:
        raise ValueError(f"radius {radius} needs more than {BLOCKS} blocks")
    prints = saved(fingerprints(docs, words), "simhash-prints")
    nodes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"), "fp")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with fingerprints of four-word shingles and their components."""
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
