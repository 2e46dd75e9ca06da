"""Document fingerprints from prefix polynomial hashes.

A text's code points c[0], c[1], ... give the modular prefix array S[i] = sum of c[j] * B**j for j < i. The hash of
any span is (S[j] - S[i]) / B**i, so that spans are compared in constant time wherever they stand, and the
longest common extension of two positions is found by binary search over span lengths. A fingerprint
holds the hash of the whole text under two bases and the ``SKETCH`` smallest mixed hashes of all its
spans of ``SPAN`` code points. Spans that two fingerprints share are extended to both sides, and the likeness is the part of the
texts that lies in common blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import partitions, slices, text_or_empty

PRIME = (1 << 31) - 1
BASES = (1_000_003, 918_273_645)
SPAN, SKETCH = 12, 64


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the Mersenne prime, for any 63-bit x."""
    p, bits = np.uint64(PRIME), np.uint64(31)
    x = (x & p) + (x >> bits)
    x = (x & p) + (x >> bits)
    return np.where(x >= p, x - p, x)


class Powers:
    """Powers of a base and of its inverse, grown as texts need them."""

    def __init__(self, base: int) -> None:
        self.steps = (base, pow(base, -1, PRIME))
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> list[np.ndarray]:
        while len(self.tables[0]) < n:
            have = len(self.tables[0])
            self.tables = [np.concatenate((t, reduced(t * np.uint64(pow(s, have, PRIME))))) for t, s in zip(self.tables, self.steps)]
        return self.tables


POWERS = [Powers(b) for b in BASES]


class PrefixHash:
    """The prefix arrays of one text."""

    def __init__(self, text: str, bases: int = 2) -> None:
        self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(self.points)
        self.sums = []
        for powers in POWERS[:bases]:
            terms = reduced(self.points * powers.upto(self.n + 1)[0][: self.n])
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), reduced(np.cumsum(terms, dtype=np.uint64)))))

    def spans(self, length: int) -> np.ndarray:
        """Hashes of all spans of a length, under the first base."""
        s = self.sums[0]
        return reduced((s[length:] + np.uint64(PRIME) - s[:-length]) * POWERS[0].upto(self.n + 1)[1][: self.n + 1 - length])

    def span(self, start: int, stop: int) -> tuple[int, ...]:
        """Hash of one span under each base."""
        return tuple((int(s[stop]) - int(s[start])) * int(p.upto(self.n + 1)[1][start]) % PRIME for s, p in zip(self.sums, POWERS))

    def whole(self) -> int:
        """Both hashes of the whole text and its length, as one 64-bit number; zero for the empty text."""
        a, b = self.span(0, self.n)
        return (a << 33 | b << 2 | self.n & 3) if self.n else 0


def spans_equal(a: PrefixHash, i: int, b: PrefixHash, j: int, length: int) -> bool:
    """Are the spans of a length at i in a and at j in b equal?"""
    return i + length <= a.n and j + length <= b.n and a.span(i, i + length) == b.span(j, j + length)


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """Length of the longest common extension from i in a and j in b, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if spans_equal(a, i, b, j, middle) else (low, middle - 1)
    return low


def common_extension_back(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """Length of the longest common extension to the left of i in a and j in b."""
    low, high = 0, min(i, j)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if spans_equal(a, i - middle, b, j - middle, middle) else (low, middle - 1)
    return low


@dataclass
class Fingerprint:
    """``places`` tells where each span of the sketch stands first; it and ``prefix`` are known for texts at hand only."""

    whole: int
    sketch: np.ndarray
    places: np.ndarray | None = None
    prefix: PrefixHash | None = None

    def __str__(self) -> str:
        return f"{self.whole:016x}" + self.sketch.astype(">u4").tobytes().hex()


def fingerprint(text: str) -> Fingerprint:
    """The fingerprint of a whole text; texts shorter than a span have one span, the empty text none."""
    prefix = PrefixHash(text)
    hashes = prefix.spans(min(SPAN, prefix.n)) if prefix.n else np.zeros(0, np.uint64)
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    mixed = (((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)
    ordered = np.sort(mixed)
    distinct = ordered[np.flatnonzero(np.diff(ordered, prepend=np.uint32(ordered[0] ^ 1)))[:SKETCH]] if len(ordered) else ordered
    low = np.flatnonzero(mixed <= distinct[-1]) if len(distinct) else np.zeros(0, np.int64)
    return Fingerprint(prefix.whole(), distinct, low[np.unique(mixed[low], return_index=True)[1]], prefix)


def parse(fingerprint: str) -> Fingerprint:
    """The fingerprint that a string stands for."""
    return Fingerprint(int(fingerprint[:16], 16), np.frombuffer(bytes.fromhex(fingerprint[16:]), ">u4").astype(np.uint32))


def estimated_likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Estimate of ``likeness`` from sketches alone: 2 J / (1 + J) for the estimated resemblance J; 1 for equal texts."""
    if a.whole == b.whole and np.array_equal(a.sketch, b.sketch):
        return 1.0
    if not len(a.sketch) or not len(b.sketch):
        return 0.0
    union = np.union1d(a.sketch, b.sketch)[:SKETCH]
    both = len(np.intersect1d(np.intersect1d(a.sketch, b.sketch, assume_unique=True), union, assume_unique=True))
    j = both / len(union)
    return 2 * j / (1 + j)


def common_blocks(a: Fingerprint, b: Fingerprint) -> list[tuple[int, int, int]]:
    """Maximal equal spans (start in a, start in b, length): from both beginnings, both ends, and each span of both sketches.

    Each is extended to both sides by binary search over prefix hashes. A span inside one found before is not extended again.
    """
    p, q = a.prefix, b.prefix
    least = max(1, min(SPAN, p.n, q.n))
    found: list[tuple[int, int, int]] = []
    end = max(1, min(SPAN, p.n // 2, q.n // 2))
    if spans_equal(p, 0, q, 0, end):
        found.append((0, 0, common_extension(p, 0, q, 0)))
    if spans_equal(p, p.n - end, q, q.n - end, end):
        n = common_extension_back(p, p.n, q, q.n)
        found.append((p.n - n, q.n - n, n))
    _, x, y = np.intersect1d(a.sketch, b.sketch, assume_unique=True, return_indices=True)
    for i, j in sorted(zip(a.places[x].tolist(), b.places[y].tolist())):
        if not any(s <= i and i + least <= s + n and j - i == t - s for s, t, n in found) and spans_equal(p, i, q, j, least):
            back = common_extension_back(p, i, q, j)
            found.append((i - back, j - back, back + common_extension(p, i, q, j)))
    return found


def covered(spans: list[tuple[int, int]]) -> int:
    """How many places lie in at least one of the spans (start, length)."""
    total = end = 0
    for start, n in sorted(spans):
        total += max(0, start + n - max(start, end))
        end = max(end, start + n)
    return total


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Share of both texts, 0 to 1, that lies in their common blocks; 1 for equal texts."""
    if a.whole == b.whole and np.array_equal(a.sketch, b.sketch):
        return 1.0
    if not len(a.sketch) or not len(b.sketch):
        return 0.0
    found = common_blocks(a, b)
    return (covered([(i, n) for i, _, n in found]) + covered([(j, n) for _, j, n in found])) / (a.prefix.n + b.prefix.n)


def edited(text: str, after: str) -> str:
    """The text with its last third replaced by the first as many code points of ``after``."""
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


def in_descending_order(docs: DataFrame) -> DataFrame:
    """guest, part, doc_id, text: ranges of descending doc_id, each followed by the first row of the next range.

    Ranges come from quantiles of the ids, weighted by bytes; an id so frequent that it fills ranges, or null, is cut by a hash
    of the text. Each range's first row is looked up for the one before it, so that texts are shuffled once, one range
    to one task. The last range is followed by the first row of all.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs["text"]).alias("text"))
    n = partitions(spark)
    size = F.octet_length("text").cast("long")
    weighed = rows.select("doc_id", size.alias("bytes"))
    total, nulls = weighed.agg(F.avg("bytes"), F.avg(F.col("doc_id").isNull().cast("double"))).first()
    often = weighed.select("doc_id", F.explode(F.sequence(F.lit(0), F.least(F.lit(n), F.floor(F.col("bytes") / max(1.0, total or 1.0))).cast("int"))))
    bounds = sorted(often.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], max(1000, 20 * n))).first()[0] or [], reverse=True)
    many = {b: bounds.count(b) for b in bounds if bounds.count(b) > 1}
    tie = F.shiftrightunsigned(F.xxhash64("text"), 1)
    share = tie / float(1 << 63)
    cut = F.element_at(F.create_map(*[F.lit(x).cast("long") for item in many.items() for x in item]), F.col("doc_id")) if many else F.lit(None)
    before = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b > F.col("doc_id"))) if bounds else F.lit(0)
    null_parts = max(1, round(n * (nulls or 0)))
    part = F.when(F.col("doc_id").isNull(), len(bounds) + 1 + F.floor(share * null_parts)).otherwise(before + F.coalesce(F.floor(share * cut), F.lit(0)))
    parted = rows.withColumn("tie", tie).withColumn("part", part.cast("int"))
    heads = sorted(parted.groupBy("part").agg(F.max(F.struct("doc_id", (-F.col("tie")).alias("tie"))).alias("head")).collect())  # at most one row a range
    followed = [(before[0], head[1][0], -head[1][1]) for before, head in zip(heads, heads[1:] + heads[:1])]
    table = spark.createDataFrame(followed, "to_part int, head_id long, head_tie long")
    met = parted.join(F.broadcast(table), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie")))
    guests = met.select(F.col("to_part").alias("part"), F.lit(True).alias("guest"), "doc_id", "text", "tie").dropDuplicates(["part"])
    every = parted.select("part", F.lit(False).alias("guest"), "doc_id", "text", "tie").unionByName(guests)
    ranges = every.repartitionById(len(bounds) + 1 + null_parts, F.col("part")).sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), "tie")
    return ranges.drop("tie")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    Null texts count as empty. The next document is the one of the next smaller doc_id (null ids come
    last, equal ids by a hash of the text), and the first one after the last. A single row follows itself; an
    empty table gives no rows; other columns are not read.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in slices(it):
            out: list[tuple] = []
            for part, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = fingerprint(text)
                if held and held[0] == part:
                    changed = edited(held[2], text)
                    after = fingerprint(changed)
                    out.append((held[1], len(held[2]), hashlib.sha256(changed.encode()).hexdigest(), str(held[3]), str(after), likeness(held[3], after), likeness(held[3], own)))
                held = None if guest else (part, doc_id, text, own)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], names=names)

    return in_descending_order(docs).mapInArrow(batches, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text."""
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
