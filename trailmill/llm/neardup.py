"""Near duplicates at a similarity of shingle sets, by SimHash and exact comparison of candidates.

Fingerprints, of distinct shingles, are linked by SimHash as in ``simhash.links``. A radius that catches all pairs of a Jaccard
similarity of 0.8 is about a third of all bits, too wide for blocks of agreeing bits. So the rest of the candidates meet in buckets of
banded minima of shingle hashes; inside a bucket, fingerprints choose which rows are compared first, and no pair is dropped by them. All
candidates, of sets not too different in size, are settled by the exact similarity of their shingle sets. Links make components.

A bucket of many near copies would have pairs with the square of its size. So the first round compares all rows
of a bucket only with its ``PIVOTS`` rows closest to the bucket's majority fingerprint (an original is
closest to what its copies have in common) and settles those links; hot buckets find their pivots by counting and are compared
where their rows lie. In the second round, buckets whose rows are not all connected by then get their shingle sets, in cells of
bounded size, and each row outside the bucket's largest component is held against all others at once by the exact
similarity. A cell passes on spanning links and never its pairs. Together the rounds cover every pair of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..scratch import saved
from .exact import id_key
from .graph import components
from .simhash import SEED, links, majority, within
from .text import HOT_SHARE, beside, partitions, slices

#: With 16 bands of 4 minima, a pair of similarity 0.8 meets with a probability of 0.9998, one of 0.9 with 1 - 1e-7.
BANDS, ROWS = 16, 4
PIVOTS = 8
#: Bits in which linked fingerprints differ at most.
RADIUS = 4
#: A cell of the second round holds at most about so many rows and shingles from each of two blocks.
CELL_ROWS, CELL_SHINGLES = 2048, 1_000_000
#: A bucket of fewer rows is never hot.
HOT_ROWS = 512
_MIX = np.random.default_rng(2024).integers(1, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """Hashes of all word shingles, repeats included; of the whole sequence if it is shorter; none without words."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate(([0], ends[:-words])).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    return np.fromiter(map(xxh64_intdigest, [joined[a:b] for a, b in zip(starts, stops)], repeat(SEED)), np.uint64, len(starts))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band: a mix of its minima of multiplied hashes."""
    minima = np.array([(hashes * a ^ (hashes >> np.uint64(32)) * b).min() for a, b in _MIX], np.uint64).reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row in range(ROWS):
        keys = (keys ^ minima[:, row]) * np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64).tolist()


def text_key(text: Column) -> Column:
    """A text's SHA-256, empty for null."""
    return F.coalesce(F.unhex(F.sha2(text.cast("string").cast("binary"), 256)), F.lit(b""))


def described(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_key, set_key (a hash of the shingle set; 0 for none), width (its size), fp and bands of each row."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text"), text_key(docs["text"]).alias("text_key"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            keys, widths, prints, bands = [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text, words)
                distinct = np.unique(hashes)
                keys.append(xxh64_intdigest(distinct.tobytes(), SEED) if len(distinct) else 0)
                widths.append(len(distinct))
                prints.append(majority(distinct) if len(distinct) else 0)
                bands.append(band_keys(distinct) if len(distinct) else [])
            signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), signed(keys), pa.array(widths, pa.int64()), signed(prints), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_key", "set_key", "width", "fp", "bands"])

    return rows.mapInArrow(batches, "doc_id long, text_key binary, set_key long, width long, fp long, bands array<long>")


def bucket_pairs(fps: np.ndarray, widths: np.ndarray, similarity: float, radius: int | None = 22) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of the rows nearest to the majority with all others; sets of too different sizes are no pair.

    A ``radius`` of fingerprints leaves out most pairs that are not near, but also some that are; None leaves out none.
    """
    n = len(fps)
    out = [(np.zeros(0, int), np.zeros(0, int))]
    order = np.argsort(np.bitwise_count(fps ^ np.uint64(majority(fps))), kind="stable") if n > PIVOTS + 1 else np.arange(n)
    for k in range(min(n - 1, PIVOTS)):
        i, j = order[k], order[k + 1 :]
        j = j[np.minimum(widths[i], widths[j]) >= similarity * np.maximum(widths[i], widths[j])]
        if len(j) and radius is not None:
            j = j[within(fps[i] ^ fps[j], radius)]
        out.append((np.full(len(j), i), j))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def whole_runs(it: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of sorted rows, cut so that rows of equal keys come together."""
    rest = None
    for pdf in it:
        rest = pdf if rest is None else pd.concat([rest, pdf])
        last = (rest[keys] == rest[keys].iloc[-1]).all(axis=1).to_numpy()
        if not last.all():
            yield rest[~last]
            rest = rest[last]  # the last run may go on in the next batch
    if rest is not None:
        yield rest


def runs_of(pdf: pd.DataFrame, keys: list[str]) -> Iterator[slice]:
    """Where runs of at least two rows of equal keys stand."""
    changes = (pdf[keys].to_numpy()[1:] != pdf[keys].to_numpy()[:-1]).any(axis=1)
    starts = np.concatenate(([0], np.flatnonzero(changes) + 1, [len(pdf)]))
    for k in np.flatnonzero(np.diff(starts) > 1):
        yield slice(starts[k], starts[k + 1])


def hot_bar(bands: DataFrame) -> float:
    """Buckets (band, n) of more rows than this are hot, and their number is bounded."""
    return max(HOT_ROWS, (bands.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE)


def hot_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of the rows of hot buckets with their bucket's pivots, without a shuffle of the rows.

    The majority of a bucket's fingerprints is counted bit by bit, and the row closest to it among each of ``PIVOTS`` hash
    classes is a pivot; pivots are at most ``PIVOTS`` rows a hot bucket, so they are broadcast.
    """
    bit = lambda b: F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1).cast("long"))
    counts = rows.groupBy("band").agg(F.count("*").alias("n"), *[F.sum(bit(b)).alias(f"b{b}") for b in range(64)])
    major = F.lit(0).cast("long")
    for b in range(64):
        major = major.bitwiseOR(F.when(F.col(f"b{b}") * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    told = rows.join(F.broadcast(counts.select("band", major.alias("major"))), "band")
    near = F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("major"))).alias("d"), "set_key", "width")
    pivots = told.groupBy("band", F.pmod(F.xxhash64("set_key"), F.lit(PIVOTS))).agg(F.min(near).alias("p")).select("band", F.col("p.set_key").alias("p"), F.col("p.width").alias("w"))
    met = rows.join(F.broadcast(pivots), "band").filter((F.col("p") != F.col("set_key")) & (F.least("width", "w") >= similarity * F.greatest("width", "w")))
    return met.select(F.least("p", "set_key").alias("a"), F.greatest("p", "set_key").alias("b"))


def candidate_pairs(rows: DataFrame, bands: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of set keys, a < b, from rows (band, set_key, width, fp) that share a bucket; ``bands`` counts its rows."""
    hot = F.broadcast(bands.filter(F.col("n") > hot_bar(bands)).select("band"))  # at most 1 / HOT_SHARE rows
    dealt = rows.join(hot, "band", "left_anti").repartition(partitions(rows.sparkSession), "band").sortWithinPartitions("band")

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_runs(it, ["band"]):
            keys, widths = pdf["set_key"].to_numpy(np.int64), pdf["width"].to_numpy(np.int64)
            fps = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            found = [np.zeros((0, 2), np.int64)]
            for s in runs_of(pdf, ["band"]):
                i, j = bucket_pairs(fps[s], widths[s], similarity, radius=None)
                a, b = keys[s][i], keys[s][j]
                found.append(np.column_stack((np.minimum(a, b), np.maximum(a, b))))
            yield pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])

    return dealt.mapInPandas(batches, "a long, b long").unionByName(hot_pairs(rows.join(hot, "band", "left_semi"), similarity))


def fingerprint_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of set keys, a < b, of one fingerprint or of two that SimHash links, of sets not too different in size.

    The smallest set key of a fingerprint stands for it.
    """
    prints = saved(nodes.groupBy("fp").agg(F.min(F.struct("set_key", "width")).alias("set")), "near-prints")
    a, b = (prints.select(F.col("fp").alias(c), F.col("set").alias(f"{c}_set")) for c in "ab")
    linked = links(prints.select("fp"), RADIUS).distinct().join(a, "a").join(b, "b").select("a_set", "b_set")
    same = nodes.select(F.col("fp").alias("a"), F.struct("set_key", "width").alias("b_set")).join(a, "a").select("a_set", "b_set")
    both = linked.unionByName(same).select("a_set.*", F.col("b_set.set_key").alias("other"), F.col("b_set.width").alias("w"))
    met = both.filter((F.col("set_key") != F.col("other")) & (F.least("width", "w") >= similarity * F.greatest("width", "w")))
    return met.select(F.least("set_key", "other").alias("a"), F.greatest("set_key", "other").alias("b"))


def cell_links(sets: list[np.ndarray], labels: np.ndarray, asked: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Spanning links of the rows ``asked`` for with rows of one cell that are so similar and not connected yet; ``labels`` is changed."""
    widths = np.array([len(x) for x in sets])
    starts = np.concatenate(([0], np.cumsum(widths)[:-1]))
    members = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(members.max(initial=0) + 1, np.int32)
    found: tuple[list[int], list[int]] = ([], [])
    for q in np.flatnonzero(asked):
        near = np.flatnonzero((labels != labels[q]) & (np.minimum(widths, widths[q]) >= similarity * np.maximum(widths, widths[q])))
        if not len(near):
            continue
        own = members[starts[q] : starts[q] + widths[q]]
        mark[own] = 1
        common = np.add.reduceat(mark[members], starts)[near]
        mark[own] = 0
        for h in near[common >= similarity * (widths[near] + widths[q] - common)]:
            if labels[h] != labels[q]:
                found[0].append(q)
                found[1].append(h)
                labels[labels == labels[h]] = labels[q]
    return found


def rest_links(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that rows (band, set_key, width, label) of one bucket have across labels, but for those that follow from others.

    Rows outside the bucket's largest label are asked for: they meet all rows of their bucket. A large bucket is dealt to
    blocks, and those asked for to blocks of their own; each block meets each of these in a cell of bounded size.
    """
    own = rows.groupBy("band", "label").agg(F.count("*").alias("m"), F.sum("width").alias("shingles"))
    largest = F.max(F.struct("m", "label")).alias("top")
    open_ = own.groupBy("band").agg(F.sum("m").alias("n"), F.sum("shingles").alias("shingles"), largest).filter(F.col("top.m") < F.col("n"))
    blocks = F.ceil(F.greatest(F.col("n") / CELL_ROWS, F.col("shingles") / CELL_SHINGLES)).cast("int")
    some = F.ceil((F.col("n") - F.col("top.m")) / F.col("n") * F.col("blocks")).cast("int")
    open_ = saved(open_.withColumn("blocks", blocks).select("band", "n", F.col("top.label").alias("top"), "blocks", some.alias("asking")), "near-open")
    met = beside(rows, open_, ["band"], hot_bar(open_)).withColumn("asked", F.col("label") != F.col("top"))
    at = F.xxhash64("set_key")
    base = met.select("band", F.pmod(at, "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("ask"), "set_key", "label", F.lit(False).alias("asked"))
    asking = met.filter("asked").select("band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(at, "asking").cast("int").alias("ask"), "set_key", "label", "asked")
    names = ["band", "block", "ask"]
    cells = base.unionByName(asking)
    dealt = cells.join(sets, "set_key").select(*names, "set_key", "label", "asked", "members").repartition(partitions(rows.sparkSession), *names).sortWithinPartitions(*names)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_runs(it, names):
            keys, labels = pdf["set_key"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64).copy()
            asked = pdf["asked"].to_numpy(bool)
            members = [np.frombuffer(x, np.uint64) for x in pdf["members"]]
            for s in runs_of(pdf, names):
                i, j = cell_links(members[s], labels[s], asked[s], similarity)
                yield pd.DataFrame({"a": keys[s][i], "b": keys[s][j]})

    return dealt.mapInPandas(batches, "a long, b long")


def shingle_sets(keys: DataFrame, docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """set_key and members (sorted 64-bit hashes) of the given keys; sets are made again for one row of each key alone."""
    named = keys.distinct().join(nodes.select("set_key", "least"), "set_key")
    rows = docs.select(docs["doc_id"].cast("long").alias("least"), docs["text"].cast("string").cast("binary").alias("text"))
    texts = rows.join(named, "least").select("set_key", "text")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            sets = [np.unique(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()]
            # a doc_id that several texts share has several sets; only that of the key counts
            own = [xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0 for s in sets]
            right = [k % (1 << 64) == o for k, o in zip(batch.column(0).to_pylist(), own)]
            kept = pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_key", "members"])
            yield kept.filter(pa.array(right, pa.bool_()))

    return saved(texts.mapInArrow(batches, "set_key long, members binary").dropDuplicates(["set_key"]), "near-sets")


def settled(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """Pairs (a, b) whose shingle sets are at least so similar."""
    sets = shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("set_key")), docs, nodes, words)
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")

    @F.pandas_udf("double")
    def jaccard(sa: pd.Series, sb: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(sa, sb):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(common / max(1, len(x) + len(y) - common))
        return pd.Series(out)

    return both.withColumn("__j", jaccard.asNondeterministic()("sa", "sb")).filter(F.col("__j") >= similarity).select("a", "b")


def rooted_sets(docs: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """All rows as ``described``, and set_key, least, pick, root of each shingle set: its smallest doc_id, its row that stays, its component."""
    told = saved(described(docs, words), "near-rows")
    nodes = saved(told.groupBy("set_key").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("pick"), F.first("width").alias("width"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "near-nodes")
    rows = saved(nodes.select(F.explode("bands").alias("band"), "set_key", "width", "fp"), "near-buckets")
    bands = saved(rows.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "near-bands")
    pairs = saved(candidate_pairs(rows, bands, similarity).unionByName(fingerprint_pairs(nodes, similarity)).distinct(), "near-pairs")
    stars = components(saved(settled(pairs, docs, nodes, words, similarity), "near-links"))
    label = F.coalesce("root", "set_key")
    # buckets of more rows than pivots are the only ones with pairs left
    left = beside(rows, bands.filter(F.col("n") > PIVOTS + 1), ["band"], hot_bar(bands)).join(stars.select(F.col("a").alias("set_key"), F.col("b").alias("root")), "set_key", "left")
    left = saved(left.select("band", "set_key", "width", label.alias("label")), "near-left")
    more = saved(rest_links(left, shingle_sets(left.select("set_key"), docs, nodes, words), similarity), "near-links")
    roots = stars if more.isEmpty() else components(stars.unionByName(more))
    return told, nodes.select("set_key", "least", "pick").join(roots.select(F.col("a").alias("set_key"), F.col("b").alias("root")), "set_key", "left").withColumn("root", label)


def near_components(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id: one row for each row of ``docs``.

    Rows link if their shingle sets are at least ``similarity`` alike (Jaccard); texts without words link with each other. The
    component is named by its smallest doc_id; null ids count only where there is no other, and a text whose every
    id is null stays by itself. Repeated rows stay repeated; an empty table gives no rows.
    """
    told, rooted = rooted_sets(docs, words, similarity)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_key = rooted.select("set_key", "root").join(named, "root").select("set_key", "component_id")
    return told.select("doc_id", "set_key").join(of_key, "set_key").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each component, that of the smallest doc_id, with all its columns.

    The row is known by its id and text, so texts that share an id, or have none, do not stand for each other.
    """
    _, rooted = rooted_sets(docs, words, similarity)
    stays = rooted.groupBy("root").agg(F.min("pick").alias("pick"))
    keep = stays.select(id_key(F.col("pick.doc_id")).alias("__keep_key"), F.col("pick.text_key").alias("__keep_text"))
    keys = docs.withColumns({"__keep_key": id_key(docs["doc_id"].cast("long")), "__keep_text": text_key(docs["text"])})
    return keys.join(keep, ["__keep_key", "__keep_text"], "left_semi").dropDuplicates(["__keep_key", "__keep_text"]).drop("__keep_key", "__keep_text")
