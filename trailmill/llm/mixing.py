"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target / size of its source times. The whole part is taken as it is;
the fractional part is a probability that is rounded to 0 or 1 without changing the source's
expected words: documents are paired, and mass that is equal in words moves at random between them until one
is integral. The others go on to the next pairs. Long documents come first and are paired with several shorter
ones at once, so that what stays open at last is short. Documents are dealt by a hash into
chunks of a source, each leaves at most one fraction, and these residuals meet in a reduction tree, up to one
for each source, which is drawn. The words taken differ from the target by less than one document.
All draws come from hashes of doc_id, so that reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import saved
from .shards import numbered_by_partition
from .text import HOT_SHARE, beside, word_count

#: A source's words are at most taken so many times.
MOST_TIMES = 3
#: Documents in a chunk on the first level, and residuals in a group on the others.
CHUNK_ROWS, FAN_IN = 2_000, 256
#: Equal rows that one task writes.
BLOCK_ROWS = 10_000
EPS = 1e-12


def source_key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source))


def source_recipe(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """source_key, of_source, n, source_no, source_size, target, times, chunks of the sources of ``rows`` (source, size), however many.

    Sources by code point, null last, weigh ``weights`` in turn. All sizes are shared by weight, none above ``MOST_TIMES``
    its own: where the share of one unit of weight is above what a source can take, the source gives all it can, which
    raises the share for the others, until none is above.
    """
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).withColumn("none", F.col("source").isNull())
    placed = saved(numbered_by_partition(found, "none", "source"), "mix-sources")
    before, offsets = 0, []
    for part, n in sorted(placed.groupBy("part").count().collect()):  # at most one row a partition
        offsets.append((part, before))
        before += n
    number = F.col("place") + F.col("offset")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    numbered = placed.join(F.broadcast(spark.createDataFrame(offsets, "part long, offset long")), "part").select("source", "n", "source_size", number.alias("source_no"), weight.alias("weight"))
    table = saved(numbered.withColumn("most", F.col("source_size") * MOST_TIMES), "mix-numbered")
    total, all_weights = table.filter("source_size > 0").agg(F.sum("source_size"), F.sum("weight")).first()
    share, full = (total or 0) / (all_weights or 1), None
    while True:
        now = table.filter("source_size > 0").filter(F.col("weight") * share > F.col("most")).agg(F.count("*"), F.sum("most"), F.sum("weight")).first()
        if now[0] == full or not now[0]:
            break
        full = now[0]
        share = (total - now[1]) / (all_weights - now[2]) if all_weights > now[2] else share
    target = F.when(F.col("source_size") > 0, F.least(F.col("weight") * share, F.col("most").cast("double"))).otherwise(0.0)
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    told = table.withColumn("target", target).withColumn("times", times)
    return saved(told.select(source_key(F.col("source")).alias("source_key"), F.col("source").alias("of_source"), "n", "source_no", "source_size", "target", "times", F.ceil(F.col("n") / CHUNK_ROWS).cast("int").alias("chunks")), "mix-recipe")


def is_open(p: float) -> bool:
    """Is a chance neither 0 nor 1?"""
    return EPS < p < 1 - EPS


def round_run(chance: np.ndarray, size: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Pivotal rounding along one run; (chances, position of the one left fractional or -1).

    Each open document in turn meets the next open ones. It becomes 1 with its own probability, taking words
    from the partners, or else 0, giving them words; a partner's share is what it can take or
    give in either case, so that every chance keeps its expectation and the words keep their sum. Where the
    partners left cannot settle it, the rest is settled pair by pair.
    """
    p, sizes, draw, n = chance.tolist(), size.tolist(), draws.tolist(), len(chance)
    for k in range(n):
        if not is_open(p[k]) or sizes[k] <= 0:
            p[k] = float(draw[k] < p[k])  # no words, or settled
            continue
        a, need, shares = p[k], float(sizes[k]), []
        for j in range(k + 1, n):
            if need <= 0:
                break
            if is_open(p[j]) and sizes[j] > 0:
                share = min(p[j] * sizes[j] / (1 - a), (1 - p[j]) * sizes[j] / a, need)
                shares.append((j, share))
                need -= share
        if need > 1e-9 * sizes[k]:
            return settle_pairs(p, sizes, draw, k)
        up = draw[k] < a
        p[k] = float(up)
        for j, share in shares:
            p[j] += (-(1 - a) * share if up else a * share) / sizes[j]
    return np.array(p), -1


def settle_pairs(p: list[float], sizes: list[int], draw: list[float], first: int) -> tuple[np.ndarray, int]:
    """Pair by pair from ``first``: words move at random until one of two is integral; the other goes on."""
    held = -1
    for k in range(first, len(p)):
        if not is_open(p[k]) or sizes[k] <= 0:
            p[k] = float(draw[k] < p[k])
            continue
        if held < 0:
            held = k
            continue
        a, b, sa, sb = p[held], p[k], sizes[held], sizes[k]
        up, down = min((1 - a) * sa, b * sb), min(a * sa, (1 - b) * sb)
        moved = up if draw[k] * (up + down) < down else -down
        p[held], p[k] = a + moved / sa, b - moved / sb
        before, held = held, held if is_open(p[held]) else k if is_open(p[k]) else -1
        for at in (before, k):
            if at != held:
                p[at] = float(p[at] >= 0.5)
    return np.array(p), held


def rounded(level: DataFrame, seed: int, last: bool) -> DataFrame:
    """Round each (source_no, chunk) group; ``open`` marks what is left fractional."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        # long documents first, so that the one left open is a short one
        pdf = pdf.sort_values(["size", "tie", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        mixed = (pdf["tie"].to_numpy(np.int64).view(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x94D049BB133111EB)
        draws = (mixed >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        chance, held = round_run(pdf["chance"].to_numpy(float), pdf["size"].to_numpy(np.int64), draws)
        pdf["chance"], pdf["open"] = chance, False
        if held >= 0 and last:
            pdf.loc[held, "chance"] = float(draws[held] < chance[held])
        elif held >= 0:
            pdf.loc[held, "open"] = True
        return pdf

    return level.groupBy("source_no", "chunk").applyInPandas(fold, level.schema)


def row_keys(docs: DataFrame) -> dict[str, Column]:
    """Two hashes that rows of equal doc_id, source and text share."""
    own = (docs["doc_id"].cast("string"), docs["source"].cast("string"), docs["text"].cast("string"))
    return {"__mix_a": F.xxhash64(*own), "__mix_b": F.xxhash64(F.lit("mix"), *own[::-1])}


def taken_units(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, size, source, source_size, target, keys, n, copies: one row for all rows of equal doc_id, source and text.

    ``n`` is their number and ``copies`` how often the mix takes them together, at most ``MOST_TIMES`` * n.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), word_count(docs["text"]).alias("size"), *(c.alias(k) for k, c in row_keys(docs).items()))
    units = saved(rows.groupBy("doc_id", "source", "size", "__mix_a", "__mix_b").agg(F.count("*").alias("m")), "mix-units")
    recipe = source_recipe(units.select("source", (F.col("size") * F.col("m")).alias("size")), weights)
    count = recipe.agg(F.sum("n")).first()[0] or 0
    wanted = beside(units.withColumn("source_key", source_key(F.col("source"))), recipe, ["source_key"], max(1.0, count * HOT_SHARE))
    tie = F.xxhash64("__mix_a", "__mix_b")
    whole = F.least(F.floor(F.col("times") * F.col("m")), F.col("m") * MOST_TIMES).cast("long")
    chance = F.col("times") * F.col("m") - F.col("whole")
    level = wanted.withColumn("whole", whole).select("doc_id", "size", "source_no", "source_size", "target", "__mix_a", "__mix_b", F.col("of_source").alias("source"), "m", "whole", chance.alias("chance"), F.pmod(F.xxhash64(tie), "chunks").cast("long").alias("chunk"), tie.alias("tie"), F.lit(False).alias("open"))
    most = recipe.agg(F.max("chunks")).first()[0] or 1
    done, depth = [], 0
    while True:
        level = saved(rounded(level, depth + 1, most == 1), f"mix-level{depth}")
        done.append(level.filter("not open"))
        if most == 1:
            break
        level = level.filter("open").withColumn("chunk", F.floor(F.col("chunk") / FAN_IN).cast("long"))
        most, depth = math.ceil(most / FAN_IN), depth + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "size", "source", "source_size", "target", "__mix_a", "__mix_b", F.col("m").alias("n"), (F.col("whole") + F.col("chance").cast("long")).alias("copies"))


def times_over(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as column ``times`` says; many copies are spread over tasks in blocks."""
    few = rows.filter(F.col(times) <= BLOCK_ROWS).withColumn("__mix_copy", F.explode(F.expr(f"sequence(1L, {times})")))
    blocks = rows.filter(F.col(times) > BLOCK_ROWS).withColumn("__mix_block", F.explode(F.expr(f"sequence(0L, ({times} - 1) div {BLOCK_ROWS})"))).repartition(times, "__mix_block")
    many = blocks.withColumn("__mix_copy", F.explode(F.expr(f"sequence(1L, least({BLOCK_ROWS}L, {times} - __mix_block * {BLOCK_ROWS}))")))
    return few.unionByName(many.drop("__mix_block")).drop("__mix_copy")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source: one row for each row of ``docs``.

    ``taken`` are the words that the mix takes of the row: ``copies`` (0 to 3) times its size. Null and
    blank texts have size 0; null is a source of its own, the last; rows of equal doc_id, source and text are rounded
    together and share what is taken evenly; an empty table gives no rows. doc_id must be an integer or null.
    """
    each, more = F.expr("copies div n"), F.expr("copies % n")
    split = F.array(F.struct(each.cast("int").alias("copies"), (F.col("n") - more).alias("rows")), F.struct((each + 1).cast("int").alias("copies"), more.alias("rows")))
    told = taken_units(docs, weights).withColumn("part", F.explode(split)).filter("part.rows > 0")
    out = times_over(told.withColumn("rows", F.col("part.rows")), "rows")
    return out.select("doc_id", "size", "source_size", "target", (F.col("part.copies") * F.col("size")).cast("long").alias("taken"), F.col("part.copies").alias("copies"), "source")


def take_mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; among rows of equal doc_id, source and text, one stands for what the others leave over."""
    keys = row_keys(docs)
    units = saved(taken_units(docs, weights).filter("copies > 0").select(*keys, "n", F.expr("copies div n").alias("__mix_each"), F.expr("copies % n").alias("__mix_more")), "mix-taken")
    bar = max(1.0, (units.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE)
    own = docs.withColumns(keys) if "n" not in docs.columns else docs.withColumnRenamed("n", "__mix_n").withColumns(keys)
    each = beside(own, units.filter("__mix_each > 0"), list(keys), bar)
    rest = beside(own, units.filter("__mix_more > 0"), list(keys), bar).dropDuplicates(list(keys))
    taken = times_over(each, "__mix_each").unionByName(times_over(rest, "__mix_more")).drop(*keys, "n", "__mix_each", "__mix_more")
    return taken.withColumnRenamed("__mix_n", "n")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
