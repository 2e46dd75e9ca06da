"""Importance resampling towards the distribution of a target set, by hashed features.

Words and runs of words fall into a fixed number of buckets. One aggregate for each table counts the features of every bucket; only these
totals are shuffled. From them each bucket has an integer gain, and the gains stand as one literal array in the plan.
Documents are scored without exploding them: a higher-order function makes the array of buckets of a text, and another one adds up
their gains. A document is drawn if its gain plus Gumbel noise from its id is among the highest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.groups import in_order_of_all
from ..scratch import saved
from .text import text_or_empty

BUCKETS = 10_000
#: What parts words: ASCII other than digits and lower-case letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_words(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; null has none."""
    parts = F.split(F.translate(text_or_empty(text), UPPER, LOWER), GAP)
    return F.filter(parts, lambda w: w != "")


def bucket(feature: Column, buckets: int) -> Column:
    """The bucket of a feature: crc32 of its bytes."""
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def feature_buckets(words: str, longest: int, buckets: int) -> Column:
    """Buckets of all runs of 1 to ``longest`` consecutive words of a column, repeats included.

    ``words`` names a column, since an expression would be computed again for each run.
    """
    single = F.transform(words, lambda w: bucket(w, buckets))

    def runs(length: int) -> Column:
        starts = F.when(F.size(words) >= length, F.sequence(F.lit(1), F.size(words) - length + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: bucket(F.array_join(F.slice(words, at, length), " "), buckets))

    return F.concat(single, *map(runs, range(2, longest + 1))) if longest > 1 else single


def bucket_totals(texts: DataFrame, longest: int, buckets: int) -> list[int]:
    """Features in each bucket over all rows; tasks add up their own rows first, so only totals are shuffled."""
    words = texts.select(plain_words(texts["text"]).alias("words"))
    found = words.select(F.explode(feature_buckets("words", longest, buckets)).alias("bucket")).groupBy("bucket").count()
    totals = [0] * buckets
    for at, n in found.collect():  # at most one row a bucket
        totals[at] = n
    return totals


def gains(target: list[int], raw: list[int]) -> list[int]:
    """floor(1000 ln) of each bucket's share among the targets over its share among all documents, with one more in each bucket."""
    t, s, n = sum(target), sum(raw), len(raw)
    return [math.floor(1000 * math.log((a + 1) * (s + n) / ((b + 1) * (t + n)))) for a, b in zip(target, raw)]


def literal_array(values: list[int]) -> Column:
    """One array literal of many integers; as a folded string it costs the planner no expression for each entry."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def scored(docs: DataFrame, gain: list[int], longest: int, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row, without a shuffle."""
    words = docs.select(docs["doc_id"].alias("doc_id"), plain_words(docs["text"]).alias("words"))
    listed = words.select("doc_id", F.size("words").alias("n_words"), feature_buckets("words", longest, len(gain)).alias("buckets"))
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(literal_array(gain), b + 1))
    n = F.size("buckets").cast("long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    told = listed.select("doc_id", "n_words", n.alias("n_features"), total.alias("total"), noise.alias("noise"))
    floored = F.floor(F.col("total") / F.col("n_features"))
    weight = F.when(F.col("n_features") > 0, floored).otherwise(F.lit(0)).cast("long")
    return told.select("doc_id", "n_words", "n_features", weight.alias("weight"), (weight + F.col("noise")).cast("long").alias("score"))


def resample(docs: DataFrame, targets: DataFrame, percent: int = 10, longest: int = 1, least_words: int = 20, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank (of the drawn rows; else null) of each row of ``docs``.

    Both tables need a column ``text``; others than it and doc_id are not read. A null or empty text has no feature and weight 0; without
    targets all gains follow from the documents alone. A null doc_id counts as an empty one in the noise and comes first among equal scores.
    Repeated rows are scored and drawn each for itself; rows of equal doc_id and score are in the order of n_features and then any order, which
    changes no result. Texts are read whole. An empty table of documents gives no rows.
    """
    gain = gains(bucket_totals(targets, longest, buckets), bucket_totals(docs, longest, buckets))
    rows = saved(scored(docs, gain, longest, seed), "resample-scores")
    eligible = rows.filter(F.col("n_words") >= least_words)
    drawn = percent * eligible.count() // 100
    ranked = in_order_of_all(eligible, [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight")])
    rank = F.when(F.col("__place") <= drawn, F.col("__place")).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = rows.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, rank).unionByName(rest)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents, drawn towards the benchmark."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same in SQL. crc32 is folded over the bytes of each different word, by a table of 256 remainders made from its rule.
OP12_SQL = """WITH RECURSIVE rule AS (SELECT b::BIGINT AS b, b::BIGINT AS r, 0 AS k FROM range(256) t(b) UNION ALL SELECT b, xor(r >> 1, (r & 1) * 3988292384), k + 1 FROM rule WHERE k < 8),
crc AS MATERIALIZED (SELECT b, r FROM rule WHERE k = 8),
d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM documents),
g AS MATERIALIZED (SELECT list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
dw AS MATERIALIZED (SELECT row, unnest(ws) AS w FROM d), gw AS MATERIALIZED (SELECT unnest(ws) AS w FROM g),
ww AS MATERIALIZED (SELECT DISTINCT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM gw)),
fold AS (SELECT w, x, 0 AS k, 4294967295::BIGINT AS c FROM ww UNION ALL SELECT w, x, k + 1, xor(c >> 8, r) FROM fold JOIN crc ON b = xor(c & 255, ('0x' || substr(x, 2 * k + 1, 2))::BIGINT) WHERE 2 * k < length(x)),
bk AS MATERIALIZED (SELECT w, xor(c, 4294967295) % 10000 AS bucket FROM fold WHERE 2 * k = length(x)),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN bk USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM gw JOIN bk USING (w) GROUP BY 1),
gain AS MATERIALIZED (SELECT b AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM gw) + 10000))))::BIGINT AS g
FROM range(10000) r(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
wt AS (SELECT row, sum(g)::BIGINT AS total, count(*) AS n FROM dw JOIN bk USING (w) JOIN gain USING (bucket) GROUP BY 1),
sc AS MATERIALIZED (SELECT doc_id, len(ws) AS n_features, coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight,
coalesce(floor(total::DOUBLE / n), 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN wt USING (row)),
rk AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * (SELECT count(*) FROM sc WHERE n_features >= 20) // 100 THEN k END AS rank FROM rk"""
