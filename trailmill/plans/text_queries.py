"""Text functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .catalog import query, table

FOLD = "regexp_replace(replace(replace(replace(replace(replace(translate(lower({0}), 'äöü', 'aou'), 'ß', 'ss'), 'ae', 'a'), 'oe', 'o'), 'ue', 'u'), 'ss', 's'), '[^a-z0-9]', '', 'g')"


@query(f"SELECT doc_id, md5({FOLD.format('text')}) AS folded FROM documents")
def c01_folded(spark, sf_dir):
    """Every text folded for search, as a digest."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.folded(F.col("text")).cast("binary")).alias("folded"))


@query("""SELECT p_partkey, CASE WHEN length(p_name) < 4 THEN 0 WHEN length(p_name) <= 7 THEN 1 ELSE 2 END AS tolerance FROM part""")
def c02_tolerance(spark, sf_dir):
    """Typo tolerance of names."""
    return table(spark, sf_dir, "part").select("p_partkey", T.typo_tolerance(F.col("p_name")).alias("tolerance"))


@query(
    """WITH RECURSIVE n AS (SELECT DISTINCT p_name AS hay FROM part), w AS (SELECT 'rign' AS needle),
f AS (SELECT hay, 0 AS i, list_transform(range(length(hay) + 1), lambda x: 0) AS row FROM n
  UNION ALL SELECT hay, i + 1, list_reduce(list_prepend([i + 1], list_transform(range(1, length(hay) + 1), lambda j: [
      least(row[j + 1] + 1, row[j] + CASE WHEN substr(hay, j::INT, 1) = substr(needle, i + 1, 1) THEN 0 ELSE 1 END)])), lambda a, b: list_append(a, least(b[1], a[len(a)] + 1)))
  FROM f, w WHERE i < length(needle))
SELECT hay AS p_name, list_min(row)::INT AS distance FROM f, w WHERE i = length(needle)"""
)
def c03_substring_distance(spark, sf_dir):
    """How far a misspelt word is from the nearest part of each name."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select("p_name", T.substring_distance(F.lit("rign"), F.col("p_name")).alias("distance"))


@query(
    """SELECT p_partkey, CASE WHEN f = 'ring' THEN 0 WHEN starts_with(f, 'ring') THEN 1 WHEN len(list_filter(string_split(lower(p_name), ' '), lambda w: starts_with(w, 'ring'))) > 0 THEN 2 WHEN contains(f, 'ring') THEN 3 ELSE 9 END AS rank
FROM (SELECT *, replace(lower(p_name), ' ', '') AS f FROM part)"""
)
def c04_match_rank(spark, sf_dir):
    """How well each name matches a search."""
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(T.match_rank(F.lit("Ring"), F.col("p_name")), F.lit(9)).alias("rank"))


@query(
    """SELECT p_partkey, left(list_filter(w, lambda x: length(x) = list_max(list_transform(w, lambda y: length(y))))[1], 2) AS key FROM (SELECT p_partkey, string_split(replace(replace(replace(replace(lower(p_name), 'ae', 'a'), 'oe', 'o'), 'ue', 'u'), 'ss', 's'), ' ') AS w FROM part)"""
)
def c05_shard_key(spark, sf_dir):
    """The letters under which a name is filed."""
    return table(spark, sf_dir, "part").select("p_partkey", T.shard_key(F.col("p_name")).alias("key"))


@query("""SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS key FROM customer""")
def c06_name_key(spark, sf_dir):
    """Names as keys."""
    return table(spark, sf_dir, "customer").select("c_custkey", T.name_key(F.col("c_name")).alias("key"))


@query("""SELECT doc_id, CASE WHEN length(text) > 140 THEN left(text, 139) || '…' ELSE text END AS short FROM documents""")
def c10_truncated(spark, sf_dir):
    """Texts cut to the length of a message."""
    return table(spark, sf_dir, "documents").select("doc_id", T.truncated(F.col("text"), 140).alias("short"))


@query(
    """WITH n AS (SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS names FROM customer GROUP BY 1)
SELECT c_nationkey, CASE WHEN len(names) <= 3 THEN array_to_string(names, ', ') ELSE array_to_string(names[1:2], ', ') || ' and ' || (len(names) - 2) || ' others' END AS joined FROM n"""
)
def c09_joined_names(spark, sf_dir):
    """Names of a group in one line."""
    names = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_set("c_mktsegment")).alias("names"))
    return names.select("c_nationkey", T.joined_names(F.col("names")).alias("joined"))


@query(
    """SELECT p_partkey, substr(p_brand, 7)::INT < 3 AS older FROM part"""
)
def c19_versions(spark, sf_dir):
    """Is a version below a least one?"""
    version = F.concat(F.substring("p_brand", 7, 9), F.lit(".0.0"))
    return table(spark, sf_dir, "part").select("p_partkey", T.is_older(version, F.lit("3.0.0")).alias("older"))


@query("""SELECT user_id, 'live:' || least(user_id::VARCHAR, (user_id % 13)::VARCHAR) || ':' || greatest(user_id::VARCHAR, (user_id % 13)::VARCHAR) AS topic, count(*) AS n FROM events GROUP BY 1, 2""")
def c17_topics(spark, sf_dir):
    """Topics of pairs."""
    other = (F.col("user_id") % 13).cast("string")
    return table(spark, sf_dir, "events").groupBy("user_id", T.pair_topic(F.col("user_id").cast("string"), other).alias("topic")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events""")
def c37_json(spark, sf_dir):
    """A number from JSON properties."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").k.alias("k"))


@query("""SELECT DISTINCT o_orderpriority, sha256(o_orderpriority) AS token FROM orders""")
def c18_sha(spark, sf_dir):
    """Digests of tokens."""
    return table(spark, sf_dir, "orders").select("o_orderpriority").distinct().select("o_orderpriority", F.sha2("o_orderpriority", 256).alias("token"))


@query("""SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS month, o_orderdate > TIMESTAMP '1998-08-02' - INTERVAL 90 DAY AS fresh FROM orders""")
def c20_retention(spark, sf_dir):
    """Months and freshness of orders."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.trunc("o_orderdate", "MM").alias("month"), (F.col("o_orderdate") > F.expr("timestamp'1998-08-02' - interval 90 days")).alias("fresh"))


@query(
    """SELECT o_orderkey, CASE WHEN p < 1000 THEN printf('%d m', round(p)::BIGINT) WHEN p < 10000 THEN printf('%.1f km', p / 1000) ELSE printf('%d km', round(p / 1000)::BIGINT) END AS label FROM (SELECT o_orderkey, o_totalprice / 16 AS p FROM orders)"""
)
def c30_labels(spark, sf_dir):
    """Lengths as labels."""
    return table(spark, sf_dir, "orders").select("o_orderkey", T.meters_label(F.col("o_totalprice") / 16).alias("label"))


@query(f"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {FOLD.format('text')} ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def j30_first_per_fold(spark, sf_dir):
    """The first document of each folded text."""
    from ..operators.setops import first_per_key

    docs = table(spark, sf_dir, "documents").withColumn("fold", T.folded(F.col("text")))
    return first_per_key(docs, ["fold"], [F.asc("doc_id")]).select("doc_id")


@query("""SELECT s_suppkey FROM supplier WHERE starts_with(lower(s_name), lower('SUPPLIER#00000001'))""")
def j11_search_prefix(spark, sf_dir):
    """People by the beginning of their name."""
    return table(spark, sf_dir, "supplier").filter(F.startswith(F.lower("s_name"), F.lower(F.lit("SUPPLIER#00000001")))).select("s_suppkey")
