import pytest
from pyspark.sql import functions as F

from trailmill.sources import publish


def rows(spark, *told):
    return spark.createDataFrame([(r, k, k < up) for r, n, up in told for k in range(n)], "region string, id int, up boolean")


def counts(df):
    return {r.region: (r.n, r.open) for r in df.groupBy("region").agg(F.count("*").alias("n"), F.count_if("up").alias("open")).collect()}


def test_gates_keep_the_old_rows(spark, tmp_path):
    path = f"file://{tmp_path}/trails"
    assert publish.published(spark, path) is None
    publish.publish(spark, path, rows(spark, ("a", 9, 9), ("b", 9, 9), ("c", 9, 9), ("d", 9, 9)), F.col("up"))
    report = publish.publish(spark, path, rows(spark, ("a", 6, 6), ("b", 5, 5), ("c", 9, 5), ("e", 2, 0)), F.col("up"))
    assert {r.region: (r.was, r.now, r.closing, r.verdict) for r in report.collect()} == {"a": (9, 6, 0, "ok"), "b": (9, 5, 0, "gone"), "c": (9, 9, 4, "closed"), "d": (9, 0, 0, "gone"), "e": (0, 2, 0, "ok")}
    assert counts(publish.published(spark, path)) == {"a": (6, 6), "b": (9, 9), "c": (9, 9), "d": (9, 9), "e": (2, 0)}


def test_a_failing_job_leaves_the_version_before(spark, tmp_path):
    path = f"file://{tmp_path}/trails"
    good = rows(spark, ("a", 3, 3))
    publish.publish(spark, path, good, F.col("up"))
    broken = good.withColumn("id", F.when(F.col("id") == 2, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        publish.publish(spark, path, broken, F.col("up"))
    assert len(publish.committed(spark, path, "v")) == 1 and counts(publish.published(spark, path)) == {"a": (3, 3)}
    publish.publish(spark, path, good.filter("id < 2"), F.col("up"))
    assert counts(publish.published(spark, path)) == {"a": (2, 2)}


def test_replays_change_no_row(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    sent = spark.createDataFrame([("c1", 1), ("c1", 2), ("c2", 3), (None, 4)], "client string, k int")
    assert sorted(r.k for r in publish.write_once(spark, path, sent, "client", [F.asc("k")]).collect()) == [1, 3, 4]
    assert publish.write_once(spark, path, sent.filter("client is not null"), "client", [F.asc("k")]).count() == 0
    more = spark.createDataFrame([("c2", 9), ("c3", 8)], sent.schema)
    assert [r.k for r in publish.write_once(spark, path, more, "client", [F.asc("k")]).collect()] == [8]
