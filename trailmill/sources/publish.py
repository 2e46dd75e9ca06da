"""Tables published in versions behind gates, and writes that a repeated request does not repeat.

A version is a folder ``v=<number>``; it counts once Spark has committed it, so a job that fails or loses its driver leaves the version before it
in place, and readers of an older version are not disturbed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: one of so many rows of a region may go, and as many may close, from one version to the next; counted in whole rows.
ONE_OF = 3


def committed(spark: SparkSession, path: str, name: str) -> list[str]:
    """Folders ``<name>=...`` below a path that a job has committed, in the order of their names."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}=*/_SUCCESS")
    listed = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found)
    return sorted(str(s.getPath().getParent()) for s in listed or [])


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest committed version, or None before the first."""
    versions = committed(spark, path, "v")
    return spark.read.parquet(versions[-1]) if versions else None


def gates(old: DataFrame, new: DataFrame, open_now: Column) -> DataFrame:
    """region, was, now, closing, verdict for rows (region, id, ...): ``ok``, or why a region's old rows stay.

    ``gone``: more than a third of the rows is missing (all of them if its source could not be read); ``closed``: more than a third was open and is not any
    more. One join and one aggregate tell all regions.
    """
    a = old.select("region", "id", F.lit(True).alias("__old"), open_now.alias("__was_open"))
    b = new.select("region", "id", F.lit(True).alias("__new"), open_now.alias("__is_open"))
    both = a.join(b, ["region", "id"], "full_outer")
    closing = F.col("__new") & F.col("__was_open") & ~F.coalesce("__is_open", F.lit(False))
    sums = both.groupBy("region").agg(F.count("__old").alias("was"), F.count("__new").alias("now"), F.count_if(closing).alias("closing"))
    verdict = F.when((F.col("was") - F.col("now")) * ONE_OF > F.col("was"), "gone").when((F.col("was") > 0) & (F.col("closing") * ONE_OF > F.col("was")), "closed").otherwise("ok")
    return sums.withColumn("verdict", verdict)


def publish(spark: SparkSession, path: str, new: DataFrame, open_now: Column) -> DataFrame:
    """Write the next version: new rows (region, id, ...; neither null, ids unique in a region) of regions that pass the gates, the old ones of all others.

    Returns the report of the gates. Columns are those of the version before; the first version takes all that is given.
    """
    old = published(spark, path)
    number = len(committed(spark, path, "v")) + 1
    target = f"{path}/v={number:08d}"
    if old is None:
        new.write.mode("overwrite").parquet(target)
        return gates(new.limit(0), spark.read.parquet(target), open_now)
    report = gates(old, new.select(old.columns), open_now)
    fine = report.filter("verdict = 'ok'").select("region")
    rows = new.select(old.columns).join(fine, "region", "left_semi").unionByName(old.join(fine, "region", "left_anti"))
    # an unfinished folder of a job that failed is nobody's version and may go
    rows.write.mode("overwrite").parquet(target)
    return report


def write_once(spark: SparkSession, path: str, rows: DataFrame, client: str, order: list[Column]) -> DataFrame:
    """Append rows whose client id was not written before (the first of each id in an order; rows without an id always) and return those written.

    Each call is a folder of its own; only the column of ids is read of the ones before. Repeating a call writes nothing, and a call that failed may be repeated.
    """
    batches = committed(spark, path, "batch")
    first = F.row_number().over(W.partitionBy(client).orderBy(*order))
    named = rows.filter(F.col(client).isNotNull()).withColumn("__first", first).filter("__first = 1").drop("__first")
    if batches:
        named = named.join(spark.read.parquet(*batches).select(client), client, "left_anti").select(rows.columns)
    target = f"{path}/batch={len(batches) + 1:08d}"
    named.unionByName(rows.filter(F.col(client).isNull())).write.mode("overwrite").parquet(target)
    return spark.read.schema(rows.schema).parquet(target)
