"""Intermediate tables in the folder that the cluster shares.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it again, so
that a lost executor costs a re-read and never a recomputation of everything before it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Small rows that one partition takes at least where partitions are merged.
ROWS_A_FILE = 250_000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of this session; only a local session may fall back to a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="trailmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/trailmill-{spark.sparkContext.applicationId}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, about so many small rows, in no more partitions than they are worth, so that it is not written as many tiny files.

    No rows move; as many partitions as the cluster has cores, or more, stay.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_FILE)))


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables that this application saved; call it once no result is read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
