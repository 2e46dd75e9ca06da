"""Columns and sizes that several text operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as all contracts of this folder define them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Keys of more than this share of all rows are hot; there are 1 / HOT_SHARE of them at most.
HOT_SHARE = 0.001


def text_or_empty(text: Column) -> Column:
    """The text, or the empty text for null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def one_spaced(text: Column) -> Column:
    """The text with each run of white space replaced by one space."""
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


def word_count(text: Column) -> Column:
    """Number of words in the text (null: 0)."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def crc_share(doc_id: Column, parts: int) -> Column:
    """crc32 of the decimal doc_id modulo ``parts``; null ids count as an empty string."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``rows``; Spark bounds the bytes of a batch (``spark.sql.execution.arrow.maxBytesPerBatch``)."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def beside(rows: DataFrame, table: DataFrame, keys: list[str], bar: float) -> DataFrame:
    """Inner join of rows with a table of one row a key and their number ``n``: keys of more than ``bar`` rows by broadcast, all others by shuffle."""
    hot = F.broadcast(table.filter(F.col("n") > bar))
    cold = rows.join(F.broadcast(table.filter(F.col("n") > bar).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(cold.join(table.filter(F.col("n") <= bar), keys))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_MODEL: dict[str, Any] = {}


def kept_in_worker(key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in each Python worker; a worker holds one model at a time, whichever operator it is of.

    The memory of the model before, and what making this one has left, goes back to the system.
    """
    if key not in _MODEL:
        _MODEL.clear()
        given_back()
        _MODEL[key] = make()
        given_back()
    return _MODEL[key]


def given_back() -> None:
    """Give memory that is free in this process back to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
