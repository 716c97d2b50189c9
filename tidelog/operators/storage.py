"""Analytics of append-only record files: offsets, the key directory, live and dead bytes.

Writes have file, seq (the order in the file), key, value; a null value is a tombstone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.records import HEADER_BYTES, record_length


def with_offsets(writes: DataFrame) -> DataFrame:
    """The writes with record_length, and offset, where in its file each record begins.

    A file is one window, sorted by Spark in one task, spilling to disk; files are the unit of
    parallelism, as their size is bounded where they are written.
    """
    sized = writes.withColumn("record_length", record_length(F.col("key"), F.col("value")))
    before = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("offset", F.coalesce(F.sum("record_length").over(before), F.lit(0)).cast("bigint"))


def key_directory(writes: DataFrame) -> DataFrame:
    """(file, key, value_offset, value_length) of the keys whose last record is no tombstone."""
    last = with_offsets(writes).groupBy("file", "key").agg(F.max_by(F.struct("offset", F.octet_length("value").alias("size")), "offset").alias("r"))
    at = F.col("r.offset") + HEADER_BYTES + F.octet_length("key")
    return last.where("r.size IS NOT NULL").select("file", "key", at.cast("bigint").alias("value_offset"), F.col("r.size").cast("bigint").alias("value_length"))


def space(writes: DataFrame) -> DataFrame:
    """(file, live_bytes, dead_bytes): records that the directory points to, and all others."""
    sized = writes.withColumn("record_length", record_length(F.col("key"), F.col("value")))
    last = sized.groupBy("file", "key").agg(F.max_by(F.struct("record_length", "value"), "seq").alias("r"), F.sum("record_length").alias("total"))
    live = F.when(F.col("r.value").isNotNull(), F.col("r.record_length")).otherwise(0)
    both = last.groupBy("file").agg(F.sum(live).alias("live_bytes"), F.sum("total").alias("total"))
    return both.select("file", F.col("live_bytes").cast("bigint").alias("live_bytes"), (F.col("total") - F.col("live_bytes")).cast("bigint").alias("dead_bytes"))


def missing_entries(writes: DataFrame, pending: DataFrame, on: list[str]) -> DataFrame:
    """What is still to be written: rows of ``pending`` that ``writes`` lacks."""
    return pending.join(writes, on, "left_anti")
