"""Append-only record files as a source and a sink.

A record is a little-endian CRC-32, key length and value length, then key and value; a value
length of 2 ** 32 - 1 marks a tombstone. Reading stops at the first record that is torn or
whose checksum is wrong: all after it is left out, and the file stays as it is.

Files are the unit of parallelism, as a record's place follows from all before it in its file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from tidelog.functions.records import HEADER_BYTES, TOMBSTONE_LENGTH, encode_record
from tidelog.plans.shipping import map_batches

FILE_BYTES = 8_000_000
BATCH_BYTES = 4_000_000

RECORDS = StructType([
    StructField("file", StringType()), StructField("offset", LongType()), StructField("record_length", LongType()),
    StructField("key", BinaryType()), StructField("value", BinaryType()), StructField("is_tombstone", BooleanType()),
])


def decode(data: memoryview) -> Iterator[tuple[int, int, bytes, bytes | None]]:
    """(offset, length, key, value) of each record up to the first bad one; a tombstone's value is None."""
    at = 0
    while at + HEADER_BYTES <= len(data):
        checksum, key_length, value_length = struct.unpack_from("<III", data, at)
        dead = value_length == TOMBSTONE_LENGTH
        key_end = at + HEADER_BYTES + key_length
        end = key_end + (0 if dead else value_length)
        if end > len(data) or zlib.crc32(data[at + 4 : end]) != checksum:
            return
        yield at, end - at, bytes(data[at + HEADER_BYTES : key_end]), None if dead else bytes(data[key_end:end])
        at = end


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files in ``path``: (file, offset, record_length, key, value, is_tombstone)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, held, size = to_arrow_schema(RECORDS), [], 0
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for offset, length, key, value in decode(memoryview(content.as_buffer())):
                    held.append({"file": file, "offset": offset, "record_length": length, "key": key, "value": value, "is_tombstone": value is None})
                    size += length + 100
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return map_batches(files, run, RECORDS)


def write(writes: DataFrame, path: str, order: list[str], file_bytes: int = FILE_BYTES, torn: str = "\x07" * 9) -> None:
    """Append the writes (key, value; null is a tombstone) to new files in ``path``, in the order of the columns ``order``.

    Spark's text writer makes one file of each row, and ends it by a separator, here ``torn``,
    too short for a record: a reader drops it like any torn tail.
    """
    schema = StructType([StructField("file", BinaryType())])
    records = writes.sortWithinPartitions(*order).select(encode_record(F.col("key"), F.col("value")).alias("record"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for record in batch.column(0).to_pylist():
                held.append(record)
                size += len(record)
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=schema.names)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=schema.names)

    files = map_batches(records, run, schema).select(F.col("file").cast("string").alias("value"))
    files.write.mode("append").option("lineSep", torn).option("maxRecordsPerFile", 1).text(path)
