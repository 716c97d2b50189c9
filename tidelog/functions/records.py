"""Sizes and bytes of stored records and log entries, in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the record format: the header is checksum, key length and value length.
HEADER_BYTES = 12
TOMBSTONE_LENGTH = 0xFFFFFFFF


def record_length(key: Column, value: Column) -> Column:
    """Bytes of the record of a key and a value; a null value is a tombstone."""
    return F.lit(HEADER_BYTES) + F.octet_length(key).cast("bigint") + F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint")


def little_endian(number: Column) -> Column:
    """The four bytes of a number below 2 ** 32, lowest first."""
    h = F.lpad(F.hex(number.cast("bigint")), 8, "0")
    return F.unhex(F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1))))


def encode_record(key: Column, value: Column) -> Column:
    """A record's bytes: CRC-32 of all that follows it, both lengths, key, value."""
    size = F.when(value.isNull(), F.lit(TOMBSTONE_LENGTH)).otherwise(F.octet_length(value).cast("bigint"))
    body = F.concat(little_endian(F.octet_length(key)), little_endian(size), key.cast("binary"), F.coalesce(value.cast("binary"), F.lit(b"")))
    return F.concat(little_endian(F.crc32(body)), body)


def log_key(idx: Column) -> Column:
    """The stored key of a log entry: "l" and the index, highest byte first."""
    return F.concat(F.unhex(F.lit("6C")), F.unhex(F.lpad(F.hex(idx.cast("bigint")), 16, "0")))


def varint_length(n: Column) -> Column:
    """Bytes of a base-128 number: its groups of seven bits, one at least."""
    bits = F.length(F.bin(n.cast("bigint")))
    return F.ceil(bits / F.lit(7)).cast("bigint")


def entry_length(term: Column, op: Column, key: Column, value: Column) -> Column:
    """Bytes of a log entry as a message, whose default fields take none; a null op is a no-op."""
    part = lambda n: F.when(n > 0, 1 + varint_length(n) + n).otherwise(F.lit(0)).cast("bigint")
    size = lambda x: F.coalesce(F.octet_length(x), F.lit(0)).cast("bigint")
    command = F.when(op == "GET", 0).otherwise(2).cast("bigint") + part(size(key)) + part(size(value))
    whole = F.when(op.isNull(), F.lit(0)).otherwise(1 + varint_length(command) + command)
    return (F.when(term == 0, 0).otherwise(1 + varint_length(term)) + whole).cast("bigint")
