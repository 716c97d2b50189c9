"""FNV-1a over key bytes, in Spark expressions.

Spark's integers are signed and raise on overflow, so the 64-bit state is kept as two halves of
32 bits; no intermediate value leaves the signed range.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of FNV-1a 64: the offset basis by halves. The prime is 2 ** 40 + 435.
BASIS_HIGH, BASIS_LOW = 0xCBF29CE4, 0x84222325
PRIME_LOW, PRIME_SHIFT = 435, 256
HALF = 0xFFFFFFFF


def fnv1a_halves(key: Column) -> Column:
    """struct<hi, lo> of the FNV-1a hash of the key's bytes; the basis for an empty key."""
    letters = F.decode(key.cast("binary"), "ISO-8859-1")
    size = F.octet_length(key.cast("binary"))
    codes = F.when(size == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.ascii(F.substring(letters, i, F.lit(1))).cast("bigint"))
    )
    start = F.struct(F.lit(BASIS_HIGH).cast("bigint").alias("hi"), F.lit(BASIS_LOW).cast("bigint").alias("lo"))

    def step(state: Column, byte: Column) -> Column:
        x = state["lo"].bitwiseXOR(byte)
        low = x * PRIME_LOW
        high = state["hi"] * PRIME_LOW + F.shiftrightunsigned(low, 32) + x * PRIME_SHIFT
        return F.struct(high.bitwiseAND(F.lit(HALF)).alias("hi"), low.bitwiseAND(F.lit(HALF)).alias("lo"))

    return F.aggregate(codes, start, step)


def fnv1a_hex(key: Column) -> Column:
    """The hash as 16 lower-case hexadecimal digits; null for a null key."""
    h = fnv1a_halves(key)
    return F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0")))


def shard_of(key: Column, shards: Column | int) -> Column:
    """The key's shard: its hash, unsigned, modulo ``shards`` (below 2 ** 31)."""
    n = (F.lit(shards) if isinstance(shards, int) else shards).cast("bigint")
    h = fnv1a_halves(key)
    return F.pmod(F.pmod(h["hi"], n) * F.pmod(F.lit(1 << 32), n) + h["lo"], n).cast("int")


def shard_of_literal(key: bytes, shards: int) -> int:
    """The shard of one key known to the caller, to filter on the partition column by a literal."""
    h = BASIS_HIGH << 32 | BASIS_LOW
    for byte in key:
        h = (h ^ byte) * ((PRIME_SHIFT << 32) + PRIME_LOW) % (1 << 64)
    return h % shards
