"""Record files, hashes and sizes against Python's own."""

import struct
import zlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions.hashing import fnv1a_hex, shard_of, shard_of_literal
from tidelog.functions.records import encode_record, entry_length, little_endian, log_key
from tidelog.operators import storage
from tidelog.sources import record_files


def record(key: bytes, value: bytes | None) -> bytes:
    body = struct.pack("<II", len(key), 0xFFFFFFFF if value is None else len(value)) + key + (value or b"")
    return struct.pack("<I", zlib.crc32(body)) + body


def fnv(key: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in key:
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h


def test_known_hashes(spark):
    keys = ["foobar", "", "a", "é中😀", "x" * 300, None]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", fnv1a_hex(F.col("k")).alias("h"), *(shard_of(F.col("k"), n).alias(f"s{n}") for n in (1, 3, 7, 1000))).collect()
    got = {r["k"]: r for r in rows}
    assert got["foobar"]["h"] == "85944171f73967e8" and got[""]["h"] == "cbf29ce484222325" and got[None]["h"] is None
    for k in keys[:-1]:
        assert got[k]["h"] == f"{fnv(k.encode()):016x}"
        assert all(got[k][f"s{n}"] == fnv(k.encode()) % n == shard_of_literal(k.encode(), n) for n in (1, 3, 7, 1000))


def test_encoded_records(spark):
    cases = [(b"a", b"1"), (b"", b""), (b"key", None), (b"\x00\xff", b"\x07" * 300)]
    df = spark.createDataFrame(cases, "k binary, v binary").select("k", "v", encode_record(F.col("k"), F.col("v")).alias("r"))
    assert all(bytes(r["r"]) == record(bytes(r["k"]), None if r["v"] is None else bytes(r["v"])) for r in df.collect())
    assert bytes(spark.range(1).select(little_endian(F.lit(0x01020304))).first()[0]) == b"\x04\x03\x02\x01"
    assert bytes(spark.range(1).select(log_key(F.lit(258))).first()[0]) == b"l" + (258).to_bytes(8, "big")


def files(spark, tmp_path, *contents):
    for i, c in enumerate(contents):
        (tmp_path / f"f{i}").write_bytes(c)
    return [(bytes(r["key"]), None if r["value"] is None else bytes(r["value"])) for r in record_files.read(spark, str(tmp_path)).orderBy("file", "offset").collect()]


def test_a_torn_tail_is_dropped(spark, tmp_path):
    assert files(spark, tmp_path, record(b"a", b"1") + b"\x07" * 9) == [(b"a", b"1")]


def test_reading_stops_at_a_bad_record(spark, tmp_path):
    bad = bytearray(record(b"b", b"2"))
    bad[-1] ^= 1
    assert files(spark, tmp_path, record(b"a", b"1") + bytes(bad) + record(b"c", b"3"), b"", b"\0" * 64, record(b"d", None)) == [(b"a", b"1"), (b"d", None)]


def test_written_files_read_back(spark, tmp_path):
    rows = [(i, f"k{i % 7}", None if i % 5 == 0 else "v" * i) for i in range(100)]
    df = spark.createDataFrame(rows, "seq int, key string, value string").coalesce(1)
    record_files.write(df, str(tmp_path / "w"), ["seq"], file_bytes=500)
    got = record_files.read(spark, str(tmp_path / "w"))
    assert got.select("file").distinct().count() > 3
    assert sorted(repr((bytes(r["key"]).decode(), None if r["value"] is None else bytes(r["value"]).decode())) for r in got.collect()) == sorted(repr((k, v)) for _, k, v in rows)


@given(st.lists(st.tuples(st.binary(max_size=5), st.none() | st.binary(max_size=9)), max_size=8), st.binary(max_size=11))
def test_decode_inverts_encode(records, tail):
    data = b"".join(record(*r) for r in records)
    found = [(k, v) for _, _, k, v in record_files.decode(memoryview(data + tail))]
    assert found[: len(records)] == records and len(found) == len(records)


def test_offsets_directory_and_space(spark):
    writes = spark.createDataFrame([(0, 1, "a", "1"), (0, 2, "a", "22"), (0, 3, "b", ""), (0, 4, "c", "x"), (0, 5, "c", None)], "file int, seq int, key string, value string")
    assert [r["offset"] for r in storage.with_offsets(writes).orderBy("seq").collect()] == [0, 14, 29, 42, 56]
    assert {r["key"]: (r["value_offset"], r["value_length"]) for r in storage.key_directory(writes).collect()} == {"a": (14 + 13, 2), "b": (29 + 13, 0)}
    assert [(r["live_bytes"], r["dead_bytes"]) for r in storage.space(writes).collect()] == [(15 + 13, 14 + 14 + 13)]


def test_entry_lengths(spark):
    # term, op, key, value: sizes worked out from the wire format.
    cases = [(0, None, None, None, 0), (1, None, None, None, 2), (300, "GET", "k", None, 3 + 2 + 3), (1, "PUT", "k", "v", 2 + 2 + 2 + 3 + 3), (1, "DELETE", "k" * 200, None, 2 + 1 + 2 + 2 + 203)]
    df = spark.createDataFrame([c[:4] for c in cases], "term bigint, op string, key string, value string").select(entry_length(F.col("term"), F.col("op"), F.col("key"), F.col("value")).alias("n"))
    assert [r["n"] for r in df.collect()] == [c[4] for c in cases]
