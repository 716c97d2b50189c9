"""WARC archives, compressed record by record with Zstandard and a dictionary.

An archive begins with a skippable frame that holds its dictionary (itself compressed); then
comes one frame for each record. Frames of the skippable kind further on are passed over. Writer
and reader are DataFrame operators: the writer turns rows into archives of about ``archive_bytes``
in the shared folder, one file each; the reader loads each file's dictionary, walks from frame to
frame by the lengths in their block headers, decodes each alone and validates its headers and
lengths.

Spark's own text writer puts the files where any of its file systems are. Each row it writes is
one archive; the separator that it adds is an empty skippable frame, which zstd tools ignore.

A record whose payload another record has (by SHA-1) is written as a revisit that refers to it
and holds no payload; the response is the one with the largest id. Digests are counted before
the shuffle, and payloads meet their group's largest id in a join that Spark splits where one
payload is that of very many records.

Records of others are read too: any record type (only application/http blocks are taken apart; of
others the block is the payload), responses without a length or in chunks, names that aren't
UUIDs. ``record_id`` and ``refers_to_id`` are the names as they stand; ``id`` and ``refers_to``
the numbers in those that this writer gave, else null. All files below the folder are read.

A task holds one archive of at most 2 GB (Spark's limit of a file as one value) and decodes it
frame by frame; a record of more than ``max_record_bytes`` counts as damaged.

Defined results: a null payload is empty; a null id is smaller than all others, and rows that
share a largest id are all responses. A damaged frame or record gives a row with ``error`` set;
after a damaged dictionary or frame header the rest of the archive is given up, in one such row.
Extra columns aren't written. An empty table or folder gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tidelog.llm.kit import cut, map_parts, named, small
from tidelog.plans.shipping import map_batches, shared_path

ARCHIVE_BYTES = 64_000_000
BATCH_BYTES = 8_000_000
AT_ONCE, MAX_RECORD_BYTES = 16_000_000, 1 << 30
DICTIONARY_BYTES = 32_768
TRAINED_ON = 200
MIN_BYTES = 0

# Fixed values of the formats: magic numbers, and an empty skippable frame as text.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
EMPTY_FRAME = "P*M\x18\0\0\0\0"

DATE = "2024-01-01T00:00:00Z"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_id(number: int | None) -> str:
    """A record's name; the low 64 bits are its number, a set bit above them says there is none."""
    value = 1 << 64 if number is None else number & (1 << 64) - 1
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def record_number(name: str) -> int | None:
    """The number in a name made by record_id; none in others."""
    try:
        value = uuid.UUID(name.removeprefix("<urn:uuid:").removesuffix(">")).int
    except ValueError:
        return None
    low = value & (1 << 64) - 1
    return None if value >> 64 else low - (1 << 64) * (low >> 63)


def make_record(number: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record; the block is an HTTP response, of which a revisit has the head alone."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(number)}", f"WARC-Date: {DATE}"]
    if uri:
        head.append(f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', uri)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {SAME_PAYLOAD}"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """An archive: the dictionary's frame, then a frame for each record."""
    sample = records[:TRAINED_ON]
    try:
        trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, sample)) // 10)), sample)
    except zstandard.ZstdError:  # too few or too short records to learn from
        trained = None
    compressor = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
    parts = []
    if trained:
        stored = zstandard.ZstdCompressor(level=9, write_checksum=True).compress(trained.as_bytes())
        parts = [struct.pack("<II", DICTIONARY_MAGIC, len(stored)), stored]
    return b"".join([*parts, *map(compressor.compress, records)])


def write_archives(records: DataFrame, at: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the rows (id, uri, payload, response_id) as archives in the folder ``at``.

    response_id is null for responses, else what the revisit refers to; revisit tells which.
    """
    schema = StructType([StructField("archive", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in map_parts(batches):
            for number, uri, payload, refers_to, revisit in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                payload = payload or b""
                held.append(make_record(number, uri, payload, sha1_base32(payload), refers_to, revisit))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([pack(held)], pa.binary())], names=["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pack(held)], pa.binary())], names=["archive"])

    rows = records.select("id", "uri", F.col("payload").cast("binary").alias("payload"), "refers_to", "revisit")
    archives = map_batches(rows, run, schema).select(F.col("archive").cast("string").alias("value"))
    archives.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(at)


class Damaged(ValueError):
    """What is wrong with a frame or a record."""


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, by the sizes in its headers."""
    try:
        (magic,) = struct.unpack_from("<I", data, at)
        if magic != FRAME_MAGIC:
            raise Damaged(f"no frame at byte {at}")
        flags = data[at + 4]
        single, checksum = flags >> 5 & 1, flags >> 2 & 1
        content_size = (1 if single else 0, 2, 4, 8)[flags >> 6]
        at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + content_size
        last = False
        while not last:
            block = int.from_bytes(data[at : at + 3], "little")
            if len(data) < at + 3 or block >> 1 & 3 == 3:
                raise Damaged(f"no block at byte {at}")
            last, at = bool(block & 1), at + 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        at += 4 * checksum
    except (struct.error, IndexError) as e:
        raise Damaged(f"frame breaks off: {e}") from None
    if at > len(data):
        raise Damaged("frame breaks off")
    return at


def inflate(decoder: zstandard.ZstdDecompressor, frame: bytes, most: int) -> bytes:
    """The frame's content; memory grows with what is decoded, not with what the frame says."""
    if 0 <= zstandard.frame_content_size(frame) <= min(AT_ONCE, most):
        return decoder.decompress(frame)
    reader, parts, size = decoder.stream_reader(frame), [], 0
    while part := reader.read(1 << 20):
        parts.append(part)
        size += len(part)
        if size > most:
            raise Damaged(f"a frame of more than {most} bytes")
    declared = zstandard.frame_content_size(frame)
    if declared >= 0 and declared != size:
        raise Damaged("frame doesn't decode to its declared size")
    return b"".join(parts)


def frames(data: memoryview, most: int = MAX_RECORD_BYTES) -> Iterator[bytes | Damaged]:
    """The content of each frame after the leading dictionary, or what is wrong with it."""
    at, decoder = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at) if len(data) >= at + 8 else (0, 0)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + size > len(data):
                yield Damaged("skippable frame breaks off")
                return
            if at == 0 and magic == DICTIONARY_MAGIC:
                stored = bytes(data[8 : 8 + size])
                try:
                    if stored[:4] == struct.pack("<I", FRAME_MAGIC):
                        stored = inflate(zstandard.ZstdDecompressor(), stored, most)
                    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stored))
                    decoder.decompressobj()
                except (zstandard.ZstdError, Damaged) as e:
                    yield Damaged(f"dictionary doesn't decode: {e}")
                    return
            at += 8 + size
            continue
        try:
            end = frame_end(data, at)
        except Damaged as e:
            yield e
            return
        try:
            yield inflate(decoder, bytes(data[at:end]), most)
        except zstandard.ZstdError as e:
            yield Damaged(f"frame doesn't decode: {e}")
        except Damaged as e:
            yield e
        at = end


@dataclass
class Record:
    """A record as read, and what is wrong with it, if anything."""

    headers: dict[str, str]
    payload: bytes = b""
    payload_bytes: int | None = None
    error: str | None = None


def parse_headers(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def length_of(text: str) -> int | None:
    """A length as headers give it, if it is one."""
    return int(text) if re.fullmatch("[0-9]{1,18}", text) else None


def unchunked(body: bytes) -> bytes | None:
    """The body of a chunked transfer, or none if it isn't one."""
    parts, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = re.match(rb"[0-9A-Fa-f]{1,8}(?=\s*(?:;|$))", body[at:end])
        if not size:
            return None
        n, at = int(size[0], 16), end + 2
        if n == 0:
            return b"".join(parts)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        parts.append(body[at : at + n])
        at += n + 2
    return None


def same_digest(declared: str, *contents: bytes) -> bool:
    """Whether a digest is that of any of the contents; those of other algorithms than SHA-1 aren't checked."""
    kind, _, value = declared.partition(":")
    return kind.lower() != "sha1" or any(value.upper() == sha1_base32(c) or value.lower() == hashlib.sha1(c).hexdigest() for c in contents)


def parse(content: bytes) -> Record:
    """One record; its version, required headers, lengths and digests are checked."""
    head, found, rest = content.partition(b"\r\n\r\n")
    headers = parse_headers(head)
    if not re.match(rb"WARC/1\.[01]\r\n", content) or not found:
        return Record(headers, error="no WARC version or header end")
    if missing := [k for k in REQUIRED if not headers.get(k)]:
        return Record(headers, error=f"no {', '.join(missing)}")
    if length_of(headers["content-length"]) != len(rest) - 4 or not rest.endswith(b"\r\n\r\n"):
        return Record(headers, error="Content-Length isn't the block's")
    block, revisit = rest[:-4], headers["warc-type"] == "revisit"
    record = Record(headers, block, len(block))
    if "warc-block-digest" in headers and not same_digest(headers["warc-block-digest"], block):
        record.error = "the block's digest isn't the declared one"
    contents = (block,)
    if headers.get("content-type", "").lower().startswith("application/http") and (block or not revisit):
        record = _http(record, block, revisit)
        contents = (record.payload, block.partition(b"\r\n\r\n")[2])
    if revisit:
        if not block:
            record.payload_bytes = None
        if record.payload or not (headers.get("warc-refers-to") or headers.get("warc-refers-to-target-uri")):
            record.error = record.error or "a revisit with a payload or without a reference"
    elif record.error is None and not same_digest(headers.get("warc-payload-digest", ""), *contents):
        record.error = "the payload's digest isn't the declared one"
    return record


def _http(record: Record, block: bytes, revisit: bool) -> Record:
    """The record with the payload of its HTTP message."""
    http, found, body = block.partition(b"\r\n\r\n")
    lines = parse_headers(http)
    declared, request = lines.get("content-length"), record.headers["warc-type"] == "request"
    if not found or not (request or http.startswith(b"HTTP/")):
        record.payload, record.payload_bytes, record.error = b"", None, record.error or "no HTTP message"
        return record
    record.payload, record.payload_bytes = body, len(body)
    if "chunked" in lines.get("transfer-encoding", "").lower():
        if (whole := unchunked(body)) is not None:
            record.payload, record.payload_bytes = whole, len(whole)
    elif declared is not None:
        n = length_of(declared)
        if n is None or not revisit and n != len(body):
            record.error = record.error or "the payload's length isn't the declared one"
        record.payload_bytes = n
    elif revisit:
        record.payload_bytes = None
    return record


READ = StructType([
    StructField("id", LongType()), StructField("uri", StringType()), StructField("record_type", StringType()), StructField("payload_bytes", LongType()),
    StructField("payload_digest", StringType()), StructField("refers_to", LongType()), StructField("payload", BinaryType()), StructField("error", StringType()),
    StructField("record_id", StringType()), StructField("refers_to_id", StringType()),
])


def _row(content: bytes | Damaged, with_payload: bool) -> dict:
    if isinstance(content, Damaged):
        return {"error": str(content)}
    record = parse(content)
    h = record.headers
    name, refers_to, digest = h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-payload-digest")
    row = {
        "uri": h.get("warc-target-uri"), "record_type": h.get("warc-type"), "payload_bytes": record.payload_bytes, "error": record.error, "record_id": name, "refers_to_id": refers_to,
        "payload_digest": digest.removeprefix("sha1:") if digest else sha1_base32(record.payload), "id": name and record_number(name), "refers_to": refers_to and record_number(refers_to),
    }
    return row | ({"payload": record.payload} if with_payload else {})


def read_archives(spark: SparkSession, at: str, with_payload: bool = True, max_record_bytes: int = MAX_RECORD_BYTES) -> DataFrame:
    """The records of all archives below the folder ``at``; a revisit's payload is empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at).select("content")
    schema = READ if with_payload else StructType([f for f in READ if f.name != "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, held, size = to_arrow_schema(schema), [], 0
        for batch in batches:
            for content in batch.column(0):
                for found in frames(memoryview(content.as_buffer()), max_record_bytes):
                    held.append(_row(found, with_payload))
                    size += 500 + len(held[-1].get("payload") or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return map_batches(files, run, schema)


def with_revisits(pages: DataFrame, id_col: str, uri_col: str, payload_col: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Rows for write_archives: of equal payloads of at least ``min_bytes``, all but the largest id's refer to it."""
    payload = F.coalesce(named(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(named(id_col).cast("long").alias("id"), named(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    shared = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("id").alias("response_id"), F.count("*").alias("n")).where("n > 1")
    # Where the digests aren't small, both sides are plain shuffles, which Spark splits where a digest is hot.
    joined = rows.join(small(cut(shared.select("digest", "response_id"), "digests")), "digest", "left")
    revisit = F.coalesce(F.col("id") < F.col("response_id"), F.col("id").isNull() & F.col("response_id").isNotNull())
    return joined.select("id", "uri", "payload", F.when(revisit, F.col("response_id")).alias("refers_to"), revisit.alias("revisit"))


def round_trip(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES, with_payload: bool = False) -> DataFrame:
    """The records read back from archives written of ``pages``."""
    spark = pages.sparkSession
    at = shared_path(spark, "archives")
    write_archives(with_revisits(pages, id_col, uri_col, payload_col, min_bytes), at)
    return read_archives(spark, at, with_payload)
