"""WARC archives with one Zstandard frame per record and a dictionary in a leading skippable frame.

Writing: tasks fill archives of bounded payload. An archive's dictionary is trained on its own
first records, so nothing is gathered on the driver. Archives get fresh names; the manifest that
Spark commits says which ones count, so a repeated task leaves no half archive behind.

Reading: one task per archive streams it, loads the dictionary, decodes frame by frame and checks
frame flags, record headers, lengths and digests; a damaged archive raises ``ArchiveError``.

Of equal payloads of at least ``MIN_REVISIT`` bytes the record with the largest id is a response
and the others revisit it. A null payload is empty. Null ids come before all others, so a record
without id revisits one that has an id; if none has, all stay responses. Rows with equal id and
payload are all responses where that id is the largest. A null URL becomes a ``urn:page:`` name.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlink.llm.tables import filesystem, stage
from ledgerlink.session import scratch_path

MIN_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20
TRAIN_BYTES = 1 << 20
DICTIONARY_BYTES = 32 << 10
READ_BYTES = 32 << 10
# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

RECORD = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


class ArchiveError(ValueError):
    """An archive breaks the format."""


def record_plan(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """What to write for each row of ``pages`` (page_id, url, html): type, target, and the payload
    of responses. The largest id per payload is a combined maximum; the join back to the pages can
    be split where one payload holds many rows."""
    full = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html"))
    shared = full.where(F.col("size") >= min_bytes).groupBy(F.col("digest").alias("of"), F.col("size").alias("of_size")).agg(
        F.max("page_id").alias("response_id"), F.count("*").alias("rows")).where("rows > 1 and response_id is not null")
    joined = full.join(shared, (F.col("digest") == F.col("of")) & (F.col("size") == F.col("of_size")), "left")
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return joined.select(
        "page_id", "url", "digest", F.when(revisit, F.col("response_id")).alias("refers_to"),
        F.when(~revisit, F.col("html").cast("binary")).alias("payload"))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    name = record.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else int(name)


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}".encode(), *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, digest: str, refers_to: int | None, payload: bytes | None) -> bytes:
    """A response with its payload, or a revisit (``payload`` is None) without."""
    uri = urllib.parse.quote(url, safe="".join(map(chr, range(33, 127)))) if url else record_id(page_id)[1:-1]
    headers = [
        ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if payload is None:
        return _record("revisit", [*headers, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))], http + b"\r\n")
    block = http + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    return _record("response", [*headers, ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())], block)


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for records like ``samples``; empty where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """One archive: records wait until there are enough to train the dictionary on."""

    def __init__(self, folder: str):
        self.fs, path = filesystem(folder)
        self.path = f"{path}/{uuid.uuid4().hex}.warc.zst"
        self.waiting: list[bytes] = [_record("warcinfo", [
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")]
        self.out = self.compressor = None
        self.bytes = self.records = 0

    def add(self, record: bytes) -> None:
        self.bytes, self.records = self.bytes + len(record), self.records + 1
        if self.out is not None:
            self.out.write(self.compressor.compress(record))
            return
        self.waiting.append(record)
        if self.bytes >= TRAIN_BYTES:
            self._open()

    def _open(self) -> None:
        dictionary = train(self.waiting[1:])
        self.out = self.fs.open_output_stream(self.path, compression=None)  # the frames are made here
        if dictionary:
            self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if data:
            data.precompute_compress(level=3)  # else every record loads it anew
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True, dict_data=data)
        for record in self.waiting:
            self.out.write(self.compressor.compress(record))
        self.waiting = []

    def close(self) -> None:
        if self.out is None:
            self._open()
        self.out.close()


def write(plan: DataFrame, folder: str) -> DataFrame:
    """Write the records of ``record_plan`` into archives below ``folder``; returns the manifest
    (path, records) of the archives that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)
        writer = None

        def closed() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_pydict({"path": [writer.path], "records": [writer.records]})

        for batch in batches:
            columns = [batch.column(k) for k in ("page_id", "url", "digest", "refers_to", "payload")]
            for row in range(batch.num_rows):
                writer = writer or ArchiveWriter(folder)
                writer.add(page_record(*(c[row].as_py() for c in columns)))
                if writer.bytes >= ARCHIVE_BYTES:
                    yield closed()
                    writer = None
        if writer:
            yield closed()

    return stage(plan.mapInArrow(run, "path string, records long"), "warc-manifest")


def frames(stream) -> Iterator[bytes]:
    """The decoded frames of an archive, one after another."""
    data = stream.read(READ_BYTES)
    dictionary = None
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", data[4:8])[0]
        data += stream.read(max(0, 8 + size - len(data)))
        if len(data) < 8 + size:
            raise ArchiveError("dictionary frame is cut short")
        raw, data = data[8:8 + size], data[8 + size:]
        if raw[:4] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while data or (data := stream.read(READ_BYTES)):
        while len(data) < 18 and (more := stream.read(READ_BYTES)):
            data += more
        if data[:4] != FRAME_MAGIC:
            raise ArchiveError("not a frame")
        shape = zstandard.get_frame_parameters(data)
        if dictionary and shape.dict_id not in (0, dictionary.dict_id()):
            raise ArchiveError("frame needs another dictionary")
        frame, parts = decompressor.decompressobj(), []
        try:
            while True:
                parts.append(frame.decompress(data))
                if frame.eof:
                    break
                if not (data := stream.read(READ_BYTES)):
                    raise ArchiveError("frame is cut short")
        except zstandard.ZstdError as e:
            raise ArchiveError(str(e)) from e
        data, record = frame.unused_data, b"".join(parts)
        if shape.content_size not in (zstandard.CONTENTSIZE_UNKNOWN, len(record)):
            raise ArchiveError("frame size differs from its header")
        yield record


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of the one record that a frame holds."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (VERSION, b"WARC/1.0"):
        raise ArchiveError("no WARC version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name.strip():
            raise ArchiveError(f"bad header line {line[:60]!r}")
        headers[name.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - set(headers)
    if missing:
        raise ArchiveError(f"headers missing: {sorted(missing)}")
    if not headers["content-length"].isdigit():
        raise ArchiveError("bad Content-Length")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ArchiveError("record length differs from Content-Length")
    block = rest[:size]
    if (digest := headers.get("warc-block-digest")) and digest != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ArchiveError("block digest differs")
    return headers, block


def page_row(headers: dict[str, str], block: bytes) -> tuple[int | None, str, int | None, str, int | None, bytes | None]:
    """A row of ``RECORD`` from a response or revisit."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        raise ArchiveError("no HTTP header")
    stated = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    page = page_of(headers["warc-record-id"])
    if headers["warc-type"] == "revisit":
        return page, "revisit", None, stated, page_of(headers["warc-refers-to"]), None
    lengths = [line.split(b":")[1].strip() for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    if lengths != [str(len(payload)).encode()]:
        raise ArchiveError("payload length differs from the HTTP header")
    if hashlib.sha1(payload).hexdigest() != stated:
        raise ArchiveError("payload digest differs")
    return page, "response", len(payload), stated, None, payload


def read(spark: SparkSession, manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The response and revisit records of the archives in ``manifest``, as ``RECORD`` rows;
    without ``payloads`` that column is null. A record count that differs from the manifest raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = filesystem(folder)[0]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in RECORD.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                rows, held, seen = [], 0, 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for record in frames(stream):
                        headers, block = parse_record(record)
                        if headers["warc-type"] not in ("response", "revisit"):
                            continue
                        *row, payload = page_row(headers, block)
                        rows.append((*row, payload if payloads else None))
                        seen, held = seen + 1, held + (len(payload or b"") if payloads else 0)
                        if len(rows) == 4096 or held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)
                if seen != records:
                    raise ArchiveError(f"{seen} records in {path}, {records} expected")

    archives = max(1, manifest.count())
    return manifest.repartition(archives).mapInArrow(run, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Records with revisits' payload sizes taken from the responses they refer to; a revisit whose
    response is missing, or has another payload, raises."""
    sizes = records.where("record_type = 'response'").groupBy(
        F.col("page_id").alias("of_page"), F.col("payload_digest").alias("of_digest")).agg(F.max("payload_bytes").alias("of_bytes"))
    found = records.join(sizes, (F.col("refers_to") == F.col("of_page")) & (F.col("payload_digest") == F.col("of_digest")), "left")
    return found.select(
        "page_id", F.coalesce("payload_bytes", "of_bytes", F.raise_error(F.lit("a revisit refers to no response"))).alias("payload_bytes"),
        "payload_digest", "record_type", "refers_to", "payload")


def archived(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    manifest = write(record_plan(pages), folder)
    return resolved(stage(read(spark, manifest, folder, payloads), "warc-records"))
