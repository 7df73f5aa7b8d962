"""Token-id files: each document compressed on its own with a shared Zstandard dictionary.

A file holds ``MAGIC``, the SHA-256 of the dictionary, one frame per document, an index with a
row (doc id or null, offset, length, ids) per document, and the place of the index. Any document
is read with one look at the index and one frame. The dictionary is trained on the serialized ids
of a bounded sample of documents and lies beside the files.

Texts are cut at ASCII white space, where the tokenizer's normalizer and patterns never join
anything, and distinct pieces are encoded once by the tokenizers library and kept by the worker. A null text
is empty and holds the end id alone. Documents stand in ascending order of id, null ids first,
equal ids by text.
"""

from __future__ import annotations

import functools
import hashlib
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ledgerlink.llm.tables import filesystem, lowest_hashes, stage
from ledgerlink.session import scratch_path

END_ID = 1
SAMPLE_DOCS = 1_000
SAMPLE_CHARS = 10_000
DICTIONARY_BYTES = 64 << 10
CACHE_PIECES = 1_000_000
TAILS = ".,;:!?"
MAGIC = b"IDSZ0001"
INDEX_ROW = np.dtype([("doc_id", "<i8"), ("known", "<i8"), ("offset", "<i8"), ("length", "<i8"), ("ids", "<i8")])
TAIL = "<QQ8s"


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Pieces(dict):
    """Serialized ids by piece, encoded when first asked for. Two generations bound the memory: a
    full one becomes the old one, from which pieces still in use come back.

    Punctuation behind a letter or digit is looked up on its own, if the tokenizer cuts there, so
    ``word,`` and ``word.`` share the ids of ``word``.
    """

    def __init__(self, path: str):
        super().__init__()
        self.encode = tokenizer(path).encode
        self.old: dict[bytes, bytes] = {}
        cut = tokenizer(path).pre_tokenizer
        self.splits = cut is not None and all(
            [t for t, _ in cut.pre_tokenize_str(before + mark + ".")] == [before, mark + "."] for before in ("b", "7") for mark in TAILS)

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            core = piece.rstrip(TAILS.encode()) if self.splits else piece
            if len(core) < len(piece) and core[-1:].isalnum():
                ids = self[core] + self[piece[len(core):]]
            else:
                ids = array("I", self.encode(piece.decode(), add_special_tokens=False).ids).tobytes()
        if len(self) >= CACHE_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Serialized ids of a text with the end id. Where the tokenizer has no capitals, ASCII ones are
    lowered before pieces are looked up."""

    def __init__(self, path: str, end_id: int = END_ID):
        self.pieces = Pieces(path)
        self.end = struct.pack("<I", end_id)
        letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]
        self.lowers = all(self.pieces.encode(x.upper() + "e").ids == self.pieces.encode(x + "e").ids for x in letters)

    def __call__(self, text: str | None) -> bytes:
        body = (text or "").encode()
        return b"".join(map(self.pieces.__getitem__, (body.lower() if self.lowers else body).split())) + self.end


@functools.cache
def encoder(path: str) -> Encoder:
    """One per worker process: pieces serve later tasks too."""
    return Encoder(path)


def sample_dictionary(docs: DataFrame, path: str) -> bytes:
    """A dictionary from the ``SAMPLE_DOCS`` documents with the lowest hash, of each at most
    ``SAMPLE_CHARS`` characters from a place drawn by hash; raw content where they are too few to
    train on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"ids": pa.array(map(encoder(path), batch.column("text").to_pylist()), pa.binary())})

    spare = F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS)
    piece = F.substr("text", (F.pmod(F.xxhash64(F.lit("piece"), "doc_id", "text"), spare) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    picked = lowest_hashes(docs.where("text is not null"), SAMPLE_DOCS, "ids", "doc_id", "text").select(piece.alias("text"))
    samples = sorted(bytes(r["ids"]) for r in picked.mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _codec(dictionary: bytes):
    """Compression with the dictionary, if it has content."""
    data = zstandard.ZstdCompressionDict(dictionary) if len(dictionary) >= 8 else None
    if data:
        data.precompute_compress(level=3)  # else every document loads it anew
    return (zstandard.ZstdCompressor(level=3, write_content_size=True, dict_data=data),
            zstandard.ZstdDecompressor(dict_data=data))


def write(docs: DataFrame, folder: str, path: str, dictionary: bytes) -> DataFrame:
    """Write all rows of ``docs`` (doc_id, text) below ``folder``; returns the manifest
    (part, path, docs, ids), parts in order of doc id. Files have fresh names, so only those in the
    committed manifest count and a repeated task does no harm."""
    digest = hashlib.sha256(dictionary).digest()
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/dictionary.zdict") as out:
        out.write(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        name = f"{base}/part-{uuid.uuid4().hex}.ids"
        compress = _codec(dictionary)[0].compress
        out, at, index, total = None, len(MAGIC) + len(digest), [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if out is None:
                    out = fs.open_output_stream(name)
                    out.write(MAGIC + digest)
                ids = encoder(path)(text.as_py())
                frame = compress(ids)
                out.write(frame)
                index.append((doc_id or 0, doc_id is not None, at, len(frame), len(ids) // 4))
                at, total = at + len(frame), total + len(ids) // 4
        if out is not None:
            out.write(np.array(index, INDEX_ROW).tobytes() + struct.pack(TAIL, at, len(index), MAGIC))
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "path": [name], "docs": [len(index)], "ids": [total]})

    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc(), F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    return stage(ordered.mapInArrow(run, "part long, path string, docs long, ids long"), "ids-manifest")


class IdFile:
    """Reads one file; the dictionary's hash must be the one the file states."""

    def __init__(self, folder: str, path: str):
        self.fs, base = filesystem(folder)
        with self.fs.open_input_stream(f"{base}/dictionary.zdict") as f:
            dictionary = f.read()
        self.file = self.fs.open_input_file(path)
        head = self.file.read_at(len(MAGIC) + 32, 0)
        if head != MAGIC + hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was not written with this dictionary")
        place, rows, magic = struct.unpack(TAIL, self.file.read_at(struct.calcsize(TAIL), self.file.size() - struct.calcsize(TAIL)))
        if magic != MAGIC or place + rows * INDEX_ROW.itemsize + struct.calcsize(TAIL) != self.file.size():
            raise ValueError(f"{path} has no whole index")
        self.index = np.frombuffer(self.file.read_at(rows * INDEX_ROW.itemsize, place), INDEX_ROW)
        self.decompress = _codec(dictionary)[1].decompress

    def ids(self, row: int) -> bytes:
        """Serialized ids of the document in a row of the index."""
        entry = self.index[row]
        ids = self.decompress(self.file.read_at(int(entry["length"]), int(entry["offset"])))
        if len(ids) != 4 * entry["ids"]:
            raise ValueError("a document's length differs from the index")
        return ids


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, and the
    CRC-32 of its serialized ids."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    placed = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                file = IdFile(folder, path)
                crc = [zlib.crc32(file.ids(row)) for row in range(len(file.index))]
                known = file.index["known"].astype(bool)
                counts = file.index["ids"].astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(file.index["doc_id"].astype(np.int64), mask=~known), "start": base + np.cumsum(counts) - counts,
                    "n_tokens": counts, "ids_crc32": pa.array(crc, pa.int64())})

    files = max(1, manifest.count())
    return placed.select("path", "base").repartition(files).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def filed(docs: DataFrame, path: str) -> DataFrame:
    """Write ``docs`` to id files in the shared folder and read them back."""
    folder = scratch_path(docs.sparkSession, "ids")
    dictionary = sample_dictionary(docs.select("doc_id", "text"), path)
    return read(write(docs, folder, path, dictionary), folder)
