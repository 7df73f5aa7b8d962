"""Byte-level BPE over a global shuffle of distinct words.

Texts are cut into pre-tokens by the vocabulary's pattern. Tasks gather documents into blocks of
bounded text; a block lists its distinct pre-tokens once and holds its texts as codes into that
list, in order of position. The lists are dealt into buckets by word and shuffled, so equal words
of all blocks meet and each is encoded once; ids go back to the blocks by (block, code), and each
block puts its documents together by position. A word enters the shuffle once per block at most,
so no word holds a large share of it. Lists and ids travel packed; a block's codes wait in a file
of the shared folder, and the committed table of blocks says which files count. Decoding looks ids
up in the table of token bytes.

A null text is an empty text: no ids, no bytes. Rows with equal ids are encoded one by one.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.tables import drop_part, filesystem, part_of, stage
from ledgerlink.session import scratch_path

BLOCK_CHARS = 10 << 20
BLOCK_WORDS = 400_000
BUCKETS_PER_PARTITION = 8
# Texts of a block: ids of the documents, pre-tokens of each, file with the codes of all. Words of
# a block that fall into a bucket: their bytes, lengths and codes.
BLOCKS = "kind string, block long, bucket int, doc_ids array<long>, sizes array<int>, path string, words binary, lengths binary, codes binary"
IDS = "block long, codes binary, lengths binary, ids binary"
# A space that whitespace or the end follows: texts with one are not cut at spaces.
LOOSE_SPACE = re.compile(r" (?=\s|\Z)")


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.cache
def word_encoder(path: str) -> tiktoken.Encoding:
    """Merges over whatever it is given as one piece."""
    return tiktoken.Encoding("one-piece", pat_str=r"(?s:.+)", mergeable_ranks=ranks(path), special_tokens={})


@functools.cache
def token_bytes(path: str) -> list[bytes]:
    by_rank = {rank: token for token, rank in ranks(path).items()}
    return [by_rank.get(rank, b"") for rank in range(max(by_rank) + 1)]


class Block:
    """Documents as codes into a list of distinct pre-tokens."""

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall
        self.codes: dict[str, int] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.doc_ids: list[int | None] = []
        self.texts: list[np.ndarray] = []
        self.chars = 0

    def _code(self, words: list[str]) -> tuple[int, ...]:
        codes = self.codes
        return tuple([codes.setdefault(word, len(codes)) for word in words])

    def add(self, doc_id: int | None, text: str) -> None:
        """A match never crosses a space before a visible character, so texts are cut there and
        equal chunks are matched once."""
        if LOOSE_SPACE.search(text):
            flat = self._code(self.find(text))
        else:
            first, *rest = text.split(" ")
            chunks, flat = self.chunks, list(self._code(self.find(first)))
            for chunk in rest:
                known = chunks.get(chunk)
                if known is None:
                    known = chunks[chunk] = self._code(self.find(" " + chunk))
                flat += known
        self.doc_ids.append(doc_id)
        self.texts.append(np.array(flat, np.uint32))
        self.chars += len(text)

    def full(self) -> bool:
        return self.chars >= BLOCK_CHARS or len(self.codes) >= BLOCK_WORDS

    def rows(self, number: int, buckets: int, folder: str) -> pa.RecordBatch:
        """Codes are renumbered by frequency, which makes them compress well."""
        self.chunks.clear()
        flat = np.concatenate(self.texts)
        order = np.argsort(-np.bincount(flat, minlength=len(self.codes)), kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        fs, base = filesystem(folder)
        path = f"{base}/{uuid.uuid4().hex}.codes"
        with fs.open_output_stream(path) as out:
            out.write(packed(place[flat]))
        rows = [{"kind": "texts", "block": number, "doc_ids": self.doc_ids, "sizes": [len(t) for t in self.texts], "path": path}]
        words = [word.encode() for word in self.codes]
        bucket = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % buckets
        dealt = np.argsort(bucket, kind="stable")
        for own in np.split(dealt, np.flatnonzero(np.diff(bucket[dealt])) + 1) if len(words) else []:
            own = sorted(own.tolist(), key=words.__getitem__)
            rows.append({
                "kind": "words", "block": number, "bucket": int(bucket[own[0]]), "words": zstandard.compress(b"".join(words[k] for k in own)),
                "lengths": packed(np.array([len(words[k]) for k in own])), "codes": packed(place[own])})
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([
            ("kind", pa.string()), ("block", pa.int64()), ("bucket", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
            ("path", pa.string()), ("words", pa.binary()), ("lengths", pa.binary()), ("codes", pa.binary())]))


def packed(codes: np.ndarray) -> bytes:
    """Codes by byte plane, compressed."""
    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


def _blocks(pattern: str, buckets: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        number = TaskContext.get().partitionId() << 32
        block = Block(pattern)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                block.add(doc_id, text.as_py() or "")
                if block.full():
                    yield block.rows(number, buckets, folder)
                    number, block = number + 1, Block(pattern)
        if block.doc_ids:
            yield block.rows(number, buckets, folder)

    return run


def _encode_words(path: str):
    """Ids of the words of each row; rows come ordered by bucket, and a bucket's words are encoded
    once for all its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path).encode_ordinary
        bucket, known = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    bucket, known = row["bucket"], {}
                words = zstandard.decompress(row["words"])
                ends = np.cumsum(unpacked(row["lengths"]), dtype=np.int64).tolist()
                found = []
                for start, end in zip([0, *ends], ends):
                    word = words[start:end]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = encode(word.decode())
                    found.append(ids)
                yield pa.RecordBatch.from_pydict({
                    "block": [row["block"]], "codes": [row["codes"]], "lengths": [packed(np.array([len(i) for i in found]))],
                    "ids": [packed(np.array(list(itertools.chain.from_iterable(found))))]})

    return run


def _expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of all ranges one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _assemble(folder: str, block: pa.Table, words: pa.Table) -> pa.Table:
    """The documents of one block with their ids as little-endian 32-bit integers."""
    def whole(column: str) -> np.ndarray:
        return np.concatenate([unpacked(blob.as_py()) for blob in words.column(column)] or [np.zeros(0, np.uint32)])

    own, flat = whole("codes"), whole("ids")
    lengths, starts = np.zeros((2, len(own)), np.int64)
    lengths[own] = sizes = whole("lengths").astype(np.int64)
    starts[own] = np.cumsum(sizes) - sizes
    with filesystem(folder)[0].open_input_stream(block.column("path")[0].as_py()) as file:
        codes = unpacked(file.read())
    tokens = flat[_expand(starts[codes], lengths[codes])]
    before = np.concatenate([[0], np.cumsum(lengths[codes])])
    bounds = 4 * before[np.concatenate([[0], np.cumsum(np.array(block.column("sizes")[0].as_py(), np.int64))])]
    return pa.table({"doc_id": pa.array(block.column("doc_ids")[0].as_py(), pa.int64()), "ids": pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(tokens.tobytes())]).cast(pa.binary())})


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) for each row of ``docs`` (doc_id, text); ids are little-endian unsigned 32-bit
    integers, one after another. ``path`` names the rank file on every executor."""
    buckets = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch_path(docs.sparkSession, "bpe-codes")
    blocks = stage(docs.select("doc_id", "text").mapInArrow(_blocks(pattern, buckets, folder), BLOCKS), "bpe-blocks", by="kind")
    words = part_of(blocks, "kind", "words").select("block", "bucket", "words", "lengths", "codes")
    dealt = words.repartition("bucket").sortWithinPartitions("bucket")
    ids = stage(dealt.mapInArrow(_encode_words(path), IDS), "bpe-ids")
    drop_part(blocks, "kind", "words")
    texts = part_of(blocks, "kind", "texts").select("block", "doc_ids", "sizes", "path")

    def assembled(block: pa.Table, words: pa.Table) -> pa.Table:
        return _assemble(folder, block, words)

    return texts.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(assembled, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the bytes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [b"".join(map(table.__getitem__, np.frombuffer(ids.as_buffer(), "<u4").tolist())) for ids in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], ["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, bytes binary")
