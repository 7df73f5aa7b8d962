"""Substring dedup by level-wise doubling.

A window of words repeats only if the shorter windows in it repeat. So short windows are compared
first, and only those that stand in two texts are extended to twice their length (the last level
to the length asked for), until that length is reached or no candidate survives. On the first
level one short window stands for each longer one: the one with the least hash in it, which is the
same in every text, so about a quarter of all positions is compared.

Equal texts are one text, held by the smallest id that has it; later holders lose all windows.
Windows are compared by 64-bit hashes of their words.

Null texts have no words. A row without id comes after all others and takes nothing from them.
Rows with equal ids do not remove each other's words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm import text_arrays as ta
from ledgerlink.llm.tables import boxed, discard, stage, unboxed

WINDOW = 13
SHORTEST = 7
LAST = (1 << 63) - 1


def levels(size: int, shortest: int = SHORTEST) -> list[int]:
    """Lengths to compare: ``size`` halved (rounded up) down to ``shortest``, in ascending order."""
    out = [size]
    while out[0] > shortest:
        out.insert(0, (out[0] + 1) // 2)
    return out


def with_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with the place of the id and the 128-bit key of the text."""
    return docs.select(
        "*", F.coalesce("doc_id", F.lit(LAST)).alias("_order"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key1"), F.xxhash64(F.lit("second"), F.coalesce("text", F.lit(""))).alias("_key2"))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """Each text once, with its first holder and a number."""
    keyed = with_keys(docs.select("doc_id", "text"))
    return stage(keyed.groupBy("_key1", "_key2").agg(F.min("_order").alias("first"), F.first("text").alias("text")).select(
        F.monotonically_increasing_id().alias("text_no"), "_key1", "_key2", "first", "text"), "distinct-texts")


def least_in_runs(values: np.ndarray, run: int) -> np.ndarray:
    """Indices that hold the least value (leftmost of equals) of some ``run`` consecutive values."""
    n = len(values) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, low = np.arange(n), values[:n].copy()
    for k in range(1, run):
        smaller = values[k:k + n] < low
        low[smaller] = values[k:k + n][smaller]
        at[smaller] = np.flatnonzero(smaller) + k
    return np.unique(at)


def _signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def _anchors(short: int, long: int):
    """(hash, text_no, at) of the short windows that stand for the long ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, t in ta.slices(batch):
                hashes = ta.window_hashes(t.words, short)
                bounds = np.concatenate([[0], np.cumsum(t.n_words)])
                found = [least_in_runs(hashes[a:b - short + 1], long - short + 1) + a
                         for a, b in zip(bounds[:-1], bounds[1:]) if b - a >= long]
                at = np.concatenate(found) if found else np.zeros(0, np.int64)
                doc = t.doc[at]
                yield pa.RecordBatch.from_arrays(
                    [_signed(hashes[at]), rows.column("text_no").take(pa.array(doc)), pa.array((at - bounds[doc]).astype(np.int32))],
                    ["hash", "text_no", "at"])

    return run


def _covering(short: int, long: int, sampled: bool):
    """(hash, text_no, first, at) of the long windows whose short ones survived (column ``live``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, t in ta.slices(batch):
                words = t.words
                bounds = np.concatenate([[0], np.cumsum(t.n_words)])
                parts = []
                for row, live in enumerate(rows.column("live")):
                    a, n = bounds[row], bounds[row + 1] - bounds[row] - long + 1
                    live = np.unique(live.values.to_numpy())
                    if n <= 0 or not len(live):
                        continue
                    if sampled:
                        near = (live[:, None] - np.arange(long - short + 1)[None, :]).ravel()
                        near = np.unique(near[(near >= 0) & (near < n)])
                    else:
                        near = live[(live < n) & np.isin(live + long - short, live)]
                    parts.append(a + near)
                at = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                doc = t.doc[at]
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [_signed(ta.window_hashes(words, long)[at] if len(at) else np.zeros(0, np.uint64)), rows.column("text_no").take(take),
                     rows.column("first").take(take), pa.array((at - bounds[doc]).astype(np.int32))], ["hash", "text_no", "first", "at"])

    return run


def repeated_windows(texts: DataFrame, size: int = WINDOW) -> DataFrame:
    """(text_no, at) of the windows of ``size`` words that an earlier holder's text also has."""
    short, *longer = levels(size)
    if not longer:
        raise ValueError(f"windows need more than {SHORTEST} words")
    source = texts.select("text_no", "text")
    anchors = source.mapInArrow(_anchors(short, longer[0]), "hash long, text_no long, at int")
    # Two steps: combined minima and maxima find the hashes of two texts or more, and a join that
    # can be split at hot hashes goes back to the positions.
    shared = stage(anchors.groupBy("hash").agg(F.min("text_no").alias("low"), F.max("text_no").alias("high")).where("low <> high").select("hash"), "shared-anchors")
    live = stage(anchors.join(shared, "hash", "left_semi").select("text_no", "at"), "live-windows")
    for number, length in enumerate(longer):
        if live.isEmpty():
            break
        here = live.groupBy("text_no").agg(F.collect_list("at").alias("live"))
        rows = texts.select("text_no", "first", "text").join(here, "text_no")
        windows = stage(rows.mapInArrow(_covering(short, length, number == 0), "hash long, text_no long, first long, at int"), "windows")
        if length == size:
            firsts = windows.groupBy("hash").agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low < high").select("hash", "low")
            live = windows.join(firsts, "hash").where("low < first").select("text_no", "at")
        else:
            both = windows.groupBy("hash").agg(F.min("text_no").alias("low"), F.max("text_no").alias("high")).where("low <> high").select("hash")
            live = windows.join(both, "hash", "left_semi").select("text_no", "at")
        live = stage(live, "live-windows")
        discard(windows)
        short = length
    return live


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept, digests = [], [], [], []
            for text, gone in zip(batch.column("text"), batch.column("gone")):
                words = (text.as_py() or "").encode().split()
                n = len(words)
                if gone.is_valid:
                    cover = np.zeros(n + 1, np.int32)
                    at = np.unique(gone.values.to_numpy())
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + size, -1)
                    stays = np.cumsum(cover[:n]) == 0
                    words = [w for w, s in zip(words, stays.tolist()) if s]
                left = b" ".join(words)
                counts.append(n)
                removed.append(n - len(words))
                kept.append(left.decode() if len(words) < n else None)
                digests.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in ("_key1", "_key2", "first")] + [
                    pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(digests, pa.string())],
                ["_key1", "_key2", "first", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return run


def cut_texts(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per distinct text of ``docs``: words, words removed where its first holder has it, the words
    left joined by one space (null if none went), and their SHA-256."""
    texts = distinct_texts(docs)
    gone = repeated_windows(texts, size).groupBy("text_no").agg(F.collect_list("at").alias("gone"))
    rows = texts.join(gone, "text_no", "left")
    cut = stage(rows.mapInArrow(_cut(size), "_key1 long, _key2 long, first long, n_words long, n_removed long, kept_text string, kept_sha256 string"), "cut-texts")
    discard(texts)
    return cut


def _copy(size: int) -> Column:
    return (F.col("_order") > F.col("first")) & (F.col("n_words") >= size)


def removal_report(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """n_words, n_removed and kept_sha256 per row of ``docs`` (doc_id, text)."""
    rows = with_keys(docs.select("doc_id", "text")).drop("text")
    joined = rows.join(cut_texts(docs, size).drop("kept_text"), ["_key1", "_key2"])
    return joined.select(
        "doc_id", "n_words", F.when(_copy(size), F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(_copy(size), F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


def deduplicated(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` with repeated words taken out of the texts; texts that lose none stay as they are.
    ``n_chars``, if there, is set anew."""
    results = cut_texts(docs, size).select("_key1", "_key2", "first", "n_words", "kept_text")
    joined = with_keys(boxed(docs, "doc_id", "text")).join(results, ["_key1", "_key2"])
    return unboxed(joined, docs, F.when(_copy(size), F.lit("")).otherwise(F.coalesce("kept_text", "text")))
