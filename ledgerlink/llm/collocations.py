"""Phrase collocations, counted by double-array tries over word codes.

Level by level: a phrase of m words can be frequent only if both phrases of m - 1 words in it
are. While one level is counted, the windows of the next length whose two parts are candidates
are counted by hash bucket; the windows in buckets that reach the threshold, with both parts
frequent, are the next candidates. No frequent phrase can miss a candidate.

Candidates are cut into tries of at most ``TRIE_PHRASES`` phrases, built by tasks and put into the
shared folder; a worker holds a few at a time, so its memory does not grow with the corpus. All
positions of a block of codes take a step in the trie at once, the accepting states are counted
by ``bincount``, and Spark sums the counts of all blocks.

Texts become codes once: each frequent (language, word) has one code, and 0 stands between pieces
and for other words, so neither documents nor languages matter to later steps. Words meet codes by
64-bit hashes, in chunks of at most ``CHUNK_WORDS`` words per worker. The bucket bitmap has at most
2 ** ``MAX_BITS`` bits; beyond, it lets more candidates through and changes no result.

A null text is empty, a null language is ``und``. Rows are counted as they stand, equal ones too.
Without a frequent phrase the result is empty. No other column is read.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ledgerlink.llm import text_arrays as ta
from ledgerlink.llm.tables import discard, filesystem, stage
from ledgerlink.session import scratch_path

LONGEST = 5
THRESHOLD = 100
TOP = 2000
TRIE_PHRASES = 250_000
CHUNK_WORDS = 1_000_000
GROUP_CODES = 3_000_000
RANGE_BITS = 20
RANGE = 1 << RANGE_BITS
MAX_BITS = 28
_BYTES = np.arange(256, dtype=np.uint8)
_CUT = 10  # every cut becomes a line feed
_FOLD = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_FOLD[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = _CUT


# --- files in the shared folder ------------------------------------------------------------


def _save(folder: str, **arrays: np.ndarray) -> str:
    """A fresh file; it counts only if a committed table names it."""
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    path = f"{base}/{uuid.uuid4().hex}.npz"
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    with fs.open_output_stream(path) as out:
        out.write(buffer.getbuffer())
    return path


@lru_cache(maxsize=4)
def _load(folder: str, path: str) -> dict[str, np.ndarray]:
    with filesystem(folder)[0].open_input_stream(path) as f:
        return dict(np.load(io.BytesIO(f.read())))


# --- words ---------------------------------------------------------------------------------


def _word_slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, ta.TextSlice, np.ndarray, np.ndarray]]:
    """Rows, words, key of each word with its language, and whether it continues the piece of the
    word before it."""
    texts = batch.column("text").cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    folded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(_FOLD[data])])
    for rows, t in ta.slices(pa.RecordBatch.from_arrays([folded, batch.column("lang"), batch.column("lang_key")], ["text", "lang", "lang_key"])):
        lang = rows.column("lang_key").to_numpy().view(np.uint64)
        keys = ta.mix(t.words ^ lang[t.doc])
        piece = np.cumsum(t.data == _CUT)[t.start] if len(t.start) else t.start
        joined = np.zeros(len(keys), bool)
        joined[1:] = (t.doc[1:] == t.doc[:-1]) & (piece[1:] == piece[:-1])
        yield rows, t, keys, joined


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, t, keys, _ in _word_slices(batch):
            key, first, n = np.unique(keys, return_index=True, return_counts=True)
            words = [t.data[a:b].tobytes() for a, b in zip(t.start[first], t.end[first])]
            yield pa.RecordBatch.from_arrays(
                [rows.column("lang").take(pa.array(t.doc[first])), pa.array(words, pa.binary()), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))],
                ["lang", "word", "key", "n"])


def _parts_of(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def dictionary(frequent: DataFrame, folder: str) -> tuple[DataFrame, list[str]]:
    """``frequent`` (lang, word, key, n) with a code from 1 on, and the files that map keys to
    codes. Chunks of a hash hold ``CHUNK_WORDS`` words on average."""
    chunks = _parts_of(frequent.count(), CHUNK_WORDS)
    dealt = frequent.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int"))
    sizes = dict(dealt.groupBy("chunk").count().collect())
    first = np.cumsum([0, *(sizes.get(k, 0) for k in range(chunks))])
    offset = F.element_at(F.array(*(F.lit(int(x)) for x in first[:-1])), F.col("chunk") + 1)
    within = F.row_number().over(W.partitionBy("chunk").orderBy("key", "lang", "word"))
    coded = stage(dealt.withColumn("code", (offset + within).cast("int")), "phrase-words")

    def run(group: pa.Table) -> pa.Table:
        key, code = (group.column(c).to_numpy() for c in ("key", "code"))
        order = np.argsort(key, kind="stable")
        return pa.table({"path": [_save(folder, key=key[order], code=code[order])]})

    files = stage(coded.select("chunk", "key", "code").groupBy("chunk").applyInArrow(run, "path string"), "phrase-dictionary")
    return coded, sorted(r["path"] for r in files.collect())


def _encode(folder: str, paths: list[str]):
    """Blocks of codes; runs of zeros are one zero, and every block ends with one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, keys, joined in _word_slices(batch):
                key, inverse = np.unique(keys.view(np.int64), return_inverse=True)
                code = np.zeros(len(key), np.int32)
                for path in paths:
                    chunk = _load(folder, path)
                    at = np.minimum(np.searchsorted(chunk["key"], key), len(chunk["key"]) - 1)
                    hit = chunk["key"][at] == key
                    code[hit] = chunk["code"][at[hit]]
                spread = np.zeros(2 * len(keys) + 1, np.int32)  # a place before each word for its cut
                spread[1::2] = code[inverse]
                keep = np.ones(len(spread), bool)
                keep[0:-1:2] = ~joined
                spread = spread[keep]
                keep = (spread != 0) | np.concatenate([[True], spread[:-1] != 0])
                yield pa.RecordBatch.from_pydict({"codes": pa.array([spread[keep].tobytes()], pa.binary())})

    return run


# --- double-array trie ---------------------------------------------------------------------


class Slots:
    """Free places of a double array that grows as needed."""

    def __init__(self, size: int, reach: int):
        self.used = np.zeros(size, bool)
        self.used[0] = True  # the root
        self.reach = reach
        self.random = np.random.default_rng(0)

    def place(self, codes: np.ndarray) -> int:
        """A base at which all ``codes`` are free; taken from now on."""
        for base in self.random.integers(1, max(2, len(self.used) - self.reach), 64):
            if not self.used[base + codes].any():
                break
        else:
            base = len(self.used)
            self.used = np.concatenate([self.used, np.zeros(self.reach + len(self.used) // 4, bool)])
        self.used[base + codes] = True
        return int(base)

    def singles(self, codes: np.ndarray) -> np.ndarray:
        """Bases for nodes with one child each."""
        free = np.flatnonzero(~self.used[self.reach:]) + self.reach
        if len(free) < len(codes):
            self.used = np.concatenate([self.used, np.zeros(len(codes), bool)])
            free = np.flatnonzero(~self.used[self.reach:]) + self.reach
        free = free[:len(codes)]
        self.used[free] = True
        return free - codes


def double_array(phrases: np.ndarray) -> dict[str, np.ndarray]:
    """Trie of the rows of ``phrases`` (codes, all rows of one length, distinct): from state s the
    word with the local number c leads to ``base[s] + c`` if ``check`` there is s. ``leaf`` is the
    row that ends in a state."""
    vocab, local = np.unique(phrases, return_inverse=True)
    local = local.reshape(phrases.shape).astype(np.int64)
    order = np.lexsort(local.T[::-1])
    rows = local[order]
    slots = Slots(2 * phrases.size + len(vocab) + 2, len(vocab))
    state = np.zeros(len(rows), np.int64)
    steps = []
    changed = np.zeros(len(rows), bool)
    changed[0] = True
    for depth in range(rows.shape[1]):
        parent_first = np.flatnonzero(changed)
        changed = changed.copy()
        changed[1:] |= rows[1:, depth] != rows[:-1, depth]
        child_first = np.flatnonzero(changed)
        children = np.add.reduceat(changed.astype(np.int64), parent_first)
        ends = np.cumsum(children)
        codes = rows[child_first, depth]
        bases = np.zeros(len(parent_first), np.int64)
        for node in sorted(np.flatnonzero(children > 1), key=lambda k: -children[k]):
            bases[node] = slots.place(codes[ends[node] - children[node]:ends[node]])
        lone = np.flatnonzero(children == 1)
        bases[lone] = slots.singles(codes[ends[lone] - 1])
        parents = state[parent_first]
        reached = np.repeat(bases, children) + codes
        steps.append((parents, bases, reached, np.repeat(parents, children)))
        state = reached[np.cumsum(changed) - 1]
    size = len(slots.used) + len(vocab)
    base, check, leaf = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    for parents, bases, reached, owners in steps:
        base[parents], check[reached] = bases, owners
    leaf[state] = order
    return {"vocab": vocab.astype(np.int32), "base": base, "check": check, "leaf": leaf, "rows": np.array([phrases.shape[0], phrases.shape[1]])}


def walk(trie: dict[str, np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a phrase starts, and its row. All positions take each step together."""
    vocab, length = trie["vocab"], int(trie["rows"][1])
    local = np.minimum(np.searchsorted(vocab, codes), len(vocab) - 1)
    local[vocab[local] != codes] = -1
    at = np.arange(max(0, len(codes) - length + 1))
    state = np.zeros(len(at), np.int64)
    for depth in range(length):
        word = local[at + depth]
        target = trie["base"][state] + word
        good = word >= 0
        good &= trie["check"][np.where(good, target, 0)] == state
        at, state = at[good], target[good]
    return at, trie["leaf"][state]


# --- levels --------------------------------------------------------------------------------


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Some blocks of codes at a time, so that a trie is fetched once for all of them."""
    held, size = [], 0
    for batch in batches:
        for blob in batch.column("codes"):
            held.append(np.frombuffer(blob.as_py(), np.int32))
            size += len(held[-1])
            if size >= GROUP_CODES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _buckets(codes: np.ndarray, at: np.ndarray, length: int, bits: int) -> np.ndarray:
    """Bucket of the window of ``length`` codes at each position."""
    hashes = np.zeros(len(at), np.uint64)
    for k in range(length):
        hashes = ta.mix(hashes * np.uint64(3) + codes[at + k].astype(np.uint64) + np.uint64(1))
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _count(folder: str, paths: list[str], length: int, bits: int):
    """(part, ids, ns): counts of each group of blocks. A part from 0 on is a trie and its ids are
    rows; a part below 0 is a range of the next level's buckets and its ids are places in it.
    Without tries every code is a candidate of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            live = [np.zeros(len(codes), bool) if paths else codes != 0 for codes in group]
            for number, path in enumerate(paths):
                trie = _load(folder, path)
                n = np.zeros(int(trie["rows"][0]), np.int64)
                for codes, flags in zip(group, live):
                    at, row = walk(trie, codes)
                    flags[at] = True
                    n += np.bincount(row, minlength=len(n))
                hit = np.flatnonzero(n)
                yield _counts(number, hit, n[hit])
            if length < LONGEST:
                found = [_buckets(codes, np.flatnonzero(flags[:-1] & flags[1:]), length + 1, bits).astype(np.int32) for codes, flags in zip(group, live)]
                buckets, n = np.unique(np.concatenate(found), return_counts=True)
                edges = np.searchsorted(buckets, np.arange(0, max(RANGE, 1 << bits) + 1, RANGE))
                for part, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    if b > a:
                        yield _counts(-1 - part, buckets[a:b] & (RANGE - 1), n[a:b])

    return run


def _counts(part: int, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([ids.astype(np.int32).tobytes()], pa.binary()), pa.array([n.astype(np.int64).tobytes()], pa.binary())], ["part", "ids", "ns"])


def _summed(threshold: int):
    """(id, n) of the counts that reach the threshold, from rows of ``_count`` in order of part. One
    dense array is in memory, that of the part at hand."""

    def reached(part: int, total: np.ndarray) -> pa.RecordBatch:
        hit = np.flatnonzero(total >= threshold)
        ids = hit + (part << 32) if part >= 0 else -1 - (hit + ((-1 - part) << RANGE_BITS))
        return pa.RecordBatch.from_pydict({"id": ids.astype(np.int64), "n": total[hit]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, np.zeros(0, np.int64)
        for batch in batches:
            for number, ids, ns in zip(batch.column("part").to_pylist(), batch.column("ids"), batch.column("ns")):
                if number != part:
                    if part is not None:
                        yield reached(part, total)
                    part, total = number, np.zeros(RANGE, np.int64)
                ids, ns = np.frombuffer(ids.as_py(), np.int32), np.frombuffer(ns.as_py(), np.int64)
                if len(ids) and ids[-1] >= len(total):  # ids ascend
                    total = np.concatenate([total, np.zeros(ids[-1] + 1 - len(total), np.int64)])
                total[ids] += ns
        if part is not None:
            yield reached(part, total)

    return run


def _listed(folder: str, paths: list[str], length: int, bits: int):
    """(part, windows): of each group of blocks, the distinct windows of ``length`` frequent words
    whose bucket reached the threshold, by range of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(1 << (bits - 3), np.uint8)
        for path in paths:
            part = _load(folder, path)
            bitmap[part["first"][0]:part["first"][0] + len(part["bits"])] = part["bits"]
        for group in _groups(batches):
            found, ranges = [], []
            for codes in group:
                whole = codes != 0
                ok = whole[:max(0, len(codes) - length + 1)].copy()
                for k in range(1, length):
                    ok &= whole[k:k + len(ok)]
                at = np.flatnonzero(ok)
                bucket = _buckets(codes, at, length, bits)
                good = (bitmap[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1 == 1
                found.append(codes[at[good][:, None] + np.arange(length)[None, :]])
                ranges.append(bucket[good] >> RANGE_BITS)
            windows, part = np.concatenate(found), np.concatenate(ranges)
            for number in np.unique(part):
                rows = np.unique(windows[part == number], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([rows.tobytes()], pa.binary())], ["part", "windows"])

    return run


def _distinct(length: int):
    """Distinct windows from rows of ``_listed`` in order of part; those of one part at a time."""

    def lists(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(0, rows.size + 1, length, dtype=np.int32), pa.array(rows.ravel(), pa.int32()))], ["words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = None, [], 0
        for batch in batches:
            for number, blob in zip(batch.column("part").to_pylist(), batch.column("windows")):
                if number != part and held:
                    yield lists(np.unique(np.concatenate(held), axis=0))
                    held, size = [], 0
                part = number
                held.append(np.frombuffer(blob.as_py(), np.int32).reshape(-1, length))
                size += len(held[-1])
                if size > 2 * len(held[0]) + GROUP_CODES:
                    held = [np.unique(np.concatenate(held), axis=0)]
                    size = len(held[0])
        if held:
            yield lists(np.unique(np.concatenate(held), axis=0))

    return run


def _bitmap(tallied: DataFrame, folder: str, bits: int) -> list[str]:
    """Files with the bits of the buckets in ``tallied``, each of a range of buckets."""
    width = min(bits, RANGE_BITS)

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        flags = np.zeros(1 << width, bool)
        flags[group.column("bucket").to_numpy() & ((1 << width) - 1)] = True
        first = key[0].as_py() << (width - 3)
        return pa.table({"path": [_save(folder, bits=np.packbits(flags), first=np.array([first]))]})

    buckets = tallied.where("id < 0").select((-1 - F.col("id")).alias("bucket"))
    files = buckets.withColumn("part", F.shiftright("bucket", width)).groupBy("part").applyInArrow(run, "path string")
    return [r["path"] for r in stage(files, "phrase-buckets").collect()]


def _tries(candidates: DataFrame, folder: str) -> tuple[DataFrame, list[str]]:
    """Candidates with their ids, and the files of the tries, in the order that the ids name."""
    number = _parts_of(candidates.count(), TRIE_PHRASES)

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        lists = group.column("words").combine_chunks()
        phrases = lists.flatten().to_numpy().reshape(len(lists), -1)
        path = _save(folder, **double_array(phrases))
        return pa.table({"part": pa.array([key[0].as_py()] * len(lists), pa.int64()), "row": pa.array(np.arange(len(lists))),
                         "words": lists, "path": pa.array([path] + [None] * (len(lists) - 1), pa.string())})

    dealt = candidates.withColumn("part", F.pmod(F.xxhash64("words"), F.lit(number)))
    built = stage(dealt.groupBy("part").applyInArrow(run, "part long, row long, words array<int>, path string"), "phrase-tries")
    named = sorted(built.where("path is not null").select("part", "path").collect())
    ids = {part: k for k, (part, _) in enumerate(named)}
    place = F.element_at(F.create_map(*(F.lit(x) for kv in ids.items() for x in kv)), F.col("part")) if ids else F.lit(0)
    return built.select(((place.cast("long") * (1 << 32)) + F.col("row")).alias("id"), "words"), [path for _, path in named]


def _bits(windows: int) -> int:
    """Eight windows to a bucket on average, within bounds."""
    return min(MAX_BITS, max(16, (max(1, windows) // 8).bit_length()))


def frequent_phrases(docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``docs`` (text, lang): frequent phrases of 1 to ``LONGEST`` words (words as codes, f), the
    coded words (lang, word, code), and the number of words per language (lang, n)."""
    folder = scratch_path(docs.sparkSession, "phrase-files")
    lang = F.coalesce("lang", F.lit("und"))
    texts = docs.select("text", lang.alias("lang"), F.xxhash64(lang).alias("lang_key"))
    counted = texts.mapInArrow(_count_words, "lang string, word binary, key long, n long").groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))
    words = stage(counted, "phrase-counts")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    coded, paths = dictionary(words.where(F.col("n") >= threshold), folder)
    codes = stage(texts.mapInArrow(_encode(folder, paths), "codes binary"), "phrase-codes") if paths else None
    levels = [coded.select(F.array("code").alias("words"), F.col("n").alias("f"))]
    tries: list[str] = []
    candidates = None
    for length in range(2, LONGEST + 1):
        if codes is None:
            break
        bits = _bits(levels[-1].agg(F.sum("f")).first()[0] or 0)
        tallied = _tallied(codes, folder, tries, length - 1, bits, threshold)
        if candidates is not None:
            levels.append(stage(tallied.join(candidates, "id").select("words", F.col("n").alias("f")), "phrase-level"))
        listed = codes.mapInArrow(_listed(folder, _bitmap(tallied, folder, bits), length, bits), "part long, windows binary")
        # Written as distinct rows first: the joins then see each window once, not once per block.
        windows = stage(_by_part(listed).mapInArrow(_distinct(length), "words array<int>"), "phrase-listed")
        if length > 2:
            known = levels[-1].select(F.col("words").alias("part"))
            for part in (F.slice("words", 1, length - 1), F.slice("words", 2, length - 1)):
                windows = windows.join(known, part == F.col("part"), "left_semi")
        candidates, tries = _tries(stage(windows, "phrase-windows"), folder)
        if not tries:
            break
    else:
        tallied = _tallied(codes, folder, tries, LONGEST, 16, threshold)
        levels.append(stage(tallied.join(candidates, "id").select("words", F.col("n").alias("f")), "phrase-level"))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    out = stage(found, "phrases")
    if codes is not None:
        discard(codes)
    return out, coded.select("lang", F.col("word").cast("string").alias("word"), "code"), totals


def _by_part(rows: DataFrame) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part")


def _tallied(codes: DataFrame, folder: str, tries: list[str], length: int, bits: int, threshold: int) -> DataFrame:
    counted = codes.mapInArrow(_count(folder, tries, length, bits), "part long, ids binary, ns binary")
    return stage(_by_part(counted).mapInArrow(_summed(threshold), "id long, n long"), "phrase-tally")


# --- scores --------------------------------------------------------------------------------


def _wide(column: Column, digits: int = 18) -> Column:
    return column.cast(f"decimal({digits},0)")


def maximal(phrases: DataFrame) -> DataFrame:
    """Phrases of two words or more that no frequent longer phrase as frequent holds.

    If a longer one does, so does one that is longer by a single word: frequency can only fall
    from a phrase to one that holds it."""
    length = F.size("words")
    long = phrases.where(length > 2)
    inner = long.select(F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))).alias("words"), "f")
    return phrases.where(length > 1).join(inner, ["words", "f"], "left_anti")


def collocations(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP) -> DataFrame:
    """The ``top`` phrases per language of ``docs`` (text, lang) by the score of their worst cut,
    ``floor(1000 * a * n / (l * r))``, in exact arithmetic."""
    phrases, words, totals = frequent_phrases(docs, threshold)
    named = (maximal(phrases).select("words", F.posexplode("words").alias("place", "code")).join(words, "code")
             .groupBy("words", "lang").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("parts"))
             .select("words", "lang", F.array_join(F.transform("parts", lambda p: p["word"]), " ").alias("phrase")))
    cuts = named.select("words", "lang", "phrase", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k")).select(
        "words", "lang", "phrase", "k", F.expr("slice(words, 1, k)").alias("left_words"), F.expr("slice(words, k + 1, size(words))").alias("right_words"))
    counts = lambda words, f: phrases.select(F.col("words").alias(words), F.col("f").alias(f))
    met = cuts.join(counts("words", "a"), "words").join(counts("left_words", "l"), "left_words").join(counts("right_words", "r"), "right_words").join(totals, "lang")
    scored = met.withColumn("ratio_top", _wide(F.col("a") * 1000, 19) * _wide(F.col("n"))).withColumn("ratio_low", _wide(F.col("l")) * _wide(F.col("r")))
    worst = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("ratio_top div ratio_low").cast("long").alias("score"), "k", "l", "r")).alias("cut"))
    order = W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    ranked = worst.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
