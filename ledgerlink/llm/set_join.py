"""Exact Jaccard self-join of shingle sets with set-relation skipping, for linked groups.

Two sets link when ``100 * |A & B| >= PERCENT * |A | B|``. Equal sets are one set from the start.
Sets are ordered rarest shingle first and indexed by a prefix: linked sets share a shingle of it.
The order is any that all tasks agree on; the most frequent shingles, found over all sets, go to
the back so that lists stay short.

*Skipping in the lists.* A list is cut into blocks by set size, so only sizes that can link meet.
Where two sets meet first, all their shingles before that place are unshared, so places whose sum
exceeds the differences that linked sets can have are skipped.
*Odd classes.* A set carries a bit per class of hashes that holds an odd number of its shingles. Two sets
differ in at least as many shingles as in bits, so most members of a list that cannot link never
become a pair.
*Rounds of hubs.* A list is not paired off: its members are compared with one of them, the hub, then
what is left with sixteen hubs, then with 256, and so on. A hub that was compared leaves
its lists. Members that link to one hub are one group, and only members of different groups are
compared in later rounds; lists within one group are done. So a list of near copies costs a few
comparisons a member, and the number of rounds grows with the logarithm of the longest list.
*Answers from a similar set.* What a set shares with another is at most what a set similar to it
shares with that one, and its own shingles beyond the similar set. Each set keeps the hub it is most
similar to and asks the hub's answers first: pairs that this rules out are not looked at.
*Sketches.* Numbers of shingles per class of hashes bound what two sets share; the others never
travel as texts.

Sets are compared by 64-bit hashes of their shingles. Null and empty texts have no set and link
with nothing. Rows with equal ids are rows of their own sets. A row without id counts as the
largest, and its group takes the smallest id there is (null if there is none).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ledgerlink.llm import text_arrays as ta
from ledgerlink.llm.components import components
from ledgerlink.llm.tables import boxed, discard, stage

SHINGLE = 3
PERCENT = 90
FREQUENT_SHINGLES = 100_000
FREQUENT_FROM = 8
COUNT_CHUNK = 1_000_000
MORE_HUBS = 16
SKETCH = 256
ODD = [f"odd{k}" for k in range(SKETCH // 64)]
COMPARED_ROWS = 250
SETS = "doc_id long, n_shingles long, print1 long, print2 long, sketch binary, text string"


def shingles(t: ta.TextSlice, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and the text of each; a text with fewer
    words than a shingle is one shingle."""
    words, counts = t.words, t.n_words
    at, hashes = t.windows(size, words)
    doc, parts = t.doc[at], [hashes]
    bounds = np.cumsum(counts) - counts
    docs = [doc]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            parts.append(ta.mix(ta.window_hashes(words, n)[bounds[short]] + np.uint64(n)))
            docs.append(short)
    hashes, doc = np.concatenate(parts), np.concatenate(docs)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], doc[new]


def _slices(batches: Iterator[pa.RecordBatch], column: str = "text"):
    for batch in batches:
        yield from ta.slices(batch, column, lower=True)


def _prints(size: int):
    """Set size, two order-free digests and the sketch per document: shingles per class of their
    hash, modulo 256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, t in _slices(batches):
            hashes, doc = shingles(t, size)
            digests = []
            for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                total = np.zeros(t.docs, np.uint64)
                np.add.at(total, doc, ta.mix(hashes ^ np.uint64(salt)))
                digests.append(pa.array(total.view(np.int64)))
            classes = np.bincount(doc * SKETCH + (hashes >> np.uint64(56)).astype(np.int64), minlength=t.docs * SKETCH).astype(np.uint8)
            sketch = pa.Array.from_buffers(pa.binary(), t.docs, [None, pa.py_buffer(np.arange(0, (t.docs + 1) * SKETCH, SKETCH, dtype=np.int32)), pa.py_buffer(classes)])
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.bincount(doc, minlength=t.docs), pa.int64()), *digests, sketch, rows.column("text")],
                ["doc_id", "n_shingles", "print1", "print2", "sketch", "text"])

    return run


def _counted(size: int):
    """(shingle, n) of shingles that stand twice or more among the sets a task sees together."""

    def counts(hashes: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(hashes), return_counts=True)
        return pa.RecordBatch.from_pydict({"shingle": found[n > 1].view(np.int64), "n": n[n > 1]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for _, t in _slices(batches):
            held.append(shingles(t, size)[0])
            total += len(held[-1])
            if total >= COUNT_CHUNK:
                yield counts(held)
                held, total = [], 0
        if held:
            yield counts(held)

    return run


def frequent(sets: DataFrame, size: int, limit: int = FREQUENT_SHINGLES) -> np.ndarray:
    """The most frequent shingles, rarest first, at most ``limit``. They only order the sets, so
    the limit bounds what is sent to tasks and never changes a result."""
    counted = sets.select("text").mapInArrow(_counted(size), "shingle long, n long")
    top = counted.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_FROM).orderBy(F.desc("n"), "shingle").limit(limit)
    rows = top.toPandas()
    return rows["shingle"].to_numpy(np.int64)[::-1].view(np.uint64) if len(rows) else np.zeros(0, np.uint64)


def size_block(n, percent: int) -> np.ndarray:
    """A set can only link with larger ones of its block or of the block of ``n / share``."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / percent) / 2 + 1e-9).astype(np.int32)


def _prefixes(size: int, percent: int, late: np.ndarray):
    """(shingle, block, set_no, n, at) for the prefix of each set, in its block and in the next
    one if larger sets that it can link with lie there."""
    by_hash = np.argsort(late)
    sorted_late = late[by_hash]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, t in _slices(batches):
            hashes, doc = shingles(t, size)
            n = np.bincount(doc, minlength=t.docs)
            rank = np.zeros(len(hashes), np.int64)
            if len(late):
                at = np.minimum(np.searchsorted(sorted_late, hashes), len(late) - 1)
                rank = np.where(sorted_late[at] == hashes, by_hash[at] + 1, 0)
            order = np.lexsort((hashes, rank, doc))
            hashes, doc = hashes[order], doc[order]
            position = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
            length = n - (percent * n + 99) // 100 + 1
            # Smaller sets link with equal sets only, and those are one set already.
            keep = (position < length[doc]) & (n[doc] * (100 - percent) >= percent)
            hashes, doc, position = hashes[keep], doc[keep], position[keep].astype(np.int32)
            block, above = size_block(n, percent), size_block(n * 100 / percent, percent)
            again = np.flatnonzero((above > block)[doc])
            take = np.concatenate([np.arange(len(doc)), again])
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[take].view(np.int64)), pa.array(np.concatenate([block[doc], above[doc[again]]])),
                 rows.column("set_no").take(pa.array(doc[take])), pa.array(n[doc[take]].astype(np.int32)), pa.array(position[take])],
                ["shingle", "block", "set_no", "n", "at"])

    return run


def _odd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set_no, odd0, odd1, ...): the lowest bits of the numbers in the sketch, 64 to a column."""
    for batch in batches:
        numbers = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        bits = np.ascontiguousarray(np.packbits(numbers & 1, axis=1)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("set_no"), *(pa.array(bits[:, k]) for k in range(len(ODD)))], ["set_no", *ODD])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed on their own: they travel to every set that they are compared with."""
    compress = zstandard.ZstdCompressor(level=6).compress
    for batch in batches:
        texts = [compress((text.as_py() or "").encode()) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("set_no"), pa.array(texts, pa.binary()), batch.column("sketch")], ["set_no", "text", "sketch"])


def _sets_of(column: pa.Array, size: int) -> list[np.ndarray]:
    """Ascending shingle arrays of a column of compressed texts."""
    out: list[np.ndarray] = []
    unpack = zstandard.ZstdDecompressor().decompress
    column = pa.array([unpack(text.as_buffer()) for text in column], pa.binary())
    for _, t in ta.slices(pa.RecordBatch.from_arrays([column], ["text"]), lower=True):
        hashes, doc = shingles(t, size)
        out.extend(np.split(hashes, np.cumsum(np.bincount(doc, minlength=t.docs))[:-1]))
    return out


def _bounded(percent: int):
    """(a, b, most) of all pairs, with the most that their sketches let them share, and whether that
    is enough to link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SKETCH) for k in ("sketch_a", "sketch_b")]
            apart = sides[0] - sides[1]  # modulo 256, so the smaller way round is a lower bound
            least = np.minimum(apart, -apart).astype(np.int64).sum(axis=1)
            n_a, n_b = (batch.column(k).to_numpy().astype(np.int64) for k in ("n_a", "n_b"))
            most = (n_a + n_b - least) // 2
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in ("a", "b", "n_a", "n_b")), pa.array(most), pa.array(most * (100 + percent) >= percent * (n_a + n_b))], ["a", "b", "n_a", "n_b", "most", "open"])

    return run


def _shared(size: int):
    """(a, b, n_a, n_b, both): what two sets share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, COMPARED_ROWS):
                rows = batch.slice(at, COMPARED_ROWS)
                firsts = rows.column("text_a").dictionary_encode()
                first_sets = _sets_of(firsts.dictionary, size)
                both = [len(np.intersect1d(first_sets[k], own, assume_unique=True))
                        for k, own in zip(firsts.indices.to_pylist(), _sets_of(rows.column("text_b"), size))]
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in ("a", "b", "n_a", "n_b")), pa.array(both, pa.int64())], ["a", "b", "n_a", "n_b", "both"])

    return run


def _ruled_out(pairs: DataFrame, seen: DataFrame, anchors: DataFrame, percent: int) -> DataFrame:
    """``pairs`` without those that were seen, and those that a similar set's answer rules out."""
    left = pairs.join(seen.select("a", "b"), ["a", "b"], "left_anti")
    both_ways = seen.select(F.col("a").alias("_h"), F.col("b").alias("_y"), "most").union(seen.select(F.col("b").alias("_h"), F.col("a").alias("_y"), "most"))
    for own, other in (("a", "b"), ("b", "a")):
        near = anchors.select(F.col("set_no").alias("_x"), "anchor", "extra")
        left = left.join(near, F.col(own) == F.col("_x"), "left").join(both_ways, (F.col("anchor") == F.col("_h")) & (F.col(other) == F.col("_y")), "left")
        can = F.col("most").isNull() | ((F.col("most") + F.col("extra")) * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b")))
        left = left.where(can).select("a", "b", "n_a", "n_b")
    return left


def linked_pairs(sets: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(node, root) of the sets of ``sets`` (set_no, text, sketch) that link with others; sets that
    reach each other by links have one root."""
    late = frequent(sets, size)
    rows = sets.select("set_no", "text").mapInArrow(_prefixes(size, percent, late), "shingle long, block int, set_no long, n int, at int")
    # Lists of one set go before anything else is shuffled.
    shared = stage(rows.groupBy("shingle", "block").agg(F.min("set_no").alias("low"), F.max("set_no").alias("high")).where("low <> high").select("shingle", "block"), "lists")
    short = stage(rows.join(shared, ["shingle", "block"], "left_semi"), "list-members")
    odd = sets.select("set_no", "sketch").mapInArrow(_odd, ", ".join(["set_no long", *(f"{name} long" for name in ODD)]))
    lists = stage(short.join(odd, "set_no"), "list-members")
    discard(short)
    members = lists.select("set_no").distinct()
    texts = stage(sets.select("set_no", "text", "sketch").join(members, "set_no", "left_semi").mapInArrow(_packed, "set_no long, text binary, sketch binary"), "listed-sets")
    spark = sets.sparkSession
    found = spark.createDataFrame([], "a long, b long, n_a int, n_b int, both long")
    seen = spark.createDataFrame([], "a long, b long, most long")
    roots = spark.createDataFrame([], "node long, root long")
    anchors = spark.createDataFrame([], "set_no long, anchor long, extra long")
    for turn in itertools.count():
        # Hubs come in one order for all lists, so lists of the same sets have the same hubs.
        order = W.partitionBy("shingle", "block").orderBy(F.xxhash64("set_no"), "set_no")
        hubs = stage(lists.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MORE_HUBS**turn).drop("place"), "hubs")
        label = roots.select(F.col("node").alias("_node"), "root")
        mine = lists.join(label, F.col("set_no") == F.col("_node"), "left").select("shingle", "block", "set_no", "n", "at", *ODD, F.coalesce("root", "set_no").alias("root"))
        theirs = hubs.join(label, F.col("set_no") == F.col("_node"), "left").select(
            "shingle", "block", F.col("set_no").alias("hub"), F.col("n").alias("hub_n"), F.col("at").alias("hub_at"),
            *(F.col(name).alias(f"hub_{name}") for name in ODD), F.coalesce("root", "set_no").alias("hub_root"))
        odd_classes = sum(F.bit_count(F.col(name).bitwiseXOR(F.col(f"hub_{name}"))) for name in ODD)
        unshared = F.greatest(F.col("at") + F.col("hub_at"), odd_classes) * (100 + percent) <= (F.col("n") + F.col("hub_n")) * (100 - percent)
        sized = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent
        met = mine.join(theirs, ["shingle", "block"]).where("root <> hub_root").where(unshared).where(sized)
        first = F.col("hub") < F.col("set_no")
        pairs = met.select(F.least("hub", "set_no").alias("a"), F.greatest("hub", "set_no").alias("b"),
                           F.when(first, F.col("hub_n")).otherwise(F.col("n")).alias("n_a"), F.when(first, F.col("n")).otherwise(F.col("hub_n")).alias("n_b")).distinct()
        new = stage(_ruled_out(pairs, seen, anchors, percent) if turn else pairs, "pairs")
        sides = [texts.select(F.col("set_no").alias(f"_{x}"), F.col("sketch").alias(f"sketch_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab"]
        sketched = new.join(sides[0].drop("text_a"), F.col("a") == F.col("_a")).join(sides[1].drop("text_b"), F.col("b") == F.col("_b"))
        bounded = stage(sketched.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_bounded(percent), "a long, b long, n_a int, n_b int, most long, open boolean"), "bounded")
        together = bounded.where("open").join(sides[0].drop("sketch_a"), F.col("a") == F.col("_a")).join(sides[1].drop("sketch_b"), F.col("b") == F.col("_b"))
        compared = stage(together.select("a", "b", "n_a", "n_b", "text_a", "text_b").mapInArrow(_shared(size), "a long, b long, n_a int, n_b int, both long"), "compared")
        answers = bounded.where("not open").select("a", "b", "most").union(compared.select("a", "b", F.col("both").alias("most")))
        seen = stage(seen.union(answers), "answers")
        fresh = compared.where(F.col("both") * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b")))
        found = stage(found.union(fresh), "links")
        roots = components(found.select("a", "b"))
        similar = found.select(F.col("a").alias("set_no"), F.col("b").alias("anchor"), (F.col("n_a") - F.col("both")).alias("extra")).union(
            found.select(F.col("b").alias("set_no"), F.col("a").alias("anchor"), (F.col("n_b") - F.col("both")).alias("extra")))
        anchors = similar.groupBy("set_no").agg(F.min(F.struct("extra", "anchor")).alias("m")).select("set_no", "m.anchor", "m.extra")
        # Lists go on without their hubs, as long as they hold sets of different groups.
        left = lists.join(hubs.select("shingle", "block", "set_no"), ["shingle", "block", "set_no"], "left_anti").join(
            roots.select(F.col("node").alias("_node"), "root"), F.col("set_no") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "set_no"))
        several = left.groupBy("shingle", "block").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("shingle", "block")
        done, lists = lists, stage(left.drop("_node", "root").join(several, ["shingle", "block"], "left_semi"), "list-members")
        discard(done, hubs, new, bounded, compared)
        if lists.isEmpty():
            discard(texts, shared)
            return roots


def _classes(printed: DataFrame, size: int, percent: int) -> DataFrame:
    """(print1, print2, root) of every set of ``printed`` (rows of ``_prints``): sets with one root
    reach each other by links."""
    sets = stage(printed.where("n_shingles > 0").groupBy("print1", "print2").agg(F.first("text").alias("text"), F.first("sketch").alias("sketch")).select(
        F.monotonically_increasing_id().alias("set_no"), "print1", "print2", "sketch", "text"), "shingle-sets")
    found = linked_pairs(sets, size, percent)
    rooted = sets.select("set_no", "print1", "print2").join(found, F.col("set_no") == F.col("node"), "left")
    classes = stage(rooted.select("print1", "print2", F.coalesce("root", "set_no").alias("root")), "set-classes")
    discard(sets)
    return classes


def groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """n_shingles and component_id (smallest doc_id reachable by links) per row of ``docs`` (doc_id, text)."""
    last = F.lit((1 << 63) - 1)
    printed = docs.select("doc_id", "text").mapInArrow(_prints(size), SETS)
    rows = printed.drop("text", "sketch").join(_classes(printed, size, percent), ["print1", "print2"], "left")
    rows = stage(rows.select("doc_id", "n_shingles", "root"), "set-members")
    lowest = rows.where("root is not null").groupBy(F.col("root").alias("of")).agg(F.min(F.coalesce("doc_id", last)).alias("lowest"))
    joined = rows.join(lowest, F.col("root") == F.col("of"), "left")
    lowest_id = F.when(F.col("lowest") != last, F.col("lowest"))
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, lowest_id).otherwise(F.col("doc_id")).alias("component_id"))


def one_per_group(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that stand for their group: of each group
    the row with the smallest id, of equal ids the first row; rows without id come last. Rows
    without words are in no group and stay."""
    rows = stage(boxed(docs, "doc_id", "text").withColumn("_row", F.monotonically_increasing_id()), "group-rows")
    printed = rows.select(F.col("_row").alias("doc_id"), "text").mapInArrow(_prints(size), SETS)
    classes = _classes(printed, size, percent)
    members = printed.select(F.col("doc_id").alias("_row"), "n_shingles", "print1", "print2").join(classes, ["print1", "print2"], "left")
    placed = members.join(rows.select("_row", "doc_id"), "_row")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "_row")
    own = F.when(F.col("n_shingles") == 0, F.col("_row"))
    chosen = placed.groupBy("root", own.alias("own")).agg(F.min(order).alias("first")).select(F.col("first._row").alias("_row"))
    return rows.join(chosen, "_row", "left_semi").select([F.col("_doc")[c].alias(c) for c in docs.columns])
