"""Near-duplicate vectors through an inverted multi-index.

Vectors are cut in halves, each half has a codebook of its own, and the pair of nearest codes is
the cell of a vector in the product grid. A vector visits the cells nearest to it in
multi-sequence order, by the sum of its halves' distances to the two codes. How many it visits is
set on a bounded sample: as many as bring ``TARGET_RECALL`` of pairs at exactly the threshold
together. Every pair that meets is then verified in double precision.

Codebooks come from the sample, all vectors are indexed and all visit. Cells are split into blocks
of bounded size on both sides, so a crowded cell is many tasks; a block returns link counts and a
spanning forest of its links, never its pairs. Equal vectors are one vector with a count.

Vectors that are null, empty, all zero, or hold null or non-finite components link with nothing.
Vectors of different lengths never link. Rows with equal ids are rows of their own. A row without
id comes after all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.components import components
from ledgerlink.llm.tables import lowest_hashes, stage

THRESHOLD = 0.9
TARGET_RECALL = 0.98
SAMPLE = 20_000
MAX_CODES = 1024
PER_CELL = 16
BLOCK = 1024
LAST = (1 << 63) - 1


def _squares(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (codes * codes).sum(1)[None, :] - 2 * x @ codes.T, 0)


def codebook(x: np.ndarray, size: int, seed: int = 3, rounds: int = 12) -> np.ndarray:
    """k-means codes of the rows of ``x``."""
    rng = np.random.default_rng(seed)
    codes = x[rng.choice(len(x), min(size, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([_squares(part, codes).argmin(1) for part in np.array_split(x, max(1, len(x) // 2000))])
        counts = np.bincount(own, minlength=len(codes))
        sums = np.zeros_like(codes)
        np.add.at(sums, own, x)
        codes[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return codes


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def nearest_cells(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], visits: int) -> np.ndarray:
    """The first ``visits`` cells of each row in multi-sequence order. The cell of the a-th and
    b-th nearest codes follows all (a+1)(b+1) - 1 cells of nearer codes, so ``visits`` codes of
    each half suffice."""
    half = x.shape[1] // 2
    orders, distances = [], []
    for part, codes in zip((x[:, :half], x[:, half:]), books):
        d = _squares(part, codes)
        order = np.argsort(d, axis=1, kind="stable")[:, :visits]
        orders.append(order)
        distances.append(np.take_along_axis(d, order, 1))
    grid = (distances[0][:, :, None] + distances[1][:, None, :]).reshape(len(x), -1)
    first = np.argsort(grid, axis=1, kind="stable")[:, :visits]
    wide = orders[1].shape[1]
    rows = np.arange(len(x))[:, None]
    return orders[0][rows, first // wide] * len(books[1]) + orders[1][rows, first % wide]


def visits_needed(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], threshold: float, recall: float, seed: int = 5) -> int:
    """Cells to visit so that a share ``recall`` of partners at exactly ``threshold`` is met."""
    rng = np.random.default_rng(seed)
    x = x[:2000]
    noise = rng.standard_normal(x.shape)
    noise = units(noise - (noise * x).sum(1, keepdims=True) * x)
    partners = threshold * x + np.sqrt(1 - threshold**2) * noise
    most = min(len(books[0]) * len(books[1]), 256)
    while True:
        cells = np.concatenate([nearest_cells(part, books, most) for part in np.array_split(x, max(1, len(x) // 100))])
        met = cells == nearest_cells(partners, books, 1)
        rank = np.where(met.any(1), met.argmax(1) + 1, most + 1)
        needed = int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(recall * len(rank))) - 1)])
        if needed <= most or most >= len(books[0]) * len(books[1]):
            return min(needed, most)
        most = min(4 * most, len(books[0]) * len(books[1]))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(array), -1)


def _addressed(books: tuple[np.ndarray, np.ndarray], visits: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cells = nearest_cells(units(_matrix(part.column("vec"))), books, visits).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(list(cells), pa.list_(pa.int64()))], ["no", "vec", "copies", "cells"])

    return run


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest number it reaches) of a block's links."""
    big = np.int64(LAST)
    low_left, low_right = left.copy(), right.copy()
    while True:
        new_right = np.minimum(low_right, np.where(linked, low_left[:, None], big).min(0))
        new_left = np.minimum(low_left, np.where(linked, new_right[None, :], big).min(1))
        if (new_right == low_right).all() and (new_left == low_left).all():
            break
        low_left, low_right = new_left, new_right
    return np.concatenate([left, right]), np.concatenate([low_left, low_right])


def _verified(threshold: float):
    def run(members: pa.Table, visitors: pa.Table) -> pa.Table:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        links = np.zeros(0, np.int64)
        if len(members) and len(visitors):
            x, y = _matrix(visitors.column("vec")), _matrix(members.column("vec"))
            cosine = x @ y.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :])
            left, right = visitors.column("no").to_numpy(), members.column("no").to_numpy()
            linked = (cosine >= threshold) & (left[:, None] < right[None, :])
            a, b = _forest(linked, left, right)
            links = np.concatenate([linked @ members.column("copies").to_numpy(), visitors.column("copies").to_numpy() @ linked])
            touched = links > 0
            a, b, links = a[touched], b[touched], links[touched]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(links, pa.int64())})

    return run


def _sized(sample: np.ndarray, count: int, threshold: float, recall: float) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    size = int(min(MAX_CODES, max(4, np.ceil(np.sqrt(count / PER_CELL)))))
    x = units(sample)
    half = x.shape[1] // 2
    books = codebook(x[:, :half], size), codebook(x[:, half:], size)
    return books, visits_needed(x, books, threshold, recall)


def block_links(vectors: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(a, b, links) of ``vectors`` (no, vec, copies), all of one length: a node, a node it reaches,
    and the rows it links with in one block. A pair is looked for from its smaller number."""
    count = vectors.count()
    rows = lowest_hashes(vectors, SAMPLE, "codes", "no").select("vec").toPandas()
    books, visits = _sized(np.array(rows["vec"].tolist(), float), count, threshold, recall)
    kind = dict(vectors.dtypes)["vec"]
    placed = stage(vectors.select("no", "vec", "copies").mapInArrow(
        _addressed(books, visits), f"no long, vec {kind}, copies long, cells array<long>"), "addressed-vectors")
    members = placed.select("no", "vec", "copies", F.col("cells")[0].alias("cell"))
    # New names for the same columns, so that both sides can be grouped together.
    visitors = placed.select(*(F.col(c).alias(c) for c in ("no", "vec", "copies")), F.explode("cells").alias("cell"))
    parts = F.ceil(F.count("*") / BLOCK).cast("int")
    cells = members.groupBy("cell").agg(parts.alias("member_parts")).join(visitors.groupBy("cell").agg(parts.alias("visitor_parts")), "cell")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in one part of its own side, and once for every part of the other side."""
        return rows.join(cells, "cell").select(
            "cell", "no", "vec", "copies", F.pmod(F.xxhash64("no"), F.col(f"{own}_parts")).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1)).alias(other))

    keys = ["cell", "member", "visitor"]
    return dealt(members, "member", "visitor").groupBy(*keys).cogroup(dealt(visitors, "visitor", "member").groupBy(*keys)).applyInArrow(
        _verified(threshold), "a long, b long, links long")


def groups(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """n_links, component_id and kept per row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    marked = vectors.select("vec_id", F.when(~bad & some, F.col("embedding")).alias("vec"))
    distinct = stage(marked.where("vec is not null").groupBy("vec").agg(
        F.min(F.coalesce("vec_id", F.lit(LAST))).alias("first"), F.count("*").alias("copies")).select(
        F.monotonically_increasing_id().alias("no"), "vec", "first", "copies"), "distinct-vectors")
    lengths = [r["n"] for r in distinct.select(F.size("vec").alias("n")).distinct().collect()]
    found = spark.createDataFrame([], "a long, b long, links long")
    for n in lengths:
        found = found.union(block_links(distinct.where(F.size("vec") == n), threshold, recall))
    found = stage(found, "vector-links")
    counted = found.groupBy(F.col("a").alias("counted")).agg(F.sum("links").alias("links"))
    rooted = components(found.select("a", "b"))
    known = distinct.join(rooted, F.col("no") == F.col("node"), "left").join(counted, F.col("no") == F.col("counted"), "left").select(
        "vec", "first", "copies", F.coalesce("root", "no").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    lowest = known.groupBy("root").agg(F.min("first").alias("lowest"))
    classes = known.join(lowest, "root").select(F.col("vec").alias("of_vec"), (F.col("links") + F.col("copies") - 1).alias("links"), "lowest")
    joined = marked.join(classes, F.col("vec") == F.col("of_vec"), "left")
    component = F.when(F.col("vec").isNull(), F.col("vec_id")).when(F.col("lowest") != LAST, F.col("lowest"))
    return joined.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))
