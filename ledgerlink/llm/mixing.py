"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Blocks all hold the same number of words (a source's last one may hold fewer). The k-th block of a
source has the quotient ``target / (2k - 1)``; blocks are awarded by highest quotient down to half a
block. A source therefore gets ``floor(target / block + 1/2)`` blocks, and since the method is
monotone in the number of blocks, the first ``h`` of ``n`` shards hold the blocks with quotients of at
least ``n / h`` halves: quotas per shard are differences of two such roundings.

The documents of a source stand in a seeded order and are cut into blocks, and the blocks are drawn
in a seeded order of their own, around it as often as needed. The first shard takes as many draws
as its quota says, the next one the draws after these, and so on; so every shard's blocks are a
seeded choice, and no block is drawn again before all have been drawn.

Nulls: a null text has no words; a null source is a source of its own, last in order. Rows with
equal ids are mixed like any others. Without any word every target is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ledgerlink.llm.tables import boxed, stage, unboxed

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCKS_OF_SMALLEST = 200
SEED = "mix-1"
BUCKET_DIGITS = 3
SHARDS = 16


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source of ``sizes`` (source, size): words, weight, target and quota in blocks.

    Targets share all words by weight; one above ``repeats`` times its source stops there and the
    rest is shared anew. Ordered by cap per weight, the sources that stop come first, so the level
    at which the sharing ends follows from running sums.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here on: windows over this table stay small.
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long"))
    capped = weighted.withColumn("cap", F.col("source_size") * repeats)
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    leveled = (
        capped.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("shares", F.sum("weight").over(after))
        .withColumn("open", F.col("left") * F.col("weight") <= F.col("cap") * F.col("shares"))
        .withColumn("rank", F.row_number().over(by_ratio))
    )
    first_open = F.min(F.when(F.col("open"), F.struct("rank", "left", "shares"))).over(everything)
    target = F.when(F.col("rank") < first_open["rank"], F.col("cap").cast("double")).otherwise(
        first_open["left"].cast("double") * F.col("weight") / first_open["shares"])
    targeted = leveled.withColumn("target", F.coalesce(target, F.lit(0.0)))
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    block = F.greatest(F.lit(1), F.floor(smallest / BLOCKS_OF_SMALLEST)).cast("long")
    return (
        targeted.withColumn("block", F.coalesce(block, F.lit(1).cast("long")))
        .withColumn("quota", F.floor(F.col("target") / F.col("block") + 0.5).cast("long"))
        .select("source", "source_size", "weight", "target", "block", "quota")
    )


def shard_quotas(targets: DataFrame, shards: int) -> DataFrame:
    """Blocks of each source in each of ``shards`` shards; shards differ by rounding only."""
    upto = F.floor(F.col("target") * F.col("shard") / (F.col("block") * shards) + 0.5).cast("long")
    return (
        targets.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
        .withColumn("upto", upto)
        .withColumn("blocks", F.col("upto") - F.coalesce(F.floor(
            F.col("target") * (F.col("shard") - 1) / (F.col("block") * shards) + 0.5).cast("long"), F.lit(0)))
        .select("source", "shard", "blocks")
    )


def seeded(column: Column, seed: str) -> Column:
    """Order in which documents, or first blocks, are drawn."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("null"))))


def _ahead(rows: DataFrame, weight: Column, order: list[str], name: str) -> DataFrame:
    """``rows`` (source, draw and others) with the sum of ``weight`` over the rows before them in
    their source's order of ``draw`` and ``order``.

    Sums run in two steps, within buckets of the seeded order and over the buckets, so a source
    with a third of all rows is dealt over 4096 groups.
    """
    rows = rows.withColumn("_bucket", F.substring("draw", 1, BUCKET_DIGITS)).withColumn("_weight", weight)
    buckets = rows.groupBy("source", "_bucket").agg(F.sum("_weight").alias("_sum"))
    over = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = buckets.select(F.col("source").alias("_source"), F.col("_bucket").alias("_in"), F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_base"))
    inside = W.partitionBy("source", "_bucket").orderBy("draw", *order).rowsBetween(W.unboundedPreceding, -1)
    summed = rows.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    joined = summed.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_in")))
    return joined.withColumn(name, (F.col("_base") + F.col("_inside")).cast("long")).drop("_bucket", "_weight", "_source", "_in", "_base", "_inside")


def drawn_blocks(targets: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """A row per draw: (source, number, turn, shard). ``number`` counts a source's blocks, ``turn``
    how often all of them were drawn before. Shards hold what ``shard_quotas`` gives them: the draw
    with ``i`` before it belongs to the first shard whose quota, with those before, exceeds i."""
    count = F.ceil(F.col("source_size") / F.col("block")).cast("long")
    blocks = targets.where("quota > 0").select("source", "target", "block", "quota", count.alias("count")).withColumn(
        "number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    key = F.concat_ws(":", F.coalesce("source", F.lit("null")), F.col("number").cast("string"))
    ranked = _ahead(blocks.withColumn("draw", seeded(key, seed)), F.lit(1).cast("long"), ["number"], "rank")
    turns = F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / F.col("count")).cast("long"))
    draws = ranked.withColumn("turn", F.explode(turns)).withColumn("i", F.col("turn") * F.col("count") + F.col("rank")).where("i < quota")
    shard = F.ceil((F.col("i") + 0.5) * (F.col("block") * shards) / F.col("target"))
    return draws.select("source", "number", "turn", F.least(F.greatest(shard, F.lit(1)), F.lit(shards)).cast("int").alias("shard"))


def located(docs: DataFrame, seed: str, *carried: str) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs`` (doc_id, text, source) its size, its source's figures and its place
    ``begins`` in the seeded order of its source; and the sources' figures."""
    sized = stage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *carried), "mix-sizes")
    targets = stage(source_targets(sized.select("source", "size")), "mix-targets")
    placed = _ahead(sized.withColumn("draw", seeded(F.col("doc_id"), seed)), F.col("size"), ["doc_id", "size"], "begins")
    joined = placed.join(targets.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source")))
    return joined.select("doc_id", "source", "size", "source_size", "target", "block", "begins", *carried), targets


def _overlaps(rows: DataFrame, draws: DataFrame) -> DataFrame:
    """``rows`` of ``located`` with words, once per drawn block that they overlap: the draw's
    ``number``, ``turn`` and ``shard``, and the words ``low`` to ``high`` of the document in it."""
    first, last = (F.floor(x / F.col("block")).cast("long") for x in (F.col("begins"), F.col("begins") + F.col("size") - 1))
    met = rows.where("size > 0").withColumn("in_block", F.explode(F.sequence(first, last))).join(
        draws.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source")) & (F.col("in_block") == F.col("number"))).drop("of_source", "in_block")
    low = F.greatest(F.lit(0), F.col("number") * F.col("block") - F.col("begins"))
    high = F.least(F.col("size"), (F.col("number") + 1) * F.col("block") - F.col("begins"))
    return met.withColumn("low", low.cast("long")).withColumn("high", high.cast("long"))


def mix(docs: DataFrame, seed: str = SEED, shards: int = SHARDS) -> DataFrame:
    """Per document of ``docs`` (doc_id, text, source): size, its source's words and target, and
    the words that the mix takes of it. Other columns are not read."""
    numbered = docs.select("doc_id", "text", "source", F.monotonically_increasing_id().alias("_row"))
    rows, targets = located(numbered, seed, "_row")
    rows = stage(rows, "mix-places")
    taken = _overlaps(rows, drawn_blocks(targets, shards, seed)).groupBy("_row").agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    return rows.join(taken, "_row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def mixed(docs: DataFrame, seed: str = SEED, shards: int = SHARDS) -> DataFrame:
    """The mix itself: rows of ``docs``, one per run of words that a turn of draws takes of a
    document: whole texts, or the words of a run joined by one space. ``n_chars``, if there, is set
    anew."""
    numbered = stage(boxed(docs, "doc_id", "text", "source").withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    rows, targets = located(numbered, seed, "_row")
    parts = _overlaps(rows, drawn_blocks(targets, shards, seed))
    # Neighbouring drawn blocks are one run; a document's blocks are as many as its length asks for.
    run = F.col("number") - F.row_number().over(W.partitionBy("_row", "turn").orderBy("number"))
    pieces = parts.withColumn("run", run).groupBy("_row", "turn", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.first("size").alias("size"))
    joined = numbered.join(pieces.drop("turn", "run"), "_row")
    words = F.regexp_extract_all("text", F.lit(r"([^ \t-\r]+)"), F.lit(1))
    cut = F.array_join(F.slice(words, (F.col("low") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int")), " ")
    return unboxed(joined, docs, F.when(F.col("high") - F.col("low") == F.col("size"), F.col("text")).otherwise(cut))
