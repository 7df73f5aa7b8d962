"""Weighted rendezvous sharding by record key, with shard files and gapless places.

Every shard scores every key and the least score wins. The score of a uniform draw u under weight
w is ``-ln(u) / w``, so a shard wins keys in proportion to its weight. A draw depends on the key
and the shard alone: a further shard takes keys only to itself, a removed one gives only its own.
Draws are linear in two words of the key's digest modulo a prime, with factors from the digest of
the shard's name.

Within a shard, rows stand by id, size and checksum. They are dealt by range with the row's number
as last key, so that equal rows (a third of the table without id, say) spread over many tasks;
a row's place follows from its place in its task and from the counts per task and shard.

Law: ``key``. Equal texts under different ids are not kept together. Null ids are one key; a null
text counts as empty. Other columns travel in the struct ``doc`` and cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerlink.llm.tables import boxed, discard, shuffles_dropped, stage
from ledgerlink.session import scratch_path

PRIME = 2147483647
FACTOR_BITS = 29
OVERHEAD = 16


def factors(shard: int) -> tuple[int, int, int]:
    """The numbers that make a shard's draws, from the digest of its name."""
    digest = hashlib.md5(f"shard:{shard}".encode()).hexdigest()
    return tuple(1 + int(digest[8 * k:8 * k + 8], 16) % (1 << FACTOR_BITS) for k in range(3))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Number of the winning shard; equal scores go to the lower number."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")))
    words = F.struct(*(F.conv(F.substring(digest, at, 8), 16, 10).cast("long").alias(name) for at, name in ((1, "x"), (9, "y"))))
    shards = F.array(*(F.struct(F.lit(i).alias("i"), *(F.lit(f).cast("long").alias(n) for f, n in zip(factors(i), "abc")), F.lit(float(w)).alias("w"))
                       for i, w in enumerate(weights)))

    def scored(h: Column) -> Column:
        draw = lambda s: (h["x"] * s["a"] + h["y"] * s["b"] + s["c"]) % PRIME
        return F.array_min(F.transform(shards, lambda s: F.struct((-F.log((draw(s) + F.lit(0.5)) / PRIME) / s["w"]).alias("score"), s["i"].alias("i"))))["i"]

    return F.element_at(F.transform(F.array(words), scored), 1)  # the digest is taken once per row


def write(docs: DataFrame, weights: Sequence[float], grown_weight: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Write ``docs`` (doc_id, text and any others) to a folder per shard; returns the files' rows
    and the first place of each (shard, part) in its shard. ``grown_shard`` in the files is the
    shard under one more shard of ``grown_weight``."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    scored = boxed(docs, "doc_id", "text").select(
        F.col("_doc").alias("doc"), "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        shard_of(F.col("doc_id"), weights).alias("shard"), shard_of(F.col("doc_id"), [*weights, grown_weight]).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"))
    rows = stage(scored, "shard-rows")
    order = ["shard", "doc_id", "size", "text_crc32", "row"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "doc", "size", "text_crc32", "shard", "grown_shard", F.monotonically_increasing_id().alias("at"))
    folder = scratch_path(spark, "shards")
    with shuffles_dropped(spark):
        placed.write.option("compression", "zstd").partitionBy("shard").parquet(folder)
    discard(rows)
    files = spark.read.schema(placed.schema).parquet(folder).withColumn("part", F.shiftright("at", 33))
    parts = files.groupBy("shard", "part").agg(F.count("*").alias("rows"), F.min("at").alias("low"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per task
    return files, stage(parts.select("shard", "part", "low", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first")), "shard-parts")


def read(files: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of the files (doc, size, text_crc32, shard, slot, grown_shard). Size and checksum are
    those of the text in the file, and must be the ones that were written."""
    text = F.coalesce("doc.text", F.lit(""))
    size, crc = (F.octet_length(text) + OVERHEAD).cast("long"), F.crc32(text)
    same = (F.col("size") == size) & (F.col("text_crc32") == crc)
    checked = F.when(same, crc).otherwise(F.raise_error(F.lit("a text differs from its checksum")).cast("long"))
    return files.join(parts, ["shard", "part"]).select(
        "doc", "size", checked.alias("text_crc32"), "shard", (F.col("first") + F.col("at") - F.col("low")).alias("slot"), "grown_shard")


def sharded(docs: DataFrame, weights: Sequence[float], grown_weight: float = 1.0) -> DataFrame:
    """Write the shards of ``docs`` and read them back."""
    return read(*write(docs, weights, grown_weight))
