"""Reading the driver tables and keeping intermediate tables in the shared folder."""

from __future__ import annotations

import urllib.parse
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlink.session import scratch_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a driver table; other columns are never read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def boxed(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``docs`` and, as ``_doc``, the whole row, so that no other column of it can
    clash with names used on the way."""
    return docs.select(F.struct("*").alias("_doc"), *columns)


def unboxed(df: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs`` with ``text`` in place of its text, and its length as ``n_chars`` if
    there is such a column."""
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(dict(docs.dtypes)["n_chars"])
    return df.select([new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])


def lowest_hashes(df: DataFrame, limit: int, seed: str, *keys: str) -> DataFrame:
    """A bounded sample: the ``limit`` rows with the lowest hash of ``keys``, ties by the keys.

    Rows whose hash is far above what ``limit`` of them need go first, so the one task that merges
    the partitions' rows gets a few times ``limit`` rows, not as many per partition.
    """
    draw = F.xxhash64(F.lit(seed), *keys)
    share = min(1.0, 4 * limit / max(1, df.count()))
    low = F.pmod(draw, F.lit(1 << 30))
    return df.where(low < int(share * (1 << 30))).orderBy(low, draw, *keys).limit(limit)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within the block, shuffle files go as soon as the statement that made them ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the table: lineage is cut there, its
    shuffle files are freed, and the loss of an executor costs at most one step. ``by`` names a
    string column whose values get folders of their own."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with shuffles_dropped(spark):
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def part_of(staged: DataFrame, by: str, value: str) -> DataFrame:
    """The rows of one folder of a table staged with ``by``."""
    return staged.where(staged[by] == value).drop(by)


def drop_part(staged: DataFrame, by: str, value: str) -> None:
    """Remove one folder of a staged table that no later step reads."""
    spark = staged.sparkSession
    for file in staged.inputFiles():
        if f"/{by}={value}/" in file:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            return


def discard(*staged: DataFrame) -> None:
    """Remove staged tables that no later step reads."""
    for df in staged:
        if files := df.inputFiles():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path for a shared folder given as a URI or an absolute path."""
    if urllib.parse.urlparse(folder).scheme:
        return pa.fs.FileSystem.from_uri(folder)
    return pa.fs.LocalFileSystem(), folder
