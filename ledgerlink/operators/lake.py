"""Partitioned tables: layouts, sized files, replacement of touched partitions, pruned reads.

Rows are dealt by partition values with the ``rebalance`` hint: adaptive execution merges small
partitions and cuts large ones at the advisory size, so a tenant with a third of all rows is many
files of the usual size and a quiet month is one. A write replaces the partitions it has rows for
and leaves the others (dynamic overwrite). Readers filter on partition columns; Spark then lists and
opens the matching folders only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


@dataclass(frozen=True)
class Layout:
    """Partition columns, the columns files are sorted by, and the codec of a table."""

    partitions: Sequence[str]
    sorted_by: Sequence[str]
    codec: str


LAYOUTS = {
    "invoices": Layout(("year", "month", "tenant_id"), ("vendor_id", "invoice_id"), "snappy"),
    "matches": Layout(("year", "month", "confidence_bucket"), ("tenant_id", "match_result_id"), "gzip"),
    "audit_events": Layout(("year", "month", "day", "tenant_id"), ("audit_id",), "lz4_raw"),
}


def with_calendar(df: DataFrame, at: Column) -> DataFrame:
    """Year, month and day of a time as partition columns."""
    return df.withColumns({"year": F.year(at), "month": F.month(at), "day": F.day(at)})


def confidence_bucket(confidence: Column) -> Column:
    """Lower end of the band of ten points; 100 is in the last."""
    return F.least(F.floor(confidence / 10) * 10, F.lit(90)).cast("int")


def write(df: DataFrame, name: str, folder: str) -> str:
    """Write ``df`` to the table ``name`` below ``folder``, replacing the partitions it touches."""
    layout = LAYOUTS[name]
    path = f"{folder}/{name}"
    dealt = df.hint("rebalance", *layout.partitions).sortWithinPartitions(*layout.partitions, *layout.sorted_by)
    (dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", layout.codec)
     .partitionBy(*layout.partitions).parquet(path))
    return path


def read(spark: SparkSession, name: str, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def partitions(table: DataFrame, name: str) -> DataFrame:
    """Distinct partition values; no file is opened for more than its row count."""
    return table.select(*LAYOUTS[name].partitions).distinct()


def drop_partitions(spark: SparkSession, path: str, values: Sequence[dict[str, object]]) -> int:
    """Remove the folders of partitions, each given by the values of all its columns."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for value in values:
        folder = hadoop.Path("/".join([path, *(f"{k}={v}" for k, v in value.items())]))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(values)
