"""Events as they arrive: files in parts, rows out of order, and rows behind any watermark."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlink.session import scratch_path
from ledgerlink.streaming.jobs import file_stream

c = F.col
PARTS = 4
FILES = 16
LATE_SQL = "(event_id % 211 = 3 AND ts < TIMESTAMP '2024-01-19 00:00:00')"
#: Watermark after all parts, in microseconds, for a delay given in minutes.
WATERMARK_SQL = f"((SELECT epoch_ms(max(ts)) FROM events WHERE NOT {LATE_SQL}) - {{0}} * 60000) * 1000"


def late() -> Column:
    """Rows that arrive in the last part, more than ten days behind the part before."""
    return (c("event_id") % 211 == 3) & (c("ts") < F.lit("2024-01-19 00:00:00").cast("timestamp_ntz"))


def part() -> Column:
    """Ten days of arrival each; a row arrives up to 80 minutes after its time."""
    minutes = F.unix_micros(c("ts").cast("timestamp")) / 60000000 - 28401120 + c("event_id") % 5 * 20  # since 2024
    return F.when(late(), PARTS - 1).otherwise(F.least(F.floor(minutes / 14400), F.lit(PARTS - 2)))


def write_parts(events: DataFrame, folder: str, files: int, parts: Iterable[int] = range(PARTS)) -> None:
    """Write the parts one after the other, ``files`` files each."""
    held = events.withColumn("_part", part())
    for number in parts:
        held.filter(c("_part") == number).drop("_part").repartition(files).write.mode("append").parquet(folder)


def event_stream(events: DataFrame, columns: list[str]) -> DataFrame:
    """A stream over the parts, a part per micro-batch."""
    spark = events.sparkSession
    folder, files = scratch_path(spark, "arrivals"), min(FILES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    write_parts(events.select(*columns), folder, files)
    return file_stream(spark, folder, "*.parquet", files)
