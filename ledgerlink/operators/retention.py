"""Retention, pseudonyms and anonymisation of aged data.

A table is kept by day: expired days are dropped as folders and only the day that the limit falls
into is rewritten, so the cost does not grow with what is kept. A pseudonym is a salted digest: equal
subjects get equal tokens, so joins and counts by subject hold, and without the salt a token cannot
be recomputed. Anonymising empties a column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlink.operators import lake
from ledgerlink.session import scratch_path

c = F.col
DAY = "_day"


def write_by_day(df: DataFrame, at: str, path: str) -> None:
    """Write ``df`` with a folder per day of ``at``; rows without a time are kept under null."""
    days = df.withColumn(DAY, c(at).cast("date")).hint("rebalance", DAY)
    days.write.mode("overwrite").partitionBy(DAY).parquet(path)


def read_by_day(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(DAY)


def expire(spark: SparkSession, path: str, at: str, limit: Column) -> int:
    """Drop all rows of a table by day that are older than ``limit``; returns the number of folders
    dropped whole. Running it again changes nothing."""
    stored = spark.read.parquet(path)
    edge = limit.cast("date")
    old = stored.select(DAY).distinct().filter(c(DAY) < edge).collect()  # one row per day
    dropped = lake.drop_partitions(spark, path, [{DAY: r[DAY]} for r in old])
    if old:
        stored = spark.read.parquet(path)
    boundary = stored.filter((c(DAY) == edge))
    if boundary.filter(c(at) < limit).head(1):
        kept = scratch_path(spark, "retained-day")
        boundary.filter(c(at) >= limit).write.parquet(kept)
        rewritten = spark.read.schema(boundary.schema).parquet(kept)
        if rewritten.head(1):
            rewritten.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
        else:
            lake.drop_partitions(spark, path, [{DAY: spark.range(1).select(edge.alias(DAY)).first()[DAY]}])
    return dropped


def expired_counts(spark: SparkSession, tables: Sequence[tuple[str, DataFrame, str]], limit: Column) -> DataFrame:
    """(source, kept, removed) per (source, rows, time column): the rows are kept by day, what is
    older than ``limit`` is dropped, and both are counted in the stored table."""
    out = None
    for label, rows, at in tables:
        path = scratch_path(spark, label)
        write_by_day(rows, at, path)
        before = spark.read.parquet(path).count()
        expire(spark, path, at, limit)
        part = read_by_day(spark, path).agg(F.count("*").alias("kept")).select(F.lit(label).alias("source"), "kept", (F.lit(before) - c("kept")).alias("removed"))
        out = part if out is None else out.unionByName(part)
    return out


def pseudonym(subject: Column, salt: str) -> Column:
    """Token of a subject; null stays null."""
    return F.when(subject.isNotNull(), F.sha2(F.concat(F.lit(f"{salt}:"), subject.cast("string")), 256))


def minimised(df: DataFrame, at: str, as_of: Column, policies: Sequence[tuple[str, str, int]], salt: str) -> DataFrame:
    """Apply (column, action, days) to rows older than so many days: ``pseudonymise`` puts a token
    in place of the value, ``anonymise`` null."""
    out = df
    for column, action, days in policies:
        aged = c(at) < as_of - F.make_dt_interval(F.lit(days))
        new = {"pseudonymise": pseudonym(c(column), salt), "anonymise": F.lit(None)}[action]
        out = out.withColumn(column, F.when(aged, new).otherwise(c(column)))
    return out


def overdue(requests: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Open requests received more than ``days`` days ago, with their age in days."""
    age = F.date_diff(as_of.cast("date"), c("received_at").cast("date"))
    return requests.filter(c("completed_at").isNull()).withColumn("age_days", age).filter(c("age_days") > days)


def erasure_status(late: DataFrame, tenants: DataFrame) -> DataFrame:
    """Per tenant: number of overdue requests, the oldest one's age, and whether none is overdue."""
    found = late.groupBy("tenant_id").agg(F.count("*").alias("overdue_requests"), F.max("age_days").alias("oldest_age"))
    joined = tenants.select("tenant_id").join(found, "tenant_id", "left").fillna(0, ["overdue_requests", "oldest_age"])
    none = c("overdue_requests") == 0
    return joined.select("tenant_id", "overdue_requests", "oldest_age", none.alias("compliant"), F.when(none, "low").otherwise("high").alias("severity"))
