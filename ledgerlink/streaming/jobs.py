"""Streaming jobs over file sources, run to completion with an available-now trigger.

Late-data policy: aggregates carry a one-hour watermark on event time; rows later than that
are dropped. Login alerts and progress have none: they keep a row per time span or batch of work
and correct it whenever a row arrives. Sinks write one folder per micro-batch id and replace it on a retry, so results
are the same after a restart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlink.session import scratch_path

c = F.col


def file_stream(spark: SparkSession, folder: str, pattern: str, per_trigger: int = 1) -> DataFrame:
    """A parquet folder as a stream; the schema is the files' own."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).parquet(folder))


def run_append(stream: DataFrame, label: str) -> DataFrame:
    """Write an append-mode stream to the shared folder and return the finished table."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    job = (stream.writeStream.outputMode("append").option("checkpointLocation", out + "-state").format("parquet")
           .option("path", out).trigger(availableNow=True).start())
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, label: str, each: Callable[[DataFrame], DataFrame], mode: str = "update") -> DataFrame:
    """Apply ``each`` to every micro-batch and keep its result under the batch id."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    job = (stream.writeStream.outputMode(mode).option("checkpointLocation", out + "-state").foreachBatch(write).trigger(availableNow=True).start())
    job.awaitTermination()
    return spark.read.option("basePath", out).parquet(out)


def newest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last update per key out of a table of per-batch updates."""
    rest = [x for x in updates.columns if x not in (*keys, "batch_id")]
    top = F.max_by(F.struct(*rest), "batch_id").alias("_row")
    return updates.groupBy(*keys).agg(top).select(*keys, "_row.*")


def hourly_metrics(events: DataFrame) -> DataFrame:
    """Count and sum per metric and hour, one-hour watermark."""
    timed = events.select(c("ts").cast("timestamp").alias("at"), c("event_type").alias("metric"), c("value").cast("decimal(18,2)").alias("value"))
    return (timed.withWatermark("at", "1 hour").groupBy(F.window("at", "1 hour").alias("w"), "metric")
            .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
            .select(c("w.start").alias("hour"), "metric", "n", c("total").cast("decimal(18,2)").alias("total")))


def login_alert_metrics(attempts: DataFrame, span: str = "24 hours") -> DataFrame:
    """Failed and suspicious logins per time span, however late they arrive; the state is a row per span."""
    timed = attempts.withColumn("at", c("attempted_at").cast("timestamp"))
    return (timed.groupBy(F.window("at", span).alias("w"))
            .agg(F.count_if(~c("success")).cast("double").alias("auth_failed_login_rate"),
                 F.count_if(c("failure_reason").isin("rate_limited", "suspicious_activity")).cast("double").alias("auth_suspicious_logins"))
            .select(c("w.start").alias("span_start"), "auth_failed_login_rate", "auth_suspicious_logins"))


def latest_progress(events: DataFrame) -> DataFrame:
    """Newest stage and number of steps per batch of work."""
    return events.groupBy("batch_key").agg(F.max_by(F.struct("stage", "event_id"), F.struct("ts", "event_id")).alias("x"), F.count("*").alias("steps")).select(
        "batch_key", c("x.stage").alias("stage"), c("x.event_id").alias("event_id"), "steps")


def session_spans(events: DataFrame, gap: str = "8 hours") -> DataFrame:
    """Activity per user until a quiet gap: start, expiry and number of events."""
    timed = events.select("user_id", c("ts").cast("timestamp").alias("at"))
    return (timed.withWatermark("at", "1 hour").groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("events"))
            .select("user_id", c("w.start").alias("started_at"), c("w.end").alias("expires_at"), "events"))
