"""Keyed streams: the same answers whatever the micro-batches, and after a restart."""

import pytest
from pyspark.sql import functions as F

from ledgerlink.session import scratch_path
from ledgerlink.sources import arrivals
from ledgerlink.streaming import anomalies, jobs, limits
from ledgerlink.streaming.ordered import keyed_state

c = F.col
DELAY = "2 hours"


def attempts(events):
    user = c("user_id")
    return events.select(c("event_id").alias("attempt_id"), "user_id", F.concat(F.lit("10."), user).alias("ip_address"), c("ts").alias("attempted_at"), (c("event_type") != "error").alias("success"))


STREAMS = {
    "rate": lambda e: limits.rate_limit_stream(e.select("event_id", "user_id", "ts"), 3, 43200, DELAY),
    "failures": lambda e: limits.failure_counter_stream(attempts(e), 43200, DELAY),
    "lockouts": lambda e: limits.lockout_stream(attempts(e), DELAY),
    "sessions": lambda e: limits.session_stream(e.select("event_id", "user_id", "ts"), 8 * 3600, DELAY),
    "anomalies": lambda e: anomalies.event_anomalies_stream(e.select("event_id", "event_type", "ts", "value"), DELAY),
}


@pytest.mark.parametrize("name", sorted(STREAMS))
def test_answers_do_not_depend_on_batches(spark, sf_dir, name):
    """All parts at one file a time, at all files at a time, and with a stop after the first part."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "ts", "value").filter(~arrivals.late())
    answers = []
    for runs, per_batch in (((range(3),), 2), ((range(3),), 40), ((range(1), range(1, 3)), 3)):
        folder, out = scratch_path(spark, "arrivals"), scratch_path(spark, "answers")
        for parts in runs:
            arrivals.write_parts(events, folder, 3, parts)
            with keyed_state(spark):
                stream = STREAMS[name](jobs.file_stream(spark, folder, "*.parquet", per_batch))
                stream.writeStream.outputMode("append").option("checkpointLocation", out + "-state").format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()
        answers.append(sorted((tuple(r) for r in spark.read.schema(stream.schema).parquet(out).collect()), key=repr))
    assert answers[0] == answers[1] == answers[2] and len(answers[0]) > 50


def test_login_alerts_count_late_attempts(spark):
    """An attempt nineteen days behind the ones before it corrects its day."""
    folder = scratch_path(spark, "late")
    for day in ("2024-01-20", "2024-01-20", "2024-01-20", "2024-01-01"):
        row = spark.sql(f"SELECT TIMESTAMP_NTZ '{day} 10:00:00' AS attempted_at, false AS success, 'rate_limited' AS failure_reason").repartition(1)
        row.write.mode("append").parquet(folder)
    updates = jobs.run_batches(jobs.login_alert_metrics(jobs.file_stream(spark, folder, "*.parquet")), "late-alerts", lambda b: b)
    got = jobs.newest(updates, ["span_start"]).select(F.date_format("span_start", "yyyy-MM-dd"), "auth_failed_login_rate", "auth_suspicious_logins")
    assert sorted(tuple(r) for r in got.collect()) == [("2024-01-01", 1.0, 1.0), ("2024-01-20", 3.0, 3.0)]
