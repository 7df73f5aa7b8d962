"""Control tests: which required controls lack an effective test in which quarter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.operators.match import latest

c = F.col
# The controls that need a test each quarter, and the days after its end that a test may take.
REQUIRED = ("IT-01-01", "IT-01-02", "IT-02-01", "IT-02-02", "IT-03-01", "IT-04-01", "IT-05-01")
GRACE_DAYS = 45


def coverage(tests: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Every quarter between the first and last tested one and every required control: the last
    test's result, and a status of ``effective``, ``failed``, ``late`` (effective, but tested after
    the deadline) or ``missing``. ``tests`` is (test_id, tenant_id, control_id, quarter, tested_at,
    result); the calendar is one row per tenant and quarter."""
    spans = tests.groupBy("tenant_id").agg(F.min("quarter").alias("low"), F.max("quarter").alias("high"))
    calendar = spans.select("tenant_id", F.explode(F.sequence("low", "high", F.expr("interval 3 months"))).alias("quarter"))
    wanted = calendar.withColumn("control_id", F.explode(F.array(*map(F.lit, required))))
    last = latest(tests.filter(c("control_id").isin(*required)), ["tenant_id", "control_id", "quarter"], [c("tested_at"), c("test_id")])
    deadline = F.date_add(F.add_months("quarter", 3), GRACE_DAYS - 1)
    status = (F.when(c("result").isNull(), "missing").when(c("result") != "EFFECTIVE", "failed").when(c("tested_at") > deadline, "late").otherwise("effective"))
    return wanted.join(last, ["tenant_id", "control_id", "quarter"], "left").select(
        "tenant_id", "quarter", "control_id", "test_id", "result", "tested_at", deadline.alias("deadline"), status.alias("status"))


def coverage_report(covered: DataFrame) -> DataFrame:
    """Per tenant and quarter: numbers by status and whether all required controls are effective."""
    of = lambda s: F.count_if(c("status") == s).alias(s)
    sums = covered.groupBy("tenant_id", "quarter").agg(F.count("*").alias("total_controls"), of("effective"), of("failed"), of("late"), of("missing"))
    whole = c("failed") + c("missing") == 0
    return sums.withColumn("compliant", whole).withColumn("severity", F.when(whole, "low").otherwise("high"))
