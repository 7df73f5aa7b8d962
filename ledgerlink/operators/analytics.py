"""Follow-up reports from the design notes: aging, scorecards, audit chain, duties, cost shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerlink.functions.numeric import percent, round_half_up

c = F.col


def exception_aging(exceptions: DataFrame, as_of: Column) -> DataFrame:
    """Open and closed exceptions by type and age band."""
    hours = F.timestamp_diff("HOUR", c("created_at"), F.coalesce(c("resolved_at"), as_of))
    band = F.when(hours < 24, "under 1 day").when(hours < 72, "1-3 days").when(hours < 168, "3-7 days").otherwise("over 7 days")
    return exceptions.groupBy("exception_type", band.alias("age_band")).agg(
        F.count("*").alias("total"), F.count_if(c("status") == "resolved").alias("resolved"))


def resolution_times(exceptions: DataFrame) -> DataFrame:
    """Mean, median and 90th percentile of resolution hours per type."""
    hours = (F.timestamp_diff("SECOND", c("created_at"), c("resolved_at")) / 3600.0)
    rows = exceptions.filter(c("resolved_at").isNotNull()).withColumn("h", hours)
    return rows.groupBy("exception_type").agg(
        F.count("*").alias("resolved"), round_half_up(F.avg("h"), 4).alias("mean_hours"), round_half_up(F.percentile("h", 0.5), 4).alias("median_hours"),
        round_half_up(F.percentile("h", 0.9), 4).alias("p90_hours"))


def vendor_scorecards(invoices: DataFrame, vendors: DataFrame) -> DataFrame:
    """Spend, invoice count, matched share and spend rank per vendor within its tenant.

    The rank is taken over one row per vendor, after aggregation.
    """
    per = invoices.groupBy("tenant_id", "vendor_id").agg(
        F.count("*").alias("invoices"), F.sum("total_amount").cast("decimal(18,2)").alias("spend"), F.count_if(c("matching_status") == "matched").alias("matched"))
    ranked = per.withColumn("spend_rank", F.rank().over(W.partitionBy("tenant_id").orderBy(F.desc("spend"))))
    return ranked.join(vendors.select("vendor_id", "name"), "vendor_id").withColumn("matched_share", percent(c("matched"), c("invoices")))


def duty_conflicts(permissions: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(user_id, rule): users holding every permission of a conflicting set."""
    need = conflicts.groupBy("rule").agg(F.count("*").alias("needed"))
    held = permissions.select("user_id", "permission").distinct().join(F.broadcast(conflicts), "permission").groupBy("user_id", "rule").agg(F.count("*").alias("held"))
    return held.join(F.broadcast(need), "rule").filter("held = needed").select("user_id", "rule")


def usage_shares(usage: DataFrame, keys: list[str], amount: str, cost: float) -> DataFrame:
    """Each key's share of the total usage and of a cost."""
    per = usage.groupBy(*keys).agg(F.sum(amount).cast("double").alias("used"))
    total = per.agg(F.sum("used").alias("total"))
    return per.join(F.broadcast(total)).select(*keys, round_half_up(c("used") / c("total"), 6).alias("share"), round_half_up(c("used") / c("total") * cost, 2).alias("cost"))


def nearest_order(invoices: DataFrame, orders: DataFrame, within: str = "10.00") -> DataFrame:
    """(invoice_id, po_id): closest total within a fixed distance, same tenant and vendor.

    Totals fall into buckets as wide as the distance, so candidates share or neighbour a bucket.
    """
    width = F.lit(within).cast("decimal(15,2)")
    bucket = lambda x: F.floor(x / width)
    left = invoices.select("tenant_id", "vendor_id", "invoice_id", "total_amount", F.explode(F.array(*[bucket(c("total_amount")) + i for i in (-1, 0, 1)])).alias("b"))
    right = orders.groupBy("tenant_id", "vendor_id", c("total_amount").alias("po_total")).agg(F.min("po_id").alias("po_id")).withColumn("b", bucket(c("po_total")))
    met = left.join(right, ["tenant_id", "vendor_id", "b"]).withColumn("gap", F.abs(c("total_amount") - c("po_total"))).filter(c("gap") <= width)
    return met.groupBy("invoice_id").agg(F.min(F.struct("gap", "po_id")).getField("po_id").alias("po_id"))
