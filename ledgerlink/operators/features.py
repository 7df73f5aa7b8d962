"""Training rows for a match model, each from what was known before it.

Facts of invoices count if their date is before the invoice's; facts of results if their day is
before the result's. Running figures go over one row per (vendor, day), never over a vendor's rows.
The amount's percentile refers to the tenant's invoices of the month before: counts below it are
those of lower amount buckets plus those of its own bucket, so no window spans a month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerlink.functions.numeric import round_half_up

c = F.col
BUCKET_WIDTH = 1000


def vendor_history(invoices: DataFrame) -> DataFrame:
    """Per (vendor_id, invoice_date): the vendor's invoices of earlier days: number, mean amount
    and days since the last one."""
    daily = invoices.groupBy("vendor_id", "invoice_date").agg(F.count("*").alias("n"), F.sum("total_amount").alias("s"))
    before = W.partitionBy("vendor_id").orderBy("invoice_date").rowsBetween(W.unboundedPreceding, -1)
    frequency, total = F.coalesce(F.sum("n").over(before), F.lit(0)), F.sum("s").over(before)
    return daily.select(
        "vendor_id", "invoice_date", frequency.alias("vendor_frequency"), round_half_up(F.try_divide(total.cast("double"), frequency.cast("double")), 4).alias("average_amount"),
        F.date_diff("invoice_date", F.max("invoice_date").over(before)).alias("days_since_last"))


def result_history(results: DataFrame) -> DataFrame:
    """Per (vendor_id, day) of ``results`` (vendor_id, day, approval_status, processing_time_ms): the
    vendor's results of earlier days: share approved at once and mean processing time."""
    approved = F.count_if(c("approval_status") == "auto_approved")
    daily = results.groupBy("vendor_id", "day").agg(
        F.count("*").alias("n"), approved.alias("a"), F.sum("processing_time_ms").alias("t"), F.count("processing_time_ms").alias("k"))
    before = W.partitionBy("vendor_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    sums = {x: F.sum(x).over(before).cast("double") for x in "natk"}
    return daily.select("vendor_id", "day", round_half_up(F.try_divide(sums["a"], sums["n"]), 6).alias("approval_rate_history"),
                        round_half_up(F.try_divide(sums["t"], sums["k"]), 4).alias("processing_time_avg"))


def amount_percentile(invoices: DataFrame) -> DataFrame:
    """Per (tenant_id, month, total_amount) of the invoices: share of the tenant's invoices of the
    month before with a lower amount; null without any."""
    month = F.year("invoice_date") * 12 + F.month("invoice_date")
    own = invoices.select("tenant_id", month.alias("month"), "total_amount", F.lit(0).alias("n"))
    facts = invoices.select("tenant_id", (month + 1).alias("month"), "total_amount", F.lit(1).alias("n"))
    cells = own.unionByName(facts).groupBy("tenant_id", "month", "total_amount").agg(F.sum("n").alias("n"), F.count_if(c("n") == 0).alias("asked"))
    cells = cells.withColumn("bucket", F.floor(c("total_amount") / BUCKET_WIDTH).cast("long"))
    inside = W.partitionBy("tenant_id", "month", "bucket").orderBy("total_amount").rowsBetween(W.unboundedPreceding, -1)
    buckets = cells.groupBy("tenant_id", "month", "bucket").agg(F.sum("n").alias("n"))
    lower = W.partitionBy("tenant_id", "month").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = buckets.select("tenant_id", "month", "bucket", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("base"), F.sum("n").over(W.partitionBy("tenant_id", "month")).alias("all"))
    ranked = cells.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).filter("asked > 0").join(sums, ["tenant_id", "month", "bucket"])
    share = F.try_divide((c("base") + c("within")).cast("double"), c("all").cast("double"))
    return ranked.select("tenant_id", "month", "total_amount", round_half_up(share, 6).alias("amount_percentile"))


def number_pattern(number: Column) -> Column:
    """Shape of a document number: letters as A, digits as 9, runs as one."""
    shaped = F.regexp_replace(F.regexp_replace(number, "[A-Za-z]+", "A"), "[0-9]+", "9")
    return F.coalesce(shaped, F.lit(""))


def split_of(vendor: Column) -> Column:
    """train, valid or test by the vendor's hash, 8 : 1 : 1, so no vendor is in two of them."""
    tenth = F.conv(F.substring(F.md5(vendor.cast("string")), 1, 8), 16, 10).cast("long") % 10
    return F.when(tenth < 8, "train").when(tenth == 8, "valid").otherwise("test")


def training_rows(results: DataFrame, invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """A row per match result of a known invoice: features, ``target`` and ``confidence_target``."""
    day = c("created_at").cast("date")
    head = invoices.select("tenant_id", "invoice_id", "vendor_id", "invoice_number", "invoice_date", "total_amount")
    known = results.select("match_result_id", "invoice_id", "match_status", "approval_status", "processing_time_ms", "overall_confidence", day.alias("day")).join(head, "invoice_id")
    items = lines.groupBy("invoice_id").agg(F.count("*").alias("line_items"))
    rows = (known.withColumn("month", F.year("invoice_date") * 12 + F.month("invoice_date"))
            .join(vendor_history(invoices), ["vendor_id", "invoice_date"]).join(result_history(known), ["vendor_id", "day"])
            .join(amount_percentile(invoices), ["tenant_id", "month", "total_amount"], "left").join(items, "invoice_id", "left"))
    return rows.select(
        "match_result_id", "invoice_id", "tenant_id", "vendor_id", split_of(c("vendor_id")).alias("split"), "total_amount", "amount_percentile",
        F.weekday("invoice_date").alias("day_of_week"), F.month("invoice_date").alias("month_of_year"), (F.last_day("invoice_date") == c("invoice_date")).alias("is_month_end"),
        "vendor_frequency", "average_amount", "days_since_last", "approval_rate_history", "processing_time_avg", number_pattern(c("invoice_number")).alias("number_pattern"),
        F.coalesce("line_items", F.lit(0)).alias("line_items"), (c("match_status") == "matched").cast("int").alias("target"), c("overall_confidence").alias("confidence_target"))
