"""Totals, dashboards and match reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.functions.numeric import percent, round_half_up

c = F.col


def totals_from_lines(heads: DataFrame, lines: DataFrame, key: str, tax: bool) -> DataFrame:
    """Subtotal, tax and total per document from its lines, zeros without lines."""
    zero = F.lit(0).cast("decimal(18,2)")
    sums = lines.groupBy(key).agg(F.sum("line_total").cast("decimal(18,2)").alias("subtotal"),
                                  (F.sum("tax_amount") if tax else F.sum(zero)).cast("decimal(18,2)").alias("tax_amount"))
    rows = heads.select(key).join(sums, key, "left").na.fill(0).select(
        key, F.coalesce("subtotal", zero).alias("subtotal"), F.coalesce("tax_amount", zero).alias("tax_amount"))
    return rows.withColumn("total_amount", (c("subtotal") + c("tax_amount")).cast("decimal(18,2)"))


def received_quantities(po_lines: DataFrame, receipt_lines: DataFrame) -> DataFrame:
    sums = receipt_lines.groupBy("po_line_id").agg(F.sum("quantity_received").alias("received"))
    return po_lines.select("po_line_id", "quantity").join(sums, "po_line_id", "left").select(
        "po_line_id", "quantity", F.coalesce(c("received"), F.lit(0)).cast("decimal(18,4)").alias("received"))


def matching_statistics(results: DataFrame) -> DataFrame:
    kind = c("match_kind")
    sums = results.agg(
        F.count("*").alias("total_matches"), F.count_if(kind == "exact").alias("exact_matches"), F.count_if(kind == "fuzzy").alias("fuzzy_matches"),
        F.count_if("auto_approved").alias("auto_approved"), F.count_if("requires_review").alias("manual_review"),
        F.count_if(c("approval_status") == "rejected").alias("rejected"),
        round_half_up(F.avg(c("overall_confidence").cast("double")), 4).alias("avg_confidence"))
    return sums


def dashboard_matching(results: DataFrame, exceptions: DataFrame) -> DataFrame:
    """First-pass and auto-approval share, mean confidence (null counts 0), open exceptions."""
    sums = results.agg(
        F.count("*").alias("n"), F.count_if(c("match_status") == "matched").alias("first"), F.count_if(c("approval_status") == "auto_approved").alias("auto"),
        F.sum(F.coalesce(c("overall_confidence"), F.lit(0))).cast("decimal(20,2)").alias("conf"))
    open_ = exceptions.agg(F.count_if(c("status") == "open").alias("exceptions_open"))
    return sums.join(F.broadcast(open_)).select(
        percent(c("first"), c("n")).alias("first_pass_rate"), percent(c("auto"), c("n")).alias("auto_approval_rate"),
        F.coalesce(round_half_up(F.try_divide(c("conf").cast("double"), c("n").cast("double")), 2), F.lit(0.0)).alias("avg_confidence"), "exceptions_open")


def report_summary(results: DataFrame, exceptions: DataFrame) -> DataFrame:
    hours = F.timestamp_diff("SECOND", c("created_at"), c("resolved_at")) / 3600.0
    ex = exceptions.join(results.select("match_result_id"), "match_result_id", "left_semi").agg(
        F.count("*").alias("total_exceptions"), F.coalesce(round_half_up(F.avg(hours), 2), F.lit(0.0)).alias("avg_resolution_hours"))
    conf = c("overall_confidence").cast("double")
    sums = results.agg(F.count("*").alias("total_results"), F.count_if(c("match_status") == "matched").alias("matched"),
                       F.sum(F.when(c("overall_confidence") != 0, c("overall_confidence"))).cast("decimal(20,2)").alias("s"), F.count_if(conf != 0).alias("k"))
    return sums.join(F.broadcast(ex)).select(
        "total_results", "matched", percent(c("matched"), c("total_results")).alias("match_rate"),
        F.coalesce(round_half_up(F.try_divide(c("s").cast("double"), c("k").cast("double")), 2), F.lit(0.0)).alias("avg_confidence"), "total_exceptions", "avg_resolution_hours")


def daily_metrics(spark, results: DataFrame, exceptions: DataFrame, start: str, end: str) -> DataFrame:
    """One row per calendar day, zero-filled; three daily aggregates joined to the calendar."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    inside = results.filter(c("created_at").cast("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    done = inside.groupBy(c("created_at").cast("date").alias("day")).agg(F.count("*").alias("processed"), F.count_if(c("match_status") == "matched").alias("matched"))
    ex = exceptions.join(inside.select("match_result_id"), "match_result_id", "left_semi")
    made = ex.groupBy(c("created_at").cast("date").alias("day")).agg(F.count("*").alias("exceptions_created"))
    solved = ex.filter(c("resolved_at").isNotNull()).groupBy(c("resolved_at").cast("date").alias("day")).agg(F.count("*").alias("exceptions_resolved"))
    rows = days.join(done, "day", "left").join(made, "day", "left").join(solved, "day", "left").na.fill(0)
    return rows.select("day", c("processed").alias("invoices_processed"), percent(c("matched"), c("processed")).alias("match_rate"), "exceptions_created", "exceptions_resolved")


def page_totals(df: DataFrame, keys: list[str], size: int, page: int) -> DataFrame:
    n = df.groupBy(*keys).agg(F.count("*").alias("total"))
    pages = F.ceil(c("total") / size).cast("bigint")
    return n.select(*keys, "total", pages.alias("total_pages"), (F.lit(page) < pages).alias("has_next"), F.lit(page > 1).alias("has_previous"))
