"""Updates expressed as joins: allowed-column changes, resolutions, feedback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlink.operators.match import latest

c = F.col


def apply_changes(base: DataFrame, changes: DataFrame, key: str, allowed: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Full outer join on ``key``; the last change per key wins, null means untouched.

    Only ``allowed`` columns are taken from the changes. Keys unknown to the base become
    new rows holding the allowed columns.
    """
    last = latest(changes.select(key, *order, *allowed), [key], [c(o) for o in order])
    new = last.select(key, *[c(a).alias(f"_{a}") for a in allowed])
    joined = base.join(new, key, "full_outer")
    return joined.select(*[F.coalesce(f"_{x}", x).alias(x) if x in allowed else c(x) for x in base.columns])


def apply_resolutions(exceptions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Set status, resolution and time from the latest decision of each exception."""
    last = latest(decisions, ["exception_id"], [c("decided_at")])
    joined = exceptions.join(last, "exception_id", "left")
    hit = c("resolution").isNotNull()
    return joined.withColumn("status", F.when(hit, "resolved").otherwise(c("status"))).withColumn(
        "resolved_at", F.when(hit, c("decided_at")).otherwise(c("resolved_at")))


def apply_feedback(results: DataFrame, feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updated results, audit rows): approve and reject change the state, all are audited."""
    joined = results.join(feedback, "match_result_id", "left")
    kind = c("feedback_type")
    updated = joined.withColumn("approval_status", F.when(kind == "approve", "approved").when(kind == "reject", "rejected")
                                .otherwise(c("approval_status"))).withColumn("review_notes", F.when(kind == "reject", c("notes")))
    audit = feedback.select("match_result_id", F.concat(F.lit("User feedback received: "), kind).alias("event_description"))
    return updated, audit


def best_rule(documents: DataFrame, rules: DataFrame, at: Column) -> DataFrame:
    """(invoice_id, field_name, name): applicable rule with the lowest priority number.

    A vendor's rules are met by (tenant, vendor), the others by tenant.
    """
    named = rules.withColumnRenamed("vendor_id", "rule_vendor").withColumnRenamed("tenant_id", "rule_tenant")
    ours = c("tenant_id") == c("rule_tenant")
    own = documents.join(named.filter("rule_vendor is not null"), ours & (c("vendor_id") == c("rule_vendor")))
    general = documents.join(named.filter("rule_vendor is null"), ours)
    fits = (c("min_amount").isNull() | (at >= c("min_amount"))) & (c("max_amount").isNull() | (at <= c("max_amount")))
    return own.unionByName(general).filter(fits).groupBy("invoice_id", "field_name").agg(
        F.min(F.struct("priority", "name")).getField("name").alias("rule_name"))
