"""Follow-up reports over the derived tables."""

from pyspark.sql import functions as F

from ledgerlink.functions.numeric import round_half_up
from ledgerlink.operators import analytics
from ledgerlink.plans.oracle_ctes import sql_percent, sql_round
from ledgerlink.plans.registry import stored_query as query
from ledgerlink.plans.security_queries import _PERM, _permissions
from ledgerlink.sources.entities import event_as_of

c = F.col
_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


@query("x04_daily_per_tenant", "tenant_id int, day date, results bigint, matched bigint, avg_confidence double",
       f"SELECT tenant_id, CAST(created_at AS DATE) AS day, count(*) AS results, count(*) FILTER (WHERE match_status = 'matched') AS matched, {sql_round('CAST(sum(overall_confidence) AS DOUBLE) / count(*)', 4)} AS avg_confidence FROM match_results GROUP BY ALL")
def _(e):
    return e.match_results.groupBy("tenant_id", c("created_at").cast("date").alias("day")).agg(
        F.count("*").alias("results"), F.count_if(c("match_status") == "matched").alias("matched"),
        round_half_up(F.sum("overall_confidence").cast("double") / F.count("*"), 4).alias("avg_confidence"))


@query("x05_nearest_order", "invoice_id bigint, po_id bigint",
       """SELECT invoice_id, po_id FROM (SELECT i.invoice_id, p.po_id, row_number() OVER (PARTITION BY i.invoice_id ORDER BY abs(p.total_amount - i.total_amount), p.po_id) AS n FROM invoices i
          JOIN purchase_orders p ON p.tenant_id = i.tenant_id AND p.vendor_id = i.vendor_id AND abs(p.total_amount - i.total_amount) <= 10) WHERE n = 1""")
def _(e):
    return analytics.nearest_order(e.invoices, e.purchase_orders)


@query("x07_exception_aging", "exception_type string, age_band string, total bigint, resolved bigint",
       f"""SELECT exception_type, CASE WHEN h < 24 THEN 'under 1 day' WHEN h < 72 THEN '1-3 days' WHEN h < 168 THEN '3-7 days' ELSE 'over 7 days' END AS age_band, count(*) AS total, count(*) FILTER (WHERE status = 'resolved') AS resolved
           FROM (SELECT *, date_sub('second', created_at, coalesce(resolved_at, {_NOW})) // 3600 AS h FROM match_exceptions) GROUP BY ALL""")
def _(e):
    return analytics.exception_aging(e.match_exceptions, event_as_of())


@query("x08_resolution_times", "exception_type string, resolved bigint, mean_hours double, median_hours double, p90_hours double",
       f"""SELECT exception_type, count(*) AS resolved, {sql_round('avg(h)', 4)} AS mean_hours, {sql_round('quantile_cont(h, 0.5)', 4)} AS median_hours, {sql_round('quantile_cont(h, 0.9)', 4)} AS p90_hours
           FROM (SELECT *, date_sub('second', created_at, resolved_at) / 3600.0e0 AS h FROM match_exceptions WHERE resolved_at IS NOT NULL) GROUP BY exception_type""")
def _(e):
    return analytics.resolution_times(e.match_exceptions)


@query("x09_vendor_scorecards", "tenant_id int, vendor_id bigint, name string, invoices bigint, spend decimal(18,2), spend_rank int, matched_share double",
       f"""SELECT s.*, v.name, rank() OVER (PARTITION BY s.tenant_id ORDER BY spend DESC) AS spend_rank FROM (SELECT tenant_id, vendor_id, count(*) AS invoices, sum(total_amount) AS spend,
           {sql_percent("count(*) FILTER (WHERE matching_status = 'matched')", 'count(*)')} AS matched_share FROM invoices GROUP BY ALL) AS s JOIN vendors v ON v.vendor_id = s.vendor_id""")
def _(e):
    return analytics.vendor_scorecards(e.invoices, e.vendors)


@query("x11_audit_gaps", "invoice_id bigint, total_amount decimal(15,2)", "SELECT invoice_id, total_amount FROM invoices WHERE invoice_id NOT IN (SELECT invoice_id FROM match_results)")
def _(e):
    return e.invoices.join(e.match_results.select("invoice_id"), "invoice_id", "left_anti")


_CONFLICTS = "SELECT * FROM (VALUES ('create-and-manage', 'vendor:create'), ('create-and-manage', 'vendor:manage'), ('enter-and-report', 'invoice:create'), ('enter-and-report', 'report:view'), ('all-and-users', 'invoice:*'), ('all-and-users', 'user:manage')) AS fixed(rule, permission)"


@query("x12_duty_conflicts", "user_id bigint, rule string",
       f"SELECT user_id, k.rule FROM (SELECT DISTINCT user_id, permission FROM ({_PERM})) AS p JOIN ({_CONFLICTS}) AS k ON k.permission = p.permission GROUP BY 1, 2 HAVING count(*) = 2")
def _(e):
    return analytics.duty_conflicts(_permissions(e), e.spark.sql(_CONFLICTS))


@query("x19_cost_shares", "tenant_id int, share double, cost double",
       f"SELECT tenant_id, {sql_round('used / sum(used) OVER ()', 6)} AS share, {sql_round('used / sum(used) OVER () * 1000.0e0', 2)} AS cost FROM (SELECT tenant_id, CAST(sum(processing_time_ms) AS DOUBLE) AS used FROM match_results GROUP BY tenant_id)")
def _(e):
    return analytics.usage_shares(e.match_results, ["tenant_id"], "processing_time_ms", 1000.0)
