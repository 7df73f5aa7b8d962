"""Totals, dashboards and match reports."""

from pyspark.sql import functions as F

from ledgerlink.functions.numeric import round_half_up
from ledgerlink.operators import report, retention, vendors
from ledgerlink.plans.match_queries import _REVIEW
from ledgerlink.plans.oracle_ctes import sql_percent, sql_round
from ledgerlink.plans.registry import stored_query as query
from ledgerlink.sources.entities import doc_as_of, event_as_of

c = F.col
_TOT = "subtotal decimal(18,2), tax_amount decimal(18,2), total_amount decimal(18,2)"
_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


@query("a01_invoice_totals", f"invoice_id bigint, {_TOT}",
       """SELECT i.invoice_id, coalesce(s, 0) AS subtotal, coalesce(t, 0) AS tax_amount, coalesce(s, 0) + coalesce(t, 0) AS total_amount FROM invoices i
          LEFT JOIN (SELECT invoice_id, sum(line_total) AS s, sum(tax_amount) AS t FROM invoice_lines GROUP BY 1) AS l ON l.invoice_id = i.invoice_id""")
def _(e):
    return report.totals_from_lines(e.invoices, e.invoice_lines, "invoice_id", True)


@query("a02_order_totals", f"po_id bigint, {_TOT}",
       "SELECT p.po_id, coalesce(s, 0) AS subtotal, 0 AS tax_amount, coalesce(s, 0) AS total_amount FROM purchase_orders p LEFT JOIN (SELECT po_id, sum(line_total) AS s FROM po_lines GROUP BY 1) AS l ON l.po_id = p.po_id")
def _(e):
    return report.totals_from_lines(e.purchase_orders, e.po_lines, "po_id", False)


@query("a03_received_quantities", "po_line_id bigint, quantity decimal(18,4), received decimal(18,4)",
       "SELECT p.po_line_id, p.quantity, coalesce(r, 0) AS received FROM po_lines p LEFT JOIN (SELECT po_line_id, sum(quantity_received) AS r FROM receipt_lines GROUP BY 1) AS x ON x.po_line_id = p.po_line_id")
def _(e):
    return report.received_quantities(e.po_lines, e.receipt_lines)


@query("a09_matching_statistics", "total_matches bigint, exact_matches bigint, fuzzy_matches bigint, auto_approved bigint, manual_review bigint, rejected bigint, avg_confidence double",
       f"""SELECT count(*) AS total_matches, count(*) FILTER (WHERE match_kind = 'exact') AS exact_matches, count(*) FILTER (WHERE match_kind = 'fuzzy') AS fuzzy_matches,
           count(*) FILTER (WHERE auto_approved) AS auto_approved, count(*) FILTER (WHERE requires_review) AS manual_review, count(*) FILTER (WHERE approval_status = 'rejected') AS rejected,
           {sql_round('avg(CAST(overall_confidence AS DOUBLE))', 4)} AS avg_confidence FROM match_results WHERE created_at >= {_NOW} - INTERVAL 15 DAY""")
def _(e):
    return report.matching_statistics(e.match_results.filter(c("created_at") >= event_as_of() - F.expr("interval 15 days")))


@query("a10_match_rate", "tenant_id int, matches bigint, invoices bigint, match_rate double",
       f"SELECT tenant_id, count(*) AS matches, count(DISTINCT invoice_id) AS invoices, {sql_round('CAST(count(*) AS DOUBLE) / count(DISTINCT invoice_id)', 4)} AS match_rate FROM match_results GROUP BY tenant_id")
def _(e):
    return e.match_results.groupBy("tenant_id").agg(F.count("*").alias("matches"), F.countDistinct("invoice_id").alias("invoices")).withColumn(
        "match_rate", round_half_up(F.try_divide(c("matches").cast("double"), c("invoices").cast("double")), 4))


@query("a11_tenant_statistics", "tenant_id int, vendors bigint, invoices bigint, pending bigint, matched bigint, in_exception bigint, orders bigint, receipts bigint, open_exceptions bigint, in_review bigint",
       """SELECT t.tenant_id, (SELECT count(*) FROM vendors v WHERE v.tenant_id = t.tenant_id) AS vendors, (SELECT count(*) FROM invoices i WHERE i.tenant_id = t.tenant_id) AS invoices,
          (SELECT count(*) FROM invoices i WHERE i.tenant_id = t.tenant_id AND status = 'pending') AS pending, (SELECT count(*) FROM invoices i WHERE i.tenant_id = t.tenant_id AND matching_status = 'matched') AS matched,
          (SELECT count(*) FROM invoices i WHERE i.tenant_id = t.tenant_id AND matching_status = 'exception') AS in_exception, (SELECT count(*) FROM purchase_orders p WHERE p.tenant_id = t.tenant_id) AS orders,
          (SELECT count(*) FROM receipts r WHERE r.tenant_id = t.tenant_id) AS receipts, (SELECT count(*) FROM match_exceptions x WHERE x.tenant_id = t.tenant_id AND status = 'open') AS open_exceptions,
          (SELECT count(*) FROM match_exceptions x WHERE x.tenant_id = t.tenant_id AND status = 'in_review') AS in_review FROM tenants t""")
def _(e):
    v = e.vendors.groupBy("tenant_id").agg(F.count("*").alias("vendors"))
    i = e.invoices.groupBy("tenant_id").agg(F.count("*").alias("invoices"), F.count_if(c("status") == "pending").alias("pending"),
                                            F.count_if(c("matching_status") == "matched").alias("matched"), F.count_if(c("matching_status") == "exception").alias("in_exception"))
    p = e.purchase_orders.groupBy("tenant_id").agg(F.count("*").alias("orders"))
    r = e.receipts.groupBy("tenant_id").agg(F.count("*").alias("receipts"))
    x = e.match_exceptions.groupBy("tenant_id").agg(F.count_if(c("status") == "open").alias("open_exceptions"), F.count_if(c("status") == "in_review").alias("in_review"))
    out = e.tenants.select("tenant_id")
    for part in (v, i, p, r, x):
        out = out.join(part, "tenant_id", "left")
    return out.na.fill(0)


@query("a12_dashboard_invoices", "total bigint, pending bigint, matched bigint, exceptions bigint",
       "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE matching_status = 'matched') AS matched, count(*) FILTER (WHERE matching_status = 'exception') AS exceptions FROM invoices WHERE invoice_date BETWEEN DATE '2000-01-01' AND DATE '2001-12-31'")
def _(e):
    rows = e.invoices.filter(c("invoice_date").between(F.lit("2000-01-01").cast("date"), doc_as_of()))
    return rows.agg(F.count("*").alias("total"), F.count_if(c("status") == "pending").alias("pending"),
                    F.count_if(c("matching_status") == "matched").alias("matched"), F.count_if(c("matching_status") == "exception").alias("exceptions"))


@query("a13_dashboard_matching", "first_pass_rate double, auto_approval_rate double, avg_confidence double, exceptions_open bigint",
       f"""SELECT {sql_percent("count(*) FILTER (WHERE match_status = 'matched')", 'count(*)')} AS first_pass_rate, {sql_percent("count(*) FILTER (WHERE approval_status = 'auto_approved')", 'count(*)')} AS auto_approval_rate,
           {sql_round('CAST(sum(coalesce(overall_confidence, 0)) AS DOUBLE) / count(*)', 2)} AS avg_confidence, (SELECT count(*) FROM match_exceptions WHERE status = 'open') AS exceptions_open FROM match_results""")
def _(e):
    return report.dashboard_matching(e.match_results, e.match_exceptions)


@query("a14_dashboard_processing", "avg_seconds double, results_today bigint",
       f"SELECT {sql_round('CAST(sum(processing_time_ms) AS DOUBLE) / count(processing_time_ms) / 1000.0e0', 2)} AS avg_seconds, count(*) FILTER (WHERE CAST(created_at AS DATE) = DATE '2024-01-30') AS results_today FROM match_results")
def _(e):
    mean = F.try_divide(F.sum("processing_time_ms").cast("double"), F.count("processing_time_ms").cast("double")) / 1000.0
    return e.match_results.agg(round_half_up(mean, 2).alias("avg_seconds"), F.count_if(c("created_at").cast("date") == F.lit("2024-01-30").cast("date")).alias("results_today"))


@query("a15_vendor_statistics", "active bigint, pending_duplicates bigint, approved_duplicates bigint",
       f"""SELECT (SELECT count(*) FROM vendors WHERE is_active) AS active, count(*) FILTER (WHERE status = 'pending') AS pending_duplicates,
           count(*) FILTER (WHERE status = 'approved') AS approved_duplicates FROM ({_REVIEW})""")
def _(e):
    """Active vendors, and the review rows of duplicates by state."""
    rows = vendors.review_rows(vendors.duplicate_groups(e.vendors_dirty, e.spark), e.vendors_dirty)
    states = rows.agg(F.count_if(c("status") == "pending").alias("pending_duplicates"), F.count_if(c("status") == "approved").alias("approved_duplicates"))
    return e.vendors.agg(F.count_if("is_active").alias("active")).join(F.broadcast(states))


@query("a16_report_summary", "total_results bigint, matched bigint, match_rate double, avg_confidence double, total_exceptions bigint, avg_resolution_hours double",
       f"""SELECT count(*) AS total_results, count(*) FILTER (WHERE match_status = 'matched') AS matched, {sql_percent("count(*) FILTER (WHERE match_status = 'matched')", 'count(*)')} AS match_rate,
           {sql_round('CAST(sum(overall_confidence) FILTER (WHERE overall_confidence <> 0) AS DOUBLE) / count(*) FILTER (WHERE overall_confidence <> 0)', 2)} AS avg_confidence,
           (SELECT count(*) FROM match_exceptions) AS total_exceptions, (SELECT {sql_round("avg(CAST(date_sub('second', created_at, resolved_at) AS DOUBLE) / 3600.0e0)", 2)} FROM match_exceptions) AS avg_resolution_hours FROM match_results""")
def _(e):
    return report.report_summary(e.match_results, e.match_exceptions)


_DAILY = f"""SELECT day, coalesce(n, 0) AS invoices_processed, {sql_percent('coalesce(m, 0)', 'coalesce(n, 0)')} AS match_rate, coalesce(cx, 0) AS exceptions_created, coalesce(rx, 0) AS exceptions_resolved
    FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day) AS cal
    LEFT JOIN (SELECT CAST(created_at AS DATE) AS d, count(*) AS n, count(*) FILTER (WHERE match_status = 'matched') AS m FROM match_results GROUP BY 1) AS a ON a.d = day
    LEFT JOIN (SELECT CAST(created_at AS DATE) AS d, count(*) AS cx FROM match_exceptions GROUP BY 1) AS b ON b.d = day
    LEFT JOIN (SELECT CAST(resolved_at AS DATE) AS d, count(*) AS rx FROM match_exceptions WHERE resolved_at IS NOT NULL GROUP BY 1) AS r ON r.d = day"""
_DCOLS = "day date, invoices_processed bigint, match_rate double, exceptions_created bigint, exceptions_resolved bigint"


@query("a17_daily_metrics", _DCOLS, _DAILY)
def daily(e):
    return report.daily_metrics(e.spark, e.match_results, e.match_exceptions, "2023-12-30", "2024-02-05")


@query("a38_page_totals", "tenant_id int, total bigint, total_pages bigint, has_next boolean, has_previous boolean",
       "SELECT tenant_id, count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages, 3 < ceil(count(*) / 50.0) AS has_next, TRUE AS has_previous FROM invoices GROUP BY tenant_id")
def _(e):
    return report.page_totals(e.invoices, ["tenant_id"], 50, 3)


@query("k06_audit_retention", "source string, kept bigint, removed bigint",
       f"SELECT 'matching_audit' AS source, count(*) FILTER (WHERE created_at >= {_NOW} - INTERVAL 20 DAY) AS kept, count(*) FILTER (WHERE created_at < {_NOW} - INTERVAL 20 DAY) AS removed FROM match_results")
def _(e):
    return retention.expired_counts(e.spark, [("matching_audit", e.match_results.select("match_result_id", "invoice_id", "created_at"), "created_at")], event_as_of() - F.expr("interval 20 days"))


@query("k07_security_retention", "kept bigint, removed bigint",
       f"""SELECT sum(k) AS kept, sum(r) AS removed FROM (SELECT count(*) FILTER (WHERE occurred_at >= {_NOW} - INTERVAL 20 DAY) AS k, count(*) FILTER (WHERE occurred_at < {_NOW} - INTERVAL 20 DAY) AS r FROM security_audit
           UNION ALL SELECT count(*) FILTER (WHERE attempted_at >= {_NOW} - INTERVAL 20 DAY), count(*) FILTER (WHERE attempted_at < {_NOW} - INTERVAL 20 DAY) FROM auth_attempts)""")
def _(e):
    parts = retention.expired_counts(e.spark, [("security_audit", e.security_audit, "occurred_at"), ("auth_attempts", e.auth_attempts, "attempted_at")], event_as_of() - F.expr("interval 20 days"))
    return parts.agg(F.sum("kept").alias("kept"), F.sum("removed").alias("removed"))


@query("o02_invoice_page", "invoice_id bigint, total_amount decimal(15,2)", "SELECT invoice_id, total_amount FROM invoices ORDER BY total_amount DESC, invoice_id LIMIT 25 OFFSET 50")
def _(e):
    return e.invoices.orderBy(F.desc("total_amount"), "invoice_id").offset(50).limit(25)


@query("o05_audit_page", "audit_id bigint, event_type string, occurred_at timestamp_ntz",
       "SELECT audit_id, event_type, occurred_at FROM security_audit WHERE tenant_id = 1 ORDER BY occurred_at DESC, audit_id LIMIT 20 OFFSET 40")
def _(e):
    return e.security_audit.filter("tenant_id = 1").orderBy(F.desc("occurred_at"), "audit_id").offset(40).limit(20)


@query("o06_metric_history", "metric string, value double, ts timestamp_ntz", f"SELECT metric, value, ts FROM metrics WHERE ts >= {_NOW} - INTERVAL 48 HOUR ORDER BY ts")
def _(e):
    return e.metrics.filter(c("ts") >= event_as_of() - F.expr("interval 48 hours")).orderBy("ts")


@query("o07_roles_by_level", "role_id int, name string, level int, users bigint",
       "SELECT r.role_id, r.name, r.level, count(u.user_id) AS users FROM roles r LEFT JOIN user_roles u ON u.role_id = r.role_id GROUP BY ALL ORDER BY level, name")
def _(e):
    counts = e.user_roles.groupBy("role_id").agg(F.count("*").alias("users"))
    return e.config("roles").join(counts, "role_id", "left").na.fill(0, ["users"]).orderBy("level", "name")
