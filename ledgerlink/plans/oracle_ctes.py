"""The entity derivation once more, in DuckDB SQL, for the check statements.

``with_entities`` puts in front of a statement the common table expressions it names.
"""

from __future__ import annotations

import re

from ledgerlink.functions import fuzzy
from ledgerlink.sources.literals import CONFIG_SQL


def sql_round(expr: str, places: int) -> str:
    scale = f"{10 ** places}.0e0"
    return f"(floor(CAST(({expr}) AS DOUBLE) * {scale} + 0.5e0) / {scale})"


def sql_percent(part: str, whole: str, places: int = 2) -> str:
    body = sql_round(f"CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0) * 100.0e0", places)
    return f"coalesce({body}, 0.0e0)"


def sql_collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '[ \\t\\r\\n]+', ' ', 'g'))"


def sql_stored_name(expr: str) -> str:
    plain = f"regexp_replace(upper(trim({expr})), '[^A-Z0-9_ \\t\\r\\n'']', '', 'g')"
    ends = "INCORPORATED|INC|CORPORATION|CORP|COMPANY|CO|LIMITED|LTD|LLC|LP|LLP"
    return sql_collapse(f"regexp_replace({plain}, '[ \\t\\r\\n]+({ends})$', '')")


def sql_duplicate_name(expr: str) -> str:
    plain = f"regexp_replace(upper(trim({expr})), '[^A-Z0-9 \\t\\r\\n]', '', 'g')"
    words = "INC|INCORPORATED|LLC|LTD|LIMITED|CORP|CORPORATION|CO|COMPANY"
    return sql_collapse(f"regexp_replace({plain}, '\\b({words})\\b', '', 'g')")


def sql_import_name(expr: str) -> str:
    flat = sql_collapse(f"upper({expr})")
    drop = "'LLC','INC','CORP','LTD','LIMITED','CORPORATION','COMPANY','CO','ASSOCIATES','ASSOC','&','AND'"
    kept = f"list_filter(string_split({flat}, ' '), lambda w: w NOT IN ({drop}))"
    return f"substring(coalesce(CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, ' ') ELSE {flat} END, ''), 1, 255)"


def sql_read_date(expr: str, year: int = 2001) -> str:
    t = f"trim({expr})"
    forms = [
        ("%Y-%m-%d", r"^\d{4}-\d{1,2}-\d{1,2}$"), ("%m/%d/%Y", r"^\d{1,2}/\d{1,2}/\d{4}$"),
        ("%d/%m/%Y", r"^\d{1,2}/\d{1,2}/\d{4}$"), ("%Y/%m/%d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
        ("%m-%d-%Y", r"^\d{1,2}-\d{1,2}-\d{4}$"), ("%d-%m-%Y", r"^\d{1,2}-\d{1,2}-\d{4}$"),
        ("%Y%m%d", r"^\d{8}$"), ("%m/%d/%y", r"^\d{1,2}/\d{1,2}/\d{2}$"),
        ("%d/%m/%y", r"^\d{1,2}/\d{1,2}/\d{2}$"),
    ]
    tries = []
    for form, shape in forms:
        d = f"CAST(try_strptime({t}, '{form}') AS DATE)"
        tries.append(
            f"CASE WHEN regexp_matches({t}, '{shape}') AND year({d}) BETWEEN 1900 AND {year + 10} THEN {d} END"
        )
    return "coalesce(" + ", ".join(tries) + ")"


def sql_read_money(expr: str) -> str:
    bare = f"regexp_replace(regexp_replace(trim({expr}), '[$€£¥₹]|USD|EUR|GBP|JPY|INR', '', 'g'), '[() ,]', '', 'g')"
    negative = f"({bare} LIKE '-%' OR ({expr} LIKE '%(%' AND {expr} LIKE '%)%'))"
    body = f"regexp_replace({bare}, '^-+', '')"
    number = (
        f"CASE WHEN regexp_matches({body}, '^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$') "
        f"THEN round(TRY_CAST({body} AS DECIMAL(30,8)), 2) END"
    )
    return f"CAST(CASE WHEN {negative} THEN -({number}) ELSE {number} END AS DECIMAL(18,2))"


def sql_numeric_text(expr: str) -> str:
    bare = f"regexp_replace({expr}, '[$€£¥₹, \\t\\r\\n]', '', 'g')"
    return f"coalesce(regexp_matches({bare}, '^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$'), FALSE)"


def sql_common(a: str, b: str) -> str:
    """Length of the longest common subsequence: a row of the table per character of ``a``. Each list
    item is itself a list, so that the first can be the row before and the rest characters."""
    row = f"list_transform(range(0, length({b}) + 1), lambda z: 0::BIGINT)"
    letters = f"list_transform(string_split({a}, ''), lambda z: [unicode(z)::BIGINT])"
    places = f"list_transform(range(1, length({b}) + 1), lambda z: [z])"
    step = (f"list_reduce(list_prepend([0::BIGINT], {places}), lambda fresh, spot: list_append(fresh, CASE WHEN unicode(substring({b}, spot[1], 1)) = ch[1] "
            f"THEN above[spot[1]] + 1 ELSE greatest(fresh[spot[1]], above[spot[1] + 1]) END))")
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE list_reduce(list_prepend({row}, {letters}), lambda above, ch: {step})[length({b}) + 1] END)"


def sql_similarity(a: str, b: str) -> str:
    """1 - distance / longer length, both sides already cleaned."""
    return f"(1.0e0 - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b})))"


_FACTOR = "CAST(CASE po_id % 10 WHEN 6 THEN '1.03' WHEN 7 THEN '1.20' ELSE '1.00' END AS DECIMAL(3,2))"
_VENDOR_NAME = (
    "s_name || CASE s_suppkey % 4 WHEN 1 THEN ' Inc.' WHEN 2 THEN ' Trading Co' "
    "WHEN 3 THEN ' & Sons LLC' ELSE '' END"
)
_TWIN_NAME = (
    "CASE WHEN copy = 0 THEN s_name WHEN s_suppkey % 5 = 1 THEN s_name || ' INC' "
    "WHEN s_suppkey % 5 = 2 THEN lower(replace(s_name, '#', '  ')) "
    "WHEN s_suppkey % 5 = 3 THEN substring(s_name, 1, 9) || 'O' || substring(s_name, 11) ELSE s_name END"
)
_USER_MAIL = "CASE WHEN user_id = 1 THEN 'admin@admin.com' ELSE 'user' || user_id || '@t' || user_id % 4 || '.example' END"
_IP = "'10.0.' || user_id % 4 || '.' || user_id"

_AUDIT_HASH = (
    "sha256('{\"audit_id\":\"' || audit_id || '\",\"event_type\":\"' || event_type || '\",\"occurred_us\":\"' || occurred_us || '\",\"resource_type\":\"' || resource_type "
    "|| '\",\"risk_level\":\"' || risk_level || '\",\"tenant_id\":\"' || tenant_id || '\",\"user_id\":\"' || user_id || '\"}')"
)

ENTITY_SQL: dict[str, str] = {
    **CONFIG_SQL,
    "tenants": "SELECT DISTINCT n_nationkey % 4 AS tenant_id, 'Tenant ' || n_nationkey % 4 AS name FROM nation",
    "vendors": f"""
        SELECT s_nationkey % 4 AS tenant_id, s_suppkey AS vendor_id, {_VENDOR_NAME} AS name,
               {sql_stored_name(_VENDOR_NAME)} AS normalized_name,
               'ap' || s_suppkey || '@vendor' || s_suppkey % 7 || '.example' AS email,
               '+1-555-' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS phone,
               'TX' || lpad(CAST(s_suppkey AS VARCHAR), 11, '0') AS tax_id,
               s_suppkey % 13 <> 12 AS is_active,
               DATE '1995-01-01' + CAST(s_suppkey % 365 AS INTEGER) AS created_at
        FROM supplier""",
    "vendors_dirty": f"""
        SELECT s_nationkey % 4 AS tenant_id, s_suppkey * 10 + copy AS vendor_id, {_TWIN_NAME} AS name,
               {sql_duplicate_name(_TWIN_NAME)} AS normalized_name,
               CASE WHEN copy = 1 AND s_suppkey % 5 = 4 THEN NULL
                    WHEN copy = 1 AND s_suppkey % 5 = 1 THEN upper('ap' || s_suppkey || '@vendor' || s_suppkey % 7 || '.example')
                    ELSE 'ap' || s_suppkey || '@vendor' || s_suppkey % 7 || '.example' END AS email,
               CASE WHEN copy = 1 AND s_suppkey % 5 IN (2, 4) THEN NULL
                    WHEN copy = 1 THEN '1555' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0')
                    ELSE '+1-555-' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') END AS phone,
               CASE WHEN copy = 1 AND s_suppkey % 5 = 2 THEN NULL
                    ELSE 'TX' || lpad(CAST(s_suppkey AS VARCHAR), 11, '0') END AS tax_id,
               TRUE AS is_active
        FROM supplier, (VALUES (0), (1)) AS twins(copy)""",
    "po_lines": """
        SELECT l_orderkey AS po_id, l_orderkey * 1000000 + rn AS po_line_id, rn AS line_number,
               CASE WHEN l_partkey % 17 <> 0 THEN 'ITEM-' || l_partkey END AS item_code,
               p_name || ' ' || p_type AS description,
               CAST(l_quantity AS DECIMAL(15,4)) AS quantity,
               CAST(floor(l_extendedprice / l_quantity * 10000.0e0 + 0.5e0) / 10000.0e0 AS DECIMAL(15,4)) AS unit_price,
               CAST(l_extendedprice AS DECIMAL(15,2)) AS line_total,
               CAST(floor(l_tax * 100.0e0 + 0.5e0) AS DECIMAL(7,2)) AS tax_rate
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                     l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn
              FROM lineitem) AS numbered
        JOIN part ON p_partkey = l_partkey""",
    "purchase_orders": """
        SELECT s_nationkey % 4 AS tenant_id, o_orderkey AS po_id,
               'PO' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS po_number, vendor_id,
               total_amount AS subtotal, CAST(0 AS DECIMAL(15,2)) AS tax_amount, total_amount,
               CAST(o_orderdate AS DATE) AS po_date,
               CASE WHEN o_orderkey % 50 = 48 THEN 'archived' WHEN o_orderstatus = 'O' THEN 'approved'
                    WHEN o_orderstatus = 'P' THEN 'partially_received' ELSE 'received' END AS status
        FROM orders
        JOIN (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(15,2)) AS total_amount,
                     min(l_suppkey) AS vendor_id FROM lineitem GROUP BY l_orderkey) AS sums ON l_orderkey = o_orderkey
        JOIN supplier ON s_suppkey = vendor_id""",
    "invoices": f"""
        SELECT tenant_id, po_id * 2 + 1 AS invoice_id, 'INV-' || lpad(CAST(po_id AS VARCHAR), 12, '0') AS invoice_number,
               vendor_id,
               CASE po_id % 10 WHEN 8 THEN 'POO' || substring(po_number, 4) WHEN 9 THEN NULL ELSE po_number END AS po_reference,
               CASE WHEN po_id % 10 <= 5 THEN po_id END AS po_id,
               CAST(total - tax AS DECIMAL(15,2)) AS subtotal, tax AS tax_amount, total AS total_amount,
               day AS invoice_date, day + 30 AS due_date,
               CASE po_id % 7 WHEN 0 THEN 'approved' WHEN 1 THEN 'cancelled' ELSE 'pending' END AS status,
               CASE WHEN po_id % 11 = 0 THEN 'matched' WHEN po_id % 13 = 0 THEN 'exception' ELSE 'unmatched' END AS matching_status
        FROM (SELECT *, CAST(round(total * CAST('0.05' AS DECIMAL(3,2)), 2) AS DECIMAL(15,2)) AS tax
              FROM (SELECT *, CAST(total_amount * {_FACTOR} AS DECIMAL(15,2)) AS total,
                           po_date + CAST(po_id % 15 AS INTEGER) AS day
                    FROM purchase_orders WHERE po_id % 20 <> 19) AS scaled) AS taxed""",
    "invoice_lines": f"""
        SELECT invoice_id, invoice_line_id, line_number, item_code, description, quantity, unit_price, line_total, tax_rate,
               CAST(CAST(line_total AS DECIMAL(18,2)) * tax_rate * CAST('0.01' AS DECIMAL(3,2)) AS DECIMAL(15,2)) AS tax_amount
        FROM (SELECT po_id * 2 + 1 AS invoice_id, po_line_id + 500000 AS invoice_line_id, line_number,
                     CASE WHEN po_id % 10 = 8 THEN lower(item_code) ELSE item_code END AS item_code,
                     CASE WHEN po_id % 10 = 7 THEN description || ' item' ELSE description END AS description,
                     quantity, CAST(unit_price * {_FACTOR} AS DECIMAL(15,4)) AS unit_price,
                     CAST(line_total * {_FACTOR} AS DECIMAL(15,2)) AS line_total, tax_rate
              FROM po_lines WHERE po_id % 20 <> 19) AS scaled""",
    "receipt_lines": """
        SELECT po_id, po_id * 10 + k AS receipt_id, po_line_id * 10 + k AS receipt_line_id, po_line_id, line_number,
               CAST(quantity * part AS DECIMAL(15,4)) AS quantity_received, unit_price AS unit_cost,
               CAST(line_total * part AS DECIMAL(15,2)) AS line_value,
               CASE WHEN po_line_id % 23 = 0 THEN 'damaged' ELSE 'good' END AS condition
        FROM po_lines JOIN (SELECT kind, k, CAST(part AS DECIMAL(2,1)) AS part FROM
             (VALUES (1, 1, '1.0'), (2, 1, '0.6'), (3, 1, '0.5'), (3, 2, '0.5')) AS v(kind, k, part)) AS shares
             ON po_id % 4 = kind""",
    "receipts": """
        SELECT p.tenant_id, receipt_id, s.po_id, p.vendor_id,
               'GR' || lpad(CAST(receipt_id AS VARCHAR), 13, '0') AS receipt_number,
               po_date + CAST(s.po_id % 5 + 1 AS INTEGER) AS receipt_date, total_quantity, total_value,
               CASE WHEN s.po_id % 9 = 0 THEN 'pending' ELSE 'accepted' END AS status
        FROM (SELECT po_id, receipt_id, CAST(sum(quantity_received) AS DECIMAL(15,4)) AS total_quantity,
                     CAST(sum(line_value) AS DECIMAL(15,2)) AS total_value
              FROM receipt_lines GROUP BY po_id, receipt_id) AS s
        JOIN purchase_orders p ON p.po_id = s.po_id""",
    "stored_invoices": "SELECT * FROM invoices WHERE ((invoice_id - 1) // 100) % 2 = 0",
    "import_rows": """
        SELECT tenant_id, CAST(floor(k / 200) AS BIGINT) AS import_batch_id, CAST(k % 200 + 2 AS INTEGER) AS row_number,
               CASE WHEN m = 10 THEN '  ' ELSE 'INV-' || lpad(CAST(CASE WHEN m = 8 THEN k - 8 ELSE k END AS VARCHAR), 12, '0') END AS invoice_number,
               CASE WHEN m = 7 THEN '' WHEN m IN (0, 8) THEN 'Bulk  Vendor ' || CAST(k // 12 AS VARCHAR) || ' Ltd'
                    WHEN m = 5 THEN '12345' ELSE name END AS vendor_name,
               CASE m WHEN 3 THEN '$' || format('{:,.2f}', CAST(total_amount AS DOUBLE))
                      WHEN 4 THEN '(' || CAST(total_amount AS VARCHAR) || ')' WHEN 5 THEN 'N/A'
                      WHEN 9 THEN '€ ' || CAST(total_amount AS VARCHAR) WHEN 11 THEN '2500000.00'
                      ELSE CAST(total_amount AS VARCHAR) END AS total_amount,
               CASE m WHEN 3 THEN strftime(invoice_date, '%m/%d/%Y') WHEN 6 THEN '2023-13-45'
                      WHEN 9 THEN strftime(invoice_date, '%Y%m%d')
                      WHEN 2 THEN CAST(month(invoice_date) AS VARCHAR) || '/' || CAST(day(invoice_date) AS VARCHAR) || '/' || strftime(invoice_date, '%y')
                      WHEN 11 THEN '2005-01-01' ELSE strftime(invoice_date, '%Y-%m-%d') END AS invoice_date,
               CASE m WHEN 1 THEN NULL WHEN 2 THEN '-5.00'
                      WHEN 3 THEN CAST(CAST(total_amount * CAST('0.60' AS DECIMAL(3,2)) AS DECIMAL(15,2)) AS VARCHAR)
                      WHEN 11 THEN '3000000.00' ELSE CAST(tax_amount AS VARCHAR) END AS tax_amount,
               CASE WHEN m = 9 THEN CAST(CAST(subtotal + 1 AS DECIMAL(15,2)) AS VARCHAR)
                    WHEN m IN (1, 2, 3, 11) THEN NULL ELSE CAST(subtotal AS VARCHAR) END AS subtotal,
               strftime(CASE m WHEN 0 THEN invoice_date - 1 WHEN 9 THEN invoice_date + 400 ELSE due_date END, '%Y-%m-%d') AS due_date,
               CASE WHEN k % 3 <> 0 THEN 'Order ' || k END AS description, po_reference,
               CASE m WHEN 4 THEN 'net' WHEN 6 THEN '45 days' ELSE '30' END AS payment_terms,
               CASE m WHEN 2 THEN 'not an address' ELSE email END AS email
        FROM (SELECT i.*, v.name, v.email, (invoice_id - 1) // 2 AS k, ((invoice_id - 1) // 2) % 12 AS m
              FROM invoices i JOIN vendors v ON v.vendor_id = i.vendor_id) AS keyed""",
    "parsed_rows": f"""
        SELECT tenant_id, import_batch_id, row_number, invoice_number AS raw_number, vendor_name AS raw_vendor,
               total_amount AS raw_amount, invoice_date AS raw_date,
               CASE WHEN trim(invoice_number) <> '' THEN substring(trim(invoice_number), 1, 100) END AS invoice_number,
               nullif({sql_import_name('vendor_name')}, '') AS vendor_name,
               {sql_read_money('total_amount')} AS total_amount, {sql_read_date('invoice_date')} AS invoice_date,
               {sql_read_money('tax_amount')} AS tax_amount, {sql_read_money('subtotal')} AS subtotal,
               {sql_read_date('due_date')} AS due_date, tax_amount AS raw_tax, due_date AS raw_due,
               description, po_reference, payment_terms, email
        FROM import_rows""",
    "score_pairs": """
        SELECT i.tenant_id, i.invoice_id, p.po_id, i.vendor_id AS inv_vendor_id, p.vendor_id AS po_vendor_id,
               i.po_reference AS inv_ref, p.po_number, i.total_amount AS inv_amount, p.total_amount AS po_amount,
               i.invoice_date, p.po_date, step, iv.name AS inv_vendor, iv.normalized_name AS inv_norm,
               pv.name AS po_vendor, pv.normalized_name AS po_norm, r.receipt_date
        FROM invoices i CROSS JOIN (VALUES (0), (1)) AS steps(step)
        JOIN purchase_orders p ON p.po_id = (i.invoice_id - 1) // 2 + step
        JOIN vendors iv ON iv.vendor_id = i.vendor_id
        JOIN vendors pv ON pv.vendor_id = p.vendor_id
        LEFT JOIN receipts r ON r.receipt_id = p.po_id * 10 + 1""",
    "match_results": """
        SELECT *, CASE WHEN overall_confidence >= 95 THEN 'matched' WHEN overall_confidence >= 70 THEN 'partial'
                       WHEN overall_confidence >= 50 THEN 'exception' ELSE 'failed' END AS match_status,
               overall_confidence >= 85 AS auto_approved,
               overall_confidence >= 70 AND overall_confidence < 85 AS requires_review,
               CASE WHEN overall_confidence >= 100 THEN 'exact' ELSE 'fuzzy' END AS match_kind,
               CASE WHEN overall_confidence >= 85 THEN 'auto_approved' WHEN event_type = 'error' THEN 'rejected'
                    ELSE 'pending' END AS approval_status
        FROM (SELECT event_id AS match_result_id, CAST(user_id % 4 AS INTEGER) AS tenant_id,
                     (event_id // 2) * 2 + 1 AS invoice_id, event_id // 2 AS po_id,
                     CASE WHEN event_type IN ('click', 'view') THEN '3way_full' ELSE '2way_po_invoice' END AS match_type,
                     CAST(least(value, 100.0e0) AS DECIMAL(5,2)) AS overall_confidence,
                     CASE WHEN event_type <> 'signup' THEN event_id % 977 + 5 END AS processing_time_ms,
                     event_type, ts AS created_at FROM events) AS scored""",
    "match_exceptions": """
        SELECT match_result_id AS exception_id, match_result_id, tenant_id,
               CASE event_type WHEN 'click' THEN 'amount_variance' WHEN 'view' THEN 'vendor_mismatch'
                    WHEN 'purchase' THEN 'date_variance' ELSE 'approval_required' END AS exception_type,
               CASE WHEN overall_confidence < 60 THEN 'high' ELSE 'medium' END AS severity,
               CASE WHEN match_result_id % 2 = 0 THEN 'resolved' WHEN match_result_id % 3 = 0 THEN 'in_review' ELSE 'open' END AS status,
               CAST(match_result_id % 3 + 1 AS INTEGER) AS priority, created_at,
               CASE WHEN match_result_id % 2 = 0 THEN created_at + to_hours(CAST(match_result_id % 72 AS INTEGER)) END AS resolved_at
        FROM match_results WHERE match_status = 'exception'""",
    "auth_attempts": f"""
        SELECT event_id AS attempt_id, user_id, CAST(user_id % 4 AS INTEGER) AS tenant_id, {_USER_MAIL} AS email,
               {_IP} AS ip_address, event_type <> 'error' AS success,
               CASE WHEN event_type = 'error' THEN CASE WHEN value > 100 THEN 'suspicious_activity'
                    WHEN value > 50 THEN 'rate_limited' ELSE 'invalid_password' END END AS failure_reason,
               value > 20 AS mfa_required, value > 20 AND event_type <> 'error' AS mfa_success, ts AS attempted_at
        FROM events""",
    "security_audit": f"""
        SELECT event_id AS audit_id, CAST(user_id % 4 AS INTEGER) AS tenant_id, user_id, event_type, {_IP} AS ip_address,
               CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'medium' WHEN value < 150 THEN 'high' ELSE 'critical' END AS risk_level,
               CASE event_type WHEN 'purchase' THEN 'invoice' WHEN 'signup' THEN 'user' ELSE 'report' END AS resource_type,
               ts AS occurred_at
        FROM events""",
    "user_sessions": """
        SELECT event_id AS session_id, user_id, ts AS created_at, ts + INTERVAL 8 HOUR AS expires_at,
               ts + to_minutes(CAST(event_id % 480 AS INTEGER)) AS last_accessed,
               CASE WHEN event_id % 10 = 9 THEN 'terminated' ELSE 'active' END AS status
        FROM events WHERE event_type = 'view'""",
    "users": f"""
        SELECT user_id, CAST(user_id % 4 AS INTEGER) AS tenant_id, {_USER_MAIL} AS email, user_id % 3 <> 0 AS mfa_enabled,
               CASE WHEN user_id % 11 = 10 THEN 'inactive' ELSE 'active' END AS auth_status,
               CASE WHEN user_id % 7 <> 0 THEN DATE '2024-01-31' - CAST(user_id % 120 AS INTEGER) END AS password_changed_at,
               last_login - to_days(CAST(user_id % 50 AS INTEGER)) AS last_login,
               CASE WHEN user_id % 9 = 0 THEN DATE '2024-01-31' - CAST(user_id % 5 AS INTEGER) END AS account_locked_until
        FROM (SELECT user_id, max(ts) AS last_login FROM events GROUP BY user_id) AS seen""",
    "user_roles": """
        SELECT user_id, tenant_id, role_id, user_id % 10 <> 9 AS is_active,
               CASE WHEN user_id % 6 = 0 THEN DATE '2024-01-31' + CAST(user_id % 4 - 1 AS INTEGER) END AS expires_at
        FROM (SELECT user_id, tenant_id, CAST(user_id % 4 AS INTEGER) AS role_id FROM users
              UNION ALL SELECT user_id, tenant_id, CAST((user_id + 1) % 4 AS INTEGER) FROM users WHERE user_id % 5 = 0) AS granted""",
    "metrics": "SELECT event_id, event_type AS metric, value, ts FROM events",
    "invoice_vectors": "SELECT invoice_id, embedding AS vec FROM invoices JOIN embeddings ON vec_id = ((invoice_id - 1) // 2) % (SELECT count(*) FROM embeddings)",
    "order_vectors": "SELECT po_id, embedding AS vec FROM purchase_orders JOIN embeddings ON vec_id = (po_id + 1) % (SELECT count(*) FROM embeddings)",
    "erasure_requests": """
        SELECT user_id AS request_id, tenant_id, user_id, password_changed_at - 20 AS received_at,
               CASE WHEN user_id % 7 < 3 THEN password_changed_at - 20 + CAST(user_id % 7 * 9 AS INTEGER) END AS completed_at
        FROM users WHERE password_changed_at IS NOT NULL""",
    "control_tests": """
        SELECT po_id AS test_id, tenant_id, ['IT-01-01', 'IT-01-02', 'IT-02-01', 'IT-02-02', 'IT-03-01', 'IT-04-01', 'IT-05-01', 'FN-01-01'][(po_id // 50) % 8 + 1] AS control_id, quarter,
               CAST(quarter + INTERVAL 3 MONTH AS DATE) + CAST(cents % 70 AS INTEGER) AS tested_at,
               CASE WHEN cents % 6 = 0 THEN 'DEFICIENT' WHEN cents % 11 = 0 THEN 'NOT TESTED' ELSE 'EFFECTIVE' END AS result
        FROM (SELECT *, CAST(date_trunc('quarter', po_date) AS DATE) AS quarter, CAST(total_amount * 100 AS BIGINT) AS cents FROM purchase_orders WHERE status = 'archived')""",
    "audit_events": """
        SELECT match_result_id AS audit_event_id, r.tenant_id, CASE match_result_id % 3 WHEN 0 THEN 'invoices' WHEN 1 THEN 'match_results' ELSE 'vendors' END AS table_name,
               created_at AS changed_at, user_id + CASE WHEN match_result_id % 3 = 2 THEN 1000000 ELSE 0 END AS changed_by, r.*
        FROM match_results r JOIN events e ON e.event_id = r.match_result_id""",
    "audit_sealed": f"""
        SELECT *, lag(record_hash) OVER (PARTITION BY tenant_id ORDER BY occurred_us, audit_id) AS previous_record_hash
        FROM (SELECT *, {_AUDIT_HASH} AS record_hash FROM (SELECT audit_id, tenant_id, user_id, event_type, risk_level, resource_type, epoch_us(occurred_at) AS occurred_us FROM security_audit))""",
    "audit_heads": "SELECT tenant_id, max_by(record_hash, (occurred_us, audit_id)) AS head, count(*) AS records FROM audit_sealed GROUP BY tenant_id",
    "audit_stored": f"""
        SELECT audit_id, tenant_id, user_id, event_type, risk_level, resource_type, occurred_us, CASE WHEN anew OR moved THEN {_AUDIT_HASH} ELSE record_hash END AS record_hash, previous_record_hash
        FROM (SELECT audit_id, tenant_id, user_id, resource_type, record_hash, previous_record_hash, anew, moved, CASE WHEN anew THEN 'export' ELSE event_type END AS event_type,
                     CASE WHEN edited THEN CASE risk_level WHEN 'low' THEN 'medium' ELSE 'low' END ELSE risk_level END AS risk_level,
                     CASE WHEN moved THEN occurred_us + 43200000000 ELSE occurred_us END AS occurred_us
              FROM (SELECT *, tenant_id <> 0 AND audit_id % 97 = 5 AS edited, tenant_id <> 0 AND audit_id % 211 = 7 AS anew, tenant_id <> 0 AND audit_id % 307 = 20 AS moved FROM audit_sealed))
        WHERE NOT (tenant_id <> 0 AND audit_id % 251 = 9) AND NOT (tenant_id = 3 AND occurred_us >= epoch_us(TIMESTAMP '2024-01-30 00:00:00'))""",
    "external_feed": """
        SELECT tenant_id, 'X' || invoice_id AS external_id, ['quickbooks', 'xero', 'netsuite'][vendor_id % 3 + 1] AS external_system, invoice_number,
               CAST(total_amount + version AS DECIMAL(15,2)) AS amount, ['pending', 'approved', 'paid'][version + 1] AS status, version, updated_at,
               CASE WHEN seen_at < TIMESTAMP '1997-06-01' THEN 1 WHEN seen_at < TIMESTAMP '1998-06-01' THEN 2 ELSE 3 END AS arrival
        FROM (SELECT *, updated_at + CASE WHEN k % 7 = 0 THEN INTERVAL 10 DAY ELSE INTERVAL 0 DAY END AS seen_at
              FROM (SELECT *, CAST(invoice_date AS TIMESTAMP) + to_days(CAST(version * 40 AS INTEGER)) + to_hours(CAST(k % 24 AS INTEGER)) AS updated_at
                    FROM (SELECT *, (invoice_id - 1) // 2 AS k FROM invoices) AS keyed JOIN (SELECT * FROM range(0, 3) AS v(version)) AS versions
                    ON version < CASE WHEN k % 5 = 0 THEN 3 WHEN k % 3 <> 0 THEN 2 ELSE 1 END))""",
}


def with_entities(sql: str) -> str:
    """``sql`` preceded by every entity expression it uses, in dependency order."""
    ordered: list[str] = []

    def visit(text: str, owner: str | None) -> None:
        for name in ENTITY_SQL:
            if name != owner and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text, re.I) and name not in ordered:
                visit(ENTITY_SQL[name], name)
                ordered.append(name)

    visit(sql, None)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{name} AS ({ENTITY_SQL[name]})" for name in ordered)
    return f"WITH RECURSIVE {ctes}\n{sql}"


def sql_whole_percent(a: str, b: str) -> str:
    """Share of the common subsequence in whole percent, halves to even."""
    return f"(CASE WHEN {a} = {b} THEN 100 ELSE CAST(round_even(200.0e0 * {sql_common(a, b)} / (length({a}) + length({b})), 0) AS INTEGER) END)"


def sql_similarities(pairs: str) -> str:
    """Per row (a, b) of ``pairs``, all texts distinct pairs: the similarities by each method, and
    ``composite`` as it is, without rounding."""
    words = "list_filter(string_split(trim(regexp_replace({0}, '[^a-z0-9_]+', ' ', 'g')), ' '), lambda w: w <> '')"
    return f"""SELECT a, b, x = y AS same, CASE WHEN same THEN 1.0e0 ELSE edit END AS levenshtein, CASE WHEN same THEN 1.0e0 ELSE whole / 100.0e0 END AS ratio,
        CASE WHEN same THEN 1.0e0 ELSE sorted_percent / 100.0e0 END AS token_sort, CASE WHEN same THEN 1.0e0 ELSE set_percent / 100.0e0 END AS token_set,
        CASE WHEN same THEN 1.0e0 ELSE edit * 0.3e0 + sorted_percent / 100.0e0 * 0.4e0 + set_percent / 100.0e0 * 0.3e0 END AS composite
        FROM (SELECT *, x = y AS same, {sql_similarity('x', 'y')} AS edit, {sql_whole_percent('x', 'y')} AS whole, {sql_whole_percent('sx', 'sy')} AS sorted_percent,
            CASE WHEN dx = [] OR dy = [] THEN 0 ELSE greatest({sql_whole_percent('shared', 'l')}, {sql_whole_percent('shared', 'r')}, {sql_whole_percent('l', 'r')}) END AS set_percent
        FROM (SELECT *, trim(concat_ws(' ', shared, array_to_string(list_sort(list_filter(dx, lambda w: NOT list_contains(dy, w))), ' '))) AS l,
                     trim(concat_ws(' ', shared, array_to_string(list_sort(list_filter(dy, lambda w: NOT list_contains(dx, w))), ' '))) AS r
        FROM (SELECT *, array_to_string(list_sort(list_filter(dx, lambda w: list_contains(dy, w))), ' ') AS shared
        FROM (SELECT a, b, x, y, array_to_string(list_sort(wx), ' ') AS sx, array_to_string(list_sort(wy), ' ') AS sy, list_distinct(wx) AS dx, list_distinct(wy) AS dy
        FROM (SELECT a, b, x, y, {words.format('x')} AS wx, {words.format('y')} AS wy FROM (SELECT a, b, lower(trim(a)) AS x, lower(trim(b)) AS y FROM ({pairs})))))))"""


def sql_windows(pairs: str) -> str:
    """(a, b, partial): best whole percent of the shorter text against equally long windows."""
    return f"""SELECT a, b, max({sql_whole_percent('short', 'win')}) AS partial FROM (SELECT DISTINCT a, b, short, substring(long, i, length(short)) AS win
        FROM (SELECT a, b, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS short, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS long
              FROM (SELECT a, b, lower(trim(a)) AS x, lower(trim(b)) AS y FROM ({pairs})) WHERE x <> '' AND y <> ''),
        range(1, length(long) - length(short) + 2) AS places(i)) GROUP BY a, b"""


def sql_soundex(text: str) -> str:
    """Sound code: letters as digits, equal neighbours once, H and W passed over, vowels and other
    characters as breaks."""
    codes = "translate(regexp_replace(upper({0}), '[^A-Z]', '0', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623017202')"
    whole = f"{codes.format(f'left({text}, 1)')} || replace({codes.format(f'substring({text}, 2)')}, '7', '')"
    for digit in "123456":
        whole = f"regexp_replace({whole}, '{digit}+', '{digit}', 'g')"
    return f"(CASE WHEN regexp_matches({text}, '^[A-Za-z]') THEN upper(left({text}, 1)) || rpad(left(replace(substring({whole}, 2), '0', ''), 3), 3, '0') ELSE {text} END)"


def sql_grams(text: str) -> str:
    """Character 2- and 3-grams of each word between blanks, as one list."""
    words = f"list_filter(regexp_split_to_array(lower(trim({text})), '[ \\t\\r\\n]+'), lambda w: w <> '')"
    cut = "list_transform(range(1, greatest(length(w) + 2 - {0}, 1) + 1), lambda i: substring(' ' || w || ' ', i, {1}))"
    return f"flatten(list_transform({words}, lambda w: list_concat({cut.format(1, 2)}, {cut.format(2, 3)})))"


def sql_variants(name: str) -> str:
    """The text and its scanner variants, one swap each, as a list."""
    swaps = ", ".join(f"'{key}': {list(subs)}" for key, subs in fuzzy.OCR_SWAPS.items())
    swapped = f"left(upper({name}), k - 1) || s || substr(upper({name}), k + 1)"
    return f"""CASE WHEN length({name}) BETWEEN 1 AND {fuzzy.OCR_MAX_LENGTH} THEN list_reduce(
        list_transform(range(1, length({name}) + 1), lambda k: flatten(list_transform(coalesce(MAP {{{swaps}}}[substr(upper({name}), k, 1)], []), lambda s: [{swapped}, lower({swapped})]))),
        lambda made, own: CASE WHEN len(own) > 2 AND len(list_distinct(made || own[1:2])) < {fuzzy.OCR_MAX_VARIANTS} THEN list_distinct(made || own) ELSE list_distinct(made || own[1:2]) END,
        [{name}]) ELSE [{name}] END"""
