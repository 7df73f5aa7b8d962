"""Small fixed configuration tables, as SQL text that Spark and DuckDB both accept.

Their size does not depend on the data, so joining them by broadcast is always safe.
"""

from __future__ import annotations


def _table(cols: str, rows: str) -> str:
    return f"SELECT * FROM (VALUES {rows}) AS fixed({cols})"


# Role templates with their permissions.
_ROLES = _table(
    "role_id, name, display_name, level, parent_role_id, permissions",
    """
    (0, 'admin', 'Administrator', 0, 1, '{"system":["*"],"invoice":["*"],"vendor":["*"],"report":["*"],"user":["*"],"tenant":["*"]}'),
    (1, 'manager', 'Manager', 1, 2, '{"invoice":["*"],"vendor":["manage"],"report":["*"],"user":["view","manage"]}'),
    (2, 'processor', 'Processor', 2, 3, '{"invoice":["create","read","update"],"vendor":["create","read","update"],"report":["view"]}'),
    (3, 'viewer', 'Viewer', 3, NULL, '{"invoice":["read"],"vendor":["read"],"report":["view"]}')
    """,
)

# Alert rules over the login and security metrics.
_ALERT_RULES = _table(
    "rule_name, metric, threshold, op, level",
    """
    ('High Failed Login Rate', 'auth_failed_login_rate', 10.0e0, '>', 'high'),
    ('Account Lockout Spike', 'auth_account_lockouts', 5.0e0, '>', 'medium'),
    ('Suspicious Login Pattern', 'auth_suspicious_logins', 3.0e0, '>', 'high'),
    ('MFA Bypass Attempts', 'auth_mfa_bypass_attempts', 1.0e0, '>', 'critical'),
    ('Password Reset Abuse', 'auth_password_reset_rate', 20.0e0, '>', 'medium'),
    ('Token Validation Errors', 'auth_token_validation_errors', 50.0e0, '>', 'high'),
    ('Session Hijacking Attempts', 'auth_session_hijack_attempts', 1.0e0, '>', 'critical')
    """,
)

# Header keywords per target field, in the order they are tried.
_HEADER_RULES = _table(
    "rule_order, field, keyword",
    """
    (1, 'invoice_number', 'invoice'), (1, 'invoice_number', 'inv_no'), (1, 'invoice_number', 'invoice_no'),
    (1, 'invoice_number', 'invoice_number'), (1, 'invoice_number', 'number'),
    (2, 'vendor', 'vendor'), (2, 'vendor', 'supplier'), (2, 'vendor', 'vendor_name'),
    (2, 'vendor', 'supplier_name'), (2, 'vendor', 'company'),
    (3, 'amount', 'amount'), (3, 'amount', 'total'), (3, 'amount', 'total_amount'),
    (3, 'amount', 'invoice_amount'), (3, 'amount', 'sum'),
    (4, 'invoice_date', 'date'), (4, 'invoice_date', 'invoice_date'), (4, 'invoice_date', 'inv_date'),
    (4, 'invoice_date', 'bill_date'),
    (5, 'po_reference', 'po'), (5, 'po_reference', 'po_number'), (5, 'po_reference', 'purchase_order'),
    (5, 'po_reference', 'po_ref'),
    (6, 'description', 'description'), (6, 'description', 'desc'), (6, 'description', 'note'),
    (6, 'description', 'memo'),
    (7, 'tax_amount', 'tax'), (7, 'tax_amount', 'vat'), (7, 'tax_amount', 'gst'), (7, 'tax_amount', 'tax_amount'),
    (8, 'due_date', 'due_date'), (8, 'due_date', 'payment_due'), (8, 'due_date', 'due')
    """,
)

_TOLERANCES = _table(
    "tenant_id, vendor_id, amount_threshold, tolerance_type, percentage_tolerance, absolute_tolerance, is_active, priority",
    """
    (0, NULL, NULL, 'price', 0.05, 10.00, TRUE, 10),
    (0, NULL, NULL, 'price', 0.02, 5.00, TRUE, 20),
    (0, 3, NULL, 'price', 0.10, 50.00, TRUE, 1),
    (0, NULL, NULL, 'date', NULL, 7.00, TRUE, 5),
    (1, NULL, 300000.00, 'price', 0.01, 100.00, TRUE, 30),
    (1, NULL, NULL, 'price', 0.05, 10.00, TRUE, 10),
    (1, NULL, NULL, 'quantity', 0.02, 1.00, TRUE, 10),
    (2, NULL, NULL, 'price', 0.03, 20.00, FALSE, 99),
    (2, NULL, NULL, 'price', 0.05, 10.00, TRUE, 10),
    (3, 7, NULL, 'date', NULL, 14.00, TRUE, 10)
    """,
)

_MATCH_CONFIG = _table(
    "tenant_id, vendor_name_weight, amount_weight, date_weight, reference_weight, auto_approve_threshold, manual_review_threshold, is_active, created_at",
    """
    (0, 0.30, 0.40, 0.20, 0.10, 0.85, 0.70, TRUE, DATE '2001-01-01'),
    (0, 0.25, 0.25, 0.25, 0.25, 0.90, 0.60, TRUE, DATE '2000-01-01'),
    (1, 0.20, 0.50, 0.20, 0.10, 0.85, 0.70, TRUE, DATE '2001-03-01'),
    (1, 0.40, 0.40, 0.10, 0.10, 0.95, 0.75, FALSE, DATE '2001-06-01'),
    (2, 0.30, 0.40, 0.20, 0.10, 0.80, 0.65, TRUE, DATE '2001-02-01')
    """,
)

# Seeded matching rules.
_MATCHING_RULES = _table(
    "tenant_id, name, rule_type, field_name, tolerance_percentage, tolerance_absolute, tolerance_days, priority, vendor_id, min_amount, max_amount",
    """
    (0, 'Exact PO Number Match', 'exact', 'po_number', NULL, NULL, NULL, 10, NULL, NULL, NULL),
    (0, 'Vendor Name Fuzzy Match', 'fuzzy', 'vendor_name', NULL, NULL, NULL, 20, NULL, NULL, NULL),
    (0, 'Amount Tolerance Match', 'tolerance', 'total_amount', 5.0, 10.0, NULL, 30, NULL, NULL, NULL),
    (0, 'Large Amount Match', 'tolerance', 'total_amount', 1.0, 100.0, NULL, 15, NULL, 200000.00, NULL),
    (1, 'Amount Tolerance Match', 'tolerance', 'total_amount', 5.0, 10.0, NULL, 30, NULL, NULL, NULL),
    (1, 'Vendor Amount Match', 'tolerance', 'total_amount', 2.0, 10.0, NULL, 5, 5, NULL, 400000.00),
    (2, 'Date Tolerance Match', 'tolerance', 'invoice_date', NULL, NULL, 7, 40, NULL, NULL, NULL),
    (2, 'Amount Tolerance Match', 'tolerance', 'total_amount', 5.0, 10.0, NULL, 30, NULL, NULL, NULL),
    (3, 'Invoice Number Match', 'exact', 'invoice_number', NULL, NULL, NULL, 50, NULL, NULL, NULL)
    """,
)

# Fields an import mapping has to cover.
_REQUIRED_FIELDS = _table("field", "('invoice_number'), ('vendor'), ('amount'), ('invoice_date')")

_PERMISSION_REQUESTS = _table(
    "resource, action",
    "('invoice','read'), ('invoice','delete'), ('vendor','create'), ('report','view'), ('user','manage'), ('tenant','update')",
)

# Accounts that should not exist.
_DEFAULT_ACCOUNTS = _table("email", "('admin@admin.com'), ('test@test.com'), ('user@user.com')")

# Audit findings weights per risk level.
_RISK_WEIGHTS = _table(
    "risk_level, weight", "('critical', 25), ('high', 15), ('medium', 8), ('low', 3), ('info', 1)"
)

CONFIG_SQL = {
    "roles": _ROLES,
    "alert_rules": _ALERT_RULES,
    "header_rules": _HEADER_RULES,
    "tolerances": _TOLERANCES,
    "match_config": _MATCH_CONFIG,
    "matching_rules": _MATCHING_RULES,
    "required_fields": _REQUIRED_FIELDS,
    "permission_requests": _PERMISSION_REQUESTS,
    "default_accounts": _DEFAULT_ACCOUNTS,
    "risk_weights": _RISK_WEIGHTS,
}
