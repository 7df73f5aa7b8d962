"""Row checks, dispositions and import outputs over the whole import table."""

from pyspark.sql import functions as F

from ledgerlink.functions import text
from ledgerlink.functions.numeric import percent
from ledgerlink.operators import names, validate, vendors
from ledgerlink.plans.oracle_ctes import sql_percent
from ledgerlink.plans.registry import stored_query as query
from ledgerlink.session import scratch_path, staged
from ledgerlink.sources.entities import doc_as_of

c = F.col
_KEYS = ["import_batch_id", "row_number"]
_F = "import_batch_id bigint, row_number int, code string, field string, severity string, raw string"
_D = "DATE '2001-12-31'"


def _sql(*rules):
    """UNION ALL of one select per (predicate, code, field, severity, raw)."""
    return " UNION ALL ".join(
        f"SELECT import_batch_id, row_number, '{code}' AS code, '{field}' AS field, '{severity}' AS severity, CAST({raw} AS VARCHAR) AS raw "
        f"FROM parsed_rows WHERE {when}" for when, code, field, severity, raw in rules)


def _findings(e, rules):
    return validate.exploded(validate.with_findings(e.parsed_rows, rules), _KEYS)


_REQUIRED = [(f"{f} IS NULL", f"MISSING_{f.upper()}", f, "error", r) for f, r in (
    ("invoice_number", "raw_number"), ("vendor_name", "raw_vendor"), ("total_amount", "raw_amount"), ("invoice_date", "raw_date"))]
_TYPES = [(f"trim({r}) <> '' AND {f} IS NULL", f"INVALID_{f.upper()}_TYPE", f, "error", r) for f, r in (
    ("total_amount", "raw_amount"), ("tax_amount", "raw_tax"), ("invoice_date", "raw_date"), ("due_date", "raw_due"))]
_PARSE = [
    ("invoice_number IS NULL", "MISSING_INVOICE_NUMBER", "invoice_number", "error", "raw_number"),
    ("vendor_name IS NULL", "MISSING_VENDOR", "vendor", "error", "raw_vendor"),
    ("total_amount IS NULL", "INVALID_AMOUNT", "amount", "error", "raw_amount"),
    ("total_amount <= 0", "NEGATIVE_AMOUNT", "amount", "error", "raw_amount"),
    ("invoice_date IS NULL", "INVALID_DATE", "invoice_date", "error", "raw_date"),
    (f"invoice_date > {_D}", "FUTURE_DATE", "invoice_date", "warning", "raw_date")]
_AMOUNT = [("total_amount <= 0", "NEGATIVE_AMOUNT", "total_amount", "error", "total_amount"),
           ("total_amount > 1000000", "AMOUNT_TOO_LARGE", "total_amount", "warning", "total_amount")]
_TAX = [("tax_amount < 0", "NEGATIVE_TAX", "tax_amount", "error", "tax_amount"),
        ("tax_amount > total_amount", "TAX_EXCEEDS_TOTAL", "tax_amount", "error", "tax_amount"),
        ("CAST(tax_amount AS DOUBLE) / nullif(CAST(total_amount AS DOUBLE), 0) > 0.5", "HIGH_TAX_RATE", "tax_amount", "warning", "tax_amount")]
_DATES = [(f"datediff('day', invoice_date, {_D}) > 1095", "DATE_TOO_OLD", "invoice_date", "warning", "invoice_date"),
          (f"invoice_date > {_D}", "FUTURE_DATE", "invoice_date", "warning", "invoice_date"),
          ("due_date < invoice_date", "DUE_BEFORE_INVOICE", "due_date", "error", "due_date"),
          ("datediff('day', invoice_date, due_date) > 365", "LONG_PAYMENT_TERMS", "due_date", "warning", "due_date")]
_CROSS = [("abs(total_amount - (subtotal + tax_amount)) > 0.02", "AMOUNT_CALCULATION_ERROR", "total_amount", "error", "total_amount")]
_VENDOR = [("length(vendor_name) < 2 OR NOT regexp_matches(vendor_name, '[a-zA-Z]')", "INVALID_VENDOR_FORMAT", "vendor_name", "error", "vendor_name")]
_SHORT = [
    ("trim(raw_number) = ''", "REQUIRED", "invoice_number", "error", "raw_number"), ("trim(raw_vendor) = ''", "REQUIRED", "vendor_name", "error", "raw_vendor"),
    ("NOT coalesce(TRY_CAST(nullif(regexp_extract(trim(raw_amount), '^([+-]?(\\d+(\\.\\d*)?|\\.\\d+))', 1), '') AS DOUBLE) >= 0, FALSE)", "AMOUNT", "amount", "error", "raw_amount"),
    ("NOT regexp_matches(raw_date, '^\\d{4}-\\d{2}-\\d{2}$') OR TRY_CAST(raw_date AS DATE) IS NULL", "DATE", "invoice_date", "error", "raw_date"),
    ("NOT regexp_matches(email, '^[^ \\t\\r\\n@]+@[^ \\t\\r\\n@]+\\.[^ \\t\\r\\n@]+$')", "EMAIL", "email", "error", "email")]

query("v01_required_fields", _F, _sql(*_REQUIRED))(lambda e: _findings(e, validate.required_rules()))
query("v02_type_checks", _F, _sql(*_TYPES))(lambda e: _findings(e, validate.type_rules()))
query("v03_parse_errors", _F, _sql(*_PARSE))(lambda e: _findings(e, validate.parse_rules(doc_as_of())))
query("v04_amount_limits", _F, _sql(*_AMOUNT))(lambda e: _findings(e, validate.amount_rules()))
query("v05_tax_limits", _F, _sql(*_TAX))(lambda e: _findings(e, validate.tax_rules()))
query("v06_date_limits", _F, _sql(*_DATES))(lambda e: _findings(e, validate.date_rules(doc_as_of())))
query("v07_cross_field_total", _F, _sql(*_CROSS))(lambda e: _findings(e, validate.cross_field_rules()))
query("v08_vendor_format", _F, _sql(*_VENDOR))(lambda e: _findings(e, validate.vendor_rules()))
query("v10_short_row_check", _F, _sql(*_SHORT))(lambda e: _findings(e, validate.short_rules()))

_KNOWN = "SELECT tenant_id, upper(trim(name)) AS uname, min(vendor_id) AS known_id FROM vendors GROUP BY ALL"


@query("v09_vendor_lookup", "import_batch_id bigint, row_number int, vendor_id bigint, is_new boolean",
       f"""SELECT import_batch_id, row_number, known_id AS vendor_id, known_id IS NULL AS is_new FROM parsed_rows p
           LEFT JOIN ({_KNOWN}) AS k ON k.tenant_id = p.tenant_id AND k.uname = upper(trim(p.vendor_name)) WHERE p.vendor_name IS NOT NULL""")
def _(e):
    found = validate.mark_known_vendors(e.parsed_rows.filter("vendor_name is not null"), e.vendors)
    return found.select(*_KEYS, "vendor_id", c("vendor_id").isNull().alias("is_new"))


@query("j04_vendor_by_upper_name", "import_batch_id bigint, row_number int, vendor_id bigint",
       f"""SELECT import_batch_id, row_number, known_id AS vendor_id FROM import_rows p
           LEFT JOIN ({_KNOWN}) AS k ON k.tenant_id = p.tenant_id AND k.uname = upper(trim(p.vendor_name))""")
def _(e):
    return validate.mark_known_vendors(e.import_rows, e.vendors).select(*_KEYS, "vendor_id")


@query("v11_field_shapes", "import_batch_id bigint, row_number int, email_ok boolean, amount_ok boolean, date_ok boolean, uuid_ok boolean",
       """SELECT import_batch_id, row_number, regexp_matches(email, '^[^ \\t\\r\\n@]+@[^ \\t\\r\\n@]+\\.[^ \\t\\r\\n@]+$') AS email_ok,
          coalesce(TRY_CAST(total_amount AS DOUBLE) >= 0, FALSE) AS amount_ok,
          regexp_matches(invoice_date, '^\\d{4}-\\d{2}-\\d{2}$') AND TRY_CAST(invoice_date AS DATE) IS NOT NULL AS date_ok,
          regexp_matches(lower(id), '^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$') AS uuid_ok FROM (
          SELECT *, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-' || substring(h, 17, 4) || '-' || substring(h, 21, 12) AS id
          FROM (SELECT *, md5(invoice_number) AS h FROM import_rows))""")
def _(e):
    h = F.md5("invoice_number")
    ident = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    amount = c("total_amount").try_cast("double")
    day = c("invoice_date").rlike(r"^\d{4}-\d{2}-\d{2}$") & c("invoice_date").try_cast("date").isNotNull()
    return e.import_rows.select(*_KEYS, text.matches_email(c("email")).alias("email_ok"),
                                F.coalesce((amount >= 0) & ~F.isnan(amount), F.lit(False)).alias("amount_ok"),
                                day.alias("date_ok"), text.matches_uuid4(ident).alias("uuid_ok"))


@query("v12_constraint_report", "table_name string, constraint_name string, violations bigint",
       """SELECT 'invoices' AS table_name, 'total_not_below_subtotal' AS constraint_name, count(*) FILTER (WHERE NOT total_amount >= subtotal) AS violations FROM invoices
          UNION ALL SELECT 'invoices', 'due_not_before_invoice', count(*) FILTER (WHERE NOT due_date >= invoice_date) FROM invoices
          UNION ALL SELECT 'invoice_lines', 'total_is_quantity_times_price', count(*) FILTER (WHERE NOT abs(line_total - quantity * unit_price) <= 0.01) FROM invoice_lines
          UNION ALL SELECT 'po_lines', 'quantity_positive', count(*) FILTER (WHERE NOT quantity > 0) FROM po_lines
          UNION ALL SELECT 'receipt_lines', 'condition_known', count(*) FILTER (WHERE condition NOT IN ('good', 'rejected')) FROM receipt_lines
          UNION ALL SELECT 'match_results', 'confidence_in_range', count(*) FILTER (WHERE NOT overall_confidence BETWEEN 0 AND 100) FROM match_results
          UNION ALL SELECT 'match_results', 'approved_has_confidence', count(*) FILTER (WHERE approval_status = 'auto_approved' AND overall_confidence < 90) FROM match_results
          UNION ALL SELECT 'user_sessions', 'expiry_after_creation', count(*) FILTER (WHERE NOT expires_at > created_at) FROM user_sessions
          UNION ALL SELECT 'user_sessions', 'access_before_expiry', count(*) FILTER (WHERE NOT last_accessed < expires_at - INTERVAL 1 HOUR) FROM user_sessions
          UNION ALL SELECT 'import_rows', 'number_unique_in_batch', count(*) - count(DISTINCT (import_batch_id, vendor_name, invoice_number)) FROM import_rows
          UNION ALL SELECT 'match_config', 'weights_sum_to_one', count(*) FILTER (WHERE abs(vendor_name_weight + amount_weight + date_weight + reference_weight - 1) > 0.001) FROM match_config""")
def _(e):
    report = validate.constraint_report([
        ("invoices", e.invoices, {"total_not_below_subtotal": c("total_amount") >= c("subtotal"), "due_not_before_invoice": c("due_date") >= c("invoice_date")}),
        ("invoice_lines", e.invoice_lines, {"total_is_quantity_times_price": F.abs(c("line_total") - c("quantity") * c("unit_price")) <= F.lit("0.01").cast("decimal(3,2)")}),
        ("po_lines", e.po_lines, {"quantity_positive": c("quantity") > 0}),
        ("receipt_lines", e.receipt_lines, {"condition_known": c("condition").isin("good", "rejected")}),
        ("match_results", e.match_results, {"confidence_in_range": c("overall_confidence").between(0, 100),
                                            "approved_has_confidence": (c("approval_status") != "auto_approved") | (c("overall_confidence") >= 90)}),
        ("user_sessions", e.user_sessions, {"expiry_after_creation": c("expires_at") > c("created_at"),
                                            "access_before_expiry": c("last_accessed") < c("expires_at") - F.expr("interval 1 hour")}),
        ("match_config", e.config("match_config"), {"weights_sum_to_one": F.abs(
            c("vendor_name_weight") + c("amount_weight") + c("date_weight") + c("reference_weight") - 1) <= 0.001}),
    ])
    groups = e.import_rows.groupBy("import_batch_id", "vendor_name", "invoice_number").count()
    repeats = groups.agg(F.coalesce(F.sum(c("count") - 1), F.lit(0)).alias("violations")).select(
        F.lit("import_rows").alias("table_name"), F.lit("number_unique_in_batch").alias("constraint_name"), "violations")
    return report.unionByName(repeats)


@query("v13_required_mapping", "import_batch_id bigint, field string",
       """SELECT b.import_batch_id, r.field FROM (SELECT DISTINCT import_batch_id FROM import_rows) AS b CROSS JOIN required_fields r
          WHERE NOT ((r.field = 'vendor' AND import_batch_id % 3 <> 0) OR (r.field = 'amount' AND import_batch_id % 5 <> 0) OR r.field IN ('invoice_number', 'invoice_date'))""")
def _(e):
    batches = e.import_rows.select("import_batch_id").distinct()
    mapped = F.array_compact(F.array(F.lit("invoice_number"), F.lit("invoice_date"),
                                     F.when(c("import_batch_id") % 3 != 0, F.lit("vendor")), F.when(c("import_batch_id") % 5 != 0, F.lit("amount"))))
    mapping = batches.select("import_batch_id", F.explode(mapped).alias("field"))
    needed = batches.join(F.broadcast(e.config("required_fields")))
    return needed.join(mapping, ["import_batch_id", "field"], "left_anti")


# --- dispositions -----------------------------------------------------------------------

_ALL = _sql(*_PARSE, *_REQUIRED, *_TYPES, *_AMOUNT, *_TAX, *_DATES, *_CROSS, *_VENDOR)
_MARKED = f"""SELECT p.*, known_id,
      p.vendor_name IS NOT NULL AND p.invoice_number IS NOT NULL AND
      row_number() OVER (PARTITION BY p.import_batch_id, p.vendor_name, p.invoice_number ORDER BY p.row_number) > 1 AS dup_batch,
      EXISTS (SELECT 1 FROM stored_invoices s WHERE s.tenant_id = p.tenant_id AND s.vendor_id = known_id AND s.invoice_number = p.invoice_number) AS dup_system
      FROM parsed_rows p LEFT JOIN ({_KNOWN}) AS k ON k.tenant_id = p.tenant_id AND k.uname = upper(trim(p.vendor_name))"""
_EXTRA = f""" UNION ALL SELECT import_batch_id, row_number, 'NEW_VENDOR', 'vendor_name', 'warning', vendor_name FROM ({_MARKED}) WHERE known_id IS NULL AND vendor_name IS NOT NULL
      UNION ALL SELECT import_batch_id, row_number, 'DUPLICATE_IN_BATCH', 'invoice_number', 'duplicate', invoice_number FROM ({_MARKED}) WHERE dup_batch
      UNION ALL SELECT import_batch_id, row_number, 'DUPLICATE_IN_SYSTEM', 'invoice_number', 'duplicate', invoice_number FROM ({_MARKED}) WHERE dup_system"""
_EVERY = _ALL + _EXTRA
_CHECKED = f"""SELECT m.*, CASE WHEN f.errors > 0 THEN 'error' WHEN dup_batch OR dup_system THEN 'duplicate' ELSE 'success' END AS disposition,
      coalesce(f.errors, 0) AS errors, coalesce(f.warnings, 0) AS warnings FROM ({_MARKED}) AS m LEFT JOIN (
      SELECT import_batch_id, row_number, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings
      FROM ({_EVERY}) GROUP BY ALL) AS f ON f.import_batch_id = m.import_batch_id AND f.row_number = m.row_number"""


def import_vendors(e):
    """Stored vendors under the name an import would normalise to."""
    return e.vendors


def checked(e):
    return validate.checked_import(e.parsed_rows, import_vendors(e), e.stored_invoices, doc_as_of())


@query("v14_row_disposition", "import_batch_id bigint, row_number int, disposition string",
       f"SELECT import_batch_id, row_number, disposition FROM ({_CHECKED})")
def _(e):
    return checked(e).select(*_KEYS, "disposition")


@query("w10_duplicate_in_batch", "import_batch_id bigint, row_number int, duplicate_in_batch boolean",
       f"SELECT import_batch_id, row_number, dup_batch AS duplicate_in_batch FROM ({_MARKED})")
def _(e):
    return validate.mark_batch_duplicates(e.parsed_rows, ["import_batch_id", "vendor_name", "invoice_number"], "row_number").select(*_KEYS, "duplicate_in_batch")


@query("j13_duplicate_in_system", "import_batch_id bigint, row_number int, duplicate_in_system boolean",
       f"SELECT import_batch_id, row_number, dup_system AS duplicate_in_system FROM ({_MARKED})")
def _(e):
    known = validate.mark_known_vendors(e.parsed_rows, e.vendors)
    return validate.mark_stored_duplicates(known, e.stored_invoices).select(*_KEYS, "duplicate_in_system")


@query("u04_all_findings", "import_batch_id bigint, row_number int, code string, severity string",
       f"SELECT import_batch_id, row_number, code, severity FROM ({_EVERY})")
def _(e):
    return validate.exploded(checked(e), _KEYS)


@query("f02_custom_rules", "import_batch_id bigint, row_number int, code string",
       "SELECT import_batch_id, row_number, 'NO_PO' AS code FROM parsed_rows WHERE po_reference IS NULL UNION ALL "
       "SELECT import_batch_id, row_number, 'WEEKEND' FROM parsed_rows WHERE isodow(invoice_date) >= 6")
def _(e):
    rules = [validate.finding(c("po_reference").isNull(), "NO_PO", "po_reference", c("po_reference")),
             validate.finding(F.weekday("invoice_date") >= 5, "WEEKEND", "invoice_date", c("invoice_date"))]
    return _findings(e, rules).select(*_KEYS, "code")


# --- outputs ------------------------------------------------------------------------------


@query("k02_accepted_invoices", "import_batch_id bigint, row_number int, invoice_number string, vendor_name string, subtotal decimal(18,2), tax_amount decimal(18,2), total_amount decimal(18,2), invoice_date date, due_date date, line_description string, line_total decimal(18,2)",
       f"""SELECT import_batch_id, row_number, invoice_number, vendor_name, coalesce(subtotal, total_amount) AS subtotal, coalesce(tax_amount, 0) AS tax_amount,
           total_amount, invoice_date, due_date, substring(description, 1, 500) AS line_description, CASE WHEN description IS NOT NULL THEN total_amount END AS line_total
           FROM ({_CHECKED}) WHERE disposition = 'success'""")
def _(e):
    """Written by batch and read back; writing a batch again replaces it."""
    inv, lines = vendors.accepted_records(staged(checked(e), "checked"))
    path = scratch_path(e.spark, "accepted")
    for _ in range(2):
        vendors.write_batches(inv, f"{path}/invoices")
        vendors.write_batches(lines, f"{path}/lines")
    inv, lines = vendors.read_batches(e.spark, f"{path}/invoices"), vendors.read_batches(e.spark, f"{path}/lines")
    return inv.join(lines.select(*_KEYS, c("description").alias("line_description"), "line_total"), _KEYS, "left")


@query("k03_row_errors", _F + ", seq int", f"SELECT import_batch_id, row_number, code, field, severity, raw, CAST(row_number() OVER (PARTITION BY import_batch_id, row_number ORDER BY code, field) - 1 AS INTEGER) AS seq FROM ({_EVERY})")
def _(e):
    """Written by batch and read back."""
    rows = checked(e).withColumn("findings", F.array_sort("findings"))
    path = scratch_path(e.spark, "row-errors")
    vendors.write_batches(validate.exploded(rows, _KEYS), path)
    return vendors.read_batches(e.spark, path)


# What a finding says besides its code; all other findings say nothing.
_HINTS = """SELECT * FROM (VALUES ('INVALID_AMOUNT', 'Numeric value (e.g., 1234.56)', ''), ('INVALID_DATE', 'YYYY-MM-DD or MM/DD/YYYY', ''),
    ('INVALID_TOTAL_AMOUNT_TYPE', 'Decimal number (e.g., 1234.56)', ''), ('INVALID_TAX_AMOUNT_TYPE', 'Decimal number (e.g., 1234.56)', ''),
    ('INVALID_INVOICE_DATE_TYPE', 'Date (YYYY-MM-DD)', ''), ('INVALID_DUE_DATE_TYPE', 'Date (YYYY-MM-DD)', ''), ('INVALID_VENDOR_FORMAT', 'Letters, digits, blanks and usual punctuation', ''),
    ('TAX_EXCEEDS_TOTAL', '', 'Check the tax against the total'), ('DUE_BEFORE_INVOICE', '', 'Move the due date behind the invoice date'),
    ('AMOUNT_CALCULATION_ERROR', '', 'Subtotal plus tax has to give the total'), ('DUPLICATE_IN_BATCH', '', 'Keep one of the equal entries'),
    ('DUPLICATE_IN_SYSTEM', '', 'Compare with the stored invoice')) AS hints(code, expected, fix)"""
_REPORTED = "2001-12-31 00:00:00"


@query("k04_error_report", "import_batch_id bigint, row_number int, column_name string, error_type string, error_code string, error_message string, severity string, raw_value string, expected_format string, suggested_fix string, created_at string, position bigint",
       f"""SELECT import_batch_id, row_number, coalesce(field, '') AS column_name, CASE severity WHEN 'duplicate' THEN 'duplicate' ELSE severity END AS error_type, e.code AS error_code,
           left(e.code, 1) || replace(lower(substring(e.code, 2)), '_', ' ') || ' (' || coalesce(field, '') || ')' AS error_message, severity,
           coalesce(raw, '') AS raw_value, coalesce(h.expected, '') AS expected_format, CASE WHEN e.code = 'NEGATIVE_AMOUNT' AND field = 'total_amount' THEN 'Enter an amount above zero' ELSE coalesce(h.fix, '') END AS suggested_fix,
           '{_REPORTED}' AS created_at, row_number() OVER (PARTITION BY import_batch_id ORDER BY row_number, e.code, coalesce(field, ''), coalesce(raw, '')) AS position FROM ({_EVERY}) AS e LEFT JOIN ({_HINTS}) AS h ON h.code = e.code""")
def _(e):
    """The report of each batch as CSV files with the ten columns of a report, read back."""
    rows = vendors.error_report(validate.exploded(checked(e), _KEYS), _REPORTED)
    path = scratch_path(e.spark, "error-reports")
    vendors.write_error_report(rows, path)
    return vendors.read_error_report(e.spark, path, rows)


@query("k09_batch_summary", "import_batch_id bigint, processed bigint, successful bigint, errors bigint, duplicates bigint, status string",
       f"""SELECT import_batch_id, count(*) AS processed, count(*) FILTER (WHERE disposition = 'success') AS successful, count(*) FILTER (WHERE disposition = 'error') AS errors,
           count(*) FILTER (WHERE disposition = 'duplicate') AS duplicates, CASE WHEN count(*) FILTER (WHERE disposition = 'success') > 0 THEN 'completed' ELSE 'failed' END AS status
           FROM ({_CHECKED}) GROUP BY import_batch_id""")
def _(e):
    return validate.batch_summary(checked(e))


@query("a18_validation_statistics", "total_rows bigint, valid_rows bigint, rows_with_errors bigint, rows_with_warnings bigint, total_errors bigint, total_warnings bigint, validation_rate double, error_rate double, warning_rate double",
       f"""SELECT count(*) AS total_rows, count(*) FILTER (WHERE errors = 0 AND warnings = 0) AS valid_rows, count(*) FILTER (WHERE errors > 0) AS rows_with_errors,
           count(*) FILTER (WHERE errors = 0 AND warnings > 0) AS rows_with_warnings, sum(errors) AS total_errors, sum(warnings) AS total_warnings,
           {sql_percent('count(*) FILTER (WHERE errors = 0 AND warnings = 0)', 'count(*)')} AS validation_rate, {sql_percent('count(*) FILTER (WHERE errors > 0)', 'count(*)')} AS error_rate,
           {sql_percent('count(*) FILTER (WHERE errors = 0 AND warnings > 0)', 'count(*)')} AS warning_rate FROM ({_CHECKED})""")
def _(e):
    n = lambda s: F.size(F.filter("findings", lambda f: f["severity"] == s))
    rows = checked(e).select(n("error").alias("errors"), n("warning").alias("warnings"))
    bad, soft = c("errors") > 0, (c("errors") == 0) & (c("warnings") > 0)
    sums = rows.agg(F.count("*").alias("total_rows"), F.count_if(~bad & ~soft).alias("valid_rows"), F.count_if(bad).alias("rows_with_errors"),
                    F.count_if(soft).alias("rows_with_warnings"), F.sum("errors").alias("total_errors"), F.sum("warnings").alias("total_warnings"))
    return sums.select("*", percent(c("valid_rows"), c("total_rows")).alias("validation_rate"),
                       percent(c("rows_with_errors"), c("total_rows")).alias("error_rate"), percent(c("rows_with_warnings"), c("total_rows")).alias("warning_rate"))


@query("a19_findings_by_code", "severity string, code string, occurrences bigint", f"SELECT severity, code, count(*) AS occurrences FROM ({_EVERY}) GROUP BY ALL")
def _(e):
    return validate.exploded(checked(e), _KEYS).groupBy("severity", "code").agg(F.count("*").alias("occurrences"))


@query("a39_import_progress", "import_batch_id bigint, processed bigint, successful bigint, failed bigint, last_row int",
       f"SELECT import_batch_id, count(*) AS processed, count(*) FILTER (WHERE disposition = 'success') AS successful, count(*) FILTER (WHERE disposition <> 'success') AS failed, max(row_number) AS last_row FROM ({_CHECKED}) GROUP BY ALL")
def _(e):
    ok = c("disposition") == "success"
    return checked(e).groupBy("import_batch_id").agg(F.count("*").alias("processed"), F.count_if(ok).alias("successful"),
                                                    F.count_if(~ok).alias("failed"), F.max("row_number").alias("last_row"))


@query("v18_error_list", "import_batch_id bigint, row_number int, code string, field string",
       f"SELECT import_batch_id, row_number, code, field FROM ({_EVERY}) WHERE severity = 'error' AND (contains(lower(code), 'amount') OR contains(lower(field), 'amount'))")
def _(e):
    found = validate.exploded(checked(e), _KEYS).filter("severity = 'error'")
    return found.filter(F.contains(F.lower("code"), F.lit("amount")) | F.contains(F.lower("field"), F.lit("amount")))


@query("o04_top_error_codes", "code string, occurrences bigint", f"SELECT code, count(*) AS occurrences FROM ({_EVERY}) WHERE severity = 'error' GROUP BY code ORDER BY 2 DESC, 1 LIMIT 5")
def _(e):
    found = validate.exploded(checked(e), _KEYS).filter("severity = 'error'")
    return found.groupBy("code").agg(F.count("*").alias("occurrences")).orderBy(F.desc("occurrences"), "code").limit(5)


@query("d04_vendor_get_or_create", "tenant_id int, vendor_name string, vendor_id bigint, created boolean, rows_using bigint",
       f"""SELECT p.tenant_id, p.vendor_name, known_id AS vendor_id, known_id IS NULL AS created, count(*) AS rows_using FROM ({_CHECKED}) AS p
           WHERE disposition = 'success' GROUP BY ALL""")
def _(e):
    return vendors.get_or_create(checked(e).filter("disposition = 'success'"))


@query("j12_po_by_number", "import_batch_id bigint, row_number int, po_id bigint",
       "SELECT import_batch_id, row_number, p.po_id FROM import_rows i LEFT JOIN purchase_orders p ON p.po_number = trim(i.po_reference) AND p.tenant_id = i.tenant_id")
def _(e):
    numbered = e.import_rows.select("tenant_id", *_KEYS, F.trim("po_reference").alias("po_number"))
    return numbered.join(e.purchase_orders.select("tenant_id", "po_number", "po_id"), ["tenant_id", "po_number"], "left")


def _coded(names: str, taken: str) -> str:
    """Codes of the names of ``names`` (tenant_id, vendor_name), behind those of ``taken``."""
    return f"""SELECT tenant_id, vendor_name, CASE WHEN first THEN base ELSE stem || CASE WHEN k + used < 10 THEN '0' || (k + used) ELSE CAST(k + used AS VARCHAR) END END AS vendor_code
        FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, stem, first ORDER BY draw, vendor_name) AS k
        FROM (SELECT b.*, n = 1 AND NOT EXISTS (SELECT 1 FROM ({taken}) AS t WHERE t.tenant_id = b.tenant_id AND t.vendor_code = base) AS first,
                     coalesce((SELECT coalesce(max(TRY_CAST(nullif(regexp_extract(vendor_code, '^.{{4}}([0-9]{{2,}})$', 1), '') AS BIGINT)), 1) FROM ({taken}) AS t WHERE t.tenant_id = b.tenant_id AND substring(t.vendor_code, 1, 4) = stem), 1) AS used
        FROM (SELECT *, substring(base, 1, 4) AS stem, substring(md5(vendor_name), 1, 3) AS draw, row_number() OVER (PARTITION BY tenant_id, base ORDER BY substring(md5(vendor_name), 1, 3), vendor_name) AS n
        FROM (SELECT tenant_id, vendor_name, CASE WHEN length(b) < 3 THEN rpad(b, 3, 'X') ELSE b END AS base
        FROM (SELECT DISTINCT tenant_id, vendor_name, substring(regexp_replace(upper(vendor_name), '[^A-Z0-9]', '', 'g'), 1, 6) AS b FROM ({names}))) AS named) AS b))"""


_TAKEN = _coded("SELECT tenant_id, name AS vendor_name FROM vendors", "SELECT NULL::INT AS tenant_id, NULL::VARCHAR AS vendor_code")


@query("w12_vendor_code_counter", "tenant_id int, vendor_name string, vendor_code string",
       _coded("SELECT tenant_id, vendor_name FROM parsed_rows WHERE vendor_name IS NOT NULL", _TAKEN))
def _(e):
    taken = names.assign_vendor_codes(e.vendors.select("tenant_id", c("name").alias("vendor_name")))
    new = e.parsed_rows.filter("vendor_name is not null").select("tenant_id", "vendor_name").distinct()
    return names.assign_vendor_codes(new, taken.select("tenant_id", "vendor_code"))
