"""Row checks for imported invoices, all evaluated in one projection.

A rule is a function from a row to a Column holding a finding struct or null. ``findings``
gathers every rule's result into one array column, so a row is read once however many
rules there are. ``RULES`` is open: callers may pass their own list.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerlink.functions.text import blank, matches_email, vendor_format_ok

c = F.col
Rule = Callable[[Column], Column]

# Limits of the business rules.
MAX_AMOUNT, MAX_AGE_DAYS, MAX_TERMS_DAYS, MAX_TAX_SHARE, ROUNDING_SLACK = 1000000, 1095, 365, 0.5, "0.02"
FINDING = "struct<code:string,field:string,severity:string,kind:string,raw:string,expected:string,fix:string>"


def finding(when: Column, code: str, field: str, raw: Column, severity: str = "error", kind: str = "business_rule",
            expected: str | None = None, fix: str | None = None) -> Column:
    body = F.struct(
        F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit(severity).alias("severity"), F.lit(kind).alias("kind"),
        raw.cast("string").alias("raw"), F.lit(expected).cast("string").alias("expected"), F.lit(fix).cast("string").alias("fix"))
    return F.when(F.coalesce(when, F.lit(False)), body)


def required_rules() -> list[Column]:
    """Required fields present after reading."""
    return [finding(blank(c(f).cast("string")), f"MISSING_{f.upper()}", f, c(r), kind="validation")
            for f, r in (("invoice_number", "raw_number"), ("vendor_name", "raw_vendor"),
                         ("total_amount", "raw_amount"), ("invoice_date", "raw_date"))]


def type_rules() -> list[Column]:
    """A raw value is there but could not be read as its type."""
    number, day = "Decimal number (e.g., 1234.56)", "Date (YYYY-MM-DD)"
    return [finding(~blank(c(r)) & c(f).isNull(), f"INVALID_{f.upper()}_TYPE", f, c(r), kind="validation", expected=x)
            for f, r, x in (("total_amount", "raw_amount", number), ("tax_amount", "raw_tax", number),
                            ("invoice_date", "raw_date", day), ("due_date", "raw_due", day))]


def parse_rules(as_of: Column) -> list[Column]:
    """What the reader itself reports for the four mapped fields."""
    amount = "Numeric value (e.g., 1234.56)"
    return [
        finding(c("invoice_number").isNull(), "MISSING_INVOICE_NUMBER", "invoice_number", c("raw_number"), kind="validation"),
        finding(c("vendor_name").isNull(), "MISSING_VENDOR", "vendor", c("raw_vendor"), kind="validation"),
        finding(c("total_amount").isNull(), "INVALID_AMOUNT", "amount", c("raw_amount"), kind="validation", expected=amount),
        finding(c("total_amount") <= 0, "NEGATIVE_AMOUNT", "amount", c("raw_amount")),
        finding(c("invoice_date").isNull(), "INVALID_DATE", "invoice_date", c("raw_date"), kind="validation",
                expected="YYYY-MM-DD or MM/DD/YYYY"),
        finding(c("invoice_date") > as_of, "FUTURE_DATE", "invoice_date", c("raw_date"), "warning"),
    ]


def amount_rules() -> list[Column]:
    return [
        finding(c("total_amount") <= 0, "NEGATIVE_AMOUNT", "total_amount", c("total_amount"), fix="Enter an amount above zero"),
        finding(c("total_amount") > MAX_AMOUNT, "AMOUNT_TOO_LARGE", "total_amount", c("total_amount"), "warning"),
    ]


def tax_rules() -> list[Column]:
    share = F.try_divide(c("tax_amount").cast("double"), c("total_amount").cast("double"))
    return [
        finding(c("tax_amount") < 0, "NEGATIVE_TAX", "tax_amount", c("tax_amount")),
        finding(c("tax_amount") > c("total_amount"), "TAX_EXCEEDS_TOTAL", "tax_amount", c("tax_amount"),
                fix="Check the tax against the total"),
        finding(share > MAX_TAX_SHARE, "HIGH_TAX_RATE", "tax_amount", c("tax_amount"), "warning"),
    ]


def date_rules(as_of: Column) -> list[Column]:
    return [
        finding(F.datediff(as_of, c("invoice_date")) > MAX_AGE_DAYS, "DATE_TOO_OLD", "invoice_date", c("invoice_date"), "warning"),
        finding(c("invoice_date") > as_of, "FUTURE_DATE", "invoice_date", c("invoice_date"), "warning"),
        finding(c("due_date") < c("invoice_date"), "DUE_BEFORE_INVOICE", "due_date", c("due_date"), fix="Move the due date behind the invoice date"),
        finding(F.datediff("due_date", "invoice_date") > MAX_TERMS_DAYS, "LONG_PAYMENT_TERMS", "due_date", c("due_date"), "warning"),
    ]


def cross_field_rules() -> list[Column]:
    off = F.abs(c("total_amount") - (c("subtotal") + c("tax_amount"))) > F.lit(ROUNDING_SLACK).cast("decimal(5,2)")
    return [finding(off, "AMOUNT_CALCULATION_ERROR", "total_amount", c("total_amount"),
                    fix="Subtotal plus tax has to give the total")]


def vendor_rules() -> list[Column]:
    return [finding(~vendor_format_ok(c("vendor_name")), "INVALID_VENDOR_FORMAT", "vendor_name", c("vendor_name"), kind="validation",
                    expected="Letters, digits, blanks and usual punctuation")]


def short_rules() -> list[Column]:
    """The lighter check: required cells, a usable amount and date, an e-mail shape."""
    number = F.regexp_extract(F.trim(c("raw_amount")), r"^([+-]?(\d+(\.\d*)?|\.\d+))", 1).try_cast("double")
    return [
        finding(blank(c("raw_number")), "REQUIRED", "invoice_number", c("raw_number")),
        finding(blank(c("raw_vendor")), "REQUIRED", "vendor_name", c("raw_vendor")),
        finding(~blank(c("raw_amount")) & ~F.coalesce(number >= 0, F.lit(False)), "AMOUNT", "amount", c("raw_amount")),
        finding(~blank(c("raw_date")) & c("raw_date").try_cast("date").isNull(), "DATE", "invoice_date", c("raw_date")),
        finding(~blank(c("email")) & ~matches_email(c("email")), "EMAIL", "email", c("email")),
    ]


def all_rules(as_of: Column) -> list[Column]:
    return [*parse_rules(as_of), *required_rules(), *type_rules(), *amount_rules(), *tax_rules(), *date_rules(as_of),
            *cross_field_rules(), *vendor_rules()]


def with_findings(rows: DataFrame, rules: Sequence[Column], name: str = "findings") -> DataFrame:
    return rows.withColumn(name, F.array_compact(F.array(*rules)))


def exploded(rows: DataFrame, keys: Sequence[str], name: str = "findings") -> DataFrame:
    """One row per finding with its position in the row's list."""
    return rows.select(*keys, F.posexplode(name).alias("seq", "f")).select(*keys, "seq", "f.*")


def mark_batch_duplicates(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Flag every row after the first (by ``order``) with equal keys.

    The first position per key is a map-side combined minimum joined back, so a heavily
    repeated key is never sorted in one task.
    """
    usable = rows
    for k in keys:
        usable = usable.filter(c(k).isNotNull())
    first = usable.groupBy(*keys).agg(F.min(order).alias("_first"))
    return rows.join(first, list(keys), "left").withColumn(
        "duplicate_in_batch", F.coalesce(c(order) > c("_first"), F.lit(False))).drop("_first")


def mark_known_vendors(rows: DataFrame, vendors: DataFrame, tenant: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """Attach the stored vendor whose upper-cased name equals the row's (smallest id wins)."""
    known = vendors.groupBy(*tenant, F.upper(F.trim("name")).alias("_name")).agg(F.min("vendor_id").alias("vendor_id"))
    keyed = rows.withColumn("_name", F.upper(F.trim("vendor_name")))
    return keyed.join(known, [*tenant, "_name"], "left").drop("_name")


def mark_stored_duplicates(rows: DataFrame, invoices: DataFrame) -> DataFrame:
    """Flag rows whose vendor and number are already stored for the tenant."""
    stored = invoices.select("tenant_id", "vendor_id", "invoice_number").distinct().withColumn("_stored", F.lit(True))
    return rows.join(stored, ["tenant_id", "vendor_id", "invoice_number"], "left").withColumn(
        "duplicate_in_system", F.coalesce("_stored", F.lit(False))).drop("_stored")


def disposition(findings: Column, duplicate: Column) -> Column:
    """error beats duplicate beats success."""
    failed = F.exists(findings, lambda f: f["severity"] == "error")
    return F.when(failed, "error").when(duplicate, "duplicate").otherwise("success")


def checked_import(rows: DataFrame, vendors: DataFrame, invoices: DataFrame, as_of: Column) -> DataFrame:
    """Import rows with findings, vendor id, both duplicate flags and their disposition."""
    marked = mark_batch_duplicates(rows, ["import_batch_id", "vendor_name", "invoice_number"], "row_number")
    known = mark_stored_duplicates(mark_known_vendors(marked, vendors), invoices)
    extra = [
        finding(c("vendor_id").isNull() & c("vendor_name").isNotNull(), "NEW_VENDOR", "vendor_name", c("vendor_name"), "warning", "validation"),
        finding(c("duplicate_in_batch"), "DUPLICATE_IN_BATCH", "invoice_number", c("invoice_number"), "duplicate", "duplicate",
                fix="Keep one of the equal entries"),
        finding(c("duplicate_in_system"), "DUPLICATE_IN_SYSTEM", "invoice_number", c("invoice_number"), "duplicate", "duplicate",
                fix="Compare with the stored invoice"),
    ]
    read = parse_rules(as_of)
    full = with_findings(known, read, "from_parse")
    full = with_findings(full, [*all_rules(as_of)[len(read):], *extra], "from_rules")
    full = full.withColumn("findings", F.concat("from_parse", "from_rules")).drop("from_parse", "from_rules")
    return full.withColumn("disposition", disposition(c("findings"), c("duplicate_in_batch") | c("duplicate_in_system")))


def batch_summary(checked: DataFrame) -> DataFrame:
    """One row per import batch: counts by disposition and the final status."""
    d = c("disposition")
    sums = checked.groupBy("import_batch_id").agg(
        F.count("*").alias("processed"), F.count_if(d == "success").alias("successful"),
        F.count_if(d == "error").alias("errors"), F.count_if(d == "duplicate").alias("duplicates"))
    return sums.withColumn("status", F.when(c("successful") > 0, "completed").otherwise("failed"))


def constraint_report(checks: Sequence[tuple[str, DataFrame, dict[str, Column]]]) -> DataFrame:
    """(table, constraint, violations) rows; one aggregate pass per table."""
    out = None
    for table, df, predicates in checks:
        labels = list(predicates)
        counts = df.agg(*[F.count_if(~F.coalesce(p, F.lit(True))).alias(f"k{i}") for i, p in enumerate(predicates.values())])
        pairs = F.array(*[F.struct(F.lit(n).alias("constraint_name"), c(f"k{i}").alias("violations")) for i, n in enumerate(labels)])
        part = counts.select(F.lit(table).alias("table_name"), F.explode(pairs).alias("x")).select("table_name", "x.*")
        out = part if out is None else out.unionByName(part)
    return out
