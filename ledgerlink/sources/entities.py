"""Accounts-payable entities derived from the driver's star-schema and event tables.

Everything here is a lazy DataFrame. Money is cast to decimal once, in this layer, so
that no later step depends on floating-point text. ``ledgerlink.plans.oracle_ctes``
states the same derivation in SQL for the checks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerlink.functions.parse import read_date, read_money
from ledgerlink.functions.text import (
    blank, duplicate_vendor_name, import_vendor_name, stored_vendor_name,
)
from ledgerlink.operators import audit_chain
from ledgerlink.session import CODEC, scratch_path
from ledgerlink.sources.literals import CONFIG_SQL

DOC_AS_OF = "2001-12-31"
EVENT_AS_OF = "2024-01-31 00:00:00"
SESSION_AS_OF = "2024-01-30 20:00:00"

MONEY = "decimal(15,2)"
QTY = "decimal(15,4)"


def doc_as_of() -> Column:
    return F.lit(DOC_AS_OF).cast("date")


def event_as_of() -> Column:
    return F.lit(EVENT_AS_OF).cast("timestamp_ntz")


def session_as_of() -> Column:
    return F.lit(SESSION_AS_OF).cast("timestamp_ntz")


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def parse_rows(rows: DataFrame, year: int) -> DataFrame:
    """Import rows with every field read into its type (null when it cannot be)."""
    vendor = import_vendor_name(F.col("vendor_name"))
    return rows.select(
        "tenant_id", "import_batch_id", "row_number",
        F.col("invoice_number").alias("raw_number"), F.col("vendor_name").alias("raw_vendor"),
        F.col("total_amount").alias("raw_amount"), F.col("invoice_date").alias("raw_date"),
        F.when(~blank(F.col("invoice_number")), F.substring(F.trim("invoice_number"), 1, 100)).alias("invoice_number"),
        F.when(vendor != "", vendor).alias("vendor_name"),
        read_money(F.col("total_amount")).alias("total_amount"),
        read_date(F.col("invoice_date"), year).alias("invoice_date"),
        read_money(F.col("tax_amount")).alias("tax_amount"),
        read_money(F.col("subtotal")).alias("subtotal"),
        read_date(F.col("due_date"), year).alias("due_date"),
        F.col("tax_amount").alias("raw_tax"), F.col("due_date").alias("raw_due"),
        "description", "po_reference", "payment_terms", "email",
    )


class Entities:
    """Lazy entity DataFrames over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def config(self, name: str) -> DataFrame:
        """A small literal table (rules, tolerances, roles); its size never grows."""
        return self.spark.sql(CONFIG_SQL[name])

    # --- vendors -----------------------------------------------------------------

    @cached_property
    def tenants(self) -> DataFrame:
        return (
            self.raw("nation")
            .select((F.col("n_nationkey") % 4).alias("tenant_id"))
            .distinct()
            .withColumn("name", F.concat(F.lit("Tenant "), F.col("tenant_id")))
        )

    @cached_property
    def vendors(self) -> DataFrame:
        key = F.col("s_suppkey")
        ending = (
            F.when(key % 4 == 1, " Inc.").when(key % 4 == 2, " Trading Co")
            .when(key % 4 == 3, " & Sons LLC").otherwise("")
        )
        return self.raw("supplier").select(
            (F.col("s_nationkey") % 4).alias("tenant_id"),
            key.alias("vendor_id"),
            F.concat("s_name", ending).alias("name"),
            stored_vendor_name(F.concat("s_name", ending)).alias("normalized_name"),
            F.concat(F.lit("ap"), key, F.lit("@vendor"), key % 7, F.lit(".example")).alias("email"),
            F.concat(F.lit("+1-555-"), _pad(key, 10)).alias("phone"),
            F.concat(F.lit("TX"), _pad(key, 11)).alias("tax_id"),
            (key % 13 != 12).alias("is_active"),
            F.date_add(F.lit("1995-01-01").cast("date"), (key % 365).cast("int")).alias("created_at"),
        )

    @cached_property
    def vendors_dirty(self) -> DataFrame:
        key = F.col("s_suppkey")
        kind = key % 5
        twin = (
            F.when(kind == 1, F.concat("s_name", F.lit(" INC")))
            .when(kind == 2, F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("  "))))
            .when(kind == 3, F.concat(F.expr("substring(s_name, 1, 9)"), F.lit("O"),
                                      F.expr("substring(s_name, 11)")))
            .otherwise(F.col("s_name"))
        )
        base = self.raw("supplier").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
        is_twin = F.col("copy") == 1
        name = F.when(is_twin, twin).otherwise(F.col("s_name"))
        mail = F.concat(F.lit("ap"), key, F.lit("@vendor"), key % 7, F.lit(".example"))
        mail = F.when(is_twin & (kind == 1), F.upper(mail)).otherwise(mail)
        phone = F.when(is_twin, F.concat(F.lit("1555"), _pad(key, 10))).otherwise(
            F.concat(F.lit("+1-555-"), _pad(key, 10)))
        return base.select(
            (F.col("s_nationkey") % 4).alias("tenant_id"),
            (key * 10 + F.col("copy")).alias("vendor_id"),
            name.alias("name"),
            duplicate_vendor_name(name).alias("normalized_name"),
            F.when(~(is_twin & (kind == 4)), mail).alias("email"),
            F.when(~(is_twin & kind.isin(2, 4)), phone).alias("phone"),
            F.when(~(is_twin & (kind == 2)), F.concat(F.lit("TX"), _pad(key, 11))).alias("tax_id"),
            F.lit(True).alias("is_active"),
        )

    # --- purchase orders, invoices, receipts ---------------------------------------

    @cached_property
    def po_lines(self) -> DataFrame:
        w = W.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
        lines = self.raw("lineitem").withColumn("line_number", F.row_number().over(w))
        part = self.raw("part").select("p_partkey", "p_name", "p_type")
        price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 10000.0 + 0.5).cast("double") / 10000.0
        return lines.join(part, lines.l_partkey == part.p_partkey).select(
            F.col("l_orderkey").alias("po_id"),
            (F.col("l_orderkey") * 1000000 + F.col("line_number")).alias("po_line_id"),
            "line_number",
            F.when(F.col("l_partkey") % 17 != 0, F.concat(F.lit("ITEM-"), F.col("l_partkey"))).alias("item_code"),
            F.concat_ws(" ", "p_name", "p_type").alias("description"),
            F.col("l_quantity").cast(QTY).alias("quantity"),
            price.cast(QTY).alias("unit_price"),
            F.col("l_extendedprice").cast(MONEY).alias("line_total"),
            (F.floor(F.col("l_tax") * 100.0 + 0.5)).cast("decimal(7,2)").alias("tax_rate"),
        )

    @cached_property
    def purchase_orders(self) -> DataFrame:
        sums = self.raw("lineitem").groupBy("l_orderkey").agg(
            F.sum(F.col("l_extendedprice").cast(MONEY)).cast(MONEY).alias("total_amount"),
            F.min("l_suppkey").alias("vendor_id"),
        )
        owner = self.raw("supplier").select(
            F.col("s_suppkey").alias("vendor_id"), (F.col("s_nationkey") % 4).alias("tenant_id"))
        orders = self.raw("orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
        key = F.col("o_orderkey")
        status = (
            F.when(key % 50 == 48, "archived").when(F.col("o_orderstatus") == "O", "approved")
            .when(F.col("o_orderstatus") == "P", "partially_received").otherwise("received")
        )
        return (
            orders.join(sums, orders.o_orderkey == sums.l_orderkey)
            .join(owner, "vendor_id")
            .select(
                "tenant_id", key.alias("po_id"),
                F.concat(F.lit("PO"), _pad(key, 12)).alias("po_number"),
                "vendor_id",
                F.col("total_amount").alias("subtotal"),
                F.lit(0).cast(MONEY).alias("tax_amount"),
                "total_amount",
                F.col("o_orderdate").cast("date").alias("po_date"),
                status.alias("status"),
            )
        )

    @staticmethod
    def _factor(key: Column) -> Column:
        return (
            F.when(key % 10 == 6, F.lit("1.03")).when(key % 10 == 7, F.lit("1.20")).otherwise(F.lit("1.00"))
        ).cast("decimal(3,2)")

    @cached_property
    def invoices(self) -> DataFrame:
        key = F.col("po_id")
        total = (F.col("total_amount") * self._factor(key)).cast(MONEY)
        reference = (
            F.when(key % 10 == 8, F.concat(F.lit("POO"), F.expr("substring(po_number, 4)")))
            .when(key % 10 == 9, F.lit(None).cast("string")).otherwise(F.col("po_number"))
        )
        day = F.date_add("po_date", (key % 15).cast("int"))
        state = F.when(key % 7 == 0, "approved").when(key % 7 == 1, "cancelled").otherwise("pending")
        matching = F.when(key % 11 == 0, "matched").when(key % 13 == 0, "exception").otherwise("unmatched")
        tax = F.round(total * F.lit("0.05").cast("decimal(3,2)"), 2).cast(MONEY)
        return self.purchase_orders.filter(key % 20 != 19).select(
            "tenant_id",
            (key * 2 + 1).alias("invoice_id"),
            F.concat(F.lit("INV-"), _pad(key, 12)).alias("invoice_number"),
            "vendor_id",
            reference.alias("po_reference"),
            F.when(key % 10 <= 5, key).alias("po_id"),
            (total - tax).cast(MONEY).alias("subtotal"),
            tax.alias("tax_amount"),
            total.alias("total_amount"),
            day.alias("invoice_date"),
            F.date_add(day, 30).alias("due_date"),
            state.alias("status"),
            matching.alias("matching_status"),
        )

    @cached_property
    def invoice_lines(self) -> DataFrame:
        key = F.col("po_id")
        factor = self._factor(key)
        total = (F.col("line_total") * factor).cast(MONEY)
        return self.po_lines.filter(key % 20 != 19).select(
            (key * 2 + 1).alias("invoice_id"),
            (F.col("po_line_id") + 500000).alias("invoice_line_id"),
            "line_number",
            F.when(key % 10 == 8, F.lower("item_code")).otherwise(F.col("item_code")).alias("item_code"),
            F.when(key % 10 == 7, F.concat("description", F.lit(" item"))).otherwise(F.col("description")).alias("description"),
            "quantity",
            (F.col("unit_price") * factor).cast(QTY).alias("unit_price"),
            total.alias("line_total"),
            "tax_rate",
            (total * F.col("tax_rate") / F.lit(100).cast("decimal(3,0)")).cast(MONEY).alias("tax_amount"),
        )

    @cached_property
    def receipt_lines(self) -> DataFrame:
        key = F.col("po_id")
        part = (
            F.when(key % 4 == 1, F.array(F.lit("1.0"))).when(key % 4 == 2, F.array(F.lit("0.6")))
            .when(key % 4 == 3, F.array(F.lit("0.5"), F.lit("0.5")))
        )
        scaled = self.po_lines.filter(key % 4 != 0).select("*", F.posexplode(part).alias("copy", "part"))
        scale = F.col("part").cast("decimal(2,1)")
        return scaled.select(
            "po_id",
            (key * 10 + F.col("copy") + 1).alias("receipt_id"),
            (F.col("po_line_id") * 10 + F.col("copy") + 1).alias("receipt_line_id"),
            "po_line_id", "line_number",
            (F.col("quantity") * scale).cast(QTY).alias("quantity_received"),
            F.col("unit_price").alias("unit_cost"),
            (F.col("line_total") * scale).cast(MONEY).alias("line_value"),
            F.when(F.col("po_line_id") % 23 == 0, "damaged").otherwise("good").alias("condition"),
        )

    @cached_property
    def received(self) -> DataFrame:
        """Receipt lines as the receipts sum them up."""
        return self.receipt_lines

    @cached_property
    def receipts(self) -> DataFrame:
        sums = self.received.groupBy("po_id", "receipt_id").agg(
            F.sum("quantity_received").cast(QTY).alias("total_quantity"),
            F.sum("line_value").cast(MONEY).alias("total_value"),
        )
        key = F.col("po_id")
        return sums.join(
            self.purchase_orders.select("tenant_id", "po_id", "vendor_id", "po_date"), "po_id"
        ).select(
            "tenant_id", "receipt_id", "po_id", "vendor_id",
            F.concat(F.lit("GR"), _pad(F.col("receipt_id"), 13)).alias("receipt_number"),
            F.date_add("po_date", (key % 5 + 1).cast("int")).alias("receipt_date"),
            "total_quantity", "total_value",
            F.when(key % 9 == 0, "pending").otherwise("accepted").alias("status"),
        )

    @cached_property
    def stored_invoices(self) -> DataFrame:
        """Invoices that are in the system when an import runs. Import rows repeat all invoices, so
        that some are known and some new, every other fifty order numbers are stored."""
        return self.invoices.filter(F.floor((F.col("invoice_id") - 1) / 100) % 2 == 0)

    # --- import rows -------------------------------------------------------------

    @cached_property
    def import_rows(self) -> DataFrame:
        """Dirty string rows: twelve shapes keyed by the source order number."""
        inv = self.invoices.join(self.vendors.select("vendor_id", "name", "email"), "vendor_id")
        key = ((F.col("invoice_id") - 1) / 2).cast("bigint")
        m = key % 12
        group = F.floor(key / 12)
        amount = F.col("total_amount").cast("string")
        iso = F.date_format("invoice_date", "yyyy-MM-dd")
        pair = F.when(m == 8, key - 8).otherwise(key)
        tax = (
            F.when(m == 1, F.lit(None)).when(m == 2, F.lit("-5.00"))
            .when(m == 3, (F.col("total_amount") * F.lit("0.60").cast("decimal(3,2)")).cast(MONEY).cast("string"))
            .when(m == 11, F.lit("3000000.00")).otherwise(F.col("tax_amount").cast("string"))
        )
        return inv.select(
            "tenant_id",
            F.floor(key / 200).cast("bigint").alias("import_batch_id"),
            (key % 200 + 2).cast("int").alias("row_number"),
            F.when(m == 10, F.lit("  ")).otherwise(F.concat(F.lit("INV-"), _pad(pair, 12))).alias("invoice_number"),
            F.when(m == 7, F.lit("")).when(m.isin(0, 8), F.concat(F.lit("Bulk  Vendor "), group, F.lit(" Ltd")))
            .when(m == 5, F.lit("12345")).otherwise(F.col("name")).alias("vendor_name"),
            F.when(m == 3, F.concat(F.lit("$"), F.expr("format_number(total_amount, '#,##0.00')")))
            .when(m == 4, F.concat(F.lit("("), amount, F.lit(")")))
            .when(m == 5, F.lit("N/A")).when(m == 9, F.concat(F.lit("€ "), amount))
            .when(m == 11, F.lit("2500000.00")).otherwise(amount).alias("total_amount"),
            F.when(m == 3, F.date_format("invoice_date", "MM/dd/yyyy"))
            .when(m == 6, F.lit("2023-13-45")).when(m == 9, F.date_format("invoice_date", "yyyyMMdd"))
            .when(m == 2, F.date_format("invoice_date", "M/d/yy"))
            .when(m == 11, F.lit("2005-01-01")).otherwise(iso).alias("invoice_date"),
            tax.alias("tax_amount"),
            F.when(m == 9, (F.col("subtotal") + 1).cast(MONEY).cast("string"))
            .when(m.isin(1, 2, 3, 11), F.lit(None)).otherwise(F.col("subtotal").cast("string")).alias("subtotal"),
            F.date_format(
                F.when(m == 0, F.date_sub("invoice_date", 1)).when(m == 9, F.date_add("invoice_date", 400))
                .otherwise(F.col("due_date")), "yyyy-MM-dd").alias("due_date"),
            F.when(key % 3 != 0, F.concat(F.lit("Order "), key)).alias("description"),
            "po_reference",
            F.when(m == 4, "net").when(m == 6, "45 days").otherwise("30").alias("payment_terms"),
            F.when(m == 2, F.lit("not an address")).otherwise(F.col("email")).alias("email"),
        )

    @cached_property
    def parsed_rows(self) -> DataFrame:
        return parse_rows(self.import_rows, int(DOC_AS_OF[:4]))

    @cached_property
    def score_pairs(self) -> DataFrame:
        """Each invoice beside its own order and the next one, with names and receipt date."""
        names = self.vendors.select("vendor_id", "name", "normalized_name")
        left = self.invoices.select(
            "tenant_id", "invoice_id", F.col("vendor_id").alias("inv_vendor_id"),
            F.col("po_reference").alias("inv_ref"), F.col("total_amount").alias("inv_amount"), "invoice_date",
            F.explode(F.array(F.lit(0), F.lit(1))).alias("step"),
        ).withColumn("po_id", ((F.col("invoice_id") - 1) / 2).cast("bigint") + F.col("step"))
        right = self.purchase_orders.select(
            "po_id", "po_number", "po_date", F.col("total_amount").alias("po_amount"),
            F.col("vendor_id").alias("po_vendor_id"))
        receipt = self.receipts.filter("receipt_id % 10 = 1").select("po_id", "receipt_date")
        return (
            left.join(right, "po_id").join(receipt, "po_id", "left")
            .join(names.toDF("inv_vendor_id", "inv_vendor", "inv_norm"), "inv_vendor_id")
            .join(names.toDF("po_vendor_id", "po_vendor", "po_norm"), "po_vendor_id")
        )

    # --- match results from events -------------------------------------------------

    @cached_property
    def match_results(self) -> DataFrame:
        value = F.col("value")
        conf = F.least(value, F.lit(100.0)).cast("decimal(5,2)")
        key = F.floor(F.col("event_id") / 2).cast("bigint")
        base = self.raw("events").select(
            F.col("event_id").alias("match_result_id"),
            (F.col("user_id") % 4).cast("int").alias("tenant_id"),
            (key * 2 + 1).alias("invoice_id"),
            key.alias("po_id"),
            F.when(F.col("event_type").isin("click", "view"), "3way_full").otherwise("2way_po_invoice").alias("match_type"),
            conf.alias("overall_confidence"),
            F.when(conf >= 85, "auto_approved").when(F.col("event_type") == "error", "rejected")
            .otherwise("pending").alias("approval_status"),
            F.when(F.col("event_type") != "signup", F.col("event_id") % 977 + 5).alias("processing_time_ms"),
            F.col("event_type"),
            F.col("ts").alias("created_at"),
        )
        c = F.col("overall_confidence")
        return base.select(
            "*",
            F.when(c >= 95, "matched").when(c >= 70, "partial").when(c >= 50, "exception")
            .otherwise("failed").alias("match_status"),
            (c >= 85).alias("auto_approved"),
            ((c >= 70) & (c < 85)).alias("requires_review"),
            F.when(c >= 100, "exact").otherwise("fuzzy").alias("match_kind"),
        )

    @cached_property
    def match_exceptions(self) -> DataFrame:
        key = F.col("match_result_id")
        kind = (
            F.when(F.col("event_type") == "click", "amount_variance")
            .when(F.col("event_type") == "view", "vendor_mismatch")
            .when(F.col("event_type") == "purchase", "date_variance").otherwise("approval_required")
        )
        return self.match_results.filter(F.col("match_status") == "exception").select(
            key.alias("exception_id"), "match_result_id", "tenant_id",
            kind.alias("exception_type"),
            F.when(F.col("overall_confidence") < 60, "high").otherwise("medium").alias("severity"),
            F.when(key % 2 == 0, "resolved").when(key % 3 == 0, "in_review").otherwise("open").alias("status"),
            (key % 3 + 1).cast("int").alias("priority"),
            "created_at",
            F.when(key % 2 == 0, F.expr("created_at + make_dt_interval(0, cast(match_result_id % 72 as int), 0, 0)")).alias("resolved_at"),
        )

    # --- security ------------------------------------------------------------------

    @staticmethod
    def _mail(user: Column) -> Column:
        return F.when(user == 1, F.lit("admin@admin.com")).otherwise(
            F.concat(F.lit("user"), user, F.lit("@t"), user % 4, F.lit(".example")))

    @cached_property
    def auth_attempts(self) -> DataFrame:
        user, value = F.col("user_id"), F.col("value")
        ok = F.col("event_type") != "error"
        return self.raw("events").select(
            F.col("event_id").alias("attempt_id"), "user_id",
            (user % 4).cast("int").alias("tenant_id"),
            self._mail(user).alias("email"),
            F.concat(F.lit("10.0."), user % 4, F.lit("."), user).alias("ip_address"),
            ok.alias("success"),
            F.when(~ok, F.when(value > 100, "suspicious_activity").when(value > 50, "rate_limited")
                   .otherwise("invalid_password")).alias("failure_reason"),
            (value > 20).alias("mfa_required"),
            ((value > 20) & ok).alias("mfa_success"),
            F.col("ts").alias("attempted_at"),
        )

    @cached_property
    def security_audit(self) -> DataFrame:
        user, value = F.col("user_id"), F.col("value")
        return self.raw("events").select(
            F.col("event_id").alias("audit_id"),
            (user % 4).cast("int").alias("tenant_id"), "user_id", "event_type",
            F.concat(F.lit("10.0."), user % 4, F.lit("."), user).alias("ip_address"),
            F.when(value < 20, "low").when(value < 60, "medium").when(value < 150, "high")
            .otherwise("critical").alias("risk_level"),
            F.when(F.col("event_type") == "purchase", "invoice").when(F.col("event_type") == "signup", "user")
            .otherwise("report").alias("resource_type"),
            F.col("ts").alias("occurred_at"),
        )

    @cached_property
    def user_sessions(self) -> DataFrame:
        return self.raw("events").filter(F.col("event_type") == "view").select(
            F.col("event_id").alias("session_id"), "user_id",
            F.col("ts").alias("created_at"),
            F.expr("ts + interval 8 hours").alias("expires_at"),
            F.expr("ts + make_dt_interval(0, 0, cast(event_id % 480 as int), 0)").alias("last_accessed"),
            F.when(F.col("event_id") % 10 == 9, "terminated").otherwise("active").alias("status"),
        )

    @cached_property
    def users(self) -> DataFrame:
        user = F.col("user_id")
        seen = self.raw("events").groupBy("user_id").agg(F.max("ts").alias("last_login"))
        return seen.select(
            "user_id", (user % 4).cast("int").alias("tenant_id"),
            self._mail(user).alias("email"),
            (user % 3 != 0).alias("mfa_enabled"),
            F.when(user % 11 == 10, "inactive").otherwise("active").alias("auth_status"),
            F.when(user % 7 != 0, F.date_sub(F.lit("2024-01-31").cast("date"), (user % 120).cast("int"))).alias("password_changed_at"),
            F.expr("last_login - make_dt_interval(cast(user_id % 50 as int), 0, 0, 0)").alias("last_login"),
            F.when(user % 9 == 0, F.date_sub(F.lit("2024-01-31").cast("date"), (user % 5).cast("int"))).alias("account_locked_until"),
        )

    @cached_property
    def user_roles(self) -> DataFrame:
        user = F.col("user_id")
        granted = F.when(user % 5 == 0, F.array(user % 4, (user + 1) % 4)).otherwise(F.array(user % 4))
        first = self.users.select("user_id", "tenant_id", F.explode(granted).alias("role_id"))
        return first.select(
            "user_id", "tenant_id", F.col("role_id").cast("int"), (user % 10 != 9).alias("is_active"),
            F.when(user % 6 == 0, F.date_add(F.lit("2024-01-31").cast("date"), (user % 4 - 1).cast("int"))).alias("expires_at"),
        )

    @cached_property
    def metrics(self) -> DataFrame:
        return self.raw("events").select("event_id", F.col("event_type").alias("metric"), "value", "ts")

    # --- hash-linked audit log ------------------------------------------------------------

    AUDIT_FIELDS = ("audit_id", "tenant_id", "user_id", "event_type", "risk_level", "resource_type", "occurred_us")
    AUDIT_ORDER = ("occurred_us", "audit_id")

    @staticmethod
    def audit_block() -> Column:
        """Days of the log."""
        return F.floor(F.col("occurred_us") / 86400000000)

    @cached_property
    def audit_sealed(self) -> DataFrame:
        """The audit log as it was written: a chain per tenant."""
        rows = self.security_audit.withColumn("occurred_us", F.unix_micros(F.col("occurred_at").cast("timestamp")))
        return audit_chain.sealed(rows.select(*self.AUDIT_FIELDS), "tenant_id", self.AUDIT_ORDER, self.audit_block(), self.AUDIT_FIELDS)

    @cached_property
    def audit_heads(self) -> DataFrame:
        return audit_chain.heads(self.audit_sealed, "tenant_id", self.AUDIT_ORDER)

    @cached_property
    def audit_stored(self) -> DataFrame:
        """The log as found: in tenants 1 to 3, records edited, written anew with a new digest,
        moved by half a day, and deleted; the last day of tenant 3 is gone."""
        key = F.col("audit_id")
        touched = F.col("tenant_id") != 0
        edited, anew, moved = touched & (key % 97 == 5), touched & (key % 211 == 7), touched & (key % 307 == 20)
        found = self.audit_sealed.withColumn("risk_level", F.when(edited, F.when(F.col("risk_level") == "low", "medium").otherwise("low")).otherwise(F.col("risk_level")))
        found = found.withColumn("event_type", F.when(anew, "export").otherwise(F.col("event_type")))
        found = found.withColumn("occurred_us", F.when(moved, F.col("occurred_us") + 43200000000).otherwise(F.col("occurred_us")))
        found = found.withColumn("record_hash", F.when(anew | moved, audit_chain.record_hash(self.AUDIT_FIELDS)).otherwise(F.col("record_hash")))
        last_day = F.unix_micros(F.lit("2024-01-30 00:00:00").cast("timestamp"))
        return found.filter(~(touched & (key % 251 == 9)) & ~((F.col("tenant_id") == 3) & (F.col("occurred_us") >= last_day)))

    # --- invoices of external systems ------------------------------------------------------

    @cached_property
    def external_feed(self) -> DataFrame:
        """Versions of invoices in three external systems, with the run from which each is seen.

        An invoice has one to three versions, 40 days apart. Runs see what was updated before
        mid-1997 and before mid-1998, and everything; an update of the ten days before a run may
        arrive one run late.
        """
        key = ((F.col("invoice_id") - 1) / 2).cast("bigint")
        count = F.when(key % 5 == 0, 3).when(key % 3 != 0, 2).otherwise(1)
        base = self.invoices.select("*", key.alias("k"), F.explode(F.sequence(F.lit(0), count - 1)).alias("version"))
        at = F.expr("cast(invoice_date as timestamp_ntz) + make_dt_interval(version * 40, cast(k % 24 as int), 0, 0)")
        rows = base.withColumn("updated_at", at)

        def run(first: str, second: str) -> Column:
            at = F.col("updated_at")
            return F.when(at < F.lit(first).cast("timestamp_ntz"), 1).when(at < F.lit(second).cast("timestamp_ntz"), 2).otherwise(3)

        late = F.col("k") % 7 == 0
        shifted = F.expr("updated_at + interval 10 days")
        on_time = run("1997-06-01 00:00:00", "1998-06-01 00:00:00")
        arrival = F.when(late, F.when(shifted >= F.lit("1998-06-01 00:00:00").cast("timestamp_ntz"), 3).when(shifted >= F.lit("1997-06-01 00:00:00").cast("timestamp_ntz"), 2).otherwise(1)).otherwise(on_time)
        return rows.select(
            "tenant_id", F.concat(F.lit("X"), "invoice_id").alias("external_id"),
            F.element_at(F.array(F.lit("quickbooks"), F.lit("xero"), F.lit("netsuite")), (F.col("vendor_id") % 3 + 1).cast("int")).alias("external_system"),
            "invoice_number", (F.col("total_amount") + F.col("version")).cast(MONEY).alias("amount"),
            F.element_at(F.array(F.lit("pending"), F.lit("approved"), F.lit("paid")), F.col("version") + 1).alias("status"),
            "version", "updated_at", arrival.alias("arrival"))

    # --- vectors, erasure requests, control tests --------------------------------------------

    def document_vectors(self, documents: DataFrame, key: str, shift: int) -> DataFrame:
        """(key, vec): the vector whose id is the order number plus ``shift``, modulo the number of
        vectors (every vector id below it exists)."""
        vectors = self.raw("embeddings").select("vec_id", F.col("embedding").alias("vec"))
        number = F.col(key) if key == "po_id" else ((F.col(key) - 1) / 2).cast("bigint")
        count = vectors.agg(F.count("*").alias("_all"))
        placed = documents.select(key, number.alias("_k")).join(F.broadcast(count)).select(key, ((F.col("_k") + shift) % F.col("_all")).alias("vec_id"))
        return placed.join(vectors, "vec_id").drop("vec_id")

    @cached_property
    def erasure_requests(self) -> DataFrame:
        """One request per user with a password change, 20 days before it; those of users with
        ``user_id % 7`` below 3 are completed."""
        user = F.col("user_id")
        received = F.date_sub("password_changed_at", 20)
        return self.users.filter("password_changed_at is not null").select(
            user.alias("request_id"), "tenant_id", "user_id", received.alias("received_at"), F.when(user % 7 < 3, F.date_add(received, (user % 7 * 9).cast("int"))).alias("completed_at"))

    @cached_property
    def control_tests(self) -> DataFrame:
        """A control test per archived order: control by order number, result by its total, tested
        within 70 days after its quarter."""
        key = F.col("po_id")
        controls = ("IT-01-01", "IT-01-02", "IT-02-01", "IT-02-02", "IT-03-01", "IT-04-01", "IT-05-01", "FN-01-01")
        quarter = F.trunc("po_date", "quarter")
        cents = (F.col("total_amount") * 100).cast("bigint")
        return self.purchase_orders.filter("status = 'archived'").select(
            key.alias("test_id"), "tenant_id", F.element_at(F.array(*map(F.lit, controls)), (F.floor(key / 50) % 8 + 1).cast("int")).alias("control_id"),
            quarter.alias("quarter"), F.date_add(F.add_months(quarter, 3), (cents % 70).cast("int")).alias("tested_at"),
            F.when(cents % 6 == 0, "DEFICIENT").when(cents % 11 == 0, "NOT TESTED").otherwise("EFFECTIVE").alias("result"))

    @cached_property
    def audit_events(self) -> DataFrame:
        """Change events with the new values as JSON text."""
        r = self.match_results
        kind = F.col("match_result_id") % 3
        invoice = F.to_json(F.struct(F.concat(F.lit("INV-"), "invoice_id").alias("invoice_number"), F.col("overall_confidence").cast("string").alias("amount"), F.col("approval_status").alias("status"), F.lit("x").alias("note")))
        result = F.to_json(F.struct(F.col("overall_confidence").cast("string").alias("confidence_score"), F.col("match_status").alias("status"), "match_type"))
        other = F.to_json(F.struct("match_result_id"))
        return r.join(self.raw("events").select(F.col("event_id").alias("match_result_id"), "user_id"), "match_result_id").select(
            F.col("match_result_id").alias("audit_event_id"), "tenant_id", F.when(kind == 0, "invoices").when(kind == 1, "match_results").otherwise("vendors").alias("table_name"),
            F.col("created_at").alias("changed_at"), (F.col("user_id") + F.when(kind == 2, 1000000).otherwise(0)).alias("changed_by"),
            F.when(kind == 0, invoice).when(kind == 1, result).otherwise(other).alias("new_values"))


# Documents a deployment keeps as tables; the matching runs read them many times. Invoices, their lines and
# receipt lines are a row-by-row reading of these, so storing them as well would only write them twice.
STORED = ("vendors", "po_lines", "purchase_orders", "receipts")
_WRITTEN: dict[tuple[str, str, str], str] = {}


class StoredEntities(Entities):
    """Entities whose document tables are written once per session to the shared folder.

    The matching runs touch orders, lines and receipts repeatedly. Reading them
    from parquet gives every use its own column pruning and filter pushdown instead of
    deriving the table again from the line items.
    """

    @cached_property
    def received(self) -> DataFrame:
        """Receipt lines of the stored order lines if there are any. Sums need neither line numbers nor texts, so
        a run without lines derives these few columns instead of numbering and storing all lines."""
        known = (self.spark.sparkContext.applicationId, self.sf_dir, "po_lines") in _WRITTEN
        return (self if known else Entities(self.spark, self.sf_dir)).receipt_lines

    def stored(self, name: str) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _WRITTEN:
            path = scratch_path(self.spark, name)
            Entities.__dict__[name].func(self).write.option("compression", CODEC).parquet(path)
            _WRITTEN[key] = path
        return self.spark.read.parquet(_WRITTEN[key])


for _name in STORED:
    setattr(StoredEntities, _name, property(lambda self, n=_name: self.stored(n)))
