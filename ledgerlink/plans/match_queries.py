"""Candidate search, matching runs and decisions over the whole tables."""

from pyspark.sql import functions as F

from ledgerlink.functions import fuzzy, scores
from ledgerlink.functions.numeric import round_half_up
from ledgerlink.operators import candidates, changes, match, names, vendors
from ledgerlink.plans.oracle_ctes import sql_round, sql_similarities, sql_soundex, sql_variants, sql_windows
from ledgerlink.plans.registry import stored_query as query
from ledgerlink.session import staged
from ledgerlink.sources.entities import doc_as_of

c = F.col


_PO = "tenant_id int, po_id bigint, po_number string, vendor_id bigint, total_amount decimal(15,2), po_date date, status string"


@query("s09_tenant_scan", _PO, "SELECT * FROM purchase_orders WHERE tenant_id = 2")
def _(e):
    return e.purchase_orders.filter("tenant_id = 2")


@query("s10_unmatched_work", "invoice_id bigint, invoice_number string, total_amount decimal(15,2)",
       "SELECT * FROM invoices WHERE matching_status = 'unmatched' AND (invoice_id - 1) // 2 IN (SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))")
def _(e):
    wanted = e.raw("orders").filter(c("o_orderpriority").isin("1-URGENT", "2-HIGH")).select((c("o_orderkey") * 2 + 1).alias("invoice_id"))
    return e.invoices.filter("matching_status = 'unmatched'").join(wanted, "invoice_id", "left_semi")


@query("s11_latest_config", "tenant_id int, vendor_name_weight double, amount_weight double, auto_approve_threshold double, invoices bigint",
       """SELECT m.tenant_id, vendor_name_weight, amount_weight, auto_approve_threshold, count(invoice_id) AS invoices FROM
          (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC) AS n FROM match_config WHERE is_active) AS m
          LEFT JOIN invoices i ON i.tenant_id = m.tenant_id WHERE n = 1 GROUP BY ALL""")
def _(e):
    cfg = match.latest(e.config("match_config").filter("is_active"), ["tenant_id"], [c("created_at")])
    counts = e.invoices.groupBy("tenant_id").agg(F.count("*").alias("invoices"))
    return cfg.join(counts, "tenant_id", "left").na.fill(0, ["invoices"])


@query("s12_open_invoices", "invoice_id bigint",
       "SELECT invoice_id FROM invoices WHERE invoice_id NOT IN (SELECT invoice_id FROM match_results WHERE approval_status <> 'rejected')")
def _(e):
    done = e.match_results.filter("approval_status <> 'rejected'").select("invoice_id")
    return e.invoices.join(done, "invoice_id", "left_anti")


# --- joins ------------------------------------------------------------------------------------

_EXACT = """SELECT invoice_id, min(p.po_id) AS po_id FROM invoices i JOIN purchase_orders p ON p.tenant_id = i.tenant_id AND p.vendor_id = i.vendor_id
            AND p.po_number = i.po_reference AND p.total_amount = i.total_amount AND p.status <> 'archived' GROUP BY invoice_id"""


@query("j01_exact_match", "invoice_id bigint, po_id bigint, confidence double", f"SELECT invoice_id, po_id, 1.0e0 AS confidence FROM ({_EXACT})")
def _(e):
    return match.exact_matches(e.invoices, e.purchase_orders).withColumn("confidence", F.lit(1.0))


_V = "CAST(abs(i.total_amount - p.total_amount) AS DOUBLE) / CAST(greatest(i.total_amount, p.total_amount) AS DOUBLE)"
_G = "CAST(abs(datediff('day', p.po_date, i.invoice_date)) AS DOUBLE)"
_BAND = f"""SELECT *, a * 0.4e0 + d * 0.2e0 AS partial_score FROM (
    SELECT i.invoice_id, p.po_id,
    greatest(0.0e0, CASE WHEN {_V} <= 0.05e0 OR abs(i.total_amount - p.total_amount) <= 10 THEN 1.0e0 - {_V} ELSE 0.5e0 - {_V} END) AS a,
    CASE WHEN {_G} <= 7 THEN greatest(0.7e0, 1.0e0 - {_G} / 30.0e0) ELSE greatest(0.0e0, 0.5e0 - {_G} / 60.0e0) END AS d
    FROM invoices i JOIN purchase_orders p ON p.tenant_id = i.tenant_id AND p.status <> 'archived' AND p.po_date BETWEEN i.invoice_date - 30 AND i.invoice_date + 7
    WHERE i.invoice_id NOT IN (SELECT invoice_id FROM ({_EXACT})))"""


def _rest(e):
    return e.invoices.join(match.exact_matches(e.invoices, e.purchase_orders), "invoice_id", "left_anti")


@query("j02_fuzzy_candidates", "invoice_id bigint, po_id bigint, amount_score double, date_score double",
       f"SELECT invoice_id, po_id, {sql_round('a', 6)} AS amount_score, {sql_round('d', 6)} AS date_score FROM ({_BAND}) WHERE 0.3e0 + 0.1e0 + a * 0.4e0 + d * 0.2e0 >= 0.7e0 - 0.00005e0")
def _(e):
    return candidates.fuzzy_candidates(_rest(e), e.purchase_orders).select(
        "invoice_id", "po_id", round_half_up(c("amount_score"), 6).alias("amount_score"), round_half_up(c("date_score"), 6).alias("date_score"))


_J03 = """SELECT i.invoice_id, p.po_id, 1 AS place FROM invoices i JOIN purchase_orders p ON p.po_id = i.po_id AND p.tenant_id = i.tenant_id
          WHERE p.status IN ('approved', 'partially_received', 'received') UNION ALL
          SELECT invoice_id, po_id, place FROM (SELECT i.invoice_id, p.po_id,
          row_number() OVER (PARTITION BY i.invoice_id ORDER BY abs(datediff('day', p.po_date, i.invoice_date)), p.po_id) AS place
          FROM invoices i JOIN purchase_orders p ON p.tenant_id = i.tenant_id AND p.vendor_id = i.vendor_id
          WHERE i.po_id IS NULL AND p.status IN ('approved', 'partially_received', 'received')) WHERE place <= 10"""
_J05 = """SELECT invoice_id, receipt_id, place FROM (SELECT i.invoice_id, r.receipt_id,
          row_number() OVER (PARTITION BY i.invoice_id ORDER BY abs(datediff('day', r.receipt_date, i.invoice_date)), r.receipt_id) AS place
          FROM invoices i JOIN receipts r ON r.tenant_id = i.tenant_id AND r.vendor_id = i.vendor_id WHERE r.status = 'accepted') WHERE place <= 10"""


@query("j03_order_candidates", "invoice_id bigint, po_id bigint, place int", _J03)
def _(e):
    return candidates.order_candidates(e.invoices, e.purchase_orders)


@query("j05_receipt_candidates", "invoice_id bigint, receipt_id bigint, place int", _J05)
def _(e):
    return candidates.receipt_candidates(e.invoices, e.receipts)


_BV = ("CASE WHEN iv.normalized_name = pv.normalized_name THEN 100.0e0 ELSE CAST(greatest(length(iv.normalized_name), length(pv.normalized_name)) - levenshtein(iv.normalized_name, pv.normalized_name) AS DOUBLE)"
       " / greatest(length(iv.normalized_name), length(pv.normalized_name)) * 100.0e0 END")
_X, _Y = "CAST(i.total_amount AS DOUBLE)", "CAST(p.total_amount AS DOUBLE)"
_T = f"greatest(({_X} + {_Y}) / 2.0e0 * 0.05e0, 10.0e0)"
_BA = (f"CASE WHEN abs({_X} - {_Y}) <= {_T} THEN 100.0e0 - abs({_X} - {_Y}) / {_T} * 20.0e0 "
       f"ELSE greatest(0.0e0, 100.0e0 - abs({_X} - {_Y}) / (({_X} + {_Y}) / 2.0e0) * 100.0e0) END")
_BD = f"CASE WHEN {_G} <= 7 THEN 100.0e0 - {_G} / 7.0e0 * 30.0e0 ELSE greatest(0.0e0, 100.0e0 - {_G} * 2.0e0) END"
_PAIRS = f"""SELECT k.invoice_id, k.po_id, k.place, i.invoice_date, {_BV} AS v, {_BA} AS a, {_BD} AS d
    FROM ({_J03}) AS k JOIN invoices i ON i.invoice_id = k.invoice_id JOIN purchase_orders p ON p.po_id = k.po_id
    JOIN vendors iv ON iv.vendor_id = i.vendor_id JOIN vendors pv ON pv.vendor_id = p.vendor_id"""
_TRIPLES = f"""SELECT q.*, n.receipt_id, n.place AS rplace, CASE WHEN r.receipt_date <= q.invoice_date THEN 90.0e0 ELSE 60.0e0 END AS r
    FROM ({_PAIRS}) AS q JOIN ({_J05}) AS n ON n.invoice_id = q.invoice_id JOIN receipts r ON r.receipt_id = n.receipt_id AND r.po_id = q.po_id"""
_BANDRUN = f"""SELECT tenant_id, invoice_id, po_id, receipt_id, match_type, {sql_round('x', 4)} AS confidence,
    CASE WHEN x >= 95 THEN 'matched' WHEN x >= 70 THEN 'partial' WHEN x >= 50 THEN 'exception' ELSE 'failed' END AS match_status,
    CASE WHEN x >= 70 THEN NULL WHEN x < 50 THEN 'no_match_found' WHEN a < 70 THEN 'amount_variance' WHEN v < 80 THEN 'vendor_mismatch' WHEN d < 70 THEN 'date_variance' ELSE 'approval_required' END AS exception_type,
    total_amount - po_amount AS variance_amount, {sql_round('CAST(total_amount - po_amount AS DOUBLE) / CAST(po_amount AS DOUBLE) * 100.0e0', 5)} AS variance_percentage,
    CASE WHEN x >= 85 THEN 'auto_approved' ELSE 'pending' END AS approval_status, CASE WHEN x >= 85 THEN 'matched' ELSE 'unmatched' END AS invoice_matching_status,
    total_amount AS invoice_amount, po_amount
    FROM (SELECT i.tenant_id, i.invoice_id, i.total_amount, use2, CASE WHEN use2 THEN x2 ELSE x3 END AS x,
                 CASE WHEN use2 OR x3 = 0 THEN '2way_po_invoice' ELSE '3way_full' END AS match_type,
                 CASE WHEN use2 THEN s.po_id ELSE t.po_id END AS po_id, CASE WHEN use2 THEN s.v ELSE t.v END AS v, CASE WHEN use2 THEN s.a ELSE t.a END AS a,
                 CASE WHEN use2 THEN s.d ELSE t.d END AS d, CASE WHEN NOT use2 THEN t.receipt_id END AS receipt_id, p.total_amount AS po_amount
          FROM (SELECT i.*, coalesce(t.x, 0.0e0) AS x3, coalesce(s.x, 0.0e0) AS x2, coalesce(t.x, 0.0e0) < 70 AND coalesce(s.x, 0.0e0) > coalesce(t.x, 0.0e0) AS use2
                FROM open_invoices i LEFT JOIN t ON t.invoice_id = i.invoice_id LEFT JOIN s ON s.invoice_id = i.invoice_id) AS i
          LEFT JOIN t ON t.invoice_id = i.invoice_id LEFT JOIN s ON s.invoice_id = i.invoice_id
          LEFT JOIN purchase_orders p ON p.po_id = CASE WHEN use2 THEN s.po_id ELSE t.po_id END)"""
_BANDRUN = f"""WITH open_invoices AS (SELECT * FROM invoices WHERE matching_status = 'unmatched'),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY x DESC, place, rplace) AS n FROM (
          SELECT *, v * 0.25e0 + a * 0.35e0 + d * 0.15e0 + r * 0.25e0 AS x FROM ({_TRIPLES})) WHERE x > 0) WHERE n = 1),
    s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY x DESC, place) AS n FROM (
          SELECT *, v * 0.3e0 + a * 0.4e0 + d * 0.3e0 AS x FROM ({_PAIRS})) WHERE x > 0) WHERE n = 1)
    {_BANDRUN}"""


def _open(e):
    return e.invoices.filter("matching_status = 'unmatched'")


def _band(e):
    return match.band_run(_open(e), e.purchase_orders, e.receipts, e.vendors)


@query("j06_triples", "invoice_id bigint, po_id bigint, receipt_id bigint, receipt_score double", f"SELECT invoice_id, po_id, receipt_id, r AS receipt_score FROM ({_TRIPLES})")
def _(e):
    pairs = match.band_pairs(e.invoices, e.purchase_orders, e.vendors, candidates.order_candidates(e.invoices, e.purchase_orders))
    return match.band_triples(pairs, e.invoices, e.receipts)


@query("w03_best_triple_or_pair", "invoice_id bigint, po_id bigint, receipt_id bigint, match_type string, confidence double", _BANDRUN)
def _(e):
    return _band(e)


@query("r02_band_run", "tenant_id int, invoice_id bigint, po_id bigint, receipt_id bigint, match_type string, match_status string, confidence double, exception_type string, variance_amount decimal(18,2), variance_percentage double, approval_status string, invoice_matching_status string", _BANDRUN)
def _(e):
    return _band(e)


@query("r03_raise_exceptions", "invoice_id bigint, exception_type string, severity string, title string, description string, expected_value string, actual_value string, field_name string, status string, priority int, variance_amount decimal(18,2), due_date date",
       f"""SELECT b.invoice_id, exception_type,
           CASE exception_type WHEN 'amount_variance' THEN 'Invoice amount differs significantly from PO amount' WHEN 'vendor_mismatch' THEN 'Invoice vendor does not match PO vendor' ELSE 'This match requires manual review' END AS description,
           CASE exception_type WHEN 'amount_variance' THEN CAST(po_amount AS VARCHAR) WHEN 'vendor_mismatch' THEN pv.name END AS expected_value,
           CASE exception_type WHEN 'amount_variance' THEN CAST(invoice_amount AS VARCHAR) WHEN 'vendor_mismatch' THEN iv.name END AS actual_value,
           CASE exception_type WHEN 'amount_variance' THEN 'total_amount' WHEN 'vendor_mismatch' THEN 'vendor_name' END AS field_name, CASE WHEN exception_type = 'amount_variance' AND abs(variance_amount) > 1000 THEN 'high' ELSE 'medium' END AS severity,
           CASE exception_type WHEN 'amount_variance' THEN 'Invoice Amount Variance' WHEN 'vendor_mismatch' THEN 'Vendor Mismatch' ELSE 'Manual Review Required' END AS title,
           'open' AS status, CASE WHEN invoice_amount > 10000 THEN 1 WHEN exception_type = 'amount_variance' THEN 2 ELSE 3 END AS priority,
           CASE exception_type WHEN 'amount_variance' THEN variance_amount END AS variance_amount, DATE '2002-01-01' AS due_date FROM ({_BANDRUN}) AS b
           JOIN invoices i ON i.invoice_id = b.invoice_id JOIN vendors iv ON iv.vendor_id = i.vendor_id LEFT JOIN purchase_orders p ON p.po_id = b.po_id LEFT JOIN vendors pv ON pv.vendor_id = p.vendor_id
           WHERE match_status = 'exception'""")
def _(e):
    name = e.vendors.select("vendor_id", "name")
    inv = e.invoices.select("invoice_id", "vendor_id").join(name, "vendor_id").select("invoice_id", c("name").alias("invoice_vendor"))
    po = e.purchase_orders.select("po_id", "vendor_id").join(name, "vendor_id").select("po_id", c("name").alias("po_vendor"))
    return match.band_exceptions(_band(e).join(inv, "invoice_id").join(po, "po_id", "left"), doc_as_of())


@query("k10_job_summary", "total_processed bigint, matched_count bigint, exception_count bigint",
       f"SELECT count(*) AS total_processed, count(*) FILTER (WHERE approval_status = 'auto_approved') AS matched_count, count(*) FILTER (WHERE approval_status <> 'auto_approved' AND match_status = 'exception') AS exception_count FROM ({_BANDRUN})")
def _(e):
    done = c("approval_status") == "auto_approved"
    return _band(e).agg(F.count("*").alias("total_processed"), F.count_if(done).alias("matched_count"),
                        F.count_if(~done & (c("match_status") == "exception")).alias("exception_count"))


_NEAR = """SELECT invoice_id, po_id FROM (SELECT i.invoice_id, p.po_id, row_number() OVER (PARTITION BY i.invoice_id ORDER BY abs(p.total_amount - i.total_amount), p.po_id) AS n
    FROM invoices i JOIN purchase_orders p ON p.tenant_id = i.tenant_id AND p.vendor_id = i.vendor_id AND p.status <> 'archived'
    AND p.po_date BETWEEN i.invoice_date - 30 AND i.invoice_date + 7 AND p.total_amount >= i.total_amount * CAST('0.9' AS DECIMAL(2,1)) AND p.total_amount <= i.total_amount * CAST('1.1' AS DECIMAL(2,1))) WHERE n = 1"""
_DIRECT = """SELECT invoice_id, min(p.po_id) AS po_id FROM invoices i JOIN purchase_orders p ON p.tenant_id = i.tenant_id AND p.vendor_id = i.vendor_id
    AND p.po_number = trim(i.po_reference) AND p.status <> 'archived' GROUP BY invoice_id"""
_FOUND = f"SELECT invoice_id, po_id, 'number' AS route FROM ({_DIRECT}) UNION ALL SELECT invoice_id, po_id, 'amount' FROM ({_NEAR}) WHERE invoice_id NOT IN (SELECT invoice_id FROM ({_DIRECT}))"


@query("j07_nearest_amount", "invoice_id bigint, po_id bigint", _NEAR)
def _(e):
    return candidates.nearest_amount(e.invoices, e.purchase_orders)


@query("j08_number_else_amount", "invoice_id bigint, po_id bigint, route string", _FOUND)
def _(e):
    return match.find_orders(e.invoices, e.purchase_orders)


def _matched(e):
    found = staged(match.find_orders(e.invoices, e.purchase_orders), "found")
    return e.invoices.drop("po_id").join(found, "invoice_id")


_RELATED = """SELECT m.invoice_id, m.po_id, r.receipt_id, r.receipt_date, r.total_quantity, r.total_value FROM found m JOIN invoices i ON i.invoice_id = m.invoice_id
    JOIN receipts r ON r.po_id = m.po_id WHERE r.receipt_date BETWEEN least(i.invoice_date - 60, DATE '2001-12-31' - 90) AND greatest(i.invoice_date + 30, DATE '2001-12-31')"""
_TOTALS = """SELECT invoice_id, po_line_id, sum(quantity_received) AS received_quantity, sum(line_value) AS received_value, min_by(receipt_line_id, (receipt_date, receipt_line_id)) AS receipt_line_id, count(*) AS receipt_lines
    FROM related JOIN receipt_lines USING (receipt_id) GROUP BY ALL"""
_LINEC = f"""CASE WHEN i.item_code IS NULL OR p.item_code IS NULL THEN 0.1e0 WHEN upper(trim(i.item_code)) = upper(trim(p.item_code)) THEN 0.4e0 ELSE 0.0e0 END
    + CAST(len(list_intersect(list_distinct(string_split(lower(i.description), ' ')), list_distinct(string_split(lower(p.description), ' ')))) AS DOUBLE)
      / len(list_distinct(list_concat(string_split(lower(i.description), ' '), string_split(lower(p.description), ' ')))) * 0.3e0
    + greatest(0.0e0, 1.0e0 - CAST(abs(i.unit_price - p.unit_price) AS DOUBLE) / CAST(p.unit_price AS DOUBLE)) * 0.2e0
    + least(CAST(i.quantity AS DOUBLE) / CAST(p.quantity AS DOUBLE), CAST(p.quantity AS DOUBLE) / CAST(i.quantity AS DOUBLE)) * 0.1e0"""
_BESTL = f"""SELECT invoice_line_id, po_line_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY invoice_line_id ORDER BY confidence DESC, line_number) AS n FROM (
    SELECT i.invoice_line_id, p.po_line_id, p.line_number, {sql_round(_LINEC, 4)} AS confidence FROM invoice_lines i JOIN found m ON m.invoice_id = i.invoice_id JOIN po_lines p ON p.po_id = m.po_id)) WHERE n = 1 AND confidence >= 0.7e0"""
_LINES = """SELECT i.invoice_id, i.invoice_line_id, b.po_line_id, t.receipt_line_id, b.po_line_id IS NOT NULL AS is_matched, coalesce(b.confidence, 0.0e0) AS confidence,
    CASE WHEN b.po_line_id IS NULL THEN 1.0e0 ELSE abs(CAST(CASE WHEN coalesce(t.received_quantity, 0) > 0 THEN t.received_quantity ELSE i.quantity END AS DOUBLE) - CAST(p.quantity AS DOUBLE)) / CAST(p.quantity AS DOUBLE) END AS quantity_variance,
    CASE WHEN b.po_line_id IS NULL THEN 1.0e0 ELSE abs(CAST(i.line_total AS DOUBLE) - CAST(p.line_total AS DOUBLE)) / CAST(p.line_total AS DOUBLE) END AS amount_variance
    FROM invoice_lines i JOIN found m ON m.invoice_id = i.invoice_id LEFT JOIN best_lines b ON b.invoice_line_id = i.invoice_line_id LEFT JOIN po_lines p ON p.po_line_id = b.po_line_id
    LEFT JOIN totals t ON t.invoice_id = i.invoice_id AND t.po_line_id = b.po_line_id"""
_SUMMARY = """SELECT m.invoice_id, m.po_id, p.total_amount AS po_amount, i.total_amount AS invoice_amount, coalesce(g.value, 0) AS receipt_amount, pq.q AS po_quantity, iq.q AS invoice_quantity,
    coalesce(g.q, 0) AS receipt_quantity, coalesce(g.n, 0) AS receipts, abs(i.total_amount - p.total_amount) AS net_amount_variance, abs(iq.q - pq.q) AS net_quantity_variance
    FROM found m JOIN invoices i ON i.invoice_id = m.invoice_id JOIN purchase_orders p ON p.po_id = m.po_id
    JOIN (SELECT po_id, sum(quantity) AS q FROM po_lines GROUP BY po_id) AS pq ON pq.po_id = m.po_id JOIN (SELECT invoice_id, sum(quantity) AS q FROM invoice_lines GROUP BY invoice_id) AS iq ON iq.invoice_id = m.invoice_id
    LEFT JOIN (SELECT invoice_id, sum(total_value) AS value, sum(total_quantity) AS q, count(*) AS n FROM related GROUP BY invoice_id) AS g ON g.invoice_id = m.invoice_id"""
_CLASS = f"""SELECT *, CASE WHEN mp >= 0.95 AND tp >= 0.95 THEN 'perfect_match' WHEN short THEN 'partial_receipt' WHEN with_receipt > with_order THEN 'split_delivery'
    WHEN price THEN 'price_variance' WHEN cnt THEN 'quantity_variance' ELSE 'partial_receipt' END AS match_type,
    {sql_round('''CASE WHEN mp >= 0.95 AND tp >= 0.95 THEN 0.95e0 WHEN short THEN mp * 0.85e0 WHEN with_receipt > with_order THEN mp * 0.8e0
      WHEN price THEN tp * 0.75e0 WHEN cnt THEN tp * 0.7e0 ELSE mp * tp * 0.8e0 END''', 4)} AS confidence,
    CASE WHEN receipts = 0 THEN 'none' WHEN receipt_quantity > po_quantity THEN 'over_delivery' WHEN receipts > 1 THEN 'split_delivery' WHEN short THEN 'under_delivery' ELSE 'full' END AS delivery_class
    FROM (SELECT s.*, n AS total_lines, hit AS matched_lines, ok AS within_lines, with_receipt, with_order, CAST(hit AS DOUBLE) / n AS mp, CAST(ok AS DOUBLE) / n AS tp, receipt_quantity < po_quantity AS short,
      CAST(net_amount_variance AS DOUBLE) > CAST(po_amount AS DOUBLE) * 0.02e0 AS price, CAST(net_quantity_variance AS DOUBLE) > CAST(po_quantity AS DOUBLE) * 0.01e0 AS cnt
      FROM summary s JOIN (SELECT invoice_id, count(*) AS n, count(*) FILTER (WHERE is_matched) AS hit, count(*) FILTER (WHERE is_matched AND quantity_variance <= 0.01e0 AND amount_variance <= 0.02e0) AS ok,
      count(receipt_line_id) AS with_receipt, count(po_line_id) AS with_order FROM lines GROUP BY invoice_id) AS l ON l.invoice_id = s.invoice_id)"""
_CHAIN = f"""WITH found AS ({_FOUND}), related AS ({_RELATED}), totals AS ({_TOTALS}), best_lines AS ({_BESTL}), lines AS ({_LINES}), summary AS ({_SUMMARY}), classified AS ({_CLASS})"""
_GATE = """SELECT *, confidence >= 0.95 AND lost = 0 AND wide = 0 AND amount_ok AND quantity_ok AS auto_approved,
    confidence >= 0.80 AND NOT (confidence >= 0.95 AND lost = 0 AND wide = 0 AND amount_ok AND quantity_ok) AS requires_review,
    concat_ws('; ', CASE WHEN lost > 0 THEN lost || ' unmatched invoice lines' END, CASE WHEN wide > 0 THEN wide || ' lines with high variance' END,
              CASE WHEN NOT amount_ok THEN 'Total amount exceeds tolerance' END, CASE WHEN NOT quantity_ok THEN 'Total quantity exceeds tolerance' END) AS exceptions
    FROM (SELECT *, total_lines - matched_lines AS lost, matched_lines - within_lines AS wide,
          CAST(net_amount_variance AS DOUBLE) <= CAST(po_amount AS DOUBLE) * 0.02e0 AS amount_ok, CAST(net_quantity_variance AS DOUBLE) <= CAST(po_quantity AS DOUBLE) * 0.01e0 AS quantity_ok FROM classified)"""


@query("j09_related_receipts", "invoice_id bigint, po_id bigint, receipt_id bigint, receipt_date date", f"{_CHAIN} SELECT * FROM related")
def _(e):
    return match.related_receipts(_matched(e), e.receipts, doc_as_of())


def _lines(e, matched=None):
    matched = matched or _matched(e)
    related = match.related_receipts(matched, e.receipts, doc_as_of())
    return match.line_matches(e.invoice_lines, e.po_lines, matched, related, e.receipt_lines)


@query("j10_line_matching", "invoice_id bigint, invoice_line_id bigint, po_line_id bigint, receipt_line_id bigint, is_matched boolean, confidence double, quantity_variance double, amount_variance double",
       f"{_CHAIN} SELECT invoice_id, invoice_line_id, po_line_id, receipt_line_id, is_matched, confidence, {sql_round('quantity_variance', 6)} AS quantity_variance, {sql_round('amount_variance', 6)} AS amount_variance FROM lines")
def _(e):
    return _lines(e).withColumn("quantity_variance", round_half_up(c("quantity_variance"), 6)).withColumn("amount_variance", round_half_up(c("amount_variance"), 6))


@query("w02_best_order_line", "invoice_line_id bigint, po_line_id bigint, confidence double", f"{_CHAIN} SELECT * FROM best_lines")
def _(e):
    return match.best_lines(e.invoice_lines, e.po_lines, _matched(e))


@query("a04_receipt_totals", "invoice_id bigint, po_line_id bigint, received_quantity decimal(18,4), received_value decimal(18,2), receipt_line_id bigint, receipt_lines bigint", f"{_CHAIN} SELECT * FROM totals")
def _(e):
    return match.receipt_totals(match.related_receipts(_matched(e), e.receipts, doc_as_of()), e.receipt_lines)


def _summary(e, matched=None):
    matched = matched or _matched(e)
    return match.financial_summary(matched, e.purchase_orders, match.related_receipts(matched, e.receipts, doc_as_of()), e.invoice_lines, e.po_lines)


_SUMCOLS = "invoice_id bigint, po_id bigint, po_amount decimal(18,2), invoice_amount decimal(18,2), receipt_amount decimal(18,2), net_amount_variance decimal(18,2), po_quantity decimal(18,4), invoice_quantity decimal(18,4), receipt_quantity decimal(18,4), net_quantity_variance decimal(18,4)"


@query("a05_financial_summary", _SUMCOLS, f"{_CHAIN} SELECT * FROM summary")
def _(e):
    return _summary(e)


@query("a06_match_classification", "invoice_id bigint, match_type string, confidence double, delivery_class string, total_lines bigint, matched_lines bigint, within_lines bigint", f"{_CHAIN} SELECT * FROM classified")
def _(e):
    matched = _matched(e)
    return match.classify(_lines(e, matched), _summary(e, matched))


_RUN = "invoice_id bigint, po_id bigint, match_type string, confidence double, auto_approved boolean, requires_review boolean, exceptions string"


@query("a07_approval_gate", "invoice_id bigint, amount_ok boolean, quantity_ok boolean, auto_approved boolean, requires_review boolean, exceptions string", f"{_CHAIN} {_GATE}")
def _(e):
    matched = _matched(e)
    return match.gate(match.classify(_lines(e, matched), _summary(e, matched))).withColumn("exceptions", F.array_join("exceptions", "; "))


@query("r07_three_way_run", _RUN + ", net_amount_variance decimal(18,2), delivery_class string", f"{_CHAIN} {_GATE}")
def three_way(e):
    run = match.three_way_run(e.invoices, e.purchase_orders, e.receipts, e.invoice_lines, e.po_lines, e.receipt_lines, doc_as_of())
    return run.withColumn("exceptions", F.array_join("exceptions", "; "))


def _alike(pairs: str) -> str:
    return f"SELECT a, b, composite FROM ({sql_similarities(pairs)})"


def _scored(open_invoices: str, exact: str) -> str:
    """Every pair of the band that reaches the threshold, with its four scores."""
    return f"""WITH left_over AS (SELECT * FROM {open_invoices} WHERE invoice_id NOT IN (SELECT invoice_id FROM ({exact}))),
        band AS (SELECT i.invoice_id, p.po_id, p.po_date, iv.name AS inv_name, pv.name AS po_name, i.vendor_id = p.vendor_id AS same_vendor, i.po_reference AS inv_ref, p.po_number, {_V} AS share,
            abs(datediff('day', p.po_date, i.invoice_date)) AS gap,
            greatest(0.0e0, CASE WHEN {_V} <= 0.05e0 OR abs(i.total_amount - p.total_amount) <= 10 THEN 1.0e0 - {_V} ELSE 0.5e0 - {_V} END) AS amount_score,
            CASE WHEN {_G} <= 7 THEN greatest(0.7e0, 1.0e0 - {_G} / 30.0e0) ELSE greatest(0.0e0, 0.5e0 - {_G} / 60.0e0) END AS date_score
            FROM left_over i JOIN purchase_orders p ON p.tenant_id = i.tenant_id AND p.status <> 'archived' AND p.po_date BETWEEN i.invoice_date - 30 AND i.invoice_date + 7
            JOIN vendors iv ON iv.vendor_id = i.vendor_id JOIN vendors pv ON pv.vendor_id = p.vendor_id),
        reachable AS (SELECT * FROM band WHERE 0.3e0 + 0.1e0 + amount_score * 0.4e0 + date_score * 0.2e0 >= 0.7e0 - 0.00005e0),
        named AS (SELECT r.*, CASE WHEN same_vendor THEN 1.0e0 ELSE composite END AS vendor_score FROM reachable r
            LEFT JOIN ({_alike('SELECT DISTINCT inv_name AS a, po_name AS b FROM reachable WHERE NOT same_vendor')}) AS v ON v.a = inv_name AND v.b = po_name),
        saved AS (SELECT *, vendor_score * 0.3e0 + amount_score * 0.4e0 + date_score * 0.2e0 AS so_far FROM named),
        hopeful AS (SELECT * FROM saved WHERE so_far + 0.1e0 >= 0.7e0 - 0.00005e0),
        scored AS (SELECT h.*, CASE WHEN upper(trim(inv_ref)) = upper(trim(po_number)) THEN 1.0e0 ELSE coalesce(composite, 0.0e0) END AS reference_score FROM hopeful h
            LEFT JOIN ({_alike("SELECT DISTINCT inv_ref AS a, po_number AS b FROM hopeful WHERE inv_ref <> '' AND po_number <> ''")}) AS r ON r.a = inv_ref AND r.b = po_number)
        SELECT * FROM (SELECT *, {sql_round('so_far + reference_score * 0.1e0', 4)} AS confidence FROM scored) WHERE confidence >= 0.7e0"""


_BEST = "SELECT * FROM ({0}) QUALIFY row_number() OVER (PARTITION BY invoice_id ORDER BY confidence DESC, po_date, po_id) = 1"
_DECIDED = """SELECT invoice_id, po_id, confidence, CASE WHEN confidence = 1.0e0 THEN 'exact' ELSE 'fuzzy' END AS match_type, CASE WHEN confidence >= 0.85e0 THEN 'approved' ELSE 'pending' END AS match_status,
    confidence >= 0.85e0 AS auto_approved, confidence < 0.85e0 AND confidence >= 0.7e0 AS requires_review"""


def _pct(x: str) -> str:
    return f"CAST(CAST(floor({x} * 1000.0e0 + 0.5e0) / 10.0e0 AS DECIMAL(12,1)) AS VARCHAR) || '%'"


_SAID = f"""CASE WHEN confidence = 1.0e0 THEN 'Exact match found on PO number, vendor, and amount' ELSE 'Fuzzy match with confidence ' || {_pct('confidence')} || '; Vendor similarity: ' || {_pct('vendor_score')}
    || '; Amount matching: ' || {_pct('amount_score')} || '; Date matching: ' || {_pct('date_score')} || '; Reference matching: ' || {_pct('reference_score')}
    || '; Amount variance: ' || {_pct('share')} || '; Date variance: ' || gap || ' days' END AS explanation"""


def _two_way(open_invoices: str, exact: str) -> str:
    """The exact matches and the best fuzzy match of each other invoice."""
    return f"""SELECT invoice_id, po_id, 1.0e0 AS confidence, 1.0e0 AS vendor_score, 1.0e0 AS amount_score, 1.0e0 AS date_score, 1.0e0 AS reference_score, 0.0e0 AS share, 0 AS gap FROM ({exact})
        UNION ALL SELECT invoice_id, po_id, confidence, vendor_score, amount_score, date_score, reference_score, share, gap FROM ({_BEST.format(_scored(open_invoices, exact))})"""


_ALL_RUN = _two_way("invoices", _EXACT)
_NOT_DONE = "(SELECT * FROM invoices WHERE invoice_id NOT IN (SELECT invoice_id FROM match_results WHERE approval_status <> 'rejected'))"


@query("j11_match_factors", "invoice_id bigint, po_id bigint, vendor_score double, amount_score double, date_score double, reference_score double, confidence double",
       f"SELECT invoice_id, po_id, vendor_score, amount_score, date_score, reference_score, confidence FROM ({_scored('invoices', _EXACT)})")
def _(e):
    return match.fuzzy_scores(candidates.fuzzy_candidates(_rest(e), e.purchase_orders), e.vendors)


@query("w01_best_order", "invoice_id bigint, po_id bigint, confidence double", f"SELECT invoice_id, po_id, confidence FROM ({_BEST.format(_scored('invoices', _EXACT))})")
def _(e):
    return match.best_fuzzy(candidates.best_order_candidates(_rest(e), e.purchase_orders, e.vendors), e.vendors)


_DECISION = "invoice_id bigint, po_id bigint, confidence double, match_type string, match_status string, auto_approved boolean, requires_review boolean"


@query("r01_decisions", _DECISION, f"{_DECIDED} FROM ({_BEST.format(_scored('invoices', _EXACT))})")
def _(e):
    return match.decide(match.best_fuzzy(candidates.best_order_candidates(_rest(e), e.purchase_orders, e.vendors), e.vendors))


@query("r08_two_way_run", _DECISION + ", explanation string", f"{_DECIDED}, {_SAID} FROM ({_two_way(_NOT_DONE, _EXACT.replace('FROM invoices i', f'FROM {_NOT_DONE} AS i'))})")
def _(e):
    done = e.match_results.filter("approval_status <> 'rejected'").select("invoice_id")
    return match.two_way_run(e.invoices, e.purchase_orders, e.vendors, done)


@query("u05_exact_and_fuzzy", "invoice_id bigint, po_id bigint, match_type string", f"SELECT invoice_id, po_id, match_type FROM ({_DECIDED} FROM ({_ALL_RUN}))")
def _(e):
    return match.two_way_run(e.invoices, e.purchase_orders, e.vendors)


@query("a08_batch_metrics", "total_invoices bigint, exact_matches bigint, fuzzy_matches bigint, unmatched bigint, auto_approved bigint, manual_review bigint, average_confidence double",
       f"""SELECT count(*) AS total_invoices, count(*) FILTER (WHERE match_type = 'exact') AS exact_matches, count(*) FILTER (WHERE match_type = 'fuzzy') AS fuzzy_matches,
           count(*) FILTER (WHERE match_type IS NULL) AS unmatched, count(*) FILTER (WHERE auto_approved) AS auto_approved, count(*) FILTER (WHERE requires_review) AS manual_review,
           {sql_round('avg(confidence)', 4)} AS average_confidence FROM invoices i LEFT JOIN ({_DECIDED} FROM ({_ALL_RUN})) AS d ON d.invoice_id = i.invoice_id""")
def _(e):
    return match.batch_metrics(e.invoices, match.two_way_run(e.invoices, e.purchase_orders, e.vendors))


@query("j14_unknown_ids", "invoice_id bigint", "SELECT o_orderkey * 2 + 1 AS invoice_id FROM orders WHERE o_orderkey * 2 + 1 NOT IN (SELECT invoice_id FROM invoices)")
def _(e):
    return e.raw("orders").select((c("o_orderkey") * 2 + 1).alias("invoice_id")).join(e.invoices.select("invoice_id"), "invoice_id", "left_anti")


@query("u01_requested_minus_existing", "invoice_id bigint", "SELECT o_orderkey * 2 + 1 AS invoice_id FROM orders EXCEPT SELECT invoice_id FROM invoices")
def _(e):
    return e.raw("orders").select((c("o_orderkey") * 2 + 1).alias("invoice_id")).exceptAll(e.invoices.select("invoice_id"))


@query("u03_word_sets", "invoice_line_id bigint, shared string, total_words int",
       """SELECT invoice_line_id, array_to_string(list_sort(list_intersect(a, b)), ' ') AS shared, len(list_distinct(list_concat(a, b))) AS total_words FROM (
          SELECT invoice_line_id, list_distinct(string_split(lower(i.description), ' ')) AS a, list_distinct(string_split(lower(p.description), ' ')) AS b
          FROM invoice_lines i JOIN po_lines p ON p.po_line_id = i.invoice_line_id - 500000)""")
def _(e):
    pairs = e.invoice_lines.select((c("invoice_line_id") - 500000).alias("po_line_id"), "invoice_line_id", F.split(F.lower("description"), " ").alias("a")).join(
        e.po_lines.select("po_line_id", F.split(F.lower("description"), " ").alias("b")), "po_line_id")
    return pairs.select("invoice_line_id", F.array_join(F.array_sort(F.array_intersect("a", "b")), " ").alias("shared"), F.size(F.array_union("a", "b")).alias("total_words"))


# Every variant of a text is compared with every name of the tenant.
@query("w04_best_vendor_for_name", "tenant_id int, text string, best_match string, score double",
       f"""WITH asked AS (SELECT DISTINCT tenant_id, name AS text FROM vendors_dirty), forms AS (SELECT tenant_id, text, unnest({sql_variants('text')}) AS variant FROM asked),
               met AS (SELECT DISTINCT f.tenant_id, f.text, variant, v.name FROM forms f JOIN vendors v ON v.tenant_id = f.tenant_id AND v.is_active AND v.name <> '' WHERE text <> ''),
               scored AS (SELECT m.tenant_id, m.text, m.name, composite FROM met m JOIN ({_alike('SELECT DISTINCT variant AS a, name AS b FROM met')}) AS s ON s.a = m.variant AND s.b = m.name),
               best AS (SELECT tenant_id, text, min(name) AS best_match, score FROM (SELECT *, max(composite) OVER (PARTITION BY tenant_id, text) AS score FROM scored) WHERE composite = score GROUP BY ALL)
           SELECT a.tenant_id, a.text, coalesce(best_match, '') AS best_match, coalesce({sql_round('score', 6)}, 0.0e0) AS score FROM asked a
           LEFT JOIN best b ON b.tenant_id = a.tenant_id AND b.text = a.text AND score > 0""")
def _(e):
    texts = e.vendors_dirty.select("tenant_id", c("name").alias("text"))
    return names.best_vendor(texts, e.vendors.filter("is_active").select("tenant_id", "name"))


@query("w05_latest_result", "invoice_id bigint, match_result_id bigint, overall_confidence decimal(5,2), approval_status string",
       "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY created_at DESC, match_result_id DESC) AS n FROM match_results) WHERE n = 1")
def _(e):
    return match.latest(e.match_results, ["invoice_id"], [c("created_at"), c("match_result_id")])


@query("w06_effective_tolerance", "invoice_id bigint, share double, absolute double, inside_share boolean",
       """SELECT invoice_id, coalesce(CAST(percentage_tolerance AS DOUBLE), 0.05e0) AS share, coalesce(CAST(absolute_tolerance AS DOUBLE), 10.0e0) AS absolute,
          percentage_tolerance IS NOT NULL AS inside_share FROM (
          SELECT i.invoice_id, t.percentage_tolerance, t.absolute_tolerance, row_number() OVER (PARTITION BY i.invoice_id ORDER BY CASE WHEN t.vendor_id IS NULL THEN 1 ELSE 0 END, t.priority DESC) AS n
          FROM invoices i LEFT JOIN tolerances t ON t.tenant_id = i.tenant_id AND t.is_active AND t.tolerance_type = 'price'
          AND (t.vendor_id IS NULL OR t.vendor_id = i.vendor_id) AND (t.amount_threshold IS NULL OR i.total_amount >= t.amount_threshold)) WHERE n = 1""")
def _(e):
    rows = match.effective_tolerances(e.invoices, e.config("tolerances"), "price")
    return rows.select("invoice_id", F.coalesce("rule.share", F.lit(0.05)).alias("share"), F.coalesce("rule.absolute", F.lit(10.0)).alias("absolute"),
                       c("rule.share").isNotNull().alias("inside_share"))


@query("r06_rule_table", "invoice_id bigint, field_name string, rule_name string",
       """SELECT invoice_id, field_name, name AS rule_name FROM (SELECT i.invoice_id, r.field_name, r.name, row_number() OVER (PARTITION BY i.invoice_id, r.field_name ORDER BY r.priority) AS n
          FROM invoices i JOIN matching_rules r ON r.tenant_id = i.tenant_id AND (r.vendor_id IS NULL OR r.vendor_id = i.vendor_id)
          AND (r.min_amount IS NULL OR i.total_amount >= r.min_amount) AND (r.max_amount IS NULL OR i.total_amount <= r.max_amount)) WHERE n = 1""")
def _(e):
    return changes.best_rule(e.invoices, e.config("matching_rules"), c("total_amount"))


_DECIDE = """SELECT exception_id, CASE WHEN (exception_id + k) % 2 = 0 THEN 'adjusted' ELSE 'accepted' END AS resolution, created_at + to_hours(CAST(k * 5 + 1 AS INTEGER)) AS decided_at
    FROM match_exceptions, (VALUES (0), (1)) AS v(k) WHERE status <> 'resolved' AND exception_id % 4 <> 3"""


@query("r04_apply_resolutions", "exception_id bigint, status string, resolution string, resolved_at timestamp_ntz",
       f"""SELECT x.exception_id, CASE WHEN d.resolution IS NOT NULL THEN 'resolved' ELSE status END AS status, d.resolution, coalesce(d.decided_at, resolved_at) AS resolved_at
           FROM match_exceptions x LEFT JOIN (SELECT exception_id, max_by(resolution, decided_at) AS resolution, max(decided_at) AS decided_at FROM ({_DECIDE}) GROUP BY exception_id) AS d ON d.exception_id = x.exception_id""")
def _(e):
    step = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
    decisions = e.match_exceptions.filter("status <> 'resolved' and exception_id % 4 <> 3").select("exception_id", "created_at", step).select(
        "exception_id", F.when((c("exception_id") + c("k")) % 2 == 0, "adjusted").otherwise("accepted").alias("resolution"),
        F.expr("created_at + make_dt_interval(0, k * 5 + 1, 0, 0)").alias("decided_at"))
    return changes.apply_resolutions(e.match_exceptions, decisions)


@query("r05_apply_feedback", "match_result_id bigint, approval_status string, review_notes string, event_description string",
       """SELECT match_result_id, CASE WHEN f = 0 THEN 'approved' WHEN f = 1 THEN 'rejected' ELSE approval_status END AS approval_status, CASE WHEN f = 1 THEN 'see ' || match_result_id END AS review_notes,
          'User feedback received: ' || CASE f WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'modify' END AS event_description
          FROM (SELECT *, CASE WHEN requires_review THEN match_result_id % 3 END AS f FROM match_results)""")
def _(e):
    key = c("match_result_id")
    kind = F.when(key % 3 == 0, "approve").when(key % 3 == 1, "reject").otherwise("modify")
    feedback = e.match_results.filter("requires_review").select(key, kind.alias("feedback_type"), F.concat(F.lit("see "), key).alias("notes"))
    updated, audit = changes.apply_feedback(e.match_results, feedback)
    return updated.join(audit, "match_result_id", "left")


_CHG = "SELECT invoice_id, status, due_date, k FROM (SELECT invoice_id, k, CASE WHEN k = 1 THEN 'cancelled' END AS status, due_date + k AS due_date FROM invoices, (VALUES (1), (2)) AS v(k) WHERE vendor_id % 3 = 0)"


@query("g01_apply_changes", "invoice_id bigint, status string, due_date date, total_amount decimal(15,2)",
       "SELECT i.invoice_id, i.status, CASE WHEN vendor_id % 3 = 0 THEN due_date + 2 ELSE due_date END AS due_date, total_amount FROM invoices i UNION ALL SELECT -1, NULL, DATE '2001-12-31', NULL")
def _(e):
    step = F.explode(F.array(F.lit(1), F.lit(2))).alias("k")
    edits = e.invoices.filter("vendor_id % 3 = 0").select("invoice_id", "status", "due_date", step).select(
        "invoice_id", F.when(c("k") == 1, "cancelled").alias("status"), F.date_add("due_date", c("k")).alias("due_date"), "k")
    extra = e.spark.sql("SELECT -1L AS invoice_id, cast(null as string) AS status, DATE '2001-12-31' AS due_date, 1 AS k")
    return changes.apply_changes(e.invoices.select("invoice_id", "status", "due_date", "total_amount"), edits.unionByName(extra), "invoice_id", ["status", "due_date"], ["k"])


@query("f04_configured_weights", "invoice_id bigint, po_id bigint, confidence double",
       f"""SELECT invoice_id, po_id, {sql_round('v * w1 + a * w2 + d * w3 + r * w4', 4)} AS confidence FROM (
           SELECT i.invoice_id, i.po_id, CASE WHEN i.inv_vendor_id = i.po_vendor_id THEN 1.0e0 ELSE 0.0e0 END AS v,
           greatest(0.0e0, 1.0e0 - CAST(abs(inv_amount - po_amount) AS DOUBLE) / CAST(greatest(inv_amount, po_amount) AS DOUBLE)) AS a,
           CASE WHEN invoice_date = po_date THEN 1.0e0 ELSE 0.0e0 END AS d, CASE WHEN inv_ref = po_number THEN 1.0e0 ELSE 0.0e0 END AS r,
           coalesce(CAST(vendor_name_weight AS DOUBLE), 0.3e0) AS w1, coalesce(CAST(amount_weight AS DOUBLE), 0.4e0) AS w2, coalesce(CAST(date_weight AS DOUBLE), 0.2e0) AS w3, coalesce(CAST(reference_weight AS DOUBLE), 0.1e0) AS w4
           FROM score_pairs i LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC) AS n FROM match_config WHERE is_active) WHERE n = 1) AS m ON m.tenant_id = i.tenant_id)""")
def _(e):
    cfg = match.latest(e.config("match_config").filter("is_active"), ["tenant_id"], [c("created_at")])
    rows = e.score_pairs.join(cfg, "tenant_id", "left")
    w = {k: F.coalesce(c(f"{k}_weight").cast("double"), F.lit(v)) for k, v in scores.UNIT_WEIGHTS.items()}
    flag = lambda p: F.when(p, 1.0).otherwise(0.0)
    amount = F.greatest(F.lit(0.0), 1.0 - scores.variance_share(c("inv_amount"), c("po_amount")))
    return rows.select("invoice_id", "po_id", scores.unit_confidence(
        flag(c("inv_vendor_id") == c("po_vendor_id")), amount, flag(c("invoice_date") == c("po_date")), flag(c("inv_ref") == c("po_number")), w).alias("confidence"))


_F03_PAIRS = "SELECT DISTINCT inv_vendor AS a, po_vendor AS b FROM score_pairs"


# Seven methods here; the eighth, by n-gram vectors, depends on a corpus and is n17.
@query("f03_similarity_methods", "inv_vendor string, po_vendor string, levenshtein double, fuzzy_ratio double, fuzzy_partial double, token_sort double, token_set double, phonetic double, composite double",
       f"""SELECT s.a AS inv_vendor, s.b AS po_vendor, levenshtein, ratio AS fuzzy_ratio, CASE WHEN same THEN 1.0e0 ELSE partial / 100.0e0 END AS fuzzy_partial, token_sort, token_set,
           CASE WHEN {sql_soundex('lower(trim(s.a))')} = {sql_soundex('lower(trim(s.b))')} THEN 1.0e0 ELSE 0.0e0 END AS phonetic, {sql_round('composite', 6)} AS composite
           FROM ({sql_similarities(_F03_PAIRS)}) AS s JOIN ({sql_windows(_F03_PAIRS)}) AS w ON w.a = s.a AND w.b = s.b""")
def _(e):
    a, b = c("inv_vendor"), c("po_vendor")
    pairs = e.score_pairs.select("inv_vendor", "po_vendor").distinct()
    methods = {"levenshtein": "levenshtein", "fuzzy_ratio": "fuzzy_ratio", "fuzzy_partial": "fuzzy_partial", "token_sort": "fuzzy_token_sort", "token_set": "fuzzy_token_set", "phonetic": "phonetic"}
    return pairs.select("*", *(fuzzy.similarity(a, b, m).alias(name) for name, m in methods.items()), fuzzy.composite_rounded(a, b).alias("composite"))


# --- lists and nested views ---------------------------------------------------------------------


@query("j15_invoice_list", "invoice_id bigint, invoice_number string, vendor_name string, vendor_email string, po_number string, po_total decimal(15,2)",
       """SELECT i.invoice_id, i.invoice_number, v.name AS vendor_name, v.email AS vendor_email, p.po_number, p.total_amount AS po_total
          FROM invoices i LEFT JOIN vendors v ON v.vendor_id = i.vendor_id LEFT JOIN purchase_orders p ON p.po_id = i.po_id""")
def _(e):
    v = e.vendors.select("vendor_id", c("name").alias("vendor_name"), c("email").alias("vendor_email"))
    p = e.purchase_orders.select("po_id", "po_number", c("total_amount").alias("po_total"))
    return e.invoices.join(v, "vendor_id", "left").join(p, "po_id", "left")


@query("j16_invoice_detail", "invoice_id bigint, section string, item_id bigint, text string, amount decimal(15,2)",
       """SELECT i.invoice_id, 'line' AS section, l.invoice_line_id AS item_id, l.description AS text, l.line_total AS amount FROM invoices i JOIN invoice_lines l ON l.invoice_id = i.invoice_id
          UNION ALL SELECT i.invoice_id, 'result', r.match_result_id, r.match_status, CAST(r.overall_confidence AS DECIMAL(15,2)) FROM invoices i JOIN match_results r ON r.invoice_id = i.invoice_id
          UNION ALL SELECT i.invoice_id, 'head', i.invoice_id, i.invoice_number, i.total_amount FROM invoices i""")
def _(e):
    head = e.invoices.select("invoice_id", F.lit("head").alias("section"), c("invoice_id").alias("item_id"), c("invoice_number").alias("text"), c("total_amount").alias("amount"))
    ids = e.invoices.select("invoice_id")
    lines = e.invoice_lines.join(ids, "invoice_id", "left_semi").select(
        "invoice_id", F.lit("line").alias("section"), c("invoice_line_id").alias("item_id"), c("description").alias("text"), c("line_total").alias("amount"))
    results = e.match_results.join(ids, "invoice_id", "left_semi").select(
        "invoice_id", F.lit("result").alias("section"), c("match_result_id").alias("item_id"), c("match_status").alias("text"), c("overall_confidence").cast("decimal(15,2)").alias("amount"))
    return head.unionByName(lines).unionByName(results)


_QUEUE = """SELECT x.exception_id, x.exception_type, x.status, x.priority, x.created_at, r.overall_confidence, i.invoice_number, v.name AS vendor_name, p.po_number
    FROM match_exceptions x LEFT JOIN match_results r ON r.match_result_id = x.match_result_id LEFT JOIN invoices i ON i.invoice_id = r.invoice_id
    LEFT JOIN vendors v ON v.vendor_id = i.vendor_id LEFT JOIN purchase_orders p ON p.po_id = r.po_id"""
_QCOLS = "exception_id bigint, exception_type string, status string, priority int, created_at timestamp_ntz, overall_confidence decimal(5,2), invoice_number string, vendor_name string, po_number string"


def _queue(e):
    r = e.match_results.select("match_result_id", "overall_confidence", "invoice_id", "po_id")
    i = e.invoices.select("invoice_id", "invoice_number", "vendor_id")
    return (e.match_exceptions.join(r, "match_result_id", "left").join(i, "invoice_id", "left")
            .join(e.vendors.select("vendor_id", c("name").alias("vendor_name")), "vendor_id", "left")
            .join(e.purchase_orders.select("po_id", "po_number"), "po_id", "left"))


@query("j17_exception_queue", _QCOLS, _QUEUE)
def _(e):
    return _queue(e)


@query("o03_open_exceptions_page", _QCOLS, f"SELECT * FROM ({_QUEUE}) WHERE status = 'open' ORDER BY priority, created_at DESC, exception_id LIMIT 50")
def _(e):
    top = e.match_exceptions.filter("status = 'open'").orderBy("priority", F.desc("created_at"), "exception_id").limit(50)
    return _queue(e).join(F.broadcast(top.select("exception_id")), "exception_id", "left_semi")


@query("j18_report_rows", "match_result_id bigint, invoice_number string, match_status string, exceptions bigint, resolved bigint",
       """SELECT r.match_result_id, i.invoice_number, r.match_status, coalesce(x.n, 0) AS exceptions, coalesce(x.done, 0) AS resolved FROM match_results r LEFT JOIN invoices i ON i.invoice_id = r.invoice_id
          LEFT JOIN (SELECT match_result_id, count(*) AS n, count(resolved_at) AS done FROM match_exceptions GROUP BY ALL) AS x ON x.match_result_id = r.match_result_id""")
def _(e):
    x = e.match_exceptions.groupBy("match_result_id").agg(F.count("*").alias("exceptions"), F.count("resolved_at").alias("resolved"))
    return e.match_results.join(e.invoices.select("invoice_id", "invoice_number"), "invoice_id", "left").join(x, "match_result_id", "left").na.fill(0, ["exceptions", "resolved"])


@query("j21_vendors_in_use", "vendor_id bigint, name string", "SELECT vendor_id, name FROM vendors WHERE vendor_id IN (SELECT vendor_id FROM invoices)")
def _(e):
    return e.vendors.join(e.invoices.select("vendor_id"), "vendor_id", "left_semi")


@query("v15_invoice_filters", "invoice_id bigint, status string, invoice_date date",
       "SELECT invoice_id, status, invoice_date FROM invoices WHERE status = 'pending' AND matching_status = 'unmatched' AND vendor_id = 3 AND invoice_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'")
def _(e):
    return e.invoices.filter("status = 'pending' and matching_status = 'unmatched' and vendor_id = 3 and invoice_date between date'1996-01-01' and date'1999-12-31'")


@query("v16_vendor_search", "vendor_id bigint, name string",
       "SELECT vendor_id, name FROM vendors WHERE name ILIKE '%TRADING%' OR normalized_name ILIKE '%TRADING%' OR email ILIKE '%@VENDOR3%'")
def _(e):
    hit = lambda f, p: F.lower(c(f)).contains(p.lower())
    return e.vendors.filter(hit("name", "TRADING") | hit("normalized_name", "TRADING") | hit("email", "@VENDOR3"))


@query("v19_tolerance_list", "invoice_vendor bigint, tolerance_type string, priority int, invoices bigint",
       """SELECT i.vendor_id AS invoice_vendor, t.tolerance_type, t.priority, count(*) AS invoices FROM tolerances t JOIN invoices i ON i.tenant_id = t.tenant_id
          WHERE t.is_active AND t.tolerance_type = 'price' AND (t.vendor_id IS NULL OR t.vendor_id = i.vendor_id) GROUP BY ALL""")
def _(e):
    rules = e.config("tolerances").filter("is_active and tolerance_type = 'price'").withColumnRenamed("vendor_id", "rule_vendor")
    counts = e.invoices.groupBy("tenant_id", c("vendor_id").alias("invoice_vendor")).agg(F.count("*").alias("invoices"))
    met = counts.join(rules, "tenant_id").filter("rule_vendor is null or rule_vendor = invoice_vendor")
    return met.groupBy("invoice_vendor", "tolerance_type", "priority").agg(F.sum("invoices").alias("invoices")).orderBy(F.desc("priority"), "invoice_vendor")


# --- duplicate vendors ---------------------------------------------------------------------------


_DIGITS = "regexp_replace({0}.phone, '[^0-9]', '', 'g')"
_LONGER = "greatest(length(a.normalized_name), length(b.normalized_name))"
# All pairs of a tenant are compared.
_DUPLICATES = f"""SELECT * FROM (SELECT a.vendor_id, b.vendor_id AS other_id,
        CASE WHEN a.normalized_name = '' OR b.normalized_name = '' THEN 0.0e0 ELSE ({_LONGER} - levenshtein(a.normalized_name, b.normalized_name))::DOUBLE / {_LONGER} END * 100.0e0 * 0.6e0
        + CASE WHEN lower(a.email) = lower(b.email) THEN 100.0e0 ELSE 0.0e0 END * 0.2e0 + CASE WHEN {_DIGITS.format('a')} = {_DIGITS.format('b')} THEN 100.0e0 ELSE 0.0e0 END * 0.1e0
        + CASE WHEN a.tax_id = b.tax_id THEN 100.0e0 ELSE 0.0e0 END * 0.1e0 AS score
    FROM vendors_dirty a JOIN vendors_dirty b ON b.tenant_id = a.tenant_id AND b.vendor_id > a.vendor_id) WHERE score >= 80.0e0 - 0.000000001e0"""
# Vendors in order of id, each with its smaller neighbours, are folded into the list of leaders.
_LED = f"""WITH pairs AS ({_DUPLICATES}),
    nodes AS (SELECT vendor_id AS node FROM pairs UNION SELECT other_id FROM pairs),
    folded AS (SELECT list_reduce(list_prepend([]::BIGINT[], list(list_prepend(node, coalesce(smaller, []::BIGINT[])) ORDER BY node)),
        lambda led, item: CASE WHEN list_has_any(led, item[2:]) THEN led ELSE list_append(led, item[1]) END) AS leaders
        FROM nodes LEFT JOIN (SELECT other_id, list(vendor_id) AS smaller FROM pairs GROUP BY other_id) AS s ON s.other_id = node)
    SELECT min(vendor_id) AS leader_id, other_id AS member_id, arg_min(score, vendor_id) AS score FROM pairs, folded
    WHERE list_contains(leaders, vendor_id) AND NOT list_contains(leaders, other_id) GROUP BY other_id"""
_REVIEW = f"""SELECT m.name AS original_name, l.normalized_name, {sql_round('score', 4)} AS confidence, leader_id AS canonical_vendor_id, CASE WHEN score >= 95 THEN 'approved' ELSE 'pending' END AS status
    FROM ({_LED}) AS g JOIN vendors_dirty m ON m.vendor_id = member_id JOIN vendors_dirty l ON l.vendor_id = leader_id"""


@query("j22_duplicate_pairs", "vendor_id bigint, other_id bigint, score double", f"SELECT vendor_id, other_id, {sql_round('score', 4)} AS score FROM ({_DUPLICATES})")
def _(e):
    return vendors.duplicate_pairs(e.vendors_dirty).withColumn("score", round_half_up(c("score"), 4))


@query("d01_duplicate_groups", "leader_id bigint, member_id bigint, score double", f"SELECT leader_id, member_id, {sql_round('score', 4)} AS score FROM ({_LED})")
def _(e):
    return vendors.duplicate_groups(e.vendors_dirty, e.spark).withColumn("score", round_half_up(c("score"), 4))


@query("d02_review_rows", "original_name string, normalized_name string, confidence double, canonical_vendor_id bigint, status string", _REVIEW)
def _(e):
    groups = vendors.duplicate_groups(e.vendors_dirty, e.spark)
    return vendors.review_rows(groups, e.vendors_dirty).withColumn("confidence", round_half_up(c("confidence"), 4))


# A vendor merges into the one before it, up to the first of each five; in every third five, the
# first merges into the last, so these run in a circle.
_MERGES = """SELECT vendor_id AS dup, vendor_id - 1 AS canon FROM vendors WHERE vendor_id % 5 <> 0
    UNION ALL SELECT vendor_id, vendor_id + 4 FROM vendors WHERE vendor_id % 15 = 10 AND vendor_id + 4 IN (SELECT vendor_id FROM vendors)"""
_RESOLVED = f"""WITH RECURSIVE m AS ({_MERGES}), walk AS (SELECT dup, canon AS reached, [dup] AS path FROM m
        UNION ALL SELECT w.dup, m.canon, list_append(path, m.dup) FROM walk w JOIN m ON m.dup = w.reached WHERE NOT list_contains(path, m.dup))
    SELECT dup, reached FROM walk WHERE reached NOT IN (SELECT dup FROM m)"""


def _merges(e):
    ids = e.vendors.select("vendor_id")
    chains = ids.filter("vendor_id % 5 <> 0").select(c("vendor_id").alias("duplicate_vendor_id"), (c("vendor_id") - 1).alias("canonical_vendor_id"))
    back = ids.filter("vendor_id % 15 = 10").withColumn("to", c("vendor_id") + 4).join(ids.select(c("vendor_id").alias("to")), "to")
    return chains.unionByName(back.select(c("vendor_id").alias("duplicate_vendor_id"), c("to").alias("canonical_vendor_id")))


@query("d03_vendor_merge", "source string, vendor_id bigint, records bigint",
       f"""SELECT source, coalesce(reached, vendor_id) AS vendor_id, count(*) AS records FROM (SELECT 'invoices' AS source, vendor_id FROM invoices UNION ALL SELECT 'orders', vendor_id FROM purchase_orders
          UNION ALL SELECT 'receipts', vendor_id FROM receipts) AS t LEFT JOIN ({_RESOLVED}) AS r ON r.dup = t.vendor_id GROUP BY ALL
          UNION ALL SELECT 'inactive', vendor_id, 1 FROM vendors WHERE NOT is_active OR vendor_id IN (SELECT dup FROM ({_RESOLVED}))
          UNION ALL SELECT 'refused', dup, 1 FROM ({_MERGES}) WHERE dup NOT IN (SELECT dup FROM ({_RESOLVED}))""")
def _(e):
    m, refused = vendors.resolve_merges(_merges(e))
    out = None
    for label, df in (("invoices", e.invoices), ("orders", e.purchase_orders), ("receipts", e.receipts)):
        part = vendors.rewrite_vendor(df, m).groupBy("vendor_id").agg(F.count("*").alias("records")).withColumn("source", F.lit(label))
        out = part if out is None else out.unionByName(part)
    gone = vendors.deactivate_merged(e.vendors, m).filter("not is_active").select("vendor_id", F.lit(1).cast("bigint").alias("records"), F.lit("inactive").alias("source"))
    circles = refused.select(c("duplicate_vendor_id").alias("vendor_id"), F.lit(1).cast("bigint").alias("records"), F.lit("refused").alias("source"))
    return out.unionByName(gone).unionByName(circles)


@query("d06_duplicate_on_create", "vendor_id bigint, name string",
       "SELECT vendor_id, name FROM vendors_dirty d WHERE vendor_id % 10 = 1 AND EXISTS (SELECT 1 FROM vendors_dirty s WHERE s.vendor_id % 10 = 0 AND s.tenant_id = d.tenant_id AND s.normalized_name = d.normalized_name)")
def _(e):
    stored = e.vendors_dirty.filter("vendor_id % 10 = 0").select("tenant_id", "normalized_name")
    return e.vendors_dirty.filter("vendor_id % 10 = 1").join(stored, ["tenant_id", "normalized_name"], "left_semi")
