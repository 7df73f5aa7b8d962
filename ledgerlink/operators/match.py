"""Invoice matching: exact, fuzzy, line level, three-way and the decisions on top."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerlink.functions import fuzzy, scores
from ledgerlink.functions.numeric import round_half_up
from ledgerlink.operators import names
from ledgerlink.operators.candidates import best_order_candidates, nearest_amount, order_candidates, receipt_lists
from ledgerlink.session import staged

c = F.col

# Thresholds of the line-level three-way run.
LINE_MATCH_MIN, THREE_WAY_AUTO, THREE_WAY_REVIEW = 0.7, 0.95, 0.80
THREE_WAY_AMOUNT_SHARE, THREE_WAY_QUANTITY_SHARE = 0.02, 0.01


def exact_matches(invoices: DataFrame, orders: DataFrame) -> DataFrame:
    """(invoice_id, po_id): same tenant, vendor, order number and total; not archived."""
    left = invoices.filter(c("po_reference").isNotNull() & (c("po_reference") != "")).select(
        "tenant_id", "vendor_id", "invoice_id", c("po_reference").alias("po_number"), "total_amount")
    right = orders.filter("status <> 'archived'").select("tenant_id", "vendor_id", "po_number", "total_amount", "po_id")
    met = left.join(right, ["tenant_id", "vendor_id", "po_number", "total_amount"])
    return met.groupBy("invoice_id").agg(F.min("po_id").alias("po_id"))


def with_vendor_scores(candidates: DataFrame, vendors: DataFrame, weights: Mapping[str, float], threshold: float) -> DataFrame:
    """Candidates with the vendor score; those a perfect reference cannot save are dropped.

    Vendor similarity is worked out once per distinct pair of names. The candidates feed both
    that list and the scoring, so the band join is run once and staged.
    """
    candidates = staged(candidates, "candidates")
    name = vendors.select("vendor_id", "name")
    pairs = (candidates.filter(c("inv_vendor_id") != c("po_vendor_id")).select("inv_vendor_id", "po_vendor_id").distinct()
             .join(name.toDF("inv_vendor_id", "inv_name"), "inv_vendor_id").join(name.toDF("po_vendor_id", "po_name"), "po_vendor_id"))
    named = pairs.select("inv_name", "po_name").distinct().withColumn("sim", fuzzy.similarity(c("inv_name"), c("po_name")))
    pairs = pairs.join(named, ["inv_name", "po_name"]).select("inv_vendor_id", "po_vendor_id", "sim")
    same = c("inv_vendor_id") == c("po_vendor_id")
    vendored = candidates.join(pairs, ["inv_vendor_id", "po_vendor_id"], "left").withColumn(
        "vendor_score", F.when(same, 1.0).otherwise(c("sim"))).drop("sim")
    return vendored.filter(_without_reference(weights) + weights["reference"] >= threshold - 0.00005)


def _without_reference(w: Mapping[str, float]) -> Column:
    return c("vendor_score") * w["vendor_name"] + c("amount_score") * w["amount"] + c("date_score") * w["date"]


def drop_dominated(vendored: DataFrame, weights: Mapping[str, float], threshold: float) -> DataFrame:
    """Candidates that can still be their invoice's best, judged by bounds on the reference score.

    A candidate whose upper bound on the confidence is below another one's lower bound cannot win.
    """
    lo, hi = scores.reference_bounds(c("inv_ref"), c("po_number"))
    base, w = _without_reference(weights), weights["reference"]
    bounded = vendored.withColumn("_lo", base + lo * w - 0.0001).withColumn("_hi", base + hi * w + 0.0001).filter(c("_hi") >= threshold)
    best = F.max("_lo").over(W.partitionBy("invoice_id"))
    return bounded.withColumn("_best", best).filter(c("_hi") >= c("_best")).drop("_lo", "_hi", "_best")


def with_reference_scores(vendored: DataFrame, weights: Mapping[str, float], threshold: float) -> DataFrame:
    ref, number = F.upper(F.trim("inv_ref")), F.upper(F.trim("po_number"))
    reference = F.when(F.coalesce(ref == number, F.lit(False)), 1.0).otherwise(fuzzy.similarity(c("inv_ref"), c("po_number")))
    scored = vendored.withColumn("reference_score", reference)
    conf = scores.unit_confidence(c("vendor_score"), c("amount_score"), c("date_score"), c("reference_score"), weights)
    return scored.withColumn("confidence", conf).filter(c("confidence") >= threshold)


def fuzzy_scores(candidates: DataFrame, vendors: DataFrame, weights: Mapping[str, float] = scores.UNIT_WEIGHTS,
                 threshold: float = scores.UNIT_REVIEW, best_only: bool = False) -> DataFrame:
    """Every candidate reaching the threshold with its four factor scores and confidence.

    ``best_only`` leaves out those that cannot be their invoice's best, so that references are
    compared only where they can decide.
    """
    rows = with_vendor_scores(candidates, vendors, weights, threshold)
    return with_reference_scores(drop_dominated(rows, weights, threshold) if best_only else rows, weights, threshold)


def best_fuzzy(candidates: DataFrame, vendors: DataFrame, weights: Mapping[str, float] = scores.UNIT_WEIGHTS,
               threshold: float = scores.UNIT_REVIEW) -> DataFrame:
    """The best candidate per invoice; references are compared only where they can decide."""
    return best_candidate(fuzzy_scores(candidates, vendors, weights, threshold, best_only=True))


def best_candidate(scored: DataFrame) -> DataFrame:
    """Highest confidence per invoice, ties by earlier order date and smaller id."""
    cols = ["confidence", "vendor_score", "amount_score", "date_score", "reference_score", "share", "gap"]
    order = F.struct((-c("confidence")).alias("k"), c("po_date"), c("po_id"), *[c(x) for x in cols])
    return scored.groupBy("invoice_id").agg(F.min(order).alias("b")).select("invoice_id", "b.po_id", *[f"b.{x}" for x in cols])


def decide(matches: DataFrame, auto: float = scores.UNIT_AUTO_APPROVE, review: float = scores.UNIT_REVIEW) -> DataFrame:
    conf = c("confidence")
    return matches.select(
        "*", F.when(conf == 1.0, "exact").otherwise("fuzzy").alias("match_type"), (conf >= auto).alias("auto_approved"),
        ((conf < auto) & (conf >= review)).alias("requires_review"),
        F.when(conf >= auto, "approved").otherwise("pending").alias("match_status"))


def two_way_run(invoices: DataFrame, orders: DataFrame, vendors: DataFrame, done: DataFrame | None = None,
                weights: Mapping[str, float] = scores.UNIT_WEIGHTS, auto: float = scores.UNIT_AUTO_APPROVE,
                review: float = scores.UNIT_REVIEW) -> DataFrame:
    """Exact matches first, the fuzzy tier for the rest, one decision per matched invoice."""
    scores.check_weights(weights)
    open_ = invoices if done is None else invoices.join(done.select("invoice_id"), "invoice_id", "left_anti")
    exact = exact_matches(open_, orders)
    rest = open_.join(exact, "invoice_id", "left_anti")
    best = best_fuzzy(best_order_candidates(rest, orders, vendors, weights, review), vendors, weights, review)
    one, none = F.lit(1.0), F.lit(0.0)
    full = exact.select("invoice_id", "po_id", one.alias("confidence"), one.alias("vendor_score"), one.alias("amount_score"),
                        one.alias("date_score"), one.alias("reference_score"), none.alias("share"), F.lit(0).alias("gap"))
    decided = decide(full.unionByName(best), auto, review)
    return decided.withColumn("explanation", names.explain_match(
        c("confidence"), c("vendor_score"), c("amount_score"), c("date_score"), c("reference_score"), c("share"), c("gap")))


def batch_metrics(invoices: DataFrame, decisions: DataFrame) -> DataFrame:
    both = invoices.select("invoice_id").join(decisions, "invoice_id", "left")
    kind = c("match_type")
    return both.agg(
        F.count("*").alias("total_invoices"), F.count_if(kind == "exact").alias("exact_matches"), F.count_if(kind == "fuzzy").alias("fuzzy_matches"),
        F.count_if(kind.isNull()).alias("unmatched"), F.count_if("auto_approved").alias("auto_approved"),
        F.count_if("requires_review").alias("manual_review"), round_half_up(F.avg("confidence"), 4).alias("average_confidence"))


# --- three-way by lines ----------------------------------------------------------------------


def find_orders(invoices: DataFrame, orders: DataFrame) -> DataFrame:
    """(invoice_id, po_id, route): by order number, else the nearest amount."""
    number = invoices.filter(c("po_reference").isNotNull()).select("tenant_id", "vendor_id", "invoice_id", F.trim("po_reference").alias("po_number"))
    usable = orders.filter("status <> 'archived'").select("tenant_id", "vendor_id", "po_number", "po_id")
    direct = number.join(usable, ["tenant_id", "vendor_id", "po_number"]).groupBy("invoice_id").agg(F.min("po_id").alias("po_id"))
    rest = invoices.join(direct, "invoice_id", "left_anti")
    return direct.withColumn("route", F.lit("number")).unionByName(nearest_amount(rest, orders).withColumn("route", F.lit("amount")))


def related_receipts(matched: DataFrame, receipts: DataFrame, as_of: Column) -> DataFrame:
    """Receipts of the matched order between the wider of two date windows."""
    start = F.least(F.date_sub("invoice_date", 60), F.date_sub(as_of, 90))
    end = F.greatest(F.date_add("invoice_date", 30), as_of)
    met = matched.select("invoice_id", "po_id", "invoice_date").join(
        receipts.filter("status <> 'archived'").select("po_id", "receipt_id", "receipt_date", "total_quantity", "total_value"), "po_id")
    return met.filter(c("receipt_date").between(start, end))


def _code(x: Column) -> Column:
    return F.nullif(F.upper(F.trim(x)), F.lit(""))


def line_confidence() -> Column:
    ic, pc = _code(c("item_code")), _code(c("p_code"))
    code = F.when(ic.isNull() | pc.isNull(), 0.1).when(ic == pc, 0.4).otherwise(0.0)
    words = scores.word_overlap(c("description"), c("p_description")) * 0.3
    price = F.when(c("p_price") > 0, F.greatest(F.lit(0.0), 1.0 - F.abs(c("unit_price") - c("p_price")).cast("double") / c("p_price").cast("double")) * 0.2).otherwise(0.0)
    q, p = c("quantity").cast("double"), c("p_quantity").cast("double")
    amount = F.when(p > 0, F.least(q / p, F.try_divide(p, q)) * 0.1).otherwise(0.0)
    return round_half_up(code + words + price + amount, 4)


_FIELDS = ["item_code", "description", "unit_price", "quantity"]


def _with_keys(both: DataFrame) -> DataFrame:
    """Lines dealt by order, ``asked`` for invoice lines and not for order lines, with the ``keys`` by which they meet.

    Without equal item codes a line scores at most 0.6, and with a code missing on either side
    0.7 needs equal word sets. So lines meet on (order, code) or, when a code is missing, on
    (order, word set), by a hash of either: lines of equal hashes only score less than 0.7.
    A line gets the key of its words only if the other side of the order has lines without code.
    """
    words = lambda x: F.array_join(F.array_sort(F.array_distinct(F.split(F.lower(x), r"[ \t\r\n]+"))), " ")
    code, text, asked = _code(c("item_code")), words(c("description")), c("asked")

    def bare(of: Column) -> Column:
        return F.max(of & code.isNull()).over(W.partitionBy("po_id"))

    def key(tag: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.xxhash64(F.lit(tag), value))

    # c: equal codes; a: a line without code meets any; n: a line with code meets those without.
    left_keys = F.when(code.isNull(), F.array(key("a", text))).otherwise(F.array(key("c", code), F.when(c("bare_offered"), key("n", text))))
    right_keys = F.when(code.isNull(), F.array(key("n", text), key("a", text))).otherwise(F.array(key("c", code), F.when(c("bare_asked"), key("a", text))))
    return both.withColumn("bare_asked", bare(asked)).withColumn("bare_offered", bare(~asked)).withColumn(
        "keys", F.array_compact(F.when(asked, left_keys).when(~asked, right_keys))).drop("bare_asked", "bare_offered")


def _offers() -> Column:
    offer = F.struct(c("item_code").alias("p_code"), c("description").alias("p_description"), c("unit_price").alias("p_price"), c("quantity").alias("p_quantity"), "line")
    return F.collect_list(F.when(~c("asked"), offer)).over(W.partitionBy("po_id", "key"))


def _pick() -> Column:
    return F.struct((-c("confidence")).alias("k"), c("line.line_number").alias("n"), c("line.po_line_id").alias("po_line_id"), c("confidence"))


def best_lines(invoice_lines: DataFrame, po_lines: DataFrame, matched: DataFrame) -> DataFrame:
    """(invoice_line_id, po_line_id, confidence): best order line per invoice line, at least 0.7.

    Both sides are dealt by order once and get their keys there; equal order lines collapse to the first line number.
    """
    left = invoice_lines.join(matched.select("invoice_id", "po_id"), "invoice_id").select("po_id", F.lit(True).alias("asked"), "invoice_line_id", *_FIELDS)
    right = po_lines.select("po_id", F.lit(False).alias("asked"), *_FIELDS, F.struct("line_number", "po_line_id").alias("line"))
    both = left.unionByName(right, allowMissingColumns=True).filter("po_id is not null").repartition("po_id")
    keyed = _with_keys(both).withColumn("key", F.explode("keys"))
    few = keyed.groupBy("po_id", "key", "asked", "invoice_line_id", *_FIELDS).agg(F.min("line").alias("line"))
    met = few.withColumn("offers", _offers()).filter("asked").drop("line").select("*", F.inline("offers")).drop("offers")
    scored = met.withColumn("confidence", line_confidence()).filter(c("confidence") >= LINE_MATCH_MIN)
    return scored.groupBy("invoice_line_id").agg(F.min(_pick()).alias("b")).select("invoice_line_id", "b.po_line_id", "b.confidence")


def receipt_totals(receipts_of: DataFrame, receipt_lines: DataFrame) -> DataFrame:
    """Received quantity and value and the first receipt line per (invoice, order line)."""
    met = receipts_of.select("invoice_id", "receipt_id", "receipt_date").join(receipt_lines, "receipt_id")
    return met.groupBy("invoice_id", "po_line_id").agg(
        F.sum("quantity_received").cast("decimal(18,4)").alias("received_quantity"), F.sum("line_value").cast("decimal(18,2)").alias("received_value"),
        F.min(F.struct("receipt_date", "receipt_line_id")).getField("receipt_line_id").alias("receipt_line_id"), F.count("*").alias("receipt_lines"))


def line_matches(invoice_lines: DataFrame, po_lines: DataFrame, matched: DataFrame, receipts_of: DataFrame, receipt_lines: DataFrame) -> DataFrame:
    """One row per invoice line of a matched invoice, matched or not, with its variances.

    A line belongs to one document. Invoice lines, order lines and the receipt lines of the matched
    order are dealt by order once. There ``best_lines`` and ``receipt_totals`` are worked out side by
    side: what a line needs of its order line travels with the offer, and receipt lines collapse to
    their totals in the aggregate in which equal lines collapse.
    """
    # An invoice that comes twice asks once per line and order.
    orders_of = matched.groupBy("invoice_id").agg(F.collect_set("po_id").alias("orders"))
    left = invoice_lines.join(orders_of, "invoice_id").select(
        F.explode_outer("orders").alias("po_id"), F.lit(True).alias("asked"), "invoice_id", "invoice_line_id", *_FIELDS, "line_total")
    right = po_lines.filter("po_id is not null").select("po_id", F.lit(False).alias("asked"), *_FIELDS, "line_total", "line_number", "po_line_id")
    got = receipts_of.select("invoice_id", "po_id", "receipt_id", "receipt_date").join(
        receipt_lines.select("receipt_id", "receipt_line_id", "po_line_id", "quantity_received"), "receipt_id").filter("po_line_id is not null").select(
        "po_id", "invoice_id", c("po_line_id").alias("got_line"), "quantity_received", "receipt_date", "receipt_line_id")
    every = left.unionByName(right, allowMissingColumns=True).unionByName(got, allowMissingColumns=True).repartition("po_id")
    # Order lines whose number comes twice are met as often.
    twins = F.collect_list(F.when(~c("asked"), F.struct(c("quantity").alias("po_quantity"), c("line_total").alias("po_amount")))).over(W.partitionBy("po_id", "po_line_id"))
    line = F.when(~c("asked"), F.struct("line_number", "po_line_id", F.array_sort(twins).alias("twins")))
    keyed = (_with_keys(every).withColumn("line", line).withColumn("line_total", F.when(c("asked"), c("line_total")))
             .withColumn("key", F.explode_outer("keys")).filter(F.coalesce("asked", F.lit(True)) | c("key").isNotNull()))
    row = ["po_id", "asked", "invoice_id", "invoice_line_id", *_FIELDS, "line_total", "got_line"]
    few = keyed.groupBy("key", *row).agg(
        F.min("line").alias("line"), F.count("*").alias("copies"), F.sum("quantity_received").cast("decimal(18,4)").alias("received"),
        F.min(F.when(c("asked").isNull(), F.struct("receipt_date", "receipt_line_id"))).alias("first"))
    met = few.withColumn("offers", _offers()).filter(F.coalesce("asked", F.lit(True))).drop("line").select("*", F.inline_outer("offers")).drop("offers")
    pick = F.when(c("line").isNotNull() & (c("confidence") >= LINE_MATCH_MIN), F.struct(_pick().alias("p"), c("line.twins").alias("twins")))
    scored = met.withColumn("confidence", line_confidence()).groupBy(*row).agg(
        F.min(pick).alias("pick"), F.max("copies").alias("copies"), F.max("received").alias("received"), F.min("first").alias("first"))
    best = scored.withColumn("pick", F.when(c("asked"), F.min("pick").over(W.partitionBy("po_id", "invoice_line_id"))))
    same = W.partitionBy("po_id", "invoice_id", "at_line")
    rich = (best.withColumn("at_line", F.coalesce("pick.p.po_line_id", "got_line"))
            .withColumn("received", F.max("received").over(same)).withColumn("first", F.min("first").over(same)).filter("asked")
            .withColumn("hit", c("at_line").isNotNull()).withColumn(
                "of", F.explode_outer(F.flatten(F.array_repeat(F.coalesce("pick.twins", F.array(F.lit(None))), c("copies").cast("int"))))))
    hit, po_q, po_a = c("hit"), c("of.po_quantity").cast("double"), c("of.po_amount").cast("double")
    received = F.when(hit, c("received"))
    compare = F.when(received > 0, received).otherwise(c("quantity")).cast("double")
    qty = F.when(~hit | (po_q == 0), 1.0).otherwise(F.abs(compare - po_q) / po_q)
    amt = F.when(~hit | (po_a == 0), 1.0).otherwise(F.abs(c("line_total").cast("double") - po_a) / po_a)
    return rich.select(
        "invoice_id", "invoice_line_id", c("at_line").alias("po_line_id"), F.when(hit, c("first.receipt_line_id")).alias("receipt_line_id"), hit.alias("is_matched"),
        F.coalesce("pick.p.confidence", F.lit(0.0)).alias("confidence"), qty.alias("quantity_variance"), amt.alias("amount_variance"),
    ).withColumn("within", c("is_matched") & (c("quantity_variance") <= THREE_WAY_QUANTITY_SHARE) & (c("amount_variance") <= THREE_WAY_AMOUNT_SHARE))


def financial_summary(matched: DataFrame, orders: DataFrame, receipts_of: DataFrame, invoice_lines: DataFrame, po_lines: DataFrame) -> DataFrame:
    """Amounts and quantities of the three documents per invoice, each aggregated on its own."""
    got = receipts_of.groupBy("invoice_id").agg(F.sum("total_value").cast("decimal(18,2)").alias("receipt_amount"),
                                                F.sum("total_quantity").cast("decimal(18,4)").alias("receipt_quantity"), F.count("*").alias("receipts"))
    inv_q = invoice_lines.groupBy("invoice_id").agg(F.sum("quantity").cast("decimal(18,4)").alias("invoice_quantity"))
    po_q = po_lines.groupBy("po_id").agg(F.sum("quantity").cast("decimal(18,4)").alias("po_quantity"))
    rows = (matched.select("invoice_id", "po_id", c("total_amount").alias("invoice_amount"))
            .join(orders.select("po_id", c("total_amount").alias("po_amount")), "po_id").join(po_q, "po_id", "left")
            .join(inv_q, "invoice_id", "left").join(got, "invoice_id", "left"))
    zero2, zero4 = F.lit(0).cast("decimal(18,2)"), F.lit(0).cast("decimal(18,4)")
    rows = rows.select("invoice_id", "po_id", "po_amount", "invoice_amount", F.coalesce("receipt_amount", zero2).alias("receipt_amount"),
                       F.coalesce("po_quantity", zero4).alias("po_quantity"), F.coalesce("invoice_quantity", zero4).alias("invoice_quantity"),
                       F.coalesce("receipt_quantity", zero4).alias("receipt_quantity"), F.coalesce("receipts", F.lit(0)).alias("receipts"))
    return rows.select("*", F.abs(c("invoice_amount") - c("po_amount")).alias("net_amount_variance"),
                       F.when(c("po_quantity") != 0, F.abs(c("invoice_quantity") - c("po_quantity"))).otherwise(zero4).alias("net_quantity_variance"))


def classify(lines: DataFrame, summary: DataFrame) -> DataFrame:
    """Match type, confidence and delivery class per invoice."""
    per = lines.groupBy("invoice_id").agg(
        F.count("*").alias("total_lines"), F.count_if("is_matched").alias("matched_lines"), F.count_if("within").alias("within_lines"),
        F.count("receipt_line_id").alias("with_receipt"), F.count("po_line_id").alias("with_order"))
    rows = summary.join(per, "invoice_id", "left").na.fill(0, ["total_lines", "matched_lines", "within_lines", "with_receipt", "with_order"])
    m = c("matched_lines").cast("double") / c("total_lines")
    t = c("within_lines").cast("double") / c("total_lines")
    none, perfect = c("total_lines") == 0, (m >= 0.95) & (t >= 0.95)
    short = c("receipt_quantity") < c("po_quantity")
    split = c("with_receipt") > c("with_order")
    price = c("net_amount_variance").cast("double") > c("po_amount").cast("double") * THREE_WAY_AMOUNT_SHARE
    count = c("net_quantity_variance").cast("double") > c("po_quantity").cast("double") * THREE_WAY_QUANTITY_SHARE
    kind = (F.when(none, "perfect_match").when(perfect, "perfect_match").when(short, "partial_receipt").when(split, "split_delivery")
            .when(price, "price_variance").when(count, "quantity_variance").otherwise("partial_receipt"))
    conf = (F.when(none, 0.0).when(perfect, 0.95).when(short, m * 0.85).when(split, m * 0.80).when(price, t * 0.75)
            .when(count, t * 0.70).otherwise(m * t * 0.80))
    delivery = (F.when(c("receipts") == 0, "none").when(c("receipt_quantity") > c("po_quantity"), "over_delivery")
                .when(c("receipts") > 1, "split_delivery").when(short, "under_delivery").otherwise("full"))
    return rows.withColumn("match_type", kind).withColumn("confidence", round_half_up(conf, 4)).withColumn("delivery_class", delivery)


def gate(classified: DataFrame) -> DataFrame:
    """Tolerance flags, exception list and approval decision."""
    amount_ok = c("net_amount_variance").cast("double") <= c("po_amount").cast("double") * THREE_WAY_AMOUNT_SHARE
    quantity_ok = F.when(c("po_quantity") > 0, c("net_quantity_variance").cast("double") <= c("po_quantity").cast("double") * THREE_WAY_QUANTITY_SHARE).otherwise(True)
    rows = classified.withColumn("amount_ok", amount_ok).withColumn("quantity_ok", quantity_ok)
    # The four texts that reviewers and reports look for.
    lost, wide = c("total_lines") - c("matched_lines"), c("matched_lines") - c("within_lines")
    items = F.array_compact(F.array(
        F.when(lost > 0, F.concat(lost.cast("string"), F.lit(" unmatched invoice lines"))),
        F.when(wide > 0, F.concat(wide.cast("string"), F.lit(" lines with high variance"))),
        F.when(~c("amount_ok"), F.lit("Total amount exceeds tolerance")), F.when(~c("quantity_ok"), F.lit("Total quantity exceeds tolerance"))))
    rows = rows.withColumn("exceptions", items)
    auto = (c("confidence") >= THREE_WAY_AUTO) & (F.size("exceptions") == 0) & c("amount_ok") & c("quantity_ok")
    return rows.withColumn("auto_approved", auto).withColumn("requires_review", (c("confidence") >= THREE_WAY_REVIEW) & ~c("auto_approved"))


def three_way_run(invoices: DataFrame, orders: DataFrame, receipts: DataFrame, invoice_lines: DataFrame, po_lines: DataFrame,
                  receipt_lines: DataFrame, as_of: Column) -> DataFrame:
    found = staged(find_orders(invoices, orders), "found")
    matched = invoices.drop("po_id").join(found, "invoice_id")
    receipts_of = related_receipts(matched, receipts, as_of)
    lines = line_matches(invoice_lines, po_lines, matched, receipts_of, receipt_lines)
    summary = financial_summary(matched, orders, receipts_of, invoice_lines, po_lines)
    return gate(classify(lines, summary))


# --- band run ----------------------------------------------------------------------------------


def band_pairs(invoices: DataFrame, orders: DataFrame, vendors: DataFrame, candidates: DataFrame) -> DataFrame:
    """Invoice-order candidates with the vendor, amount and date band scores."""
    # Names are joined to the documents, which are fewer than their pairs; pairs keep what scores need.
    norm = vendors.select("vendor_id", "normalized_name")
    left = invoices.select("invoice_id", "vendor_id", "invoice_date", c("total_amount").alias("inv_amount")).join(
        norm.withColumnRenamed("normalized_name", "inv_norm"), "vendor_id", "left").drop("vendor_id")
    right = orders.select("po_id", "vendor_id", "po_date", c("total_amount").alias("po_amount")).join(
        norm.withColumnRenamed("normalized_name", "po_norm"), "vendor_id", "left").drop("vendor_id")
    return candidates.join(left, "invoice_id").join(right, "po_id").select(
        "invoice_id", "po_id", "place", "invoice_date", scores.band_vendor_score(c("inv_norm"), c("po_norm")).alias("vendor_score"),
        scores.band_amount_score(c("inv_amount"), c("po_amount")).alias("amount_score"),
        scores.band_date_score(c("invoice_date"), c("po_date")).alias("date_score"))


def band_triples(pairs: DataFrame, invoices: DataFrame, receipts: DataFrame, k: int = 10) -> DataFrame:
    """Pairs extended by those candidate receipts that belong to the same order."""
    # The order's receipts are looked up in the invoice's list, so the list is never written row by row.
    of_order = pairs.join(receipts.select("po_id", "receipt_id", "receipt_date"), "po_id")
    met = of_order.join(receipt_lists(invoices, receipts, k), "invoice_id")
    hits = F.filter("near", lambda x: x["id"] == c("receipt_id"))
    return met.withColumn("_hit", F.explode(hits)).withColumn("receipt_place", c("_hit.place")).drop("near", "_hit").withColumn(
        "receipt_score", scores.band_receipt_score(c("receipt_date"), c("invoice_date")))


def band_run(invoices: DataFrame, orders: DataFrame, receipts: DataFrame, vendors: DataFrame, auto: float = 85.0) -> DataFrame:
    """Best triple per invoice, or the best pair when no triple reaches 70 and the pair beats it."""
    pairs = staged(band_pairs(invoices, orders, vendors, order_candidates(invoices, orders)), "pairs")
    triples = band_triples(pairs, invoices, receipts)
    three = scores.band3_confidence(c("vendor_score"), c("amount_score"), c("date_score"), c("receipt_score"))
    two = scores.band2_confidence(c("vendor_score"), c("amount_score"), c("date_score"))
    fields = ["po_id", "vendor_score", "amount_score", "date_score"]

    def best(df: DataFrame, conf: Column, places: list[str], extra: list[Column], name: str) -> DataFrame:
        order = F.struct((-conf).alias("k"), *[c(p) for p in places], *[c(f) for f in fields], *extra)
        return df.filter(conf > 0).groupBy("invoice_id").agg(F.min(order).alias(name))

    b3 = best(triples, three, ["place", "receipt_place"], [c("receipt_id"), c("receipt_score")], "t")
    b2 = best(pairs, two, ["place"], [], "p")
    both = invoices.select("tenant_id", "invoice_id", "total_amount").join(b3, "invoice_id", "left").join(b2, "invoice_id", "left")
    c3, c2 = F.coalesce(-c("t.k"), F.lit(0.0)), F.coalesce(-c("p.k"), F.lit(0.0))
    use2 = (c3 < 70) & (c2 > c3)
    chosen = both.select(
        "tenant_id", "invoice_id", "total_amount", F.when(use2, c2).otherwise(c3).alias("raw"),
        F.when(use2 | (c3 == 0), "2way_po_invoice").otherwise("3way_full").alias("match_type"),
        *[F.when(use2, c(f"p.{f}")).otherwise(c(f"t.{f}")).alias(f) for f in fields],
        F.when(~use2, c("t.receipt_id")).alias("receipt_id"))
    chosen = chosen.join(orders.select("po_id", c("total_amount").alias("po_amount")), "po_id", "left")
    status = scores.band_status(c("raw"))
    kind = scores.band_exception_type(c("po_id"), c("amount_score"), c("vendor_score"), c("date_score"))
    variance = c("total_amount") - c("po_amount")
    return chosen.select(
        "tenant_id", "invoice_id", "po_id", "receipt_id", "match_type", status.alias("match_status"), round_half_up(c("raw"), 4).alias("confidence"),
        F.when(status == "exception", kind).when(status == "failed", "no_match_found").alias("exception_type"), variance.alias("variance_amount"),
        round_half_up(F.try_divide(variance.cast("double"), c("po_amount").cast("double")) * 100.0, 5).alias("variance_percentage"),
        F.when(c("raw") >= auto, "auto_approved").otherwise("pending").alias("approval_status"),
        F.when(c("raw") >= auto, "matched").otherwise("unmatched").alias("invoice_matching_status"), c("total_amount").alias("invoice_amount"), "po_amount")


def band_exceptions(results: DataFrame, as_of: Column) -> DataFrame:
    """Exception rows for results in state ``exception``, due a day later, with the vendors' names
    (invoice_vendor, po_vendor) beside them."""
    kind = c("exception_type")
    told = scores.exception_details(kind, c("invoice_amount"), c("po_amount"), c("invoice_vendor"), c("po_vendor"))
    return results.filter("match_status = 'exception'").withColumn("_told", told).select(
        "tenant_id", "invoice_id", "exception_type", scores.exception_severity(kind, c("variance_amount")).alias("severity"),
        *(c(f"_told.{x}").alias(x) for x in ("title", "description", "expected_value", "actual_value", "field_name")),
        F.lit("open").alias("status"), scores.exception_priority(kind, c("invoice_amount")).alias("priority"),
        F.when(kind == "amount_variance", c("variance_amount")).alias("variance_amount"), F.date_add(as_of, 1).alias("due_date"))


# --- tolerances, results and feedback ------------------------------------------------------------


def effective_tolerances(documents: DataFrame, tolerances: DataFrame, kind: str) -> DataFrame:
    """Per document the active tolerance of a kind: vendor-specific first, then priority.

    A vendor's rules meet its documents by (tenant, vendor), the general ones by tenant; an array
    holds the rules of one kind for one vendor, or for a whole tenant. Whether a side is small
    enough to broadcast is left to Spark's own statistics.
    """
    active = tolerances.filter(c("is_active") & (c("tolerance_type") == kind))
    rule = F.struct("vendor_id", "amount_threshold", "priority", "percentage_tolerance", "absolute_tolerance")
    general = active.filter("vendor_id is null").groupBy(c("tenant_id").alias("rule_tenant")).agg(F.collect_list(rule).alias("rules"))
    own = active.filter("vendor_id is not null").groupBy(c("tenant_id").alias("own_tenant"), c("vendor_id").cast("bigint").alias("own_vendor")).agg(F.collect_list(rule).alias("own_rules"))
    met = documents.join(general, c("tenant_id") == c("rule_tenant"), "left").join(
        own, (c("tenant_id") == c("own_tenant")) & (c("vendor_id").cast("bigint") == c("own_vendor")), "left")
    every = F.concat(F.coalesce("own_rules", F.array()), F.coalesce("rules", F.array()))
    fit = F.filter(every, lambda r: F.coalesce(c("total_amount") >= r["amount_threshold"], r["amount_threshold"].isNull()))
    ranked = F.transform(fit, lambda r: F.struct(F.when(r["vendor_id"].isNull(), 1).otherwise(0).alias("general"), (-r["priority"]).alias("order"),
                                                 r["percentage_tolerance"].cast("double").alias("share"), r["absolute_tolerance"].cast("double").alias("absolute")))
    return met.withColumn("rule", F.array_min(ranked)).drop("rules", "rule_tenant", "own_rules", "own_tenant", "own_vendor")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row per key by an ordering, as a map-side combined maximum."""
    rest = [x for x in df.columns if x not in keys]
    top = F.max(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("_row")))
    return df.groupBy(*keys).agg(top.alias("_t")).select(*keys, "_t._row.*")
