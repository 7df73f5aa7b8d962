"""Candidate search: nearest rows by date, nearest amount, and pruned fuzzy bands.

None of these joins a whole group with itself. Each one joins on keys narrow enough that
only rows able to win meet, and the narrowing is lossless by the argument in its docstring.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerlink.functions import scores
from ledgerlink.session import staged

c = F.col
DAYS_BACK, DAYS_AHEAD = 30, 7


def nearest_lists(left: DataFrame, right: DataFrame, keys: Sequence[str], left_date: str, right_date: str,
                  right_id: str, k: int) -> DataFrame:
    """(keys, left_date, near): per asked date the ``k`` right rows closest in date, ties by id, as
    an array of (id, place).

    Only the ``k`` smallest ids of a day can ever be chosen, so each (keys, day) is first cut
    to ``k`` rows (a per-task group limit before the shuffle) and becomes one row with a short list.
    The days that offer something are numbered; a left date needs the lists of the ``k`` numbers
    up to its own place and of the ``k`` after it, which a window frame over the numbers holds. What
    is kept per key is bounded by the number of days, whatever the key's share of the table, and
    nothing is written per pair.
    """
    keys = list(keys)
    day_top = W.partitionBy(*keys, "day").orderBy("rid")
    few = (right.na.drop(subset=keys).select(*keys, c(right_date).alias("day"), c(right_id).alias("rid"))
           .withColumn("n", F.row_number().over(day_top)).filter(c("n") <= k).drop("n"))
    offered = few.groupBy(*keys, "day").agg(F.sort_array(F.collect_list(F.struct("rid"))).alias("ids")).withColumn("asked", F.lit(False))
    days = left.na.drop(subset=keys).select(*keys, c(left_date).alias("day")).distinct().withColumn("asked", F.lit(True))
    upto = W.partitionBy(*keys).orderBy("day").rangeBetween(W.unboundedPreceding, W.currentRow)
    around = W.partitionBy(*keys).orderBy("number")
    listed = F.collect_list(F.when(c("ids").isNotNull(), F.struct(c("day").alias("rday"), c("ids"))))
    placed = (offered.unionByName(days, allowMissingColumns=True).withColumn("number", F.count("ids").over(upto))
              .withColumn("back", listed.over(around.rangeBetween(1 - k, 0))).withColumn("ahead", listed.over(around.rangeBetween(1, k))).filter("asked"))

    def nearest(lists: Column) -> Column:
        return F.slice(F.flatten(F.transform(lists, lambda d: F.transform(d["ids"], lambda i: F.struct(d["rday"].alias("rday"), i["rid"].alias("rid"))))), 1, k)

    both = F.concat(nearest(F.sort_array("back", asc=False)), nearest(F.sort_array("ahead")))
    ranked = F.sort_array(F.transform(both, lambda x: F.struct(F.abs(F.datediff(c("day"), x["rday"])).alias("gap"), x["rid"].alias("rid"))))
    near = F.transform(F.slice(ranked, 1, k), lambda x, i: F.struct(x["rid"].alias("id"), (i + 1).alias("place")))
    return placed.select(*keys, c("day").alias(left_date), near.alias("near"))


def nearest_by_date(left: DataFrame, right: DataFrame, keys: Sequence[str], left_date: str, right_date: str,
                    right_id: str, k: int) -> DataFrame:
    """(keys, left_date, right_id, place): ``nearest_lists`` as rows."""
    lists = nearest_lists(left, right, keys, left_date, right_date, right_id, k)
    return lists.select(*keys, left_date, F.explode("near").alias("n")).select(*keys, left_date, c("n.id").alias(right_id), "n.place")


def order_candidates(invoices: DataFrame, orders: DataFrame, k: int = 10) -> DataFrame:
    """(invoice_id, po_id, place): the linked order, else the vendor's ``k`` closest by date."""
    usable = orders.filter(c("status").isin("approved", "partially_received", "received")).select("tenant_id", "vendor_id", "po_id", "po_date")
    linked = invoices.filter(c("po_id").isNotNull()).select("tenant_id", "invoice_id", "po_id").join(
        usable.select("tenant_id", "po_id"), ["tenant_id", "po_id"]).select("invoice_id", "po_id", F.lit(1).alias("place"))
    loose = invoices.filter(c("po_id").isNull()).select("tenant_id", "vendor_id", "invoice_id", "invoice_date")
    keys = ["tenant_id", "vendor_id"]
    lists = nearest_lists(loose, usable, keys, "invoice_date", "po_date", "po_id", k)
    near = loose.join(lists, [*keys, "invoice_date"]).select("invoice_id", F.explode("near").alias("n"))
    return linked.unionByName(near.select("invoice_id", c("n.id").alias("po_id"), "n.place"))


def receipt_lists(invoices: DataFrame, receipts: DataFrame, k: int = 10) -> DataFrame:
    """(invoice_id, near): the vendor's ``k`` accepted receipts closest by date, an array of (id, place)."""
    usable = receipts.filter("status = 'accepted'").select("tenant_id", "vendor_id", "receipt_id", "receipt_date")
    keys = ["tenant_id", "vendor_id"]
    asked = invoices.select(*keys, "invoice_id", "invoice_date")
    near = nearest_lists(asked, usable, keys, "invoice_date", "receipt_date", "receipt_id", k)
    return asked.join(near, [*keys, "invoice_date"]).select("invoice_id", "near")


def receipt_candidates(invoices: DataFrame, receipts: DataFrame, k: int = 10) -> DataFrame:
    """(invoice_id, receipt_id, place): ``receipt_lists`` as rows."""
    return receipt_lists(invoices, receipts, k).select("invoice_id", F.explode("near").alias("n")).select(
        "invoice_id", c("n.id").alias("receipt_id"), "n.place")


# --- nearest amount ----------------------------------------------------------------------


def _day_number(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def _day_buckets(day: Column, back: int = DAYS_BACK, ahead: int = DAYS_AHEAD, width: int = DAYS_BACK + DAYS_AHEAD + 1) -> Column:
    """The buckets of ``width`` days that a window of days around ``day`` touches."""
    return F.sequence(F.floor((_day_number(day) - back) / width), F.floor((_day_number(day) + ahead) / width))


def nearest_amount(invoices: DataFrame, orders: DataFrame) -> DataFrame:
    """(invoice_id, po_id): same vendor, order date -30/+7 days, total within 10 %, closest total.

    Orders collapse to distinct (vendor, date, total) keeping the smallest id, invoices to
    distinct (vendor, date, total); copies therefore cost nothing. Nothing is joined pair by pair:
    an invoice total asks each of its 38 days, and a day's totals, asked and offered, are walked in
    order, which yields the neighbour below and above. The cost is 38 rows per distinct total,
    whatever a vendor's share of the table; they come up where they are walked, since asked and
    offered totals are dealt by cells of 38 days before.
    """
    keys, width, start = ["tenant_id", "vendor_id"], DAYS_BACK + DAYS_AHEAD + 1, F.lit("1970-01-01").cast("date")
    asked = invoices.select(*keys, "invoice_date", "total_amount").distinct().select(
        *keys, F.explode(_day_buckets(c("invoice_date"))).alias("cell"), c("total_amount").alias("at"), "invoice_date")
    offered = orders.filter("status <> 'archived'").groupBy(*keys, "po_date", c("total_amount").alias("at")).agg(F.min("po_id").alias("id")).select(
        *keys, F.floor(_day_number(c("po_date")) / width).alias("cell"), "at", "po_date", F.struct(c("at").alias("t"), c("id")).alias("o"))
    number = _day_number(c("invoice_date"))
    asks = F.sequence(F.greatest(number - DAYS_BACK, c("cell") * width).cast("int"), F.least(number + DAYS_AHEAD, c("cell") * width + (width - 1)).cast("int"))
    days = asked.unionByName(offered, allowMissingColumns=True).repartition(*keys, "cell").withColumn(
        "po_date", F.explode(F.when(c("o").isNotNull(), F.array("po_date")).otherwise(F.transform(asks, lambda n: F.date_add(start, n)))))
    day = W.partitionBy(*keys, "cell", "po_date").orderBy("at")
    below = F.last("o", True).over(day.rangeBetween(W.unboundedPreceding, 0))
    above = F.first("o", True).over(day.rangeBetween(0, W.unboundedFollowing))
    walked = days.withColumn("lo", below).withColumn("hi", above).filter(c("invoice_date").isNotNull())
    near = (c("po_total") >= c("total_amount") * F.lit("0.9").cast("decimal(2,1)")) & (c("po_total") <= c("total_amount") * F.lit("1.1").cast("decimal(2,1)"))
    pairs = (walked.select(*keys, "invoice_date", c("at").alias("total_amount"), F.explode(F.array_compact(F.array("lo", "hi"))).alias("o"))
             .select(*keys, "invoice_date", "total_amount", c("o.t").alias("po_total"), c("o.id").alias("po_id")).filter(near))
    gap = F.abs(c("po_total") - c("total_amount"))
    best = pairs.groupBy(*keys, "invoice_date", "total_amount").agg(
        F.min(F.struct(gap.alias("gap"), c("po_id"))).getField("po_id").alias("po_id"))
    return invoices.select("invoice_id", *keys, "invoice_date", "total_amount").join(
        best, [*keys, "invoice_date", "total_amount"]).select("invoice_id", "po_id")


# --- fuzzy band ---------------------------------------------------------------------------


def amount_limit(weights: Mapping[str, float], threshold: float, share: float) -> float | None:
    """Largest amount variance that can still reach ``threshold``; None when any can."""
    need = (threshold - 0.00005 - (sum(weights.values()) - weights["amount"])) / weights["amount"]
    if need <= 0:
        return None
    return max(share, 0.5 - need)


def fuzzy_candidates(invoices: DataFrame, orders: DataFrame, weights: Mapping[str, float] = scores.UNIT_WEIGHTS,
                     threshold: float = scores.UNIT_REVIEW, share: float = scores.AMOUNT_TOLERANCE[0],
                     absolute: float = scores.AMOUNT_TOLERANCE[1], days: int = scores.DATE_TOLERANCE_DAYS) -> DataFrame:
    """Invoice-order pairs in the -30/+7 day band that can still reach the threshold.

    A pair whose amount and date scores are so low that perfect vendor and reference scores
    would not lift it to ``threshold`` cannot be chosen. Outside tolerance the amount score is
    at most 0.5 - variance, so the variance is bounded, and totals within that bound fall into
    the same or a neighbouring logarithmic bucket. Small totals, where the absolute tolerance
    may allow more, share the lowest bucket. Joining on tenant, 38-day bucket and amount
    bucket therefore loses nothing; the exact bound is applied right after.
    """
    limit = amount_limit(weights, threshold, share)
    met = _in_band(*_sides(invoices, orders), DAYS_BACK, DAYS_AHEAD, DAYS_BACK + DAYS_AHEAD + 1, limit, absolute)
    return _reaching(met, weights, F.lit(threshold - 0.00005), share, absolute, days)


def _sides(invoices: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (invoices.select("tenant_id", "invoice_id", c("vendor_id").alias("inv_vendor_id"), c("po_reference").alias("inv_ref"), c("total_amount").alias("inv_amount"), "invoice_date"),
            orders.filter("status <> 'archived'").select("tenant_id", "po_id", "po_number", "po_date", c("vendor_id").alias("po_vendor_id"), c("total_amount").alias("po_amount")))


def _in_band(left: DataFrame, right: DataFrame, back: int, ahead: int, width: int, limit: float | None, absolute: float) -> DataFrame:
    """Pairs within the days, met by day bucket and, with a ``limit`` on the amount variance, by amount bucket."""
    left = left.withColumn("cell", F.explode(_day_buckets(c("invoice_date"), back, ahead, width)))
    right = right.withColumn("cell", F.floor(_day_number(c("po_date")) / width))
    keys = ["tenant_id", "cell"]
    if limit is not None and limit < 1:
        span, floor_amount = -math.log(1 - limit) + 1e-9, absolute / limit

        def band(x: Column) -> Column:
            return F.floor(F.log(F.greatest(x.cast("double"), F.lit(floor_amount))) / span)

        left = left.withColumn("band", F.explode(F.array(*[band(c("inv_amount")) + i for i in (-1, 0, 1)])))
        right = right.withColumn("band", band(c("po_amount")))
        keys.append("band")
    in_days = c("po_date").between(F.date_sub("invoice_date", back), F.date_add("invoice_date", ahead))
    return left.join(right, keys).filter(in_days).drop("cell", "band")


def _reaching(pairs: DataFrame, weights: Mapping[str, float], least: Column, share: float, absolute: float, days: int) -> DataFrame:
    """Pairs with amount and date scores that perfect vendor and reference scores lift to ``least``."""
    a, b = c("inv_amount"), c("po_amount")
    gap = scores.day_gap(c("invoice_date"), c("po_date"))
    scored = pairs.withColumn("share", scores.variance_share(a, b)).withColumn("gap", gap).select(
        "*", scores.unit_amount_score(c("share"), scores.within_tolerance(a, b, share, absolute)).alias("amount_score"),
        scores.unit_date_score(c("gap"), c("gap") <= days).alias("date_score"))
    reach = weights["vendor_name"] + weights["reference"] + c("amount_score") * weights["amount"] + c("date_score") * weights["date"]
    return scored.filter(reach >= least)


# --- fuzzy band, best order only -------------------------------------------------------------

# Days and cells in which an invoice looks for a first good order, and the cells' width.
_NEAR_DAYS, _NEAR_CELLS, _CELL = (-1, 0, 1), (-2, -1, 0, 1), 8
# Edit distances up to which bounds tell apart.
_FAR = 5


def _forms(vendors: DataFrame) -> DataFrame:
    """(vendor_id, form): the cleaned name, its words in order and its distinct words; null if a
    vendor has several names, so that nothing is concluded from them."""
    one = vendors.groupBy("vendor_id").agg(F.min("name").alias("a"), F.max("name").alias("b")).select(
        "vendor_id", F.when((c("a") == c("b")) & (c("a") != ""), scores.clean(c("a"))).alias("key"))
    words = F.array_sort(F.regexp_extract_all("key", F.lit("[a-z0-9_]+"), F.lit(0)))
    worded = one.select("vendor_id", "key", F.array_join(words, " ").alias("ordered"), F.array_distinct(words).alias("words"))
    fields = ["key", "ordered", "words", *_marks("key"), *_marks("ordered")]
    return _marked(_marked(worded, "key"), "ordered").select("vendor_id", F.when(c("key").isNotNull(), F.struct(*fields)).alias("form"))


def _marks(text: str) -> list[str]:
    return [f"{text}_chars", f"{text}_pairs"]


def _marked(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with two 64-bit sets of a text: of its characters and of its pairs of neighbours, each
    counted ("the second a"), by hash. Two texts differ in at least as many as their sets do."""
    size, (chars, pairs) = F.length(text), _marks(text)

    def parts(n: int) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substr(c(text), i, F.lit(n)))
        return F.when(size >= n, F.array_sort(some)).when(size < n, F.array().cast("array<string>"))

    def bits(sorted_: str) -> Column:
        nth = F.transform(c(sorted_), lambda x, i: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(x, i - F.array_position(c(sorted_), x)), F.lit(64)).cast("int")))
        return F.aggregate(nth, F.lit(0).cast("bigint"), lambda found, m: found.bitwiseOR(m))

    return rows.withColumn("_one", parts(1)).withColumn("_two", parts(2)).withColumn(chars, bits("_one")).withColumn(pairs, bits("_two")).drop("_one", "_two")


def _taken_least(a: str, b: str, of_longer: float, of_both: float) -> Column:
    """What the edit distance of two texts takes at least (see ``_taken``), by their marks alone. An edit
    takes and brings one character and two pairs at most; where nothing is replaced, it takes or brings one."""
    only = lambda p, q: F.bit_count(c(p).bitwiseAND(F.bitwise_not(c(q))))
    (gone, come), (lost, won) = ((only(p, q), only(q, p)) for p, q in zip(_marks(a), _marks(b)))
    n, m, half = F.length(a), F.length(b), F.greatest(lost, won) * 0.5
    taken = F.lit(0.0)
    if of_longer:
        taken = taken + F.greatest(F.greatest(gone, come).cast("double"), half) * F.try_divide(F.lit(of_longer), F.greatest(n, m).cast("double"))
    if of_both:
        taken = taken + F.greatest((gone + come).cast("double"), half) * F.try_divide(F.lit(of_both), (n + m).cast("double"))
    return taken


def _common_least(x: Column, y: Column) -> Column:
    """What ``percent_ratio`` / 100 of two texts is at least: an edit distance d leaves a common
    subsequence of max(n, m) - d characters."""
    n, m = F.length(x), F.length(y)
    return F.when(x == y, 1.0).otherwise(F.greatest(F.lit(0.0), F.try_divide((F.greatest(n, m) - F.levenshtein(x, y)) * 2.0, (n + m).cast("double")) - 0.005))


def _vendor_least(a: Column, b: Column) -> Column:
    """Lower bound of the composite similarity of two names given as forms; null if one is missing."""
    shared = F.array_intersect(a["words"], b["words"])
    left, right = (F.array_join(F.concat(shared, F.array_except(x["words"], y["words"])), " ") for x, y in ((a, b), (b, a)))
    words = F.when((F.size(a["words"]) > 0) & (F.size(b["words"]) > 0), _common_least(left, right)).otherwise(0.0)
    other = scores.edit_similarity(a["key"], b["key"]) * 0.3 + _common_least(a["ordered"], b["ordered"]) * 0.4 + words * 0.3
    return F.when(a.isNotNull() & b.isNotNull(), F.when(a["key"] == b["key"], 1.0).otherwise(other))


def _neighbours(asked: DataFrame, offered: DataFrame, keys: list[str]) -> DataFrame:
    """(i, o): per asked row the offered rows of its keys with the next smaller and the next larger
    total. Both are walked in order of the total, so that nothing is joined."""
    o = F.struct(*[x for x in offered.columns if x not in keys])
    i = F.struct(*[x for x in asked.columns if x not in keys])
    both = asked.select(*keys, c("inv_amount").alias("at"), i.alias("i")).unionByName(
        offered.select(*keys, c("po_amount").alias("at"), o.alias("o")), allowMissingColumns=True)
    part = W.partitionBy(*keys)
    upto = (W.unboundedPreceding, W.currentRow)
    walked = both.withColumn("lo", F.last("o", True).over(part.orderBy("at").rangeBetween(*upto))).withColumn(
        "hi", F.last("o", True).over(part.orderBy(F.desc("at")).rangeBetween(*upto)))
    return walked.filter(c("i").isNotNull()).select("i", F.explode(F.array_compact(F.array("lo", "hi"))).alias("o")).select("i.*", "o.*")


def _first_found(left: DataFrame, right: DataFrame, weights: Mapping[str, float], share: float, absolute: float, days: int) -> DataFrame:
    """(invoice_id, least): a confidence that the best order of an invoice has at least, from the
    vendor's orders of the weeks around and the tenant's orders of the days around with the closest totals."""
    day, left = _day_number(c("invoice_date")), left.filter("tenant_id is not null")
    cells = left.withColumn("cell", F.explode(F.array(*[F.floor(day / _CELL) + k for k in _NEAR_CELLS]))).withColumn("vendor", c("inv_vendor_id"))
    own = _neighbours(cells, right.withColumn("cell", F.floor(_day_number(c("po_date")) / _CELL)).withColumn("vendor", c("po_vendor_id")), ["tenant_id", "vendor", "cell"])
    dated = left.withColumn("cell", F.explode(F.array(*[day + k for k in _NEAR_DAYS])))
    other = _neighbours(dated, right.withColumn("cell", _day_number(c("po_date"))), ["tenant_id", "cell"])
    in_days = c("po_date").between(F.date_sub("invoice_date", DAYS_BACK), F.date_add("invoice_date", DAYS_AHEAD))
    met = _reaching(own.unionByName(other).filter(in_days), weights, F.lit(0.0), share, absolute, days).filter("share is not null")
    vendor = F.when(c("inv_vendor_id") == c("po_vendor_id"), 1.0).otherwise(_vendor_least(c("inv_form"), c("po_form")))
    low, _ = scores.reference_bounds(c("inv_ref"), c("po_number"))
    conf = vendor * weights["vendor_name"] + c("amount_score") * weights["amount"] + c("date_score") * weights["date"] + low * weights["reference"]
    return met.groupBy("invoice_id").agg(F.max(conf - 0.0001).alias("least"))


def best_order_candidates(invoices: DataFrame, orders: DataFrame, vendors: DataFrame, weights: Mapping[str, float] = scores.UNIT_WEIGHTS,
                          threshold: float = scores.UNIT_REVIEW, share: float = scores.AMOUNT_TOLERANCE[0],
                          absolute: float = scores.AMOUNT_TOLERANCE[1], days: int = scores.DATE_TOLERANCE_DAYS) -> DataFrame:
    """The ``fuzzy_candidates`` that can still be the best order of their invoice.

    A few orders with close totals show what confidence the best one has at least. Where that
    asks for a total within tolerance and a date within ``days``, an invoice meets only the orders
    of these days and of its amount buckets of that tolerance, else the whole band. A pair is kept if
    bounds on its vendor and reference scores, from edit distances, reach what was found. The bounds are
    part of the join, so only pairs that are kept are written or shuffled.
    """
    left, right = _sides(invoices, orders)
    forms = _forms(vendors)
    left = staged(_marked(left.join(forms.toDF("inv_vendor_id", "inv_form"), "inv_vendor_id", "left").withColumn("ref", _one_word(c("inv_ref"))), "ref"), "asked")
    right = staged(_marked(right.join(forms.toDF("po_vendor_id", "po_form"), "po_vendor_id", "left").withColumn("number", _one_word(c("po_number"))), "number"), "offered")
    found = _first_found(left, right, weights, share, absolute, days)
    floor = F.lit(threshold - 0.00005)
    # A missing reference brings in nothing. What amount and date have to, and the most that they can outside tolerance and days.
    lost = F.when(c("inv_ref").isNull(), weights["reference"]).otherwise(0.0)
    need = c("asks") - weights["vendor_name"] - weights["reference"]
    outside = max(weights["amount"] * max(0.0, 0.5 - share) + weights["date"], weights["amount"] + weights["date"] * max(0.0, 0.5 - (days + 1) / 60.0))
    left = staged(left.join(found, "invoice_id", "left")
                  .withColumn("asks", F.greatest(c("least") - 0.0002, floor) + lost).withColumn("close", need > outside), "bounded")
    left, right = (side.select("*", c(amount).cast("double").alias(f"{of}_total"), *[c(f"{of}_form.{x}").alias(f"{of}_{x}") for t in ("key", "ordered") for x in (t, *_marks(t))]).drop(f"{of}_form")
                   for side, of, amount in ((left, "inv", "inv_amount"), (right, "po", "po_amount")))
    wide = _in_band(left.filter(~c("close")), right, DAYS_BACK, DAYS_AHEAD, DAYS_BACK + DAYS_AHEAD + 1, amount_limit(weights, threshold, share), absolute)
    close = _in_band(left.filter("close"), right, min(days, DAYS_BACK), min(days, DAYS_AHEAD), _CELL, share, absolute)

    def most(taken: Callable[[str, str, float, float], Column], amount: Column, date: Column) -> Column:
        # Each distance takes its part from perfect scores; where one is not known, nothing is taken.
        name = 1.002 - taken("inv_key", "po_key", 0.3, 0.0) - taken("inv_ordered", "po_ordered", 0.0, 0.4)
        vendor = F.when(c("inv_vendor_id") == c("po_vendor_id"), 1.0).otherwise(F.coalesce(name, F.lit(1.0)))
        reference = F.coalesce(1.0035 - taken("ref", "number", 0.3, 0.7), F.lit(1.0))
        return vendor * weights["vendor_name"] + amount * weights["amount"] + date * weights["date"] + reference * weights["reference"]

    # Nearly all pairs end at bounds from bits and doubles, a little above those from edit distances and exact amounts.
    x, y = c("inv_total"), c("po_total")
    off = F.when(F.greatest(x, y) > 0, F.abs(x - y) / F.greatest(x, y)).otherwise(0.0)
    inside = (off <= share + 1e-9) | (F.abs(x - y) <= absolute + 1e-6)
    gap = scores.day_gap(c("invoice_date"), c("po_date"))
    quick = most(_taken_least, F.coalesce(scores.unit_amount_score(off, inside), F.lit(1.0)), scores.unit_date_score(gap, gap <= days)) + 1e-6 >= c("asks")
    met = _reaching(wide.filter(quick), weights, c("asks"), share, absolute, days).unionByName(_reaching(close.filter(quick), weights, c("asks"), share, absolute, days))
    # A lambda keeps the join out of whole-stage code, whose one method would be too long for Java to compile.
    kept = met.filter(F.exists(F.array("asks"), lambda asks: most(_taken, c("amount_score"), c("date_score")) >= asks))
    helpers = [f"{of}_{x}" for of in ("inv", "po") for t in ("key", "ordered") for x in (t, *_marks(t))]
    return kept.drop("ref", "number", *_marks("ref"), *_marks("number"), *helpers, "inv_total", "po_total", "asks", "close", "least")


def _one_word(text: Column) -> Column:
    """The cleaned text if it is a single word, of which edit distances tell most."""
    key = scores.clean(text)
    return F.when(key.rlike("^[a-z0-9_]+$"), key)


def _taken(a: str, b: str, of_longer: float, of_both: float) -> Column:
    """What the edit distance of two texts takes from their edit similarity and their ratio, weighted;
    of a distance beyond ``_FAR`` only that much is counted, as it need not be known."""
    n, m = F.length(a), F.length(b)
    # It is -1 beyond. Written so that it is worked out once.
    distance = F.pmod(F.levenshtein(c(a), c(b), _FAR), F.lit(_FAR + 2))
    return distance * (F.try_divide(F.lit(of_longer), F.greatest(n, m).cast("double")) + F.try_divide(F.lit(of_both), (n + m).cast("double")))
