"""Scalar expressions run over whole tables."""

from pyspark.sql import functions as F

from ledgerlink.functions import fuzzy, parse, scores, text
from ledgerlink.functions.numeric import round_half_up
from ledgerlink.operators import names, vendors
from ledgerlink.plans.oracle_ctes import (
    sql_duplicate_name, sql_import_name, sql_numeric_text, sql_read_date, sql_read_money,
    sql_grams, sql_round, sql_similarities, sql_similarity, sql_soundex, sql_stored_name, sql_variants, sql_windows,
)
from ledgerlink.plans.registry import query
from ledgerlink.sources.entities import event_as_of

_ROW = "import_batch_id bigint, row_number int"
_PAIR = "invoice_id bigint, po_id bigint"
c = F.col


@query("n01_read_date", f"{_ROW}, raw string, parsed date",
       f"SELECT import_batch_id, row_number, invoice_date AS raw, {sql_read_date('invoice_date')} AS parsed FROM import_rows")
def _(e):
    return e.import_rows.select("import_batch_id", "row_number", c("invoice_date").alias("raw"),
                                parse.read_date(c("invoice_date"), 2001).alias("parsed"))


@query("n02_read_money", f"{_ROW}, raw string, parsed decimal(18,2)",
       f"SELECT import_batch_id, row_number, total_amount AS raw, {sql_read_money('total_amount')} AS parsed FROM import_rows")
def _(e):
    return e.import_rows.select("import_batch_id", "row_number", c("total_amount").alias("raw"),
                                parse.read_money(c("total_amount")).alias("parsed"))


@query("n03_import_vendor_name", f"{_ROW}, name string",
       f"SELECT import_batch_id, row_number, {sql_import_name('vendor_name')} AS name FROM import_rows")
def _(e):
    return e.import_rows.select("import_batch_id", "row_number", text.import_vendor_name(c("vendor_name")).alias("name"))


@query("n04_stored_vendor_name", "vendor_id bigint, name string",
       f"SELECT vendor_id, {sql_stored_name('name')} AS name FROM vendors UNION ALL "
       f"SELECT vendor_id, {sql_stored_name('name')} FROM vendors_dirty")
def _(e):
    both = e.vendors.select("vendor_id", "name").unionByName(e.vendors_dirty.select("vendor_id", "name"))
    return both.select("vendor_id", text.stored_vendor_name(c("name")).alias("name"))


@query("n05_duplicate_vendor_name", "vendor_id bigint, name string",
       f"SELECT vendor_id, {sql_duplicate_name('name')} AS name FROM vendors UNION ALL "
       f"SELECT vendor_id, {sql_duplicate_name('name')} FROM vendors_dirty")
def _(e):
    both = e.vendors.select("vendor_id", "name").unionByName(e.vendors_dirty.select("vendor_id", "name"))
    return both.select("vendor_id", text.duplicate_vendor_name(c("name")).alias("name"))


@query("n06_phone_digits", "vendor_id bigint, digits string",
       "SELECT vendor_id, regexp_replace(phone, '[^0-9]', '', 'g') AS digits FROM vendors_dirty")
def _(e):
    return e.vendors_dirty.select("vendor_id", text.digits_only(c("phone")).alias("digits"))


@query("n07_loose_amount", f"{_ROW}, amount double",
       """SELECT import_batch_id, row_number, CASE WHEN v > 0 THEN v END AS amount FROM (
          SELECT *, TRY_CAST(regexp_replace(total_amount, '[^0-9.-]', '', 'g') AS DOUBLE) AS v FROM import_rows)""")
def _(e):
    return e.import_rows.select("import_batch_id", "row_number", parse.read_loose_amount(c("total_amount")).alias("amount"))


@query("n08_due_date_from_terms", f"{_ROW}, due date",
       """SELECT import_batch_id, row_number,
                 invoice_date + TRY_CAST(regexp_extract(trim(payment_terms), '^([+-]?\\d+)', 1) AS INTEGER) AS due
          FROM parsed_rows""")
def _(e):
    return e.parsed_rows.select("import_batch_id", "row_number",
                                F.date_add("invoice_date", parse.leading_int(c("payment_terms"))).alias("due"))


@query("n09_numeric_text", f"{_ROW}, is_numeric boolean",
       f"SELECT import_batch_id, row_number, {sql_numeric_text('total_amount')} AS is_numeric FROM import_rows")
def _(e):
    return e.import_rows.select("import_batch_id", "row_number", parse.numeric_text(c("total_amount")).alias("is_numeric"))


@query("n10_date_like_text", f"{_ROW}, looks_like_date boolean",
       """SELECT import_batch_id, row_number, regexp_matches(invoice_date,
          '^[ \\t]*(\\d{4}-\\d{1,2}-\\d{1,2}|\\d{1,2}/\\d{1,2}/\\d{2,4}|\\d{1,2}-\\d{1,2}-\\d{2,4})') AS looks_like_date
          FROM import_rows""")
def _(e):
    return e.import_rows.select("import_batch_id", "row_number", parse.date_like(c("invoice_date")).alias("looks_like_date"))


@query("n11_header_suggestions", "header string, field string",
       """SELECT header, min_by(field, rule_order) AS field FROM (
          SELECT DISTINCT lower(trim(regexp_replace(p_name, ' ', '_'))) || '_' || suffix AS header FROM part,
                 (VALUES ('invoice_no'), ('due_date'), ('supplier'), ('total'), ('memo'), ('color')) AS s(suffix)) AS h
          LEFT JOIN header_rules ON contains(header, keyword) GROUP BY header""")
def _(e):
    endings = F.array(*[F.lit(s) for s in ("invoice_no", "due_date", "supplier", "total", "memo", "color")])
    headers = e.raw("part").select("p_name", F.explode(endings).alias("suffix")).select(
        F.concat(F.lower(F.trim(F.regexp_replace("p_name", "^([^ ]*) ", "$1_"))), F.lit("_"), "suffix").alias("header")
    ).distinct()
    return names.suggest_fields(headers, e.config("header_rules"))


@query("n12_edit_similarity", f"{_PAIR}, score double",
       f"""SELECT invoice_id, po_id, CASE WHEN inv_ref IS NULL THEN 0.0e0
           ELSE {sql_round(sql_similarity('lower(inv_ref)', 'lower(po_number)'), 6)} END AS score FROM score_pairs""")
def _(e):
    return e.score_pairs.select("invoice_id", "po_id",
                                round_half_up(scores.edit_similarity(c("inv_ref"), c("po_number")), 6).alias("score"))


@query("n13_stored_name_similarity", f"{_PAIR}, score double",
       f"""SELECT invoice_id, po_id, CASE WHEN inv_norm = po_norm THEN 100.0e0 ELSE
           {sql_round("CAST(greatest(length(inv_norm), length(po_norm)) - levenshtein(inv_norm, po_norm) AS DOUBLE) / greatest(length(inv_norm), length(po_norm)) * 100.0e0", 2)}
           END AS score FROM score_pairs""")
def _(e):
    return e.score_pairs.select("invoice_id", "po_id",
                                scores.stored_name_similarity(c("inv_vendor"), c("po_vendor")).alias("score"))


def _name_pairs(e):
    return e.score_pairs.select("inv_vendor", "po_vendor").distinct()


_PAIRS = "SELECT DISTINCT inv_vendor AS a, po_vendor AS b FROM score_pairs"


@query("n14_token_ratios", "inv_vendor string, po_vendor string, ratio double, partial_ratio double, token_sort double, token_set double",
       f"""SELECT s.a AS inv_vendor, s.b AS po_vendor, ratio, CASE WHEN same THEN 1.0e0 ELSE partial / 100.0e0 END AS partial_ratio, token_sort, token_set
           FROM ({sql_similarities(_PAIRS)}) AS s JOIN ({sql_windows(_PAIRS)}) AS w ON w.a = s.a AND w.b = s.b""")
def _(e):
    a, b = c("inv_vendor"), c("po_vendor")
    return _name_pairs(e).select(
        "*", fuzzy.similarity(a, b, "fuzzy_ratio").alias("ratio"), fuzzy.similarity(a, b, "fuzzy_partial").alias("partial_ratio"),
        fuzzy.similarity(a, b, "fuzzy_token_sort").alias("token_sort"), fuzzy.similarity(a, b, "fuzzy_token_set").alias("token_set"))


@query("n15_phonetic_equality", "inv_vendor string, po_vendor string, score double",
       f"SELECT a AS inv_vendor, b AS po_vendor, CASE WHEN {sql_soundex('lower(trim(a))')} = {sql_soundex('lower(trim(b))')} THEN 1.0e0 ELSE 0.0e0 END AS score FROM ({_PAIRS})")
def _(e):
    return _name_pairs(e).select("*", fuzzy.similarity(c("inv_vendor"), c("po_vendor"), "phonetic").alias("score"))


@query("n16_composite_similarity", "inv_vendor string, po_vendor string, score double",
       f"SELECT a AS inv_vendor, b AS po_vendor, {sql_round('composite', 6)} AS score FROM ({sql_similarities(_PAIRS)})")
def _(e):
    return _name_pairs(e).select("*", fuzzy.composite_rounded(c("inv_vendor"), c("po_vendor")).alias("score"))


# All entries of a tenant are compared with each text; a pair counts if no entry is closer.
@query("n17_tfidf_vendor_match", "tenant_id int, text string, candidate string, score double",
       f"""WITH entries AS (SELECT DISTINCT tenant_id, lower(trim(name)) AS text FROM vendors WHERE is_active),
               wanted AS (SELECT DISTINCT d.tenant_id, lower(trim(d.name)) AS text, lower(trim(v.name)) AS candidate FROM vendors_dirty d JOIN vendors v ON v.vendor_id = d.vendor_id // 10),
               terms AS (SELECT tenant_id, text, gram, count(*) AS tf FROM (SELECT tenant_id, text, unnest({sql_grams('text')}) AS gram FROM (SELECT * FROM entries UNION SELECT tenant_id, text FROM wanted)) GROUP BY ALL),
               vocabulary AS (SELECT t.tenant_id, gram, ln((n + 1)::DOUBLE / (count(*) + 1)) + 1.0e0 AS idf FROM terms t JOIN entries k ON k.tenant_id = t.tenant_id AND k.text = t.text
                   JOIN (SELECT tenant_id, count(*) AS n FROM entries GROUP BY tenant_id) AS z ON z.tenant_id = t.tenant_id GROUP BY t.tenant_id, gram, n),
               vectors AS (SELECT tenant_id, text, gram, w / sqrt(sum(w * w) OVER (PARTITION BY tenant_id, text)) AS w FROM (SELECT t.tenant_id, text, t.gram, tf * idf AS w FROM terms t JOIN vocabulary v ON v.tenant_id = t.tenant_id AND v.gram = t.gram)),
               near AS (SELECT a.tenant_id, a.text, b.text AS entry, sum(a.w * b.w) AS cosine FROM vectors a JOIN vectors b ON b.tenant_id = a.tenant_id AND b.gram = a.gram
                   WHERE (b.tenant_id, b.text) IN (SELECT tenant_id, text FROM entries) AND (a.tenant_id, a.text) IN (SELECT tenant_id, text FROM wanted) GROUP BY ALL)
           SELECT w.tenant_id, w.text, w.candidate, CASE WHEN n.cosine IS NULL OR n.cosine < m.best - 0.000000001e0 THEN 0.0e0 ELSE {sql_round('n.cosine', 6)} END AS score FROM wanted w
           LEFT JOIN near n ON n.tenant_id = w.tenant_id AND n.text = w.text AND n.entry = w.candidate
           LEFT JOIN (SELECT tenant_id, text, max(cosine) AS best FROM near GROUP BY ALL) AS m ON m.tenant_id = w.tenant_id AND m.text = w.text""")
def _(e):
    corpus = e.vendors.filter("is_active").select("tenant_id", c("name"))
    pairs = e.vendors_dirty.select("tenant_id", c("name").alias("text"), F.floor(c("vendor_id") / 10).cast("bigint").alias("vendor_id")).join(
        e.vendors.select("vendor_id", c("name").alias("candidate")), "vendor_id").drop("vendor_id").distinct()
    return names.tfidf_match(pairs, corpus)


@query("n18_ocr_variants", "vendor_id bigint, variant string",
       f"SELECT vendor_id, unnest({sql_variants('name')}) AS variant FROM vendors_dirty")
def _(e):
    return e.vendors_dirty.select("vendor_id", F.explode(fuzzy.ocr_variants(c("name"))).alias("variant"))


@query("n19_word_overlap", "invoice_line_id bigint, po_line_id bigint, score double",
       f"""SELECT invoice_line_id, po_line_id, {sql_round('''CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b)))''', 6)} AS score
           FROM (SELECT invoice_line_id, po_line_id, list_distinct(string_split(lower(i.description), ' ')) AS a,
                        list_distinct(string_split(lower(p.description), ' ')) AS b
                 FROM invoice_lines i JOIN po_lines p ON p.po_line_id = i.invoice_line_id - 500000)""")
def _(e):
    pairs = e.invoice_lines.select((c("invoice_line_id") - 500000).alias("po_line_id"), "invoice_line_id", c("description").alias("a")).join(
        e.po_lines.select("po_line_id", c("description").alias("b")), "po_line_id")
    return pairs.select("invoice_line_id", "po_line_id", round_half_up(scores.word_overlap(c("a"), c("b")), 6).alias("score"))


_VAR = "abs(CAST(inv_amount AS DOUBLE) - CAST(po_amount AS DOUBLE)) / greatest(CAST(inv_amount AS DOUBLE), CAST(po_amount AS DOUBLE))"
_VAR = "CAST(abs(inv_amount - po_amount) AS DOUBLE) / CAST(greatest(inv_amount, po_amount) AS DOUBLE)"
_IN = f"({_VAR} <= 0.05e0 OR abs(inv_amount - po_amount) <= 10)"


@query("n20_amount_tolerance", f"{_PAIR}, share double, inside boolean, inside_signed boolean",
       f"""SELECT invoice_id, po_id, {sql_round(_VAR, 6)} AS share, {_IN} AS inside,
           abs(inv_amount - po_amount) <= 10 OR {sql_round(f"{_VAR} * 100.0e0", 5)} <= 5.0e0 AS inside_signed FROM score_pairs""")
def _(e):
    a, b = c("inv_amount"), c("po_amount")
    return e.score_pairs.select(
        "invoice_id", "po_id", round_half_up(scores.variance_share(a, b), 6).alias("share"),
        scores.within_tolerance(a, b, *scores.AMOUNT_TOLERANCE).alias("inside"),
        scores.within_tolerance_signed(a, b).alias("inside_signed"))


@query("n21_quantity_tolerance", "receipt_line_id bigint, share double, inside boolean",
       f"""SELECT receipt_line_id, {sql_round("CAST(abs(quantity - quantity_received) AS DOUBLE) / CAST(greatest(quantity, quantity_received) AS DOUBLE)", 6)} AS share,
           CAST(abs(quantity - quantity_received) AS DOUBLE) / CAST(greatest(quantity, quantity_received) AS DOUBLE) <= 0.02e0
             OR abs(quantity - quantity_received) <= 1 AS inside
           FROM receipt_lines r JOIN po_lines p ON p.po_line_id = r.po_line_id""")
def _(e):
    both = e.receipt_lines.join(e.po_lines.select("po_line_id", "quantity"), "po_line_id")
    a, b = c("quantity"), c("quantity_received")
    return both.select("receipt_line_id", round_half_up(scores.variance_share(a, b), 6).alias("share"),
                       scores.within_tolerance(a, b, *scores.QUANTITY_TOLERANCE).alias("inside"))


@query("n22_date_tolerance", f"{_PAIR}, gap int, inside boolean",
       """SELECT invoice_id, po_id, abs(datediff('day', po_date, invoice_date)) AS gap,
          abs(datediff('day', po_date, invoice_date)) <= 7 AS inside FROM score_pairs""")
def _(e):
    gap = scores.day_gap(c("invoice_date"), c("po_date"))
    return e.score_pairs.select("invoice_id", "po_id", gap.alias("gap"), (gap <= scores.DATE_TOLERANCE_DAYS).alias("inside"))


_GAP = "CAST(abs(datediff('day', po_date, invoice_date)) AS DOUBLE)"
_UA = f"greatest(0.0e0, CASE WHEN {_IN} THEN 1.0e0 - {_VAR} ELSE 0.5e0 - {_VAR} END)"
_UD = f"CASE WHEN {_GAP} <= 7 THEN greatest(0.7e0, 1.0e0 - {_GAP} / 30.0e0) ELSE greatest(0.0e0, 0.5e0 - {_GAP} / 60.0e0) END"
_UV = f"CASE WHEN inv_vendor_id = po_vendor_id THEN 1.0e0 ELSE {sql_similarity('lower(inv_vendor)', 'lower(po_vendor)')} END"
_UR = "CASE WHEN upper(inv_ref) = upper(po_number) THEN 1.0e0 ELSE 0.0e0 END"


@query("n23_unit_scores", f"{_PAIR}, vendor double, amount double, day double, reference double, confidence double",
       f"""SELECT invoice_id, po_id, {sql_round('v', 6)} AS vendor, {sql_round('a', 6)} AS amount, {sql_round('d', 6)} AS day,
           r AS reference, {sql_round('v * 0.3e0 + a * 0.4e0 + d * 0.2e0 + r * 0.1e0', 4)} AS confidence
           FROM (SELECT invoice_id, po_id, {_UV} AS v, {_UA} AS a, {_UD} AS d, {_UR} AS r FROM score_pairs)""")
def _(e):
    a, b = c("inv_amount"), c("po_amount")
    gap = scores.day_gap(c("invoice_date"), c("po_date"))
    s = e.score_pairs.select(
        "invoice_id", "po_id",
        F.when(c("inv_vendor_id") == c("po_vendor_id"), 1.0).otherwise(scores.edit_similarity(c("inv_vendor"), c("po_vendor"))).alias("v"),
        scores.unit_amount_score(scores.variance_share(a, b), scores.within_tolerance(a, b, *scores.AMOUNT_TOLERANCE)).alias("a"),
        scores.unit_date_score(gap, gap <= 7).alias("d"),
        F.when(F.upper("inv_ref") == F.upper("po_number"), 1.0).otherwise(0.0).alias("r"))
    return s.select("invoice_id", "po_id", round_half_up(c("v"), 6).alias("vendor"), round_half_up(c("a"), 6).alias("amount"),
                    round_half_up(c("d"), 6).alias("day"), c("r").alias("reference"),
                    scores.unit_confidence(c("v"), c("a"), c("d"), c("r")).alias("confidence"))


_BV = ("CASE WHEN inv_norm = po_norm THEN 100.0e0 ELSE CAST(greatest(length(inv_norm), length(po_norm)) - levenshtein(inv_norm, po_norm) AS DOUBLE)"
       " / greatest(length(inv_norm), length(po_norm)) * 100.0e0 END")
_X, _Y = "CAST(inv_amount AS DOUBLE)", "CAST(po_amount AS DOUBLE)"
_BT = f"greatest(({_X} + {_Y}) / 2.0e0 * 0.05e0, 10.0e0)"
_BA = (f"CASE WHEN abs({_X} - {_Y}) <= {_BT} THEN 100.0e0 - abs({_X} - {_Y}) / {_BT} * 20.0e0 "
       f"ELSE greatest(0.0e0, 100.0e0 - abs({_X} - {_Y}) / (({_X} + {_Y}) / 2.0e0) * 100.0e0) END")
_BD = f"CASE WHEN {_GAP} <= 7 THEN 100.0e0 - {_GAP} / 7.0e0 * 30.0e0 ELSE greatest(0.0e0, 100.0e0 - {_GAP} * 2.0e0) END"
_BR = "CASE WHEN receipt_date IS NULL THEN 0.0e0 WHEN receipt_date <= invoice_date THEN 90.0e0 ELSE 60.0e0 END"
_BAND = f"SELECT *, {_BV} AS v, {_BA} AS a, {_BD} AS d, {_BR} AS r FROM score_pairs"
_BAND3 = "v * 0.25e0 + a * 0.35e0 + d * 0.15e0 + r * 0.25e0"
_BAND2 = "v * 0.3e0 + a * 0.4e0 + d * 0.3e0"


def _band(e):
    return e.score_pairs.select(
        "*", scores.band_vendor_score(c("inv_norm"), c("po_norm")).alias("v"), scores.band_amount_score(c("inv_amount"), c("po_amount")).alias("a"),
        scores.band_date_score(c("invoice_date"), c("po_date")).alias("d"), scores.band_receipt_score(c("receipt_date"), c("invoice_date")).alias("r"))


for _name, _letter in (("n24_band_vendor_score", "v"), ("n25_band_amount_score", "a"), ("n26_band_date_score", "d"), ("n27_band_receipt_score", "r")):
    query(_name, f"{_PAIR}, score double",
          f"SELECT invoice_id, po_id, {sql_round(_letter, 4)} AS score FROM ({_BAND})")(
        lambda e, k=_letter: _band(e).select("invoice_id", "po_id", round_half_up(c(k), 4).alias("score")))


@query("n28_weighted_confidence", f"{_PAIR}, three_way double, two_way double, by_field double",
       f"""SELECT invoice_id, po_id, {sql_round(_BAND3, 4)} AS three_way, {sql_round(_BAND2, 4)} AS two_way,
           {sql_round('''v * 0.25e0 + a * 0.3e0 + CASE WHEN inv_ref = po_number THEN 100.0e0 ELSE 0.0e0 END * 0.2e0
                         + CASE WHEN step = 0 THEN 100.0e0 ELSE 0.0e0 END * 0.15e0 + d * 0.1e0''', 4)} AS by_field FROM ({_BAND})""")
def _(e):
    same_ref = F.when(c("inv_ref") == c("po_number"), 100.0).otherwise(0.0)
    own = F.when(c("step") == 0, 100.0).otherwise(0.0)
    return _band(e).select(
        "invoice_id", "po_id", round_half_up(scores.band3_confidence(c("v"), c("a"), c("d"), c("r")), 4).alias("three_way"),
        round_half_up(scores.band2_confidence(c("v"), c("a"), c("d")), 4).alias("two_way"),
        round_half_up(scores.field_confidence(c("v"), c("a"), c("d"), same_ref, own), 4).alias("by_field"))


@query("n29_contact_similarity", "vendor_id bigint, other_id bigint, score double, renormalized double",
       f"""SELECT vendor_id, other_id, {sql_round('n * 0.6e0 + m * 0.2e0 + p * 0.1e0 + t * 0.1e0', 4)} AS score,
           {sql_round('(n * 0.6e0 + m * 0.2e0 + p * 0.1e0 + t * 0.1e0) / (0.6e0 + hm + hp + ht)', 4)} AS renormalized FROM (
           SELECT a.vendor_id, b.vendor_id AS other_id,
                  CAST(greatest(length(a.normalized_name), length(b.normalized_name)) - levenshtein(a.normalized_name, b.normalized_name) AS DOUBLE)
                    / greatest(length(a.normalized_name), length(b.normalized_name)) * 100.0e0 AS n,
                  CASE WHEN lower(a.email) = lower(b.email) THEN 100.0e0 ELSE 0.0e0 END AS m,
                  CASE WHEN regexp_replace(a.phone, '[^0-9]', '', 'g') = regexp_replace(b.phone, '[^0-9]', '', 'g') THEN 100.0e0 ELSE 0.0e0 END AS p,
                  CASE WHEN a.tax_id = b.tax_id THEN 100.0e0 ELSE 0.0e0 END AS t,
                  CASE WHEN a.email IS NULL OR b.email IS NULL THEN 0.0e0 ELSE 0.2e0 END AS hm, CASE WHEN a.phone IS NULL OR b.phone IS NULL THEN 0.0e0 ELSE 0.1e0 END AS hp,
                  CASE WHEN a.tax_id IS NULL OR b.tax_id IS NULL THEN 0.0e0 ELSE 0.1e0 END AS ht
           FROM vendors_dirty a JOIN vendors_dirty b ON b.tenant_id = a.tenant_id AND b.vendor_id > a.vendor_id
               AND (lower(a.email) = lower(b.email) OR regexp_replace(a.phone, '[^0-9]', '', 'g') = regexp_replace(b.phone, '[^0-9]', '', 'g') OR a.tax_id = b.tax_id))""")
def _(e):
    """All pairs of a tenant's vendors that share an e-mail, phone or tax id."""
    return vendors.contact_scores(e.vendors_dirty)


_STATUS = "CASE WHEN x >= 95 THEN 'matched' WHEN x >= 70 THEN 'partial' WHEN x >= 50 THEN 'exception' ELSE 'failed' END"
_KIND = "CASE WHEN po_id IS NULL THEN 'missing_document' WHEN a < 70 THEN 'amount_variance' WHEN v < 80 THEN 'vendor_mismatch' WHEN d < 70 THEN 'date_variance' ELSE 'approval_required' END"


@query("n30_status_and_variance", f"{_PAIR}, status string, variance decimal(18,2), variance_pct double",
       f"""SELECT invoice_id, po_id, {_STATUS} AS status, inv_amount - po_amount AS variance,
           {sql_round('CAST(inv_amount - po_amount AS DOUBLE) / CAST(po_amount AS DOUBLE) * 100.0e0', 5)} AS variance_pct
           FROM (SELECT *, {_BAND2} AS x FROM ({_BAND}))""")
def _(e):
    diff = c("inv_amount") - c("po_amount")
    return _band(e).select(
        "invoice_id", "po_id", scores.band_status(scores.band2_confidence(c("v"), c("a"), c("d"))).alias("status"), diff.alias("variance"),
        round_half_up(F.try_divide(diff.cast("double"), c("po_amount").cast("double")) * 100.0, 5).alias("variance_pct"))


@query("n31_exception_type", f"{_PAIR}, exception_type string", f"SELECT invoice_id, po_id, {_KIND} AS exception_type FROM ({_BAND})")
def _(e):
    return _band(e).select("invoice_id", "po_id", scores.band_exception_type(c("po_id"), c("a"), c("v"), c("d")).alias("exception_type"))


@query("n32_severity_and_priority", f"{_PAIR}, severity string, priority int",
       f"""SELECT invoice_id, po_id, CASE WHEN kind = 'amount_variance' AND abs(inv_amount - po_amount) > 1000 THEN 'high' ELSE 'medium' END AS severity,
           CASE WHEN inv_amount > 10000 THEN 1 WHEN kind = 'amount_variance' THEN 2 ELSE 3 END AS priority
           FROM (SELECT *, {_KIND} AS kind FROM ({_BAND}))""")
def _(e):
    kind = scores.band_exception_type(c("po_id"), c("a"), c("v"), c("d"))
    return _band(e).select("invoice_id", "po_id", scores.exception_severity(kind, c("inv_amount") - c("po_amount")).alias("severity"),
                           scores.exception_priority(kind, c("inv_amount")).alias("priority"))


@query("n33_exception_details", f"{_PAIR}, title string, description string, expected_value string, actual_value string, field_name string, variance_amount decimal(18,2)",
       f"""SELECT invoice_id, po_id,
           CASE kind WHEN 'amount_variance' THEN 'Invoice Amount Variance' WHEN 'vendor_mismatch' THEN 'Vendor Mismatch' ELSE 'Manual Review Required' END AS title,
           CASE kind WHEN 'amount_variance' THEN 'Invoice amount differs significantly from PO amount'
                WHEN 'vendor_mismatch' THEN 'Invoice vendor does not match PO vendor' ELSE 'This match requires manual review' END AS description,
           CASE kind WHEN 'amount_variance' THEN CAST(po_amount AS VARCHAR) WHEN 'vendor_mismatch' THEN po_vendor END AS expected_value,
           CASE kind WHEN 'amount_variance' THEN CAST(inv_amount AS VARCHAR) WHEN 'vendor_mismatch' THEN inv_vendor END AS actual_value,
           CASE kind WHEN 'amount_variance' THEN 'total_amount' WHEN 'vendor_mismatch' THEN 'vendor_name' END AS field_name,
           CASE kind WHEN 'amount_variance' THEN inv_amount - po_amount END AS variance_amount
           FROM (SELECT *, {_KIND} AS kind FROM ({_BAND}))""")
def _(e):
    kind = scores.band_exception_type(c("po_id"), c("a"), c("v"), c("d"))
    details = scores.exception_details(kind, c("inv_amount"), c("po_amount"), c("inv_vendor"), c("po_vendor"))
    return _band(e).select("invoice_id", "po_id", details.alias("x")).select("invoice_id", "po_id", "x.*")


def _pct(x):
    return f"CAST(floor({x} * 1000.0e0 + 0.5e0) / 10.0e0 AS DECIMAL(12,1)) || '%'"


@query("n34_match_explanation", f"{_PAIR}, explanation string",
       f"""SELECT invoice_id, po_id, CASE WHEN conf = 1 THEN 'Exact match found on PO number, vendor, and amount' ELSE
           'Fuzzy match with confidence ' || {_pct('conf')} || '; Vendor similarity: ' || {_pct('v')} || '; Amount matching: ' || {_pct('a')}
           || '; Date matching: ' || {_pct('d')} || '; Reference matching: ' || {_pct('r')} || '; Amount variance: ' || {_pct('share')}
           || '; Date variance: ' || gap || ' days' END AS explanation
           FROM (SELECT *, {sql_round('v * 0.3e0 + a * 0.4e0 + d * 0.2e0 + r * 0.1e0', 4)} AS conf
                 FROM (SELECT invoice_id, po_id, {_UV} AS v, {_UA} AS a, {_UD} AS d, {_UR} AS r, {_VAR} AS share,
                              abs(datediff('day', po_date, invoice_date)) AS gap FROM score_pairs))""")
def _(e):
    a, b = c("inv_amount"), c("po_amount")
    gap = scores.day_gap(c("invoice_date"), c("po_date"))
    s = e.score_pairs.select(
        "invoice_id", "po_id", gap.alias("gap"), scores.variance_share(a, b).alias("share"),
        F.when(c("inv_vendor_id") == c("po_vendor_id"), 1.0).otherwise(scores.edit_similarity(c("inv_vendor"), c("po_vendor"))).alias("v"),
        scores.unit_amount_score(scores.variance_share(a, b), scores.within_tolerance(a, b, *scores.AMOUNT_TOLERANCE)).alias("a"),
        scores.unit_date_score(gap, gap <= 7).alias("d"),
        F.when(F.upper("inv_ref") == F.upper("po_number"), 1.0).otherwise(0.0).alias("r"))
    conf = scores.unit_confidence(c("v"), c("a"), c("d"), c("r"))
    return s.select("invoice_id", "po_id", names.explain_match(conf, c("v"), c("a"), c("d"), c("r"), c("share"), c("gap")).alias("explanation"))


@query("n35_audit_hash", "match_result_id bigint, event_hash string",
       """SELECT match_result_id, sha256('{"confidence":"' || overall_confidence || '","invoice_id":"' || invoice_id
          || '","match_type":"' || match_kind || '"}') AS event_hash FROM match_results""")
def _(e):
    return e.match_results.select("match_result_id", names.audit_hash(
        confidence=c("overall_confidence"), invoice_id=c("invoice_id"), match_type=c("match_kind")).alias("event_hash"))


@query("n36_vendor_codes", "tenant_id int, vendor_name string, vendor_code string",
       """SELECT tenant_id, vendor_name, CASE WHEN n = 1 THEN base ELSE substring(base, 1, 4) ||
                 CASE WHEN k < 9 THEN '0' || (k + 1) ELSE CAST(k + 1 AS VARCHAR) END END AS vendor_code
          FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, substring(base, 1, 4), n > 1 ORDER BY substring(md5(vendor_name), 1, 3), vendor_name) AS k
          FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, base ORDER BY substring(md5(vendor_name), 1, 3), vendor_name) AS n FROM (
          SELECT DISTINCT tenant_id, vendor_name, CASE WHEN length(b) < 3 THEN rpad(b, 3, 'X') ELSE b END AS base FROM (
          SELECT tenant_id, vendor_name, substring(regexp_replace(upper(vendor_name), '[^A-Z0-9]', '', 'g'), 1, 6) AS b
          FROM parsed_rows WHERE vendor_name IS NOT NULL))))""")
def _(e):
    found = e.parsed_rows.filter("vendor_name is not null").select("tenant_id", "vendor_name").distinct()
    return names.assign_vendor_codes(found)


@query("n37_event_risk", "attempt_id bigint, login_risk string, access_risk string",
       """SELECT attempt_id, CASE WHEN success THEN 'low' WHEN failure_reason IN ('brute_force', 'suspicious_activity', 'account_locked') THEN 'high' ELSE 'medium' END AS login_risk,
          CASE WHEN attempt_id % 5 = 0 THEN 'high' WHEN mfa_required THEN 'medium' ELSE 'low' END AS access_risk FROM auth_attempts""")
def _(e):
    label = F.when(c("attempt_id") % 5 == 0, "restricted").otherwise("internal")
    return e.auth_attempts.select("attempt_id", scores.login_risk(c("success"), c("failure_reason")).alias("login_risk"),
                                  scores.data_access_risk(c("mfa_required"), label).alias("access_risk"))


@query("n38_lockout_and_delay", "user_id bigint, failures bigint, lock_minutes double, delay_seconds double",
       """SELECT user_id, n AS failures, CASE WHEN n >= 5 THEN least(1440.0e0, 30.0e0 * pow(2.0e0, n - 5)) END AS lock_minutes,
          least(30.0e0, 0.5e0 * pow(2.0e0, n)) AS delay_seconds FROM (SELECT user_id, count(*) FILTER (WHERE NOT success) AS n FROM auth_attempts GROUP BY user_id)""")
def _(e):
    per_user = e.auth_attempts.groupBy("user_id").agg(F.count_if(~c("success")).alias("failures"))
    return per_user.select("*", scores.lockout_minutes(c("failures")).alias("lock_minutes"),
                           scores.retry_delay_seconds(c("failures")).alias("delay_seconds"))


def _access_log(e):
    """Request rows over the event table: a path and a method per event."""
    path = (F.when(c("event_type") == "error", "/api/v1/auth/login").when(c("event_type") == "signup", "/api/v1/auth/refresh")
            .when(c("event_type") == "purchase", "/api/v1/invoices/bulk").when(c("event_type") == "view", "/api/v1/admin/users")
            .otherwise("/api/v1/invoices"))
    method = F.when(c("event_id") % 3 == 0, "POST").otherwise("GET")
    return e.raw("events").select("event_id", "user_id", "ts", path.alias("path"), method.alias("method"))


_LOG = """SELECT event_id, CASE event_type WHEN 'error' THEN '/api/v1/auth/login' WHEN 'signup' THEN '/api/v1/auth/refresh'
          WHEN 'purchase' THEN '/api/v1/invoices/bulk' WHEN 'view' THEN '/api/v1/admin/users' ELSE '/api/v1/invoices' END AS path,
          CASE WHEN event_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method FROM events"""


@query("n39_rate_class", "event_id bigint, max_requests int, window_seconds int",
       f"""SELECT event_id, CASE WHEN path LIKE '%login%' THEN 5 WHEN path LIKE '%refresh%' THEN 10 WHEN path LIKE '%/bulk%' THEN 10 ELSE 100 END AS max_requests,
           CASE WHEN path LIKE '%/bulk%' THEN 3600 ELSE 60 END AS window_seconds FROM ({_LOG})""")
def _(e):
    return _access_log(e).select("event_id", scores.rate_class(c("path")).alias("x")).select("event_id", "x.*")


@query("v23_audited_requests", "event_id bigint, path string, method string",
       f"SELECT * FROM ({_LOG}) WHERE path LIKE '%/auth/%' OR path LIKE '%/admin/%' OR method = 'POST'")
def _(e):
    return _access_log(e).filter(scores.audited_request(c("path"), c("method")))


@query("n40_permission_strings", "user_id bigint, role_id int, permission string",
       """SELECT DISTINCT user_id, u.role_id, resource || ':' || unnest(from_json(json_extract(permissions, '$.' || resource), '["VARCHAR"]')) AS permission
          FROM user_roles u JOIN (SELECT *, unnest(json_keys(permissions)) AS resource FROM roles) AS r ON r.role_id = u.role_id""")
def _(e):
    return e.user_roles.select("user_id", "role_id").join(F.broadcast(names.permission_strings(e.config("roles"))), "role_id")


@query("n41_period_start", "period string, invoices bigint, first_day date",
       "SELECT period, count(*) AS invoices, min(invoice_date) AS first_day FROM invoices JOIN (VALUES ('today', 0), ('week', 7), ('month', 30), ('quarter', 90), ('year', 365)) AS p(period, days) "
       "ON invoice_date BETWEEN DATE '2000-12-31' - days AND DATE '2000-12-31' GROUP BY period")
def _(e):
    end = F.lit("2000-12-31").cast("date")
    hits = F.array_compact(F.array(*[
        F.when(c("invoice_date").between(scores.period_start(end, p), end), F.lit(p)) for p in ("today", "week", "month", "quarter", "year")]))
    return e.invoices.select("invoice_date", F.explode(hits).alias("period")).groupBy("period").agg(
        F.count("*").alias("invoices"), F.min("invoice_date").alias("first_day"))


@query("n42_line_values", "invoice_line_id bigint, line_value decimal(15,2), line_tax decimal(15,2)",
       """SELECT invoice_line_id, CAST(quantity * unit_price AS DECIMAL(15,2)) AS line_value,
          CAST(CAST(quantity * unit_price AS DECIMAL(15,2)) * tax_rate * CAST('0.01' AS DECIMAL(3,2)) AS DECIMAL(15,2)) AS line_tax FROM invoice_lines""")
def _(e):
    value = (c("quantity") * c("unit_price")).cast("decimal(15,2)")
    return e.invoice_lines.select("invoice_line_id", value.alias("line_value"),
                                  (value * c("tax_rate") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(15,2)").alias("line_tax"))


@query("n43_trusted_device", "session_id bigint, user_id bigint, trusted boolean",
       """SELECT s.session_id, s.user_id, coalesce(bool_or(d.expires_at > TIMESTAMP '2024-01-31' AND d.fingerprint = s.session_id % 3), FALSE) AS trusted
          FROM user_sessions s LEFT JOIN (SELECT user_id, user_id % 3 AS fingerprint, max(ts) + INTERVAL 30 DAY AS expires_at FROM events WHERE event_type = 'signup' GROUP BY user_id
               UNION ALL SELECT user_id, (user_id + 1) % 3, min(ts) + INTERVAL 10 DAY FROM events WHERE event_type = 'signup' GROUP BY user_id) AS d
          ON d.user_id = s.user_id GROUP BY ALL""")
def _(e):
    devices = e.raw("events").filter("event_type = 'signup'").groupBy("user_id").agg(F.array(
        F.struct((c("user_id") % 3).alias("fingerprint"), F.expr("max(ts) + interval 30 days").alias("expires_at")),
        F.struct(((c("user_id") + 1) % 3).alias("fingerprint"), F.expr("min(ts) + interval 10 days").alias("expires_at")),
    ).alias("devices"))
    sessions = e.user_sessions.join(devices, "user_id", "left")
    return sessions.select("session_id", "user_id", names.trusted_device(c("devices"), c("session_id") % 3, event_as_of()).alias("trusted"))


@query("f01_stored_functions", f"{_PAIR}, name string, similarity double, amount_ok boolean, date_ok boolean, confidence double",
       f"""SELECT invoice_id, po_id, {sql_stored_name('inv_vendor')} AS name, sim AS similarity, {_IN} AS amount_ok, {_GAP} <= 7 AS date_ok,
           {sql_round('sim * 0.25e0 + a * 0.3e0 + 100.0e0 * 0.2e0 + 0.0e0 * 0.15e0 + d * 0.1e0', 4)} AS confidence
           FROM (SELECT *, CASE WHEN inv_norm = po_norm THEN 100.0e0 ELSE {sql_round("CAST(greatest(length(inv_norm), length(po_norm)) - levenshtein(inv_norm, po_norm) AS DOUBLE) / greatest(length(inv_norm), length(po_norm)) * 100.0e0", 2)} END AS sim FROM ({_BAND}))""")
def _(e):
    a, b = c("inv_amount"), c("po_amount")
    sim = scores.stored_name_similarity(c("inv_vendor"), c("po_vendor"))
    rows = _band(e).withColumn("sim", sim)
    return rows.select(
        "invoice_id", "po_id", text.stored_vendor_name(c("inv_vendor")).alias("name"), c("sim").alias("similarity"),
        scores.within_tolerance(a, b, *scores.AMOUNT_TOLERANCE).alias("amount_ok"), (scores.day_gap(c("invoice_date"), c("po_date")) <= 7).alias("date_ok"),
        round_half_up(scores.field_confidence(c("sim"), c("a"), c("d"), F.lit(100.0), F.lit(0.0)), 4).alias("confidence"))
