"""Operators of the design notes: audit chains, incremental sync, anomaly streams, names, lake,
features, retention, blended and tiered matching, control tests."""

from pyspark.sql import functions as F

from ledgerlink.functions.fuzzy import OCR_SWAPS
from ledgerlink.functions.jaro import jaro_similarities
from ledgerlink.functions.numeric import round_half_up
from ledgerlink.operators import audit_chain, blended, controls, features, lake, retention
from ledgerlink.operators.sync import SyncedTable
from ledgerlink.plans.match_queries import _J03 as ORDER_CANDIDATES_SQL
from ledgerlink.plans.oracle_ctes import sql_common, sql_round
from ledgerlink.plans.registry import query, stored_query
from ledgerlink.session import scratch_path
from ledgerlink.sources.arrivals import LATE_SQL, WATERMARK_SQL, event_stream
from ledgerlink.sources.entities import event_as_of
from ledgerlink.streaming import anomalies, jobs
from ledgerlink.streaming.ordered import keyed_state

c = F.col

# --- X10 audit chains ------------------------------------------------------------------------

_HASH = """sha256('{"audit_id":"' || audit_id || '","event_type":"' || event_type || '","occurred_us":"' || occurred_us || '","resource_type":"' || resource_type
    || '","risk_level":"' || risk_level || '","tenant_id":"' || tenant_id || '","user_id":"' || user_id || '"}')"""
_BROKEN = f"""SELECT tenant_id, audit_id, 'content' AS reason FROM audit_stored WHERE {_HASH} <> record_hash
    UNION ALL
    SELECT tenant_id, audit_id, CASE WHEN previous_record_hash IS NULL OR EXISTS (SELECT 1 FROM audit_stored h WHERE h.tenant_id = f.tenant_id AND h.record_hash = f.previous_record_hash)
        THEN 'order' ELSE 'predecessor' END FROM (SELECT *, lag(record_hash) OVER (PARTITION BY tenant_id ORDER BY occurred_us, audit_id) AS found FROM audit_stored) AS f
    WHERE previous_record_hash IS DISTINCT FROM found
    UNION ALL
    SELECT t.tenant_id, t.audit_id, 'tail' FROM (SELECT tenant_id, max_by(audit_id, (occurred_us, audit_id)) AS audit_id, max_by(record_hash, (occurred_us, audit_id)) AS newest
        FROM audit_stored GROUP BY tenant_id) AS t JOIN audit_heads k ON k.tenant_id = t.tenant_id WHERE newest <> head"""


def _broken(e):
    return audit_chain.broken_records(e.audit_stored, e.audit_heads, "tenant_id", "audit_id", e.AUDIT_ORDER, e.audit_block(), e.AUDIT_FIELDS)


@query("x10_audit_chain_breaks", "tenant_id int, audit_id bigint, reason string", _BROKEN)
def _(e):
    return _broken(e)


@query("x10_audit_chain_status", "tenant_id int, sealed_records bigint, total_records bigint, verified_records bigint, tampered bigint, broken_links bigint, cut_tails bigint, verification_status string",
       f"""SELECT *, total_records - tampered AS verified_records, CASE WHEN tampered + broken_links + cut_tails = 0 AND total_records = sealed_records THEN 'VERIFIED_INTACT' ELSE 'INTEGRITY_COMPROMISED' END AS verification_status
           FROM (SELECT k.tenant_id, k.records AS sealed_records, (SELECT count(*) FROM audit_stored s WHERE s.tenant_id = k.tenant_id) AS total_records,
                 count(*) FILTER (WHERE reason = 'content') AS tampered, count(*) FILTER (WHERE reason IN ('order', 'predecessor')) AS broken_links, count(*) FILTER (WHERE reason = 'tail') AS cut_tails
                 FROM audit_heads k LEFT JOIN ({_BROKEN}) AS b ON b.tenant_id = k.tenant_id GROUP BY k.tenant_id, k.records)""")
def _(e):
    return audit_chain.chain_status(e.audit_stored, _broken(e), e.audit_heads, "tenant_id")


# --- X15 incremental sync --------------------------------------------------------------------


def _synced(e):
    """Three runs over a growing feed, each repeated at once, with a snapshot after the second."""
    table = SyncedTable(e.spark, scratch_path(e.spark, "synced"), ["tenant_id", "external_id", "external_system"], "external_system", ["updated_at", "version"], "10 days")
    for run in (1, 2, 3):
        feed = e.external_feed.filter(c("arrival") <= run).drop("arrival")
        for _ in range(2):
            table.sync(feed)
        if run == 2:
            table.compact()
    return table


@stored_query("x15_incremental_sync", "tenant_id int, external_id string, external_system string, invoice_number string, amount decimal(15,2), status string, version int, updated_at timestamp_ntz",
              "SELECT * FROM external_feed QUALIFY row_number() OVER (PARTITION BY tenant_id, external_id, external_system ORDER BY updated_at DESC, version DESC) = 1")
def _(e):
    return _synced(e).rows()


@stored_query("x15_sync_runs", "run int, external_system string, cursor timestamp_ntz, inserted bigint, updated bigint",
              """SELECT run, external_system, max(top) AS cursor, count(*) FILTER (WHERE before IS NULL) AS inserted, count(*) FILTER (WHERE before IS NOT NULL) AS updated
                 FROM (SELECT run, external_system, external_id, max(updated_at) FILTER (WHERE arrival <= run) AS top, max(updated_at) FILTER (WHERE arrival < run) AS before
                       FROM external_feed, range(1, 4) AS r(run) GROUP BY ALL) WHERE top IS NOT NULL AND (before IS NULL OR top > before) GROUP BY run, external_system""")
def _(e):
    return _synced(e).runs()


# --- X16 event stream with anomaly flags ---------------------------------------------------------

_DELAY = "2 hours"
# Sums of everything before a row of its type; only rows that the watermark has passed are answered.
_SCORED = """SELECT *, CASE WHEN seen < 10 OR spread <= 0 THEN 0.0e0 ELSE floor(least(1.0e0, abs(seen::HUGEINT * cents - total)::DOUBLE / sqrt(spread::DOUBLE) / 5.0e0) * 1000000.0e0 + 0.5e0) / 1000000.0e0 END AS score
    FROM (SELECT *, seen::HUGEINT * squares - total::HUGEINT * total AS spread FROM (
        SELECT event_id, event_type, event_us, cents, count(*) OVER w AS seen, coalesce(sum(cents) OVER w, 0)::BIGINT AS total, coalesce(sum(cents * cents) OVER w, 0)::BIGINT AS squares
        FROM (SELECT event_id, event_type, epoch_us(ts) AS event_us, floor(value * 100.0e0 + 0.5e0)::BIGINT AS cents FROM events {where})
        WINDOW w AS (PARTITION BY event_type ORDER BY event_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""
_ANOMALY = "event_id bigint, event_type string, event_us bigint, cents bigint, seen bigint, score double, flagged boolean"


@query("x16_event_anomalies", _ANOMALY, f"SELECT *, score > 0.8 AS flagged FROM ({_SCORED.format(where='')})")
def _(e):
    return anomalies.event_anomalies(e.raw("events"), F.date_trunc("DAY", c("ts")))


@query("x16_event_anomalies_stream", _ANOMALY,
       f"SELECT *, score > 0.8 AS flagged FROM ({_SCORED.format(where=f'WHERE NOT {LATE_SQL}')}) WHERE event_us <= {WATERMARK_SQL.format(120)}")
def _(e):
    stream = event_stream(e.raw("events"), ["event_id", "event_type", "ts", "value"])
    with keyed_state(e.spark):
        return jobs.run_append(anomalies.event_anomalies_stream(stream, _DELAY), "anomalies")



# --- X02, X03 name, amount and reference similarity -----------------------------------------------

_NAME_PAIRS = """SELECT DISTINCT inv_vendor AS a, po_vendor AS b FROM score_pairs UNION
    SELECT DISTINCT x.name AS a, y.name AS b FROM vendors_dirty x JOIN vendors_dirty y ON x.tenant_id = y.tenant_id AND x.vendor_id // 10 = y.vendor_id // 10 WHERE x.vendor_id <> y.vendor_id"""
# Matched places of the second text, one entry per character of the first, 0 for none.
_MATCHED = f"""SELECT a, b, ca, cb, list_reduce(list_prepend([]::BIGINT[], list_transform(range(1, len(ca) + 1), lambda z: [z])),
        lambda used, i: list_append(used, coalesce(list_filter(range(greatest(1, i[1] - reach), least(i[1] + reach, len(cb)) + 1), lambda j: cb[j] = ca[i[1]] AND NOT list_contains(used, j))[1], 0))) AS used
    FROM (SELECT a, b, string_split(a, '') AS ca, string_split(b, '') AS cb, greatest(0, greatest(length(a), length(b)) // 2 - 1) AS reach FROM ({_NAME_PAIRS}))"""
_JARO = f"""SELECT a, b, CASE WHEN a = b THEN 1.0e0 WHEN m = 0 THEN 0.0e0 ELSE (m / length(a) + m / length(b) + (m - moved / 2.0e0) / m) / 3.0e0 END AS jaro,
        len(list_filter(range(1, least(length(a), length(b), 4) + 1), lambda k: left(a, k) = left(b, k))) AS prefix
    FROM (SELECT *, CAST(len(x) AS DOUBLE) AS m, len(list_filter(range(1, len(x) + 1), lambda k: x[k] <> y[k])) AS moved
          FROM (SELECT a, b, list_filter(ca, lambda ch, i: used[i] > 0) AS x, list_transform(list_sort(list_filter(used, lambda z: z > 0)), lambda j: cb[j]) AS y FROM ({_MATCHED})))"""


def _name_pairs(e):
    dirty = e.vendors_dirty.select("tenant_id", F.floor(c("vendor_id") / 10).alias("k"), "vendor_id", "name")
    twins = dirty.toDF("tenant_id", "k", "x", "a").join(dirty.toDF("tenant_id", "k", "y", "b"), ["tenant_id", "k"]).filter("x <> y").select("a", "b")
    return e.score_pairs.select(c("inv_vendor").alias("a"), c("po_vendor").alias("b")).unionByName(twins).distinct()


@query("x02_jaro_similarity", "a string, b string, jaro double, jaro_winkler double, strict_jaro double, strict_jaro_winkler double",
       f"""SELECT a, b, {sql_round('jaro', 9)} AS jaro, {sql_round('CASE WHEN a = b THEN 1.0e0 ELSE jaro + 0.1e0 * prefix * (1.0e0 - jaro) END', 9)} AS jaro_winkler,
           {sql_round('jaro_similarity(a, b)', 9)} AS strict_jaro, {sql_round('jaro_winkler_similarity(a, b)', 9)} AS strict_jaro_winkler FROM ({_JARO})""")
def _(e):
    pairs = _name_pairs(e).withColumn("s", jaro_similarities(c("a"), c("b"))).withColumn("t", jaro_similarities(c("a"), c("b"), strict=True))
    parts = {"jaro": "s.jaro", "jaro_winkler": "s.winkler", "strict_jaro": "t.jaro", "strict_jaro_winkler": "t.winkler"}
    return pairs.select("a", "b", *(round_half_up(c(v), 9).alias(k) for k, v in parts.items()))


_SWAPPED = "list_transform(range(1, length(x) + 1), lambda i: list_transform(coalesce(map_extract_value(" + "MAP {" + ", ".join(
    f"'{k}': {[s for s in v]!r}" for k, v in OCR_SWAPS.items()) + "}, substring(x, i, 1)), []::VARCHAR[]), lambda s: substring(x, 1, i - 1) || s || substring(x, i + 1)))"


@stored_query("x03_banded_scores", "invoice_id bigint, po_id bigint, amount_score double, reference_score double",
              f"""SELECT invoice_id, po_id, {sql_round("CASE WHEN off = 0 THEN 1.0e0 WHEN off <= 0.01e0 THEN 0.95e0 WHEN off <= 0.05e0 THEN 0.85e0 - (off - 0.01e0) * 10.0e0 WHEN off <= 0.1e0 THEN 0.75e0 - (off - 0.05e0) * 8.0e0 ELSE greatest(0.0e0, 0.35e0 - off) END", 6)} AS amount_score,
                  CASE WHEN x = y THEN 1.0e0 WHEN x = '' OR y = '' THEN 0.0e0 ELSE {sql_round("greatest(1.0e0 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)), CASE WHEN contains(x, y) OR contains(y, x) THEN least(length(x), length(y))::DOUBLE / greatest(length(x), length(y)) ELSE 0.0e0 END, coalesce(list_max(list_transform(flatten(" + _SWAPPED + "), lambda v: 1.0e0 - levenshtein(v, y)::DOUBLE / greatest(length(v), length(y)))), 0.0e0))", 6)} END AS reference_score
                  FROM (SELECT invoice_id, po_id, abs(inv_amount - po_amount)::DOUBLE / greatest(inv_amount, po_amount)::DOUBLE AS off,
                        regexp_replace(upper(coalesce(inv_ref, '')), '[^A-Z0-9]', '', 'g') AS x, regexp_replace(upper(po_number), '[^A-Z0-9]', '', 'g') AS y FROM score_pairs)""")
def _(e):
    pairs = e.score_pairs
    return pairs.select("invoice_id", "po_id", blended.banded_amount(c("inv_amount"), c("po_amount")).alias("amount_score"),
                        blended.best_reference(blended.bare_number(c("inv_ref")), blended.bare_number(c("po_number"))).alias("reference_score"))


# --- X06 audit change view ---------------------------------------------------------------------------


@query("x06_audit_change_view", "audit_event_id bigint, tenant_id int, table_name string, changed_at timestamp_ntz, changed_by_email string, key_changes string",
       """SELECT audit_event_id, a.tenant_id, table_name, changed_at, u.email AS changed_by_email,
          CASE table_name WHEN 'invoices' THEN '{"invoice_number":"INV-' || invoice_id || '","amount":"' || overall_confidence || '","status":"' || approval_status || '"}'
               WHEN 'match_results' THEN '{"confidence_score":"' || overall_confidence || '","status":"' || match_status || '"}' ELSE '{"match_result_id":' || audit_event_id || '}' END AS key_changes
          FROM audit_events a LEFT JOIN users u ON u.user_id = a.changed_by""")
def _(e):
    return audit_chain.change_view(e.audit_events, e.users)


# --- X18 lake ------------------------------------------------------------------------------------------

_MATCH_BUCKET = "least(floor(overall_confidence / 10) * 10, 90)::INTEGER"


def _invoice_lake(e) -> str:
    """The invoices by year, month and tenant; then March of 1998 of one tenant once more, with
    totals up by one: only its partition is replaced."""
    folder = scratch_path(e.spark, "lake")
    rows = lake.with_calendar(e.invoices, c("invoice_date")).drop("day")
    lake.write(rows, "invoices", folder)
    restated = rows.filter("year = 1998 and month = 3 and tenant_id = 1").withColumn("total_amount", (c("total_amount") + 1).cast("decimal(15,2)"))
    lake.write(restated, "invoices", folder)
    return folder


@stored_query("x18_invoice_lake", "year int, month int, tenant_id int, invoices bigint, total decimal(18,2)",
              "SELECT year(invoice_date) AS year, month(invoice_date) AS month, tenant_id, count(*) AS invoices, sum(total_amount + CASE WHEN year(invoice_date) = 1998 AND month(invoice_date) = 3 AND tenant_id = 1 THEN 1 ELSE 0 END) AS total FROM invoices GROUP BY ALL")
def _(e):
    return lake.read(e.spark, "invoices", _invoice_lake(e)).groupBy("year", "month", "tenant_id").agg(F.count("*").alias("invoices"), F.sum("total_amount").alias("total"))


@stored_query("x18_lake_slice", "invoice_id bigint, vendor_id bigint, total_amount decimal(15,2)",
              "SELECT invoice_id, vendor_id, (total_amount + CASE WHEN month(invoice_date) = 3 THEN 1 ELSE 0 END) AS total_amount FROM invoices WHERE year(invoice_date) = 1998 AND month(invoice_date) IN (3, 4) AND tenant_id = 1")
def _(e):
    return lake.read(e.spark, "invoices", _invoice_lake(e)).filter((c("year") == 1998) & c("month").isin(3, 4) & (c("tenant_id") == 1))


@query("x18_match_lake", "year int, month int, confidence_bucket int, results bigint, confidence decimal(18,2)",
       f"SELECT year(created_at) AS year, month(created_at) AS month, {_MATCH_BUCKET} AS confidence_bucket, count(*) AS results, sum(overall_confidence) AS confidence FROM match_results GROUP BY ALL")
def _(e):
    folder = scratch_path(e.spark, "lake")
    rows = lake.with_calendar(e.match_results, c("created_at")).drop("day").withColumn("confidence_bucket", lake.confidence_bucket(c("overall_confidence")))
    lake.write(rows, "matches", folder)
    return lake.read(e.spark, "matches", folder).groupBy("year", "month", "confidence_bucket").agg(F.count("*").alias("results"), F.sum("overall_confidence").alias("confidence"))


@query("x18_audit_lake", "year int, month int, day int, tenant_id int, records bigint, last_record bigint",
       "SELECT year(occurred_at) AS year, month(occurred_at) AS month, day(occurred_at) AS day, tenant_id, count(*) AS records, max(audit_id) AS last_record FROM security_audit GROUP BY ALL")
def _(e):
    folder = scratch_path(e.spark, "lake")
    lake.write(lake.with_calendar(e.security_audit, c("occurred_at")), "audit_events", folder)
    return lake.read(e.spark, "audit_events", folder).groupBy("year", "month", "day", "tenant_id").agg(F.count("*").alias("records"), F.max("audit_id").alias("last_record"))


# --- X17 features ----------------------------------------------------------------------------------------

_BEFORE = "OVER (PARTITION BY vendor_id ORDER BY {0} RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"
_DAY_BEFORE, _RESULT_BEFORE = _BEFORE.format("invoice_date"), _BEFORE.format("day")


@stored_query("x17_training_rows",
              "match_result_id bigint, invoice_id bigint, tenant_id int, vendor_id bigint, split string, total_amount decimal(15,2), amount_percentile double, day_of_week int, month_of_year int, is_month_end boolean, "
              "vendor_frequency bigint, average_amount double, days_since_last int, approval_rate_history double, processing_time_avg double, number_pattern string, line_items bigint, target int, confidence_target decimal(5,2)",
              f"""WITH heads AS (SELECT *, count(*) {_DAY_BEFORE} AS vendor_frequency, sum(total_amount) {_DAY_BEFORE} AS spent, max(invoice_date) {_DAY_BEFORE} AS last_date FROM invoices),
                  known AS (SELECT r.*, i.vendor_id, CAST(r.created_at AS DATE) AS day FROM match_results r JOIN invoices i ON i.invoice_id = r.invoice_id),
                  past AS (SELECT *, count(*) {_RESULT_BEFORE} AS n, count(*) FILTER (WHERE approval_status = 'auto_approved') {_RESULT_BEFORE} AS ok,
                           sum(processing_time_ms) {_RESULT_BEFORE} AS spent_ms, count(processing_time_ms) {_RESULT_BEFORE} AS timed FROM known),
                  shares AS (SELECT i.invoice_id, count(*) FILTER (WHERE p.total_amount < i.total_amount) / CAST(count(*) AS DOUBLE) AS share FROM invoices i
                           JOIN invoices p ON p.tenant_id = i.tenant_id AND year(p.invoice_date) * 12 + month(p.invoice_date) + 1 = year(i.invoice_date) * 12 + month(i.invoice_date) GROUP BY i.invoice_id),
                  items AS (SELECT invoice_id, count(*) AS line_items FROM invoice_lines GROUP BY invoice_id)
                  SELECT match_result_id, h.invoice_id, h.tenant_id, h.vendor_id, CASE WHEN tenth < 8 THEN 'train' WHEN tenth = 8 THEN 'valid' ELSE 'test' END AS split, total_amount, {sql_round('share', 6)} AS amount_percentile,
                         isodow(invoice_date) - 1 AS day_of_week, month(invoice_date) AS month_of_year, last_day(invoice_date) = invoice_date AS is_month_end, vendor_frequency,
                         CASE WHEN vendor_frequency > 0 THEN {sql_round('CAST(spent AS DOUBLE) / vendor_frequency', 4)} END AS average_amount, invoice_date - last_date AS days_since_last,
                         CASE WHEN n > 0 THEN {sql_round('CAST(ok AS DOUBLE) / n', 6)} END AS approval_rate_history, CASE WHEN timed > 0 THEN {sql_round('CAST(spent_ms AS DOUBLE) / timed', 4)} END AS processing_time_avg,
                         regexp_replace(regexp_replace(invoice_number, '[A-Za-z]+', 'A', 'g'), '[0-9]+', '9', 'g') AS number_pattern, coalesce(line_items, 0) AS line_items,
                         CASE WHEN match_status = 'matched' THEN 1 ELSE 0 END AS target, overall_confidence AS confidence_target
                  FROM past r JOIN (SELECT *, ('0x' || substring(md5(vendor_id::VARCHAR), 1, 8))::BIGINT % 10 AS tenth FROM heads) AS h ON h.invoice_id = r.invoice_id
                  LEFT JOIN shares s ON s.invoice_id = h.invoice_id LEFT JOIN items l ON l.invoice_id = h.invoice_id""")
def _(e):
    return features.training_rows(e.match_results, e.invoices, e.invoice_lines)


# --- X13, X14 retention and erasure -----------------------------------------------------------------------

_SALT = "retention-1"
_AS_OF = "2025-01-20 12:00:00"
_POLICIES = (("email", "pseudonymise", 375), ("ip_address", "anonymise", 365))
_TOKEN = f"sha256('{_SALT}:' || email)"
_AGED = f"""SELECT attempt_id, tenant_id, CASE WHEN attempted_at < TIMESTAMP '{_AS_OF}' - INTERVAL 375 DAY THEN {_TOKEN} ELSE email END AS subject,
    CASE WHEN attempted_at < TIMESTAMP '{_AS_OF}' - INTERVAL 365 DAY THEN NULL ELSE ip_address END AS ip_address, attempted_at FROM auth_attempts WHERE attempted_at >= TIMESTAMP '{_AS_OF}' - INTERVAL 380 DAY"""


def _aged_attempts(e):
    """Attempts kept by day: those older than 380 days go, the rest lose what is due."""
    as_of = F.lit(_AS_OF).cast("timestamp_ntz")
    path = scratch_path(e.spark, "attempts-by-day")
    retention.write_by_day(e.auth_attempts.select("attempt_id", "tenant_id", "email", "ip_address", "attempted_at"), "attempted_at", path)
    retention.expire(e.spark, path, "attempted_at", as_of - F.expr("interval 380 days"))
    return retention.minimised(retention.read_by_day(e.spark, path), "attempted_at", as_of, _POLICIES, _SALT)


@query("x13_minimised_attempts", "attempt_id bigint, tenant_id int, subject string, ip_address string, attempted_at timestamp_ntz", _AGED)
def _(e):
    return _aged_attempts(e).withColumnRenamed("email", "subject")


@query("x13_subject_join", "user_id bigint, kept_attempts bigint, aged_attempts bigint",
       f"SELECT user_id, count(*) AS kept_attempts, count(*) FILTER (WHERE subject = {_TOKEN}) AS aged_attempts FROM users u JOIN ({_AGED}) AS a ON a.subject IN (email, {_TOKEN}) GROUP BY user_id")
def _(e):
    """Attempts per user found through the token or the address: none is lost by pseudonyms."""
    names = e.users.select("user_id", F.explode(F.array(F.struct(c("email").alias("subject"), F.lit(False).alias("aged")),
                                                        F.struct(retention.pseudonym(c("email"), _SALT).alias("subject"), F.lit(True).alias("aged")))).alias("n")).select("user_id", "n.*")
    met = _aged_attempts(e).select(c("email").alias("subject")).join(names, "subject")
    return met.groupBy("user_id").agg(F.count("*").alias("kept_attempts"), F.count_if("aged").alias("aged_attempts"))


_LATE = "SELECT *, DATE '2024-01-31' - received_at AS age_days FROM erasure_requests WHERE completed_at IS NULL AND DATE '2024-01-31' - received_at > 30"


@query("x14_overdue_erasures", "request_id bigint, tenant_id int, user_id bigint, received_at date, age_days int", _LATE)
def _(e):
    return retention.overdue(e.erasure_requests, event_as_of())


@query("x14_erasure_status", "tenant_id int, overdue_requests bigint, oldest_age int, compliant boolean, severity string",
       f"""SELECT t.tenant_id, count(request_id) AS overdue_requests, coalesce(max(age_days), 0) AS oldest_age, count(request_id) = 0 AS compliant, CASE WHEN count(request_id) = 0 THEN 'low' ELSE 'high' END AS severity
           FROM tenants t LEFT JOIN ({_LATE}) AS l ON l.tenant_id = t.tenant_id GROUP BY t.tenant_id""")
def _(e):
    return retention.erasure_status(retention.overdue(e.erasure_requests, event_as_of()), e.tenants)


# --- X21 control tests ---------------------------------------------------------------------------------------

_COVERED = """SELECT q.tenant_id, q.quarter, control_id, test_id, result, tested_at, CAST(q.quarter + INTERVAL 3 MONTH AS DATE) + 44 AS deadline,
        CASE WHEN result IS NULL THEN 'missing' WHEN result <> 'EFFECTIVE' THEN 'failed' WHEN tested_at > CAST(q.quarter + INTERVAL 3 MONTH AS DATE) + 44 THEN 'late' ELSE 'effective' END AS status
    FROM (SELECT tenant_id, CAST(unnest(generate_series(min(quarter), max(quarter), INTERVAL 3 MONTH)) AS DATE) AS quarter FROM control_tests GROUP BY tenant_id) AS q
    CROSS JOIN (VALUES ('IT-01-01'), ('IT-01-02'), ('IT-02-01'), ('IT-02-02'), ('IT-03-01'), ('IT-04-01'), ('IT-05-01')) AS k(control_id)
    LEFT JOIN (SELECT * FROM control_tests QUALIFY row_number() OVER (PARTITION BY tenant_id, control_id, quarter ORDER BY tested_at DESC, test_id DESC) = 1) AS t
        USING (tenant_id, quarter, control_id)"""


@stored_query("x21_control_coverage", "tenant_id int, quarter date, control_id string, test_id bigint, result string, tested_at date, deadline date, status string", _COVERED)
def _(e):
    return controls.coverage(e.control_tests)


@stored_query("x21_control_report", "tenant_id int, quarter date, total_controls bigint, effective bigint, failed bigint, late bigint, missing bigint, compliant boolean, severity string",
              f"""SELECT *, failed + missing = 0 AS compliant, CASE WHEN failed + missing = 0 THEN 'low' ELSE 'high' END AS severity FROM (SELECT tenant_id, quarter, count(*) AS total_controls,
                  count(*) FILTER (WHERE status = 'effective') AS effective, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'late') AS late,
                  count(*) FILTER (WHERE status = 'missing') AS missing FROM ({_COVERED}) GROUP BY tenant_id, quarter)""")
def _(e):
    return controls.coverage_report(controls.coverage(e.control_tests))


# --- X01 blended score, X20 tiers --------------------------------------------------------------------------------

_A, _B = "CAST(i.total_amount AS DOUBLE)", "CAST(p.total_amount AS DOUBLE)"
_FOLD = "list_reduce(list_prepend(0.0e0, list_transform({0}, lambda v, k: v::DOUBLE * {1}[k]::DOUBLE)), lambda s, v: s + v)"
_COS = f"({_FOLD.format('x.vec', 'y.vec')} / (sqrt({_FOLD.format('x.vec', 'x.vec')}) * sqrt({_FOLD.format('y.vec', 'y.vec')})))"
_OFF = f"(CAST(abs(i.total_amount - p.total_amount) AS DOUBLE) / CAST(greatest(i.total_amount, p.total_amount) AS DOUBLE))"
_RULE = f"""0.35e0 * ((greatest(length(i.invoice_number), length(p.po_number)) - levenshtein(i.invoice_number, p.po_number))::DOUBLE / greatest(length(i.invoice_number), length(p.po_number)))
    + 0.25e0 * CASE WHEN {_OFF} <= 0.05e0 THEN 1.0e0 ELSE greatest(0.0e0, 1.0e0 - {_OFF} * 2.0e0) END + 0.2e0 * 1.0e0
    + 0.15e0 * CASE WHEN abs(invoice_date - po_date) <= 30 THEN 1.0e0 ELSE greatest(0.0e0, 1.0e0 - abs(invoice_date - po_date)::DOUBLE / 90.0e0) END + 0.05e0 * 0.5e0"""


@stored_query("x01_blended_top3", "invoice_id bigint, rank int, po_id bigint, confidence double, rule_score double, vector_score double, explanation string",
              f"""SELECT * FROM (SELECT invoice_id, row_number() OVER (PARTITION BY invoice_id ORDER BY confidence DESC, po_id) AS rank, po_id, confidence, rule_score, vector_score,
                  CASE WHEN said = '' THEN 'Low confidence match' ELSE said END AS explanation FROM (
                  SELECT *, concat_ws('; ', CASE WHEN rule_score > 0.8e0 THEN 'Strong rule-based match' END, CASE WHEN vector_score > 0.8e0 THEN 'High semantic similarity' END, CASE WHEN off < 0.05e0 THEN 'Amount within 5% tolerance' END) AS said,
                         {sql_round('0.7e0 * rule_score + 0.3e0 * vector_score', 6)} AS confidence
                  FROM (SELECT k.invoice_id, k.po_id, {sql_round(_RULE, 6)} AS rule_score, {_OFF} AS off,
                               {sql_round(f'coalesce(CASE WHEN sqrt({_FOLD.format("x.vec", "x.vec")}) * sqrt({_FOLD.format("y.vec", "y.vec")}) > 0 THEN {_COS} ELSE 0.0e0 END, 0.0e0)', 6)} AS vector_score
                        FROM ({ORDER_CANDIDATES_SQL}) AS k JOIN invoices i ON i.invoice_id = k.invoice_id JOIN purchase_orders p ON p.po_id = k.po_id
                        LEFT JOIN invoice_vectors x ON x.invoice_id = k.invoice_id LEFT JOIN order_vectors y ON y.po_id = k.po_id))) WHERE rank <= 3""")
def _(e):
    return blended.best_orders(e.invoices, e.purchase_orders, e.document_vectors(e.invoices, "invoice_id", 0), e.document_vectors(e.purchase_orders, "po_id", 1))


_X, _Y = ("regexp_replace(upper(coalesce({0}, '')), '[^A-Z0-9]', '', 'g')".format(n) for n in ("po_reference", "po_number"))
_TIER_OFF = "abs(CAST(i.total_amount - p.total_amount AS DOUBLE) / CAST(p.total_amount AS DOUBLE)) * 100.0e0"
_TIERS = f"""WITH found AS (SELECT i.invoice_id, min(p.po_id) AS po_id FROM invoices i JOIN purchase_orders p ON p.tenant_id = i.tenant_id AND p.po_number = i.po_reference AND abs(i.total_amount - p.total_amount) < 0.01 GROUP BY 1),
    near AS (SELECT i.invoice_id, p.po_id, {_TIER_OFF} AS off, abs(invoice_date - po_date) AS days, {_X} AS x, {_Y} AS y FROM invoices i JOIN purchase_orders p ON p.tenant_id = i.tenant_id AND p.vendor_id = i.vendor_id
        WHERE {_TIER_OFF} <= 5.0e0 AND NOT EXISTS (SELECT 1 FROM found f WHERE f.invoice_id = i.invoice_id)),
    alike AS (SELECT x, y, 2.0e0 * {sql_common('x', 'y')} / (length(x) + length(y)) AS similarity FROM (SELECT DISTINCT x, y FROM near WHERE x <> '' AND y <> '')),
    scored AS (SELECT *, {sql_round('reached + price + 0.2e0 + closeness', 6)} AS score FROM (SELECT n.*, similarity, (1.0e0 - off / 100.0e0) * 0.3e0 AS price,
        CASE WHEN similarity > 0.8e0 THEN similarity * 0.4e0 ELSE 0.0e0 END AS reached, CASE WHEN days <= 7 THEN (1.0e0 - days / 30.0e0) * 0.1e0 ELSE 0.0e0 END AS closeness FROM near n LEFT JOIN alike a ON a.x = n.x AND a.y = n.y)),
    fuzzy AS (SELECT * FROM scored WHERE score >= 0.85e0 QUALIFY row_number() OVER (PARTITION BY invoice_id ORDER BY score DESC, po_id) = 1),
    tolerance AS (SELECT *, {sql_round('(price + 0.2e0 + closeness) / 0.6e0', 6)} AS part FROM scored s WHERE days <= 7 AND NOT EXISTS (SELECT 1 FROM fuzzy f WHERE f.invoice_id = s.invoice_id)
        QUALIFY row_number() OVER (PARTITION BY invoice_id ORDER BY part DESC, po_id) = 1),
    placed AS (SELECT invoice_id, 'exact' AS tier, 1.0e0 AS confidence, po_id, NULL AS similarity FROM found UNION ALL SELECT invoice_id, 'fuzzy', score, po_id, similarity FROM fuzzy
        UNION ALL SELECT invoice_id, 'tolerance', part, po_id, similarity FROM tolerance),
    tiers AS (SELECT i.tenant_id, i.invoice_id, coalesce(tier, 'exception') AS tier, coalesce(confidence, 0.0e0) AS confidence, q.po_id, r.receipt_id, similarity, i.po_reference, p.po_number,
        i.total_amount, p.total_amount AS po_total, i.invoice_date, p.po_date FROM invoices i LEFT JOIN placed q ON q.invoice_id = i.invoice_id LEFT JOIN purchase_orders p ON p.po_id = q.po_id
        LEFT JOIN (SELECT po_id, min(receipt_id) AS receipt_id FROM receipts GROUP BY po_id) AS r ON r.po_id = q.po_id),
    differing AS (SELECT tenant_id, invoice_id, 'po_number' AS field, po_number AS expected, po_reference AS actual, {sql_round('coalesce(similarity, 0.0e0)', 6)} AS measure FROM tiers WHERE tier IN ('fuzzy', 'tolerance') AND coalesce(similarity, 0.0e0) <= 0.8e0
        UNION ALL SELECT tenant_id, invoice_id, 'amount', CAST(po_total AS VARCHAR), CAST(total_amount AS VARCHAR), {sql_round('abs(CAST(total_amount - po_total AS DOUBLE) / CAST(po_total AS DOUBLE)) * 100.0e0', 6)} FROM tiers WHERE tier IN ('fuzzy', 'tolerance') AND total_amount <> po_total
        UNION ALL SELECT tenant_id, invoice_id, 'date', CAST(po_date AS VARCHAR), CAST(invoice_date AS VARCHAR), CAST(invoice_date - po_date AS DOUBLE) FROM tiers WHERE tier IN ('fuzzy', 'tolerance') AND invoice_date <> po_date)"""


def _tiers(e):
    return blended.tiered(e.invoices, e.purchase_orders, e.receipts)


@stored_query("x20_tiered_match", "tenant_id int, invoice_id bigint, tier string, confidence double, po_id bigint, receipt_id bigint, differences bigint",
              f"SELECT * FROM ({_TIERS} SELECT t.tenant_id, t.invoice_id, tier, confidence, po_id, receipt_id, (SELECT count(*) FROM differing d WHERE d.invoice_id = t.invoice_id) AS differences FROM tiers t)")
def _(e):
    return _tiers(e).withColumn("differences", F.size("discrepancies"))


@stored_query("x20_discrepancies", "tenant_id int, invoice_id bigint, field string, expected string, actual string, measure double", f"SELECT * FROM ({_TIERS} SELECT * FROM differing)")
def _(e):
    return _tiers(e).select("tenant_id", "invoice_id", F.inline("discrepancies"))


@stored_query("x20_tier_summary", "tenant_id int, tier string, invoices bigint, confidence double",
              f"SELECT * FROM ({_TIERS} SELECT tenant_id, tier, count(*) AS invoices, {sql_round('sum(CAST(confidence AS DECIMAL(18,6)))::DOUBLE / count(*)', 6)} AS confidence FROM tiers GROUP BY tenant_id, tier)")
def _(e):
    return _tiers(e).groupBy("tenant_id", "tier").agg(F.count("*").alias("invoices"), round_half_up(F.sum(c("confidence").cast("decimal(18,6)")).cast("double") / F.count("*"), 6).alias("confidence"))
