"""Streams over the event and import tables, each with a batch statement to check against.

Events arrive in parts, out of order by up to 80 minutes and some far too late (``sources.arrivals``);
the statements take the rows that are not too late, up to the watermark where answers wait for it.
Login alerts (``t07``) and progress (``t08``) have no watermark and count late rows too.
"""

from pyspark.sql import functions as F

from ledgerlink.operators import security, validate
from ledgerlink.plans.import_queries import _KNOWN
from ledgerlink.plans.registry import query
from ledgerlink.session import scratch_path
from ledgerlink.sources.arrivals import LATE_SQL, WATERMARK_SQL, event_stream
from ledgerlink.sources.entities import doc_as_of, parse_rows
from ledgerlink.streaming import jobs, limits
from ledgerlink.streaming.ordered import keyed_state

c = F.col
_LIMIT, _WINDOW = 3, 43200
_DELAY, _PASSED = "2 hours", WATERMARK_SQL.format(120)
_ANSWER = "event_id bigint, user_id bigint, allowed boolean, remaining int, reset_at bigint, retry_after bigint"


# One event of every user per step; the kept times of accepted events walk along as a list.
_US = _WINDOW * 1000000
_WALK = f"""WITH RECURSIVE queued AS (
        SELECT event_id, user_id, epoch_us(ts) AS tick, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {{rows}}),
    walk AS (
        SELECT event_id, user_id, tick, n, TRUE AS allowed, [tick] AS kept FROM queued WHERE n = 1
        UNION ALL
        SELECT event_id, user_id, tick, n, len(live) < {_LIMIT}, CASE WHEN len(live) >= {_LIMIT} THEN list_filter(live, lambda t: t <> tick) ELSE list_distinct(list_append(live, tick)) END
        FROM (SELECT q.*, list_filter(w.kept, lambda t: t > q.tick - {_US}) AS live FROM walk w JOIN queued q ON q.user_id = w.user_id AND q.n = w.n + 1))
    SELECT event_id, user_id, allowed, CASE WHEN allowed THEN greatest(0, {_LIMIT} - len(kept)) ELSE 0 END AS remaining, tick + {_US} AS reset_at,
        CASE WHEN NOT allowed THEN {_WINDOW} END AS retry_after FROM walk"""
_DUE = f"(SELECT * FROM events WHERE NOT {LATE_SQL} AND epoch_us(ts) <= {_PASSED})"
_ALL_WALK = _WALK.format(rows="events")


def _arriving(e):
    return event_stream(e.raw("events"), ["event_id", "user_id", "event_type", "ts", "value"])


def _attempts(e):
    """Login attempts out of the stream of events."""
    user = c("user_id")
    return _arriving(e).select(c("event_id").alias("attempt_id"), "user_id", F.concat(F.lit("10.0."), user % 4, F.lit("."), user).alias("ip_address"),
                               c("ts").alias("attempted_at"), (c("event_type") != "error").alias("success"))


def _answered(e, stream, label: str):
    with keyed_state(e.spark):
        return jobs.run_append(stream, label)


def _events(e):
    return e.raw("events").select("event_id", "user_id", "ts")


@query("t01_rate_limit", _ANSWER, _ALL_WALK)
def _(e):
    return limits.rate_limit(_events(e), _LIMIT, _WINDOW, F.date_trunc("DAY", c("ts")))


@query("t01_rate_limit_stream", _ANSWER, _WALK.format(rows=_DUE))
def _(e):
    return _answered(e, limits.rate_limit_stream(_arriving(e).select("event_id", "user_id", "ts"), _LIMIT, _WINDOW, _DELAY), "rate-limit")


@query("t02_remaining_quota", "user_id bigint, denied bigint, lowest_remaining int, longest_wait bigint",
       f"SELECT user_id, count(*) FILTER (WHERE NOT allowed) AS denied, min(remaining) AS lowest_remaining, max(retry_after) AS longest_wait FROM ({_ALL_WALK}) GROUP BY user_id")
def _(e):
    answers = limits.rate_limit(_events(e), _LIMIT, _WINDOW, F.date_trunc("DAY", c("ts")))
    return answers.groupBy("user_id").agg(F.count_if(~c("allowed")).alias("denied"), F.min("remaining").alias("lowest_remaining"), F.max("retry_after").alias("longest_wait"))


_PROG = """SELECT attempt_id, user_id, island_pos AS failures, least(30.0e0, 0.5e0 * pow(2.0e0, island_pos - 1)) AS delay_seconds FROM (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY attempted_at, attempt_id) AS island_pos FROM (
    SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY attempted_at, attempt_id ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN attempted_at - lag(attempted_at) OVER (PARTITION BY user_id ORDER BY attempted_at, attempt_id) < INTERVAL 43200 SECOND THEN 0 ELSE 1 END AS brk FROM {rows} WHERE NOT success)))"""


_ATTEMPTS = f"(SELECT a.* FROM auth_attempts a JOIN {_DUE} AS d ON d.event_id = a.attempt_id)"


@query("t03_progressive_delay_stream", "attempt_id bigint, user_id bigint, failures bigint, delay_seconds double", _PROG.format(rows=_ATTEMPTS))
def _(e):
    return _answered(e, limits.failure_counter_stream(_attempts(e), 43200, _DELAY), "failure-counter")


@query("t04_progressive_lockout_stream", "attempt_id bigint, user_id bigint, failures bigint, lock_minutes double",
       f"""SELECT attempt_id, user_id, failures, CASE WHEN failures >= 5 AND NOT success THEN least(1440.0e0, 30.0e0 * pow(2.0e0, failures - 5)) END AS lock_minutes FROM (
           SELECT *, count(*) FILTER (WHERE NOT success) OVER (PARTITION BY user_id, era ORDER BY attempted_at, attempt_id ROWS UNBOUNDED PRECEDING) AS failures FROM (
           SELECT *, count(*) FILTER (WHERE success) OVER (PARTITION BY user_id ORDER BY attempted_at, attempt_id ROWS UNBOUNDED PRECEDING) AS era FROM {_ATTEMPTS}))""")
def _(e):
    return _answered(e, limits.lockout_stream(_attempts(e), _DELAY), "lockouts")


_GAPS = "SELECT *, CASE WHEN attempted_at - lag(attempted_at) OVER (PARTITION BY ip_address ORDER BY attempted_at, attempt_id) < INTERVAL 24 HOUR THEN FALSE ELSE TRUE END AS fresh FROM auth_attempts WHERE attempted_at <= TIMESTAMP '2024-01-30 12:00:00'"


@query("t05_device_attempts", "attempt_id bigint, ip_address string, attempted_at timestamp_ntz, success boolean",
       f"""SELECT attempt_id, ip_address, attempted_at, success FROM (SELECT *, row_number() OVER (PARTITION BY ip_address ORDER BY attempted_at DESC, attempt_id DESC) AS n,
           max(attempted_at) OVER (PARTITION BY ip_address) AS last_at, max(CASE WHEN fresh THEN attempted_at END) OVER (PARTITION BY ip_address) AS reset_at FROM ({_GAPS}))
           WHERE n <= 10 AND attempted_at >= reset_at AND last_at > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR""")
def _(e):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    rows = e.auth_attempts.filter(c("attempted_at") <= now).select("attempt_id", "ip_address", "attempted_at", "success")
    return security.device_lists(rows, "ip_address", now)


@query("t05_device_attempts_stream", "attempt_id bigint, ip_address string, attempted_us bigint, success boolean",
       f"""SELECT attempt_id, ip_address, epoch_us(attempted_at) AS attempted_us, success FROM (SELECT *, row_number() OVER (PARTITION BY ip_address ORDER BY attempted_at DESC, attempt_id DESC) AS n,
           max(CASE WHEN fresh THEN attempted_at END) OVER (PARTITION BY ip_address) AS reset_at FROM (
           SELECT *, CASE WHEN attempted_at - lag(attempted_at) OVER (PARTITION BY ip_address ORDER BY attempted_at, attempt_id) < INTERVAL 24 HOUR THEN FALSE ELSE TRUE END AS fresh FROM {_ATTEMPTS}))
           WHERE n <= 10 AND attempted_at >= reset_at""")
def _(e):
    """The newest list of each device."""
    lists = _answered(e, limits.device_stream(_attempts(e), _DELAY), "devices")
    newest = lists.groupBy("ip_address").agg(F.max("version").alias("version"))
    return lists.join(newest, ["ip_address", "version"]).distinct().withColumnRenamed("at", "attempted_us")


@query("t06_hourly_metrics", "hour timestamp_ntz, metric string, n bigint, total decimal(18,2)",
       "SELECT date_trunc('hour', ts) AS hour, event_type AS metric, count(*) AS n, sum(CAST(value AS DECIMAL(18,2))) AS total FROM events WHERE NOT " + LATE_SQL + " GROUP BY ALL")
def _(e):
    updates = jobs.run_batches(jobs.hourly_metrics(_arriving(e)), "hourly", lambda b: b)
    return jobs.newest(updates, ["hour", "metric"])


@query("t07_continuous_alerts", "span_start timestamp_ntz, rule_name string, level string, value double",
       """SELECT span_start, rule_name, level, v AS value FROM (SELECT CAST(date_trunc('day', attempted_at) AS TIMESTAMP) AS span_start, count(*) FILTER (WHERE NOT success) AS f,
          count(*) FILTER (WHERE failure_reason IN ('rate_limited', 'suspicious_activity')) AS s FROM auth_attempts GROUP BY 1) AS h
          CROSS JOIN LATERAL (VALUES ('auth_failed_login_rate', h.f), ('auth_suspicious_logins', h.s)) AS m(metric, v) JOIN alert_rules r ON r.metric = m.metric WHERE v > threshold""")
def _(e):
    raw = _arriving(e)
    ok = c("event_type") != "error"
    attempts = raw.select(c("ts").alias("attempted_at"), ok.alias("success"), F.when(~ok & (c("value") > 100), "suspicious_activity").when(~ok & (c("value") > 50), "rate_limited").alias("failure_reason"))
    rules = e.config("alert_rules")

    def fire(batch):
        long = batch.unpivot(["span_start"], ["auth_failed_login_rate", "auth_suspicious_logins"], "metric", "value")
        hit = long.join(F.broadcast(rules), "metric").filter("value > threshold")
        return hit.select("span_start", "rule_name", "level", "value")

    updates = jobs.run_batches(jobs.login_alert_metrics(attempts), "alerts", fire)
    return jobs.newest(updates, ["span_start", "rule_name"])


@query("t08_latest_progress", "batch_key bigint, stage string, event_id bigint, steps bigint",
       "SELECT user_id AS batch_key, max_by(event_type, (ts, event_id)) AS stage, max_by(event_id, (ts, event_id)) AS event_id, count(*) AS steps FROM events GROUP BY 1")
def _(e):
    raw = _arriving(e)
    updates = jobs.run_batches(jobs.latest_progress(raw.select(c("user_id").alias("batch_key"), c("event_type").alias("stage"), "event_id", "ts")), "progress", lambda b: b)
    return jobs.newest(updates, ["batch_key"])


@query("t10_import_then_match", "import_batch_id bigint, row_number int, vendor_id bigint, po_id bigint",
       f"""SELECT import_batch_id, row_number, known_id AS vendor_id, p.po_id FROM (SELECT r.*, k.known_id FROM parsed_rows r LEFT JOIN ({_KNOWN}) AS k ON k.tenant_id = r.tenant_id AND k.uname = upper(trim(r.vendor_name))
           WHERE r.invoice_number IS NOT NULL AND r.vendor_name IS NOT NULL AND r.total_amount > 0 AND r.invoice_date IS NOT NULL) AS a
           LEFT JOIN purchase_orders p ON p.tenant_id = a.tenant_id AND p.po_number = trim(a.po_reference) AND p.status <> 'archived'""", stored=True)
def _(e):
    folder = scratch_path(e.spark, "incoming")
    e.import_rows.repartition(4, "import_batch_id").write.parquet(folder)
    vendors, orders = e.vendors, e.purchase_orders.filter("status <> 'archived'").select("tenant_id", "po_number", "po_id")

    def import_and_match(batch):
        parsed = validate.with_findings(parse_rows(batch, 2001), validate.parse_rules(doc_as_of()))
        good = parsed.filter(~F.exists("findings", lambda f: f["severity"] == "error"))
        known = validate.mark_known_vendors(good, vendors).withColumn("po_number", F.trim("po_reference"))
        return known.join(orders, ["tenant_id", "po_number"], "left").select("import_batch_id", "row_number", "vendor_id", "po_id")

    return jobs.run_batches(jobs.file_stream(e.spark, folder, "*.parquet", 2), "import-match", import_and_match, "append").drop("batch_id")


@query("t11_session_spans", "user_id bigint, started_at timestamp_ntz, expires_at timestamp_ntz, events bigint",
       """SELECT user_id, min(ts) AS started_at, max(ts) + INTERVAL 8 HOUR AS expires_at, count(*) AS events FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (
          SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 8 HOUR THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY user_id, island""")
def _(e):
    return jobs.session_spans(e.raw("events"))


_GAP = 8 * 3600


@query("t11_session_spans_stream", "user_id bigint, started bigint, expires bigint, events bigint",
       f"""SELECT user_id, min(tick) AS started, max(tick) + {_GAP * 1000000} AS expires, count(*) AS events FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY tick, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (
           SELECT *, CASE WHEN tick - lag(tick) OVER (PARTITION BY user_id ORDER BY tick, event_id) <= {_GAP * 1000000} THEN 0 ELSE 1 END AS brk FROM (SELECT *, epoch_us(ts) AS tick FROM {_DUE})))
           GROUP BY user_id, island HAVING max(tick) + {_GAP * 1000000} < {_PASSED}""")
def _(e):
    """Spans that have ended, given out by timers."""
    return _answered(e, limits.session_stream(_arriving(e).select("event_id", "user_id", "ts"), _GAP, _DELAY), "sessions")
