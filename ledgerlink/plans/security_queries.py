"""Login, session, permission and compliance queries over the event tables."""

from pyspark.sql import functions as F

from ledgerlink.functions import scores
from ledgerlink.functions.numeric import round_half_up
from ledgerlink.operators import security
from ledgerlink.plans.oracle_ctes import sql_percent, sql_round
from ledgerlink.plans.registry import query
from ledgerlink.sources.entities import event_as_of, session_as_of
from ledgerlink.sources.literals import CONFIG_SQL

c = F.col
_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
_SES = "TIMESTAMP '2024-01-30 20:00:00'"
_WEEK = f"{_NOW} - INTERVAL 7 DAY"


def _since(days):
    return event_as_of() - F.expr(f"interval {days} days")


@query("v17_audit_filters", "audit_id bigint, event_type string, risk_level string",
       f"SELECT audit_id, event_type, risk_level FROM security_audit WHERE tenant_id = 2 AND resource_type = 'invoice' AND risk_level = 'high' AND occurred_at >= {_NOW} - INTERVAL 20 DAY")
def _(e):
    return e.security_audit.filter("tenant_id = 2 and resource_type = 'invoice' and risk_level = 'high'").filter(c("occurred_at") >= _since(20))


@query("a20_security_metrics", "section string, item string, events bigint",
       f"""SELECT 'total' AS section, 'all' AS item, count(*) AS events FROM security_audit WHERE occurred_at >= {_WEEK} UNION ALL
           SELECT 'type', event_type, count(*) FROM security_audit WHERE occurred_at >= {_WEEK} GROUP BY 2 UNION ALL SELECT 'risk', risk_level, count(*) FROM security_audit WHERE occurred_at >= {_WEEK} GROUP BY 2
           UNION ALL SELECT 'failed_logins', 'all', count(*) FROM auth_attempts WHERE attempted_at >= {_WEEK} AND NOT success UNION ALL
           SELECT 'suspicious', 'all', count(*) FROM security_audit WHERE occurred_at >= {_WEEK} AND risk_level IN ('high', 'critical')""")
def _(e):
    cube = e.security_audit.filter(c("occurred_at") >= _since(7)).groupBy("event_type", "risk_level").agg(F.count("*").alias("n"))
    risky = F.when(c("risk_level").isin("high", "critical"), F.struct(F.lit("suspicious").alias("section"), F.lit("all").alias("item")))
    tags = F.array_compact(F.array(F.struct(F.lit("total").alias("section"), F.lit("all").alias("item")), F.struct(F.lit("type").alias("section"), c("event_type").alias("item")),
                                   F.struct(F.lit("risk").alias("section"), c("risk_level").alias("item")), risky))
    counts = cube.select("n", F.explode(tags).alias("t")).groupBy("t.section", "t.item").agg(F.sum("n").alias("events"))
    failed = e.auth_attempts.filter(c("attempted_at") >= _since(7)).agg(F.count_if(~c("success")).alias("events")).select(
        F.lit("failed_logins").alias("section"), F.lit("all").alias("item"), "events")
    return counts.unionByName(failed)


@query("a21_top_risk_addresses", "ip_address string, event_count bigint, max_risk string",
       f"""SELECT ip_address, n AS event_count, CASE r WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS max_risk FROM (SELECT ip_address, count(*) AS n,
           max(CASE risk_level WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END) AS r FROM security_audit WHERE risk_level <> 'low' AND occurred_at >= {_WEEK} GROUP BY 1) ORDER BY n DESC, ip_address LIMIT 10""")
def _(e):
    rank = security.risk_rank(c("risk_level"))
    rows = e.security_audit.filter((c("risk_level") != "low") & (c("occurred_at") >= _since(7))).groupBy("ip_address").agg(
        F.count("*").alias("event_count"), F.max_by("risk_level", rank).alias("max_risk"))
    return rows.orderBy(F.desc("event_count"), "ip_address").limit(10)


@query("a22_brute_force", "ip_address string, failed_attempts bigint, unique_emails bigint",
       "SELECT ip_address, count(*) AS failed_attempts, count(DISTINCT email) AS unique_emails FROM auth_attempts WHERE NOT success GROUP BY 1 HAVING count(*) >= 10")
def _(e):
    return security.brute_force(e.auth_attempts)


@query("a23_success_after_failures", "ip_address string, email string, successes bigint, failures bigint",
       "SELECT ip_address, email, count(*) FILTER (WHERE success) AS successes, count(*) FILTER (WHERE NOT success) AS failures FROM auth_attempts GROUP BY 1, 2 HAVING successes > 0 AND failures >= 10")
def _(e):
    return security.success_after_failures(e.auth_attempts)


_LOGIN = f"""SELECT CAST(count(*) AS DOUBLE) AS auth_total_attempts, CAST(count(*) FILTER (WHERE success) AS DOUBLE) AS auth_successful_logins, CAST(count(*) FILTER (WHERE NOT success) AS DOUBLE) AS auth_failed_logins,
    {sql_round('count(*) / 168.0e0', 6)} AS auth_login_rate, {sql_round('count(*) FILTER (WHERE NOT success) / 168.0e0', 6)} AS auth_failed_login_rate, {sql_percent('count(*) FILTER (WHERE success)', 'count(*)', 4)} AS auth_success_rate,
    CAST((SELECT count(*) FROM users WHERE account_locked_until > {_WEEK}) AS DOUBLE) AS auth_account_lockouts, CAST(count(*) FILTER (WHERE mfa_required) AS DOUBLE) AS auth_mfa_required,
    CAST(count(*) FILTER (WHERE mfa_success) AS DOUBLE) AS auth_mfa_success, CAST(count(*) FILTER (WHERE failure_reason IN ('rate_limited', 'suspicious_activity')) AS DOUBLE) AS auth_suspicious_logins,
    CAST(count(DISTINCT ip_address) AS DOUBLE) AS auth_unique_ip_addresses, CAST(count(DISTINCT substring(ip_address, 1, 7)) AS DOUBLE) AS auth_ip_range_diversity
    FROM auth_attempts WHERE attempted_at BETWEEN {_WEEK} AND {_NOW}"""


def _login(e):
    rows = e.auth_attempts.filter(c("attempted_at").between(_since(7), event_as_of()))
    return security.login_metrics(rows, e.users, _since(7), 168.0)


@query("a24_login_metrics", "auth_total_attempts double, auth_successful_logins double, auth_failed_logins double, auth_login_rate double, auth_failed_login_rate double, auth_success_rate double, auth_account_lockouts double, auth_mfa_required double, auth_mfa_success double", _LOGIN)
def _(e):
    return _login(e)


@query("a25_security_diversity", "auth_suspicious_logins double, auth_unique_ip_addresses double, auth_ip_range_diversity double", _LOGIN)
def _(e):
    return _login(e)


_LIVE = f"SELECT * FROM user_sessions WHERE status = 'active' AND expires_at > {_SES}"


@query("a26_session_metrics", "active_sessions bigint, avg_minutes double, per_user double",
       f"SELECT count(*) AS active_sessions, coalesce({sql_round(f'''CAST(sum(date_sub('second', created_at, {_SES})) AS DOUBLE) / count(*) / 60.0e0''', 4)}, 0) AS avg_minutes, coalesce({sql_round('CAST(count(*) AS DOUBLE) / nullif(count(DISTINCT user_id), 0)', 4)}, 0) AS per_user FROM ({_LIVE})")
def _(e):
    return security.session_metrics(e.user_sessions, session_as_of())


_OPEN = "SELECT * FROM user_sessions WHERE status = 'active' AND expires_at > TIMESTAMP '2024-01-05 00:00:00'"


def _early():
    return F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")


@query("a27_users_over_session_limit", "user_id bigint, sessions bigint", f"SELECT user_id, count(*) AS sessions FROM ({_OPEN}) GROUP BY 1 HAVING count(*) > 3")
def _(e):
    return security.users_over_limit(e.user_sessions, _early())


@query("w07_excess_sessions", "session_id bigint, user_id bigint",
       f"SELECT session_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_accessed, session_id) AS n, count(*) OVER (PARTITION BY user_id) AS k FROM ({_OPEN})) WHERE k >= 3 AND n <= k - 3 + 1")
def _(e):
    return security.excess_sessions(e.user_sessions, _early())


@query("k08_session_sweep", "session_id bigint, status string, reason string",
       f"SELECT session_id, CASE WHEN status = 'active' AND expires_at <= {_SES} THEN 'expired' ELSE status END AS status, CASE WHEN status = 'active' AND expires_at <= {_SES} THEN 'session_expired' END AS reason FROM user_sessions")
def _(e):
    gone = (c("status") == "active") & (c("expires_at") <= session_as_of())
    return e.user_sessions.select("session_id", F.when(gone, "expired").otherwise(c("status")).alias("status"), F.when(gone, "session_expired").alias("reason"))


@query("o08_active_sessions", "session_id bigint, user_id bigint, last_accessed timestamp_ntz", f"SELECT session_id, user_id, last_accessed FROM ({_LIVE}) ORDER BY user_id, last_accessed DESC")
def _(e):
    return e.user_sessions.filter((c("status") == "active") & (c("expires_at") > session_as_of())).orderBy("user_id", F.desc("last_accessed"))


_COMP = f"""SELECT {sql_percent("count(*) FILTER (WHERE mfa_enabled)", 'count(*)', 4)} AS mfa_adoption_percent,
    {sql_percent("count(*) FILTER (WHERE password_changed_at >= DATE '2024-01-31' - 30)", 'count(*)', 4)} AS password_age_percent,
    {sql_percent("count(*) FILTER (WHERE password_changed_at > DATE '2024-01-31' - 90)", 'count(*)', 4)} AS password_policy_percent FROM users WHERE auth_status = 'active'"""


def _day():
    return F.lit("2024-01-31").cast("date")


@query("a28_compliance_metrics", "mfa_adoption_percent double, password_age_percent double", _COMP)
def _(e):
    return security.compliance_metrics(e.users, _day())


def _values(e):
    flags = F.array(F.struct(F.lit("account_lockout_enabled").alias("name"), F.lit(None).cast("double").alias("value"), F.lit(True).alias("flag")),
                    F.struct(F.lit("audit_events_present").alias("name"), F.lit(None).cast("double").alias("value"), (c("n") > 0).alias("flag")))
    seen = e.auth_attempts.agg(F.count("*").alias("n")).select(F.explode(flags).alias("x")).select("x.*")
    nums = security.long_form(security.compliance_metrics(e.users, _day())).select(c("metric").alias("name"), "value", F.lit(None).cast("boolean").alias("flag"))
    return nums.unionByName(seen)


@query("a29_compliance_score", "score double",
       f"SELECT {sql_round('(mfa_adoption_percent + password_age_percent + password_policy_percent + 100.0e0 + 100.0e0) / 5', 4)} AS score FROM ({_COMP})")
def _(e):
    return security.compliance_score(_values(e))


@query("a30_compliance_report", "section string, name string, value double",
       f"""SELECT 'metrics' AS section, 'mfa_adoption_percent' AS name, mfa_adoption_percent AS value FROM ({_COMP}) UNION ALL SELECT 'metrics', 'password_age_percent', password_age_percent FROM ({_COMP})
           UNION ALL SELECT 'access', 'password_policy_percent', password_policy_percent FROM ({_COMP}) UNION ALL SELECT 'audit', 'total_events_logged', CAST(count(*) AS DOUBLE) FROM auth_attempts WHERE attempted_at >= {_NOW} - INTERVAL 30 DAY
           UNION ALL SELECT 'score', 'overall', {sql_round('(mfa_adoption_percent + password_age_percent + password_policy_percent + 100.0e0 + 100.0e0) / 5', 4)} FROM ({_COMP})
           UNION ALL SELECT 'monitoring', 'alert_rules_configured', CAST(count(*) AS DOUBLE) FROM alert_rules""")
def _(e):
    nums = security.long_form(security.compliance_metrics(e.users, _day())).select(
        F.when(c("metric") == "password_policy_percent", "access").otherwise("metrics").alias("section"), c("metric").alias("name"), "value")
    audit = e.auth_attempts.filter(c("attempted_at") >= _since(30)).agg(F.count("*").cast("double").alias("value")).select(F.lit("audit").alias("section"), F.lit("total_events_logged").alias("name"), "value")
    score = security.compliance_score(_values(e)).select(F.lit("score").alias("section"), F.lit("overall").alias("name"), c("score").alias("value"))
    rules = e.config("alert_rules").agg(F.count("*").cast("double").alias("value")).select(F.lit("monitoring").alias("section"), F.lit("alert_rules_configured").alias("name"), "value")
    return nums.unionByName(audit).unionByName(score).unionByName(rules)


_LONG = f"SELECT metric, value FROM (UNPIVOT ({_LOGIN}) ON COLUMNS(*) INTO NAME metric VALUE value)"
_ALERT = f"SELECT r.rule_name, m.metric, r.level, m.value, r.threshold FROM ({_LONG}) AS m JOIN alert_rules r ON r.metric = m.metric WHERE m.value > r.threshold"


def _alerts(e):
    return security.alerts(security.long_form(_login(e)), e.config("alert_rules"))


@query("a31_alert_rules", "rule_name string, metric string, level string, value double, threshold double", _ALERT)
def _(e):
    return _alerts(e)


@query("a32_alert_summary", "total_alerts bigint, critical_alerts bigint, high_alerts bigint, health string",
       f"SELECT count(*) AS total_alerts, count(*) FILTER (WHERE level = 'critical') AS critical_alerts, count(*) FILTER (WHERE level = 'high') AS high_alerts, CASE WHEN count(*) = 0 THEN 'healthy' ELSE 'warning' END AS health FROM ({_ALERT})")
def _(e):
    return _alerts(e).agg(F.count("*").alias("total_alerts"), F.count_if(c("level") == "critical").alias("critical_alerts"), F.count_if(c("level") == "high").alias("high_alerts"),
                          F.when(F.count("*") == 0, "healthy").otherwise("warning").alias("health"))


@query("a33_metric_query", "metric string, n bigint, average double, total decimal(18,2), lowest double, highest double",
       f"SELECT metric, count(*) AS n, {sql_round('CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*)', 4)} AS average, sum(CAST(value AS DECIMAL(18,2))) AS total, min(value) AS lowest, max(value) AS highest FROM metrics WHERE ts >= {_NOW} - INTERVAL 240 HOUR GROUP BY metric")
def _(e):
    v = c("value").cast("decimal(18,2)")
    rows = e.metrics.filter(c("ts") >= _since(10)).groupBy("metric").agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.min("value").alias("lowest"), F.max("value").alias("highest"))
    return rows.withColumn("average", round_half_up(c("total").cast("double") / c("n"), 4))


_HYG = f"""SELECT 'Default Account Found' AS title, 'high' AS risk_level, 'Authentication' AS category, 1 AS affected FROM users WHERE email IN (SELECT email FROM default_accounts)
    UNION ALL SELECT * FROM (SELECT 'Users Without MFA', 'medium', 'Authentication', count(*) AS n FROM users WHERE auth_status = 'active' AND NOT mfa_enabled) WHERE n > 0
    UNION ALL SELECT * FROM (SELECT 'Users Never Changed Password', 'low', 'Authentication', count(*) AS n FROM users WHERE auth_status = 'active' AND password_changed_at IS NULL) WHERE n > 0
    UNION ALL SELECT * FROM (SELECT 'Stale User Sessions', 'low', 'Session Management', count(*) AS n FROM users WHERE auth_status = 'active' AND last_login < {_NOW} - INTERVAL 30 DAY) WHERE n > 0
    UNION ALL SELECT * FROM (SELECT 'Excessive Old Audit Logs', 'low', 'Audit Security', count(*) AS n FROM auth_attempts WHERE attempted_at < {_NOW} - INTERVAL 20 DAY) WHERE n > 100"""


def _hygiene(e):
    return security.hygiene_findings(e.users, e.auth_attempts, e.config("default_accounts"), event_as_of(), old_limit=100, old_days=20)


@query("a34_hygiene_findings", "title string, risk_level string, category string, affected bigint", _HYG)
def _(e):
    return _hygiene(e)


@query("a35_findings_report", "section string, label string, findings bigint, security_score double",
       f"""SELECT 'total' AS section, 'all' AS label, count(*) AS findings, {sql_round('greatest(0.0e0, 100.0e0 - CAST(sum(weight) AS DOUBLE) / (count(*) * 25.0e0) * 100.0e0)', 4)} AS security_score FROM ({_HYG}) AS h JOIN risk_weights w ON w.risk_level = h.risk_level
           UNION ALL SELECT 'risk', w.risk_level, count(title), NULL FROM risk_weights w LEFT JOIN ({_HYG}) AS h ON h.risk_level = w.risk_level GROUP BY w.risk_level
           UNION ALL SELECT 'category', category, count(*), NULL FROM ({_HYG}) GROUP BY category""")
def _(e):
    return security.findings_report(_hygiene(e), e.config("risk_weights"))


# --- permissions -------------------------------------------------------------------------------

_ACTIVE = "SELECT * FROM user_roles WHERE is_active AND (expires_at IS NULL OR expires_at > DATE '2024-01-31')"
_CLOSURE = """WITH RECURSIVE up(role_id, ancestor_id) AS (SELECT role_id, role_id FROM roles
    UNION SELECT u.role_id, r.parent_role_id FROM up u JOIN roles r ON r.role_id = u.ancestor_id WHERE r.parent_role_id IS NOT NULL)
    SELECT role_id, ancestor_id FROM up"""
_GRANT = """SELECT role_id, resource || ':' || unnest(from_json(json_extract(permissions, '$.' || resource), '["VARCHAR"]')) AS permission FROM (SELECT *, unnest(json_keys(permissions)) AS resource FROM roles)"""
_PERM = f"SELECT DISTINCT a.user_id, a.tenant_id, g.permission FROM ({_ACTIVE}) AS a JOIN ({_CLOSURE}) AS x ON x.role_id = a.role_id JOIN ({_GRANT}) AS g ON g.role_id = x.ancestor_id"


def _active(e):
    return security.active_roles(e.user_roles, _day())


def _permissions(e):
    return security.user_permissions(_active(e), e.config("roles"), security.role_closure(e.config("roles")))


@query("j19_user_active_roles", "user_id bigint, tenant_id int, name string, level int",
       f"SELECT a.user_id, a.tenant_id, r.name, r.level FROM ({_ACTIVE}) AS a JOIN roles r ON r.role_id = a.role_id")
def _(e):
    return _active(e).join(e.config("roles"), "role_id")


@query("j20_visible_lines", "user_id bigint, lines bigint, total decimal(18,2), first_line bigint",
       """SELECT u.user_id, count(l.invoice_line_id) AS lines, coalesce(sum(l.line_total), 0) AS total, min(l.invoice_line_id) AS first_line FROM users u
          LEFT JOIN (SELECT i.tenant_id, x.* FROM invoice_lines x JOIN invoices i ON i.invoice_id = x.invoice_id) AS l ON l.tenant_id = u.tenant_id GROUP BY u.user_id""")
def _(e):
    """What each user sees. Lines are summed per tenant before users meet them."""
    return security.visible_totals(e.users, e.invoices, e.invoice_lines)


@query("j23_role_closure", "role_id int, ancestor_id int, users bigint",
       f"SELECT x.role_id, x.ancestor_id, count(u.user_id) AS users FROM ({_CLOSURE}) AS x LEFT JOIN user_roles u ON u.role_id = x.role_id GROUP BY ALL")
def _(e):
    counts = e.user_roles.groupBy("role_id").agg(F.count("*").alias("users"))
    return security.role_closure(e.config("roles")).join(counts, "role_id", "left").na.fill(0, ["users"])


@query("j24_defaults_per_tenant", "tenant_id int, role_name string, level int", "SELECT t.tenant_id, r.name AS role_name, r.level FROM tenants t CROSS JOIN roles r")
def _(e):
    return e.tenants.select("tenant_id").crossJoin(F.broadcast(e.config("roles").select(c("name").alias("role_name"), "level")))


@query("a36_user_permissions", "user_id bigint, tenant_id int, permissions string",
       f"SELECT user_id, tenant_id, string_agg(permission, ',' ORDER BY permission) AS permissions FROM ({_PERM}) GROUP BY 1, 2")
def _(e):
    return _permissions(e).groupBy("user_id", "tenant_id").agg(F.array_join(F.sort_array(F.collect_set("permission")), ",").alias("permissions"))


@query("u02_permission_union", "user_id bigint, permission string", f"SELECT DISTINCT user_id, permission FROM ({_PERM})")
def _(e):
    return _permissions(e).select("user_id", "permission").distinct()


@query("a37_permission_checks", "user_id bigint, resource string, action string, allowed boolean",
       f"""SELECT u.user_id, q.resource, q.action, EXISTS (SELECT 1 FROM ({_PERM}) AS p WHERE p.user_id = u.user_id AND p.permission IN (q.resource || ':' || q.action, q.resource || ':*', 'system:*')) AS allowed
           FROM users u CROSS JOIN permission_requests q""")
def _(e):
    requests = e.users.select("user_id").crossJoin(F.broadcast(e.config("permission_requests")))  # a few fixed rights, asked for everybody
    return security.check_permissions(e.users.select("user_id"), requests, _permissions(e))


# --- recent rows and sliding state ------------------------------------------------------------------


@query("w08_last_attempts_per_device", "attempt_id bigint, ip_address string, attempted_at timestamp_ntz",
       "SELECT attempt_id, ip_address, attempted_at FROM (SELECT *, row_number() OVER (PARTITION BY ip_address ORDER BY attempted_at DESC, attempt_id DESC) AS n FROM auth_attempts) WHERE n <= 10")
def _(e):
    return security.last_n(e.auth_attempts, ["ip_address"], [F.desc("attempted_at"), F.desc("attempt_id")], 10)


@query("w09_last_values_per_metric", "metric string, value double, ts timestamp_ntz",
       f"SELECT metric, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts DESC, event_id DESC) AS n FROM metrics WHERE ts >= {_NOW} - INTERVAL 24 HOUR - INTERVAL 48 HOUR) WHERE n <= 100")
def _(e):
    return security.last_n(e.metrics.filter(c("ts") >= _since(3)), ["metric"], [F.desc("ts"), F.desc("event_id")], 100)


@query("w11_sliding_count", "event_id bigint, user_id bigint, in_window bigint",
       "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW) AS in_window FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)")
def _(e):
    return security.sliding_counts(e.raw("events").select("event_id", "user_id", "ts"), "user_id", "ts", 21600)


@query("w13_trusted_device_list", "user_id bigint, fingerprint bigint, added_at timestamp_ntz",
       """SELECT user_id, fingerprint, added_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY added_at DESC, fingerprint) AS n FROM (
          SELECT user_id, event_id % 9 AS fingerprint, max(ts) AS added_at FROM events WHERE event_type = 'signup' GROUP BY ALL)) WHERE n <= 5""")
def _(e):
    devices = e.raw("events").filter("event_type = 'signup'").groupBy("user_id", (c("event_id") % 9).alias("fingerprint")).agg(F.max("ts").alias("added_at"))
    return security.last_n(devices, ["user_id"], [F.desc("added_at"), c("fingerprint")], 5)


_PROG = """SELECT attempt_id, user_id, island_pos AS failures, least(30.0e0, 0.5e0 * pow(2.0e0, island_pos - 1)) AS delay_seconds FROM (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY attempted_at, attempt_id) AS island_pos FROM (
    SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY attempted_at, attempt_id ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN attempted_at - lag(attempted_at) OVER (PARTITION BY user_id ORDER BY attempted_at, attempt_id) < INTERVAL 43200 SECOND THEN 0 ELSE 1 END AS brk FROM auth_attempts WHERE NOT success)))"""


@query("t03_progressive_delay", "attempt_id bigint, user_id bigint, failures bigint, delay_seconds double", _PROG)
def _(e):
    failed = e.auth_attempts.filter("not success").select("attempt_id", "user_id", "attempted_at")
    hour = F.date_trunc("DAY", c("attempted_at"))
    seen = security.previous_time(failed, "user_id", "attempted_at", "attempt_id", hour, "previous")
    fresh = c("previous").isNull() | ((c("attempted_at") - c("previous")) >= F.expr("interval 43200 seconds"))
    runs = security.running_since_reset(seen, "user_id", ["attempted_at", "attempt_id"], hour, fresh, F.lit(1), "failures")
    return runs.withColumn("delay_seconds", scores.retry_delay_seconds(c("failures") - 1))


_LOCK = """SELECT attempt_id, user_id, failures, CASE WHEN failures >= 5 AND NOT success THEN least(1440.0e0, 30.0e0 * pow(2.0e0, failures - 5)) END AS lock_minutes FROM (
    SELECT *, count(*) FILTER (WHERE NOT success) OVER (PARTITION BY user_id, era ORDER BY attempted_at, attempt_id ROWS UNBOUNDED PRECEDING) AS failures FROM (
    SELECT *, count(*) FILTER (WHERE success) OVER (PARTITION BY user_id ORDER BY attempted_at, attempt_id ROWS UNBOUNDED PRECEDING) AS era FROM auth_attempts))"""


@query("t04_progressive_lockout", "attempt_id bigint, user_id bigint, failures bigint, lock_minutes double", _LOCK)
def _(e):
    rows = e.auth_attempts.select("attempt_id", "user_id", "attempted_at", "success")
    good = c("success")
    runs = security.running_since_reset(rows, "user_id", ["attempted_at", "attempt_id"], F.date_trunc("DAY", c("attempted_at")), good, (~c("success")).cast("bigint"), "failures")
    return runs.withColumn("lock_minutes", F.when(~c("success"), scores.lockout_minutes(c("failures"))))


@query("t09_blocked_events", "event_id bigint, blocked boolean",
       """SELECT e.event_id, EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'error' AND b.value > 100 AND b.user_id = e.user_id AND b.ts < e.ts AND e.ts <= b.ts + INTERVAL 3600 SECOND) AS blocked FROM events e""")
def _(e):
    rows = e.raw("events").select("event_id", "user_id", "ts", "event_type", "value")
    block = F.when((c("event_type") == "error") & (c("value") > 100), c("ts"))
    return security.blocked_flags(rows, "user_id", "ts", block, 3600)
