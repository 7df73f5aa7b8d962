"""Login, session, permission and compliance work on event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerlink.functions.numeric import percent, round_half_up
from ledgerlink.operators.names import permission_strings
from ledgerlink.session import staged

c = F.col
MAX_SESSIONS = 3
RISK_ORDER = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def risk_rank(level: Column) -> Column:
    out = F.lit(0)
    for name, n in RISK_ORDER.items():
        out = F.when(level == name, n).otherwise(out)
    return out


def brute_force(attempts: DataFrame, at_least: int = 10) -> DataFrame:
    """Addresses with many failed logins and how many accounts they tried."""
    per_mail = attempts.filter("not success").groupBy("ip_address", "email").agg(F.count("*").alias("n"))
    return per_mail.groupBy("ip_address").agg(F.sum("n").alias("failed_attempts"), F.count("*").alias("unique_emails")).filter(c("failed_attempts") >= at_least)


def success_after_failures(attempts: DataFrame, at_least: int = 10) -> DataFrame:
    sums = attempts.groupBy("ip_address", "email").agg(F.count_if("success").alias("successes"), F.count_if(~c("success")).alias("failures"))
    return sums.filter((c("successes") > 0) & (c("failures") >= at_least))


def login_metrics(attempts: DataFrame, users: DataFrame, start: Column, hours: float) -> DataFrame:
    """One row of login and security metrics for a time slice."""
    locked = users.agg(F.count_if(c("account_locked_until") > start).alias("auth_account_lockouts"))
    ok = c("success")
    per = attempts.groupBy("ip_address").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("good"), F.count_if("mfa_required").alias("mfa"), F.count_if("mfa_success").alias("mfa_ok"),
        F.count_if(c("failure_reason").isin("rate_limited", "suspicious_activity")).alias("odd"))
    sums = per.agg(F.sum("n").alias("total"), F.sum("good").alias("good"), F.sum("mfa").alias("mfa"), F.sum("mfa_ok").alias("mfa_ok"), F.sum("odd").alias("odd"),
                   F.count("*").alias("ips"), F.countDistinct(F.substring("ip_address", 1, 7)).alias("ranges"))
    total, good = F.coalesce("total", F.lit(0)), F.coalesce("good", F.lit(0))
    return sums.join(F.broadcast(locked)).select(
        total.cast("double").alias("auth_total_attempts"), good.cast("double").alias("auth_successful_logins"), (total - good).cast("double").alias("auth_failed_logins"),
        round_half_up(total / hours, 6).alias("auth_login_rate"), round_half_up((total - good) / hours, 6).alias("auth_failed_login_rate"),
        percent(good, total, 4).alias("auth_success_rate"), c("auth_account_lockouts").cast("double").alias("auth_account_lockouts"),
        F.coalesce("mfa", F.lit(0)).cast("double").alias("auth_mfa_required"), F.coalesce("mfa_ok", F.lit(0)).cast("double").alias("auth_mfa_success"),
        F.coalesce("odd", F.lit(0)).cast("double").alias("auth_suspicious_logins"), c("ips").cast("double").alias("auth_unique_ip_addresses"),
        c("ranges").cast("double").alias("auth_ip_range_diversity"))


def long_form(row: DataFrame) -> DataFrame:
    """(metric, value) rows out of a one-row frame of doubles."""
    return row.unpivot([], row.columns, "metric", "value")


def session_metrics(sessions: DataFrame, as_of: Column) -> DataFrame:
    live = sessions.filter((c("status") == "active") & (c("expires_at") > as_of))
    seconds = F.timestamp_diff("SECOND", c("created_at"), as_of)
    per = live.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(seconds).alias("s"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("active_sessions"), F.coalesce(round_half_up(F.try_divide(F.sum("s").cast("double"), F.sum("n").cast("double")) / 60.0, 4), F.lit(0.0)).alias("avg_minutes"),
                   F.coalesce(round_half_up(F.try_divide(F.sum("n").cast("double"), F.count("*").cast("double")), 4), F.lit(0.0)).alias("per_user"))


def users_over_limit(sessions: DataFrame, as_of: Column, limit: int = MAX_SESSIONS) -> DataFrame:
    live = sessions.filter((c("status") == "active") & (c("expires_at") > as_of))
    return live.groupBy("user_id").agg(F.count("*").alias("sessions")).filter(c("sessions") > limit)


def excess_sessions(sessions: DataFrame, as_of: Column, limit: int = MAX_SESSIONS) -> DataFrame:
    """Sessions to end so that a new one fits: all but the ``limit - 1`` most recently used.

    Keeping is a top-k per user (cut before the shuffle); ending is an anti join, so a user
    with very many sessions is never ranked as a whole.
    """
    live = sessions.filter((c("status") == "active") & (c("expires_at") > as_of))
    top = W.partitionBy("user_id").orderBy(F.desc("last_accessed"), F.desc("session_id"))
    keep = live.withColumn("n", F.row_number().over(top)).filter(c("n") <= limit - 1).select("session_id")
    full = live.groupBy("user_id").agg(F.count("*").alias("k")).filter(c("k") >= limit).select("user_id")
    return live.join(full, "user_id", "left_semi").join(keep, "session_id", "left_anti")


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key in an order; Spark cuts each task's part before shuffling."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(c("_n") <= n).drop("_n")


def sliding_counts(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Events of the same key in the ``seconds`` before and up to each event.

    Events collapse to counts per second first; each count is seen by its own time block and
    the next one, so a window never spans more than two blocks of a key.
    """
    sec = F.unix_timestamp(c(at).cast("timestamp"))
    counts = events.groupBy(key, sec.alias("sec")).agg(F.count("*").alias("n"))
    block = F.floor(c("sec") / seconds)
    spread = counts.select("*", F.explode(F.array(F.struct(block.alias("block"), F.lit(True).alias("own")), F.struct((block + 1).alias("block"), F.lit(False).alias("own")))).alias("b"))
    w = W.partitionBy(key, "b.block").orderBy("sec").rangeBetween(-seconds, 0)
    sums = spread.withColumn("in_window", F.sum("n").over(w)).filter("b.own").select(key, "sec", "in_window")
    return events.withColumn("sec", sec).join(sums, [key, "sec"]).drop("sec")


def running_since_reset(df: DataFrame, key: str, order: list[str], block: Column, reset: Column, weight: Column, name: str) -> DataFrame:
    """Sum of ``weight`` since the last row where ``reset`` holds, that row included.

    A key is worked on block by block (say, per hour); what one block hands to the next is
    carried by a small summary with one row per (key, block). No task sees a whole hot key.
    """
    rows = df.withColumn("_b", block).withColumn("_r", F.coalesce(reset, F.lit(False)).cast("int")).withColumn("_w", weight)
    inside = W.partitionBy(key, "_b").orderBy(*order)
    rows = rows.withColumn("_g", F.sum("_r").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy(key, "_b", "_g").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum("_w").over(run))
    parts = rows.groupBy(key, "_b", "_g").agg(F.sum("_w").alias("s"))
    tail = parts.groupBy(key, "_b").agg(F.max("_g").alias("resets"), F.max(F.struct("_g", "s")).getField("s").alias("tail"))
    order_b = W.partitionBy(key).orderBy("_b")
    tail = tail.withColumn("_epoch", F.sum((c("resets") > 0).cast("int")).over(order_b.rowsBetween(W.unboundedPreceding, 0)))
    upto = W.partitionBy(key, "_epoch").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    tail = tail.withColumn("_out", F.sum("tail").over(upto))
    carry = tail.select(key, "_b", F.coalesce(F.lag("_out").over(order_b), F.lit(0)).alias("_in"))
    joined = rows.join(carry, [key, "_b"])
    return joined.withColumn(name, c("_run") + F.when(c("_g") == 0, c("_in")).otherwise(0)).drop("_b", "_r", "_w", "_g", "_run", "_in")


def previous_time(df: DataFrame, key: str, at: str, tie: str, block: Column, name: str) -> DataFrame:
    """Time of the key's previous row, looked up inside a block or from the last earlier block."""
    rows = df.withColumn("_b", block)
    inside = F.lag(at).over(W.partitionBy(key, "_b").orderBy(at, tie))
    last = rows.groupBy(key, "_b").agg(F.max(at).alias("_last"))
    before = last.select(key, "_b", F.lag("_last").over(W.partitionBy(key).orderBy("_b")).alias("_before"))
    return rows.withColumn("_p", inside).join(before, [key, "_b"]).withColumn(name, F.coalesce("_p", "_before")).drop("_b", "_p", "_before")


# --- permissions -----------------------------------------------------------------------------


def active_roles(user_roles: DataFrame, as_of: Column) -> DataFrame:
    return user_roles.filter(c("is_active") & (c("expires_at").isNull() | (c("expires_at") > as_of)))


def role_closure(roles: DataFrame) -> DataFrame:
    """(role_id, ancestor_id): each role with itself and everything it inherits from.

    Known steps are joined to themselves until nothing new is found, so chains may have any length
    (rounds grow with its logarithm) and may run in a circle. ``roles`` is the table of role
    templates: one row per role, never per user.
    """
    reached = roles.select("role_id", c("role_id").alias("ancestor_id")).union(
        roles.filter("parent_role_id is not null").select("role_id", c("parent_role_id").alias("ancestor_id"))).join(
        roles.select(c("role_id").alias("ancestor_id")), "ancestor_id", "left_semi").select("role_id", "ancestor_id").distinct()
    known = reached.count()
    while True:
        further = reached.select("role_id", c("ancestor_id").alias("via")).join(
            reached.select(c("role_id").alias("via"), "ancestor_id"), "via").select("role_id", "ancestor_id").distinct()
        reached = staged(further, "role-closure")
        if (now := reached.count()) == known:
            return reached
        known = now


def user_permissions(active: DataFrame, roles: DataFrame, closure: DataFrame) -> DataFrame:
    """Distinct (user_id, tenant_id, permission) over direct and inherited roles."""
    granted = closure.join(permission_strings(roles).withColumnRenamed("role_id", "ancestor_id"), "ancestor_id").select("role_id", "permission").distinct()
    return active.select("user_id", "tenant_id", "role_id").join(granted, "role_id").select("user_id", "tenant_id", "permission").distinct()


def check_permissions(users: DataFrame, requests: DataFrame, permissions: DataFrame) -> DataFrame:
    """Per request (user_id, resource, action) of a known user: allowed when the user holds the
    exact right, the resource wildcard or the system one."""
    need = F.explode(F.array(F.concat_ws(":", "resource", "action"), F.concat(c("resource"), F.lit(":*")), F.lit("system:*"))).alias("permission")
    asked = requests.join(users.select("user_id"), "user_id", "left_semi").select("user_id", "resource", "action", need)
    hit = permissions.select("user_id", "permission").distinct().withColumn("hit", F.lit(True))
    return asked.join(hit, ["user_id", "permission"], "left").groupBy("user_id", "resource", "action").agg(F.coalesce(F.max("hit"), F.lit(False)).alias("allowed"))


def visible_lines(lines: DataFrame, invoices: DataFrame, users: DataFrame) -> DataFrame:
    """Invoice lines that one of ``users`` may see: those of invoices of the users' tenants."""
    seen = invoices.join(users.select("tenant_id"), "tenant_id", "left_semi").select("invoice_id")
    return lines.join(seen, "invoice_id", "left_semi")


def visible_totals(users: DataFrame, invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Per user the number, sum and first id of the lines the user may see."""
    owned = visible_lines(lines, invoices, users).join(invoices.select("invoice_id", "tenant_id"), "invoice_id")
    sums = owned.groupBy("tenant_id").agg(F.count("*").alias("lines"), F.sum("line_total").alias("total"), F.min("invoice_line_id").alias("first_line"))
    return users.select("user_id", "tenant_id").join(sums, "tenant_id", "left").fillna(0, ["lines", "total"])


# --- compliance ---------------------------------------------------------------------------------


def compliance_metrics(users: DataFrame, as_of: Column) -> DataFrame:
    live = c("auth_status") == "active"
    old = c("password_changed_at").isNull() | (c("password_changed_at") < F.date_sub(as_of, 30))
    sums = users.agg(F.count_if(live).alias("n"), F.count_if(live & c("mfa_enabled")).alias("mfa"), F.count_if(live & ~old).alias("fresh"),
                     F.count_if(live & (c("password_changed_at") > F.date_sub(as_of, 90))).alias("recent"))
    return sums.select(percent(c("mfa"), c("n"), 4).alias("mfa_adoption_percent"), percent(c("fresh"), c("n"), 4).alias("password_age_percent"),
                       percent(c("recent"), c("n"), 4).alias("password_policy_percent"))


def compliance_score(values: DataFrame) -> DataFrame:
    """Mean of (name, value, flag): percent names keep their value, flags count 100 or 0."""
    score = F.when(c("flag").isNotNull(), F.when(c("flag"), 100.0).otherwise(0.0)).when(F.contains(c("name"), F.lit("percent")), c("value"))
    return values.agg(round_half_up(F.avg(score), 4).alias("score"))


def alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules whose metric crosses the threshold."""
    v, t, op = c("value"), c("threshold"), c("op")
    hit = (F.when(op == ">", v > t).when(op == "<", v < t).when(op == ">=", v >= t).when(op == "<=", v <= t).when(op == "==", v == t))
    return metrics.join(F.broadcast(rules), "metric").filter(hit).select("rule_name", "metric", "level", "value", "threshold")


def hygiene_findings(users: DataFrame, attempts: DataFrame, default_accounts: DataFrame, as_of: Column, old_limit: int = 10000, old_days: int = 90) -> DataFrame:
    """(title, risk_level, category, affected) findings over the user and attempt tables."""
    live = c("auth_status") == "active"
    known = users.join(F.broadcast(default_accounts), "email", "left_semi").select(
        F.lit("Default Account Found").alias("title"), F.lit("high").alias("risk_level"), F.lit("Authentication").alias("category"), F.lit(1).cast("bigint").alias("affected"))
    sums = users.agg(F.count_if(live & ~c("mfa_enabled")).alias("a"), F.count_if(live & c("password_changed_at").isNull()).alias("b"),
                     F.count_if(live & (c("last_login") < as_of - F.expr("interval 30 days"))).alias("s"))
    found = F.array(
        F.struct(F.lit("Users Without MFA").alias("title"), F.lit("medium").alias("risk_level"), F.lit("Authentication").alias("category"), c("a").alias("affected")),
        F.struct(F.lit("Users Never Changed Password").alias("title"), F.lit("low").alias("risk_level"), F.lit("Authentication").alias("category"), c("b").alias("affected")),
        F.struct(F.lit("Stale User Sessions").alias("title"), F.lit("low").alias("risk_level"), F.lit("Session Management").alias("category"), c("s").alias("affected")))
    rest = sums.select(F.explode(found).alias("x")).select("x.*").filter(c("affected") > 0)
    old = attempts.agg(F.count_if(c("attempted_at") < as_of - F.make_dt_interval(F.lit(old_days))).alias("affected")).filter(c("affected") > old_limit).select(
        F.lit("Excessive Old Audit Logs").alias("title"), F.lit("low").alias("risk_level"), F.lit("Audit Security").alias("category"), "affected")
    return known.unionByName(rest).unionByName(old)


def findings_report(findings: DataFrame, weights: DataFrame) -> DataFrame:
    """(section, label, findings, security_score): all findings with the score, and the number of
    findings by risk level (each level of ``weights``, also without any) and by category."""
    rated = findings.join(weights, "risk_level")
    sums = rated.agg(F.count("*").alias("findings"), F.sum("weight").alias("w"))
    score = F.greatest(F.lit(0.0), 100.0 - F.try_divide(c("w").cast("double"), c("findings") * 25.0) * 100.0)
    total = sums.select(F.lit("total").alias("section"), F.lit("all").alias("label"), "findings", F.coalesce(round_half_up(score, 4), F.lit(100.0)).alias("security_score"))
    none = F.lit(None).cast("double").alias("security_score")
    levels = weights.join(findings.select("risk_level", "title"), "risk_level", "left").groupBy("risk_level").agg(F.count("title").alias("findings"))
    by_level = levels.select(F.lit("risk").alias("section"), c("risk_level").alias("label"), "findings", none)
    by_category = findings.groupBy("category").agg(F.count("*").alias("findings")).select(F.lit("category").alias("section"), c("category").alias("label"), "findings", none)
    return total.unionByName(by_level).unionByName(by_category)


def blocked_flags(events: DataFrame, key: str, at: str, block_start: Column, seconds: int) -> DataFrame:
    """Flag events that fall into an earlier block of their key lasting ``seconds``.

    Only the latest earlier block start matters. It lies in the event's own time block or
    the one before, so each block start is copied to the next block and no join on the key
    is needed.
    """
    micros = F.unix_micros(c(at).cast("timestamp"))
    width = seconds * 1000000
    rows = events.withColumn("_m", micros).withColumn("_s", F.when(block_start.isNotNull(), micros))
    own = rows.withColumn("_own", F.lit(True)).withColumn("_b", F.floor(c("_m") / width))
    spill = own.filter(c("_s").isNotNull()).withColumn("_own", F.lit(False)).withColumn("_b", c("_b") + 1)
    w = W.partitionBy(key, "_b").orderBy("_m").rangeBetween(-width, -1)
    return own.unionByName(spill).withColumn("blocked", F.max("_s").over(w).isNotNull()).filter("_own").drop("_m", "_s", "_own", "_b")


def device_lists(attempts: DataFrame, key: str, as_of: Column, keep: int = 10) -> DataFrame:
    """The last ``keep`` attempts of devices seen in the last day.

    The list is forgotten after a day without attempts, so only attempts since the last
    such gap count.
    """
    day = F.expr("interval 24 hours")
    seen = previous_time(attempts, key, "attempted_at", "attempt_id", F.date_trunc("DAY", c("attempted_at")), "_previous")
    fresh = c("_previous").isNull() | (c("attempted_at") - c("_previous") >= day)
    spans = seen.groupBy(key).agg(F.max("attempted_at").alias("_last"), F.max(F.when(fresh, c("attempted_at"))).alias("_reset"))
    live = attempts.join(spans.filter(c("_last") > as_of - day), key).filter(c("attempted_at") >= c("_reset")).drop("_last", "_reset")
    return last_n(live, [key], [F.desc("attempted_at"), F.desc("attempt_id")], keep)
