"""Operators of the design notes against plain versions and on hand-made cases."""

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerlink.functions import jaro
from ledgerlink.operators import audit_chain, features, lake, retention
from ledgerlink.operators.sync import SyncedTable
from ledgerlink.plans.catalog import QUERIES
from ledgerlink.session import scratch_path
from ledgerlink.sources.entities import Entities
from ledgerlink.streaming import anomalies

c = F.col

# --- audit chains -------------------------------------------------------------------------

FIELDS, ORDER = ("id", "owner", "note", "at"), ("at", "id")


def digest(row):
    kept = {k: str(row[k]) for k in sorted(FIELDS) if row[k] is not None}
    return hashlib.sha256(json.dumps(kept, separators=(",", ":")).encode()).hexdigest()


def chain(spark, rows):
    frame = spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows], "id long, owner string, note string, at long")
    return audit_chain.sealed(frame, "owner", ORDER, F.floor(c("at") / 10), FIELDS)


def breaks(spark, rows, heads):
    log = spark.createDataFrame(rows, "owner string, id long, note string, at long, record_hash string, previous_record_hash string")
    found = audit_chain.broken_records(log, heads, "owner", "id", ORDER, F.floor(c("at") / 10), FIELDS)
    return sorted((r["id"], r["reason"]) for r in found.collect())


@pytest.fixture(scope="module")
def log(spark):
    """Two chains over several blocks, with quiet blocks, equal times and a null field."""
    rng = random.Random(3)
    rows = [{"id": k, "owner": "ab"[k % 2], "note": rng.choice(["x", "y", None]), "at": rng.choice([0, 1, 25, 26, 40, 41, 42, 99])} for k in range(30)]
    frame = chain(spark, rows)
    heads = spark.createDataFrame(audit_chain.heads(frame, "owner", ORDER).collect())
    got = sorted((r.asDict() for r in frame.collect()), key=lambda r: (r["owner"], r["at"], r["id"]))
    return got, heads


def test_chain_is_sealed(log):
    rows, heads = log
    last = {}
    for row in rows:
        assert row["record_hash"] == digest(row) and row["previous_record_hash"] == last.get(row["owner"])
        last[row["owner"]] = row["record_hash"]
    assert {r["owner"]: (r["head"], r["records"]) for r in heads.collect()} == {k: (v, 15) for k, v in last.items()}


def test_chain_breaks(spark, log):
    rows, heads = log
    mine = [i for i, r in enumerate(rows) if r["owner"] == "a"]
    at = lambda k: rows[mine[k]]
    assert breaks(spark, rows, heads) == []
    edited = [dict(r, note="z") if r is at(4) else r for r in rows]
    assert breaks(spark, edited, heads) == [(at(4)["id"], "content")]
    anew = dict(at(4), note="z")
    anew["record_hash"] = digest(anew)
    assert breaks(spark, [anew if r is at(4) else r for r in rows], heads) == [(at(5)["id"], "predecessor")]
    assert breaks(spark, [r for r in rows if r is not at(4)], heads) == [(at(5)["id"], "predecessor")]
    assert breaks(spark, [r for r in rows if r is not at(0)], heads) == [(at(1)["id"], "predecessor")]
    assert breaks(spark, [r for r in rows if r is not at(14)], heads) == [(at(13)["id"], "tail")]
    swapped = [dict(r, previous_record_hash=at(7)["previous_record_hash"], record_hash=at(7)["record_hash"]) if r is at(6) else
               dict(r, previous_record_hash=at(6)["previous_record_hash"], record_hash=at(6)["record_hash"]) if r is at(7) else r for r in rows]
    assert breaks(spark, swapped, heads) == sorted([(at(6)["id"], "content"), (at(7)["id"], "content"), (at(6)["id"], "order"), (at(7)["id"], "order"), (at(8)["id"], "order")])
    assert breaks(spark, [], heads) == []


def test_chain_status_of_a_lost_log(spark, log):
    rows, heads = log
    kept = spark.createDataFrame([r for r in rows if r["owner"] == "a"], "owner string, id long, note string, at long, record_hash string, previous_record_hash string")
    broken = audit_chain.broken_records(kept, heads, "owner", "id", ORDER, F.floor(c("at") / 10), FIELDS)
    found = {r["owner"]: (r["total_records"], r["verification_status"]) for r in audit_chain.chain_status(kept, broken, heads, "owner").collect()}
    assert found == {"a": (15, "VERIFIED_INTACT"), "b": (0, "INTEGRITY_COMPROMISED")}


# --- incremental sync -----------------------------------------------------------------------

FEED = "tenant int, id string, system string, amount int, at timestamp_ntz, version int"


def day(n, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hour)


def synced(spark, lookback="3 days"):
    return SyncedTable(spark, scratch_path(spark, "synced"), ["tenant", "id", "system"], "system", ["at", "version"], lookback)


def feed(spark, rows):
    return spark.createDataFrame(rows, FEED)


def content(table):
    return sorted(tuple(r[k] for k in ("tenant", "id", "system", "amount", "at", "version")) for r in table.rows().collect())


def newest(rows):
    best = {}
    for r in rows:
        if r[:3] not in best or (r[4], r[5]) > (best[r[:3]][4], best[r[:3]][5]):
            best[r[:3]] = r
    return sorted(best.values())


def test_runs_equal_one_full_run(spark):
    rng = random.Random(8)
    rows = [(rng.randint(1, 2), f"k{rng.randint(0, 25)}", rng.choice(["q", "x"]), n, day(rng.randint(0, 29), rng.randint(0, 23)), n) for n in range(150)]
    # Each update arrives on its day or, late, up to two days after.
    arrive = [(r, (r[4] - day(0)).days + rng.randint(0, 2)) for r in rows]
    table = synced(spark)
    for upto in (9, 10, 20, 33):
        seen = [r for r, d in arrive if d <= upto]
        table.sync(feed(spark, seen))
        assert content(table) == newest(seen)
        before = table.last_run()
        assert table.sync(feed(spark, seen)) is False and table.last_run() == before
        if upto == 10:
            table.compact()
            assert content(table) == newest(seen)
    assert content(table) == newest(rows)


def test_run_that_dies_leaves_nothing(spark):
    table = synced(spark)
    first = [(1, "a", "q", 1, day(1), 1)]
    with pytest.raises(RuntimeError):
        table.sync(feed(spark, first), fail_before_commit=True)
    assert table.last_run() == 0 and table.rows() is None and table.runs() is None
    assert table.sync(feed(spark, first)) and content(table) == first
    more = first + [(1, "a", "q", 2, day(2), 2), (1, "b", "x", 3, day(1), 1)]
    with pytest.raises(RuntimeError):
        table.sync(feed(spark, more), fail_before_commit=True)
    assert table.last_run() == 1 and content(table) == first
    assert table.sync(feed(spark, more + [(2, "z", "q", 9, day(2), 1)])) and content(table) == sorted([more[1], more[2], (2, "z", "q", 9, day(2), 1)])
    assert sorted((r["run"], r["system"], r["cursor"], r["inserted"], r["updated"]) for r in table.runs().collect()) == [
        (1, "q", day(1), 1, 0), (2, "q", day(2), 1, 1), (2, "x", day(1), 1, 0)]


def test_sync_of_nothing_and_of_late_rows(spark):
    table = synced(spark)
    assert table.sync(feed(spark, [])) is False and table.rows() is None
    assert table.sync(feed(spark, [(1, "a", "q", 1, day(20), 1)]))
    assert table.sync(feed(spark, [(1, "b", "q", 1, day(18), 1)])) and table.sync(feed(spark, [(1, "c", "q", 1, day(17), 1)])) is False
    assert [r[1] for r in content(table)] == ["a", "b"]


# --- anomaly stream --------------------------------------------------------------------------


def test_scores():
    assert anomalies.score_of(5, 9, 9, 9) == 0.0 and anomalies.score_of(5, 12, 12, 12) == 0.0
    assert anomalies.score_of(100, 10, 55, 385) == 1.0 and anomalies.score_of(5, 10, 55, 385) == 0.034816


def test_flags_are_raised(spark, sf_dir):
    found = QUERIES["x16_event_anomalies"].run(spark, sf_dir)
    assert 0 < found.filter("flagged").count() < found.count() / 10


# --- lake and retention --------------------------------------------------------------------


def scans(df):
    """Text of the plan's scans and the number of files they read."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan, len(df.inputFiles())


def test_reads_are_pruned(spark, tmp_path):
    rows = spark.range(4000).select((c("id") % 3).cast("int").alias("tenant_id"), c("id").alias("invoice_id"), (c("id") % 7).alias("vendor_id"),
                                    F.date_add(F.lit("1998-01-01").cast("date"), (c("id") % 120).cast("int")).alias("day_of"))
    path = lake.write(lake.with_calendar(rows, c("day_of")).drop("day"), "invoices", str(tmp_path))
    slice_ = lake.read(spark, "invoices", str(tmp_path)).filter((c("year") == 1998) & (c("month") == 2) & (c("tenant_id") == 1))
    plan, _ = scans(slice_)
    assert "PartitionFilters: [isnotnull(year" in plan and "(month" in plan and "(tenant_id" in plan
    files = {r[0] for r in slice_.select(F.input_file_name()).distinct().collect()}
    assert len(files) == 1 and all("year=1998/month=2/tenant_id=1" in f for f in files) and len(spark.read.parquet(path).inputFiles()) == 12
    assert slice_.count() == rows.filter("month(day_of) = 2 and tenant_id = 1").count()
    assert all(f.split("/")[-1].endswith(".snappy.parquet") for f in files)


def test_write_replaces_only_what_it_touches(spark, tmp_path):
    def rows(month, amount, n):
        return spark.range(n).select(F.lit(1998).alias("year"), F.lit(month).alias("month"), F.lit(1).alias("tenant_id"), c("id").alias("invoice_id"), F.lit(2).alias("vendor_id"), F.lit(amount).alias("amount"))

    lake.write(rows(1, 10, 5).union(rows(2, 10, 5)), "invoices", str(tmp_path))
    lake.write(rows(2, 20, 3), "invoices", str(tmp_path))
    got = {(r["month"], r["amount"]): r["count"] for r in lake.read(spark, "invoices", str(tmp_path)).groupBy("month", "amount").count().collect()}
    assert got == {(1, 10): 5, (2, 20): 3}


@pytest.mark.parametrize("limit, kept", [("2024-01-01 00:00:00", 12), ("2024-01-02 06:00:00", 7), ("2024-01-03 00:00:00", 6), ("2024-01-03 23:00:00", 3), ("2024-02-01 00:00:00", 1)])
def test_expire(spark, tmp_path, limit, kept):
    """Twelve rows, three a day at 0, 5 and 10 o'clock, from the first to the third; two later, one without a time."""
    rows = [(d * 3 + k, dt.datetime(2024, 1, 1 + d, 5 * k)) for d in range(3) for k in range(3)] + [(90, dt.datetime(2024, 1, 9)), (91, dt.datetime(2024, 1, 9)), (92, None)]
    path = f"{tmp_path}/t"
    retention.write_by_day(spark.createDataFrame(rows, "id int, at timestamp_ntz"), "at", path)
    bound = dt.datetime.fromisoformat(limit)
    want = sorted(i for i, at in rows if at is None or at >= bound)
    for _ in range(2):
        retention.expire(spark, path, "at", F.lit(limit).cast("timestamp_ntz"))
        assert sorted(r["id"] for r in retention.read_by_day(spark, path).collect()) == want
    assert len(want) == kept


def test_pseudonyms_keep_joins(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "who string, n int").withColumn("t", retention.pseudonym(c("who"), "s"))
    got = {r["n"]: r["t"] for r in rows.collect()}
    assert got[1] == got[2] == hashlib.sha256(b"s:a").hexdigest() != got[3] and got[4] is None
    assert rows.select(retention.pseudonym(c("who"), "other")).first()[0] != got[1]


# --- names -------------------------------------------------------------------------------------


def plain_matches(a, b):
    reach, used, kept = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(i + reach + 1, len(b))):
            if j not in used and b[j] == ch:
                used.add(j)
                kept.append(ch)
                break
    return len(kept), sum(x != b[j] for x, j in zip(kept, sorted(used)))


def test_jaro_against_plain_version():
    rng = random.Random(4)
    for _ in range(1500):
        a, b = ("".join(rng.choices("ab cü#", k=rng.choice([0, 1, 2, 5, 9, 20, 63, 64, 65, 90]))) for _ in "xy")
        if rng.random() < 0.5:
            b = "".join(rng.sample(a, len(a)))
        assert jaro.matched_long(a, b) == plain_matches(a, b)
        if max(len(a), len(b)) <= jaro.WORD:
            assert tuple(int(x[0]) for x in jaro.matched([a], [b])) == plain_matches(a, b)


def test_jaro_of_edge_cases(spark):
    rows = spark.createDataFrame([("MARTHA", "MARHTA"), ("", ""), ("a", ""), (None, "a"), ("abc", "abc"), ("abcdef", "bcaxyz")], "a string, b string")
    got = [(r["s"]["jaro"], r["s"]["winkler"], r["t"]["jaro"]) for r in rows.select(jaro.jaro_similarities(c("a"), c("b")).alias("s"), jaro.jaro_similarities(c("a"), c("b"), True).alias("t")).collect()]
    assert [round(x, 6) for x in got[0]] == [0.944444, 0.961111, 0.944444]
    assert got[1] == (0.0, 1.0, 0.0) and got[2] == (0.0, 0.0, 0.0) and got[3] == (None, None, None) and got[4] == (1.0, 1.0, 1.0)
    assert round(got[5][0], 6) == 0.5 and got[5][2] > got[5][0]  # three characters out of order: one and a half against one


# --- features --------------------------------------------------------------------------------------


def test_no_feature_sees_later_facts(spark):
    """Facts on or after a row's day change nothing in it."""
    day_ = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    rng = random.Random(2)
    invoices = [(1, k, rng.randint(1, 3), f"INV-{k}", day_(rng.randint(0, 80)), rng.randint(1, 5000)) for k in range(120)]
    results = [(k, k, rng.choice(["matched", "failed"]), rng.choice(["auto_approved", "pending"]), rng.choice([None, 5, 9]), 50, dt.datetime(2024, 5, rng.randint(1, 20), 4)) for k in range(120)]

    def rows(invoices, results):
        i = spark.createDataFrame(invoices, "tenant_id int, invoice_id long, vendor_id long, invoice_number string, invoice_date date, total_amount int")
        r = spark.createDataFrame(results, "match_result_id long, invoice_id long, match_status string, approval_status string, processing_time_ms int, overall_confidence int, created_at timestamp_ntz")
        lines = i.select("invoice_id")
        return {x["match_result_id"]: x for x in features.training_rows(r, i, lines).collect()}

    whole = rows(invoices, results)
    cut = day_(45)
    early = [i for i in invoices if i[4] <= cut]
    small = rows(early, results)
    names = ["vendor_frequency", "average_amount", "days_since_last", "amount_percentile"]
    for i in early:
        assert [small[i[1]][n] for n in names] == [whole[i[1]][n] for n in names]
        before = [x for x in invoices if x[2] == i[2] and x[4] < i[4]]
        last_month = [x[5] for x in invoices if x[4].month == i[4].month - 1]
        assert whole[i[1]]["vendor_frequency"] == len(before)
        assert whole[i[1]]["amount_percentile"] == (round(sum(a < i[5] for a in last_month) / len(last_month) + 1e-12, 6) if last_month else None)
    first = rows(invoices, [r for r in results if r[6].day <= 10])
    for r in results:
        if r[6].day <= 10:
            assert [first[r[0]][n] for n in ("approval_rate_history", "processing_time_avg")] == [whole[r[0]][n] for n in ("approval_rate_history", "processing_time_avg")]
    assert {(x["vendor_id"], x["split"]) for x in whole.values()} == {(v, s) for v, s in {x["vendor_id"]: x["split"] for x in whole.values()}.items()}


# --- tiers ------------------------------------------------------------------------------------------


def test_every_invoice_has_one_tier(spark, sf_dir):
    found = QUERIES["x20_tiered_match"].run(spark, sf_dir)
    counts = {r["tier"]: r["count"] for r in found.groupBy("tier").count().collect()}
    invoices = Entities(spark, sf_dir).invoices.count()
    assert found.select("invoice_id").distinct().count() == sum(counts.values()) == invoices and set(counts) == {"exact", "fuzzy", "tolerance", "exception"}
    assert sum(r["invoices"] for r in QUERIES["x20_tier_summary"].run(spark, sf_dir).collect()) == invoices
