"""Operators against brute force on small inputs, and invariants of the runs."""

import datetime as dt
import math
import random
import re
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlink.functions import fuzzy, scores
from ledgerlink.operators import candidates, changes, match, names, security, vendors
from ledgerlink.plans.catalog import QUERIES
from ledgerlink.sources import csv_files, entities as entities_module
from ledgerlink.sources.entities import Entities, StoredEntities
from ledgerlink.streaming.limits import rate_limit

c = F.col


@pytest.fixture(scope="module")
def entities(spark, sf_dir):
    return Entities(spark, sf_dir)


def _documents(spark, n=300, vendors_=3, seed=5):
    rnd = random.Random(seed)
    day = dt.date(2020, 1, 1)
    inv = [(0, i, rnd.randrange(vendors_), day + dt.timedelta(days=rnd.randrange(90)), Decimal(rnd.randrange(90, 130))) for i in range(n)]
    po = [(0, i, rnd.randrange(vendors_), day + dt.timedelta(days=rnd.randrange(90)), Decimal(rnd.randrange(90, 130)), "approved") for i in range(n)]
    return (spark.createDataFrame(inv, "tenant_id int, invoice_id bigint, vendor_id bigint, invoice_date date, total_amount decimal(15,2)"),
            spark.createDataFrame(po, "tenant_id int, po_id bigint, vendor_id bigint, po_date date, total_amount decimal(15,2), status string"), inv, po)


def test_nearest_amount_equals_brute_force(spark):
    inv, po, li, lp = _documents(spark)
    want = {}
    for _, i, v, d, t in li:
        near = [(abs(pt - t), p) for _, p, pv, pd_, pt, _ in lp if pv == v and -30 <= (pd_ - d).days <= 7 and t * Decimal("0.9") <= pt <= t * Decimal("1.1")]
        if near:
            want[i] = min(near)[1]
    assert dict(candidates.nearest_amount(inv, po).collect()) == want


def test_nearest_by_date_equals_brute_force(spark):
    inv, po, li, lp = _documents(spark)
    got = candidates.nearest_by_date(inv, po, ["tenant_id", "vendor_id"], "invoice_date", "po_date", "po_id", 4).collect()
    found = {}
    for r in got:
        found.setdefault((r.vendor_id, r.invoice_date), {})[r.place] = r.po_id
    for _, _, v, d, _ in li:
        best = sorted((abs((pd_ - d).days), p) for _, p, pv, pd_, _, _ in lp if pv == v)[:4]
        assert found[(v, d)] == {n + 1: p for n, (_, p) in enumerate(best)}


def test_receipt_lists_are_one_row_per_invoice(spark):
    """Days with more receipts than are kept, receipts that come twice, and missing keys, ids and days."""
    rnd, day = random.Random(8), dt.date(2020, 1, 1)
    inv = [(0, i, rnd.choice([0, 1, None]), day + dt.timedelta(days=rnd.randrange(40))) for i in range(60)]
    some = [(0, rnd.choice([0, 1, None]), i, i // 2, day + dt.timedelta(days=rnd.choice([3, 3, 3, rnd.randrange(40)])), "accepted" if i % 5 else "pending") for i in range(50)]
    rec = [*some, *some[:8], (0, 0, None, 7, day + dt.timedelta(days=20), "accepted"), (None, 0, 99, 7, day, "accepted")]
    invoices = spark.createDataFrame(inv, "tenant_id int, invoice_id bigint, vendor_id bigint, invoice_date date")
    receipts = spark.createDataFrame(rec, "tenant_id int, vendor_id bigint, receipt_id bigint, po_id bigint, receipt_date date, status string")
    got = {r.invoice_id: [x.id for x in r.near] for r in candidates.receipt_lists(invoices, receipts, 4).collect()}
    first = lambda x: -1 if x is None else x
    want = {i: [r for _, _, r in sorted((abs((rd - d).days), first(r), r) for t, rv, r, _, rd, s in rec if t == 0 and rv == v and s == "accepted")[:4]] for _, i, v, d in inv if v is not None}
    assert got == want
    pairs = invoices.select("invoice_id", "invoice_date").crossJoin(spark.range(25).withColumnRenamed("id", "po_id"))
    triples = match.band_triples(pairs, invoices, receipts, 4).select("invoice_id", "po_id", "receipt_id", "receipt_place").collect()
    slow = [(i, p, r, n + 1) for i, near in got.items() for n, r in enumerate(near) for _, _, rr, p, _, _ in rec if r is not None and rr == r]
    assert Counter(map(tuple, triples)) == Counter(slow)


def test_band_pairs_join_names_to_documents(spark):
    """Pairs are dealt by invoice and order only and carry no names; vendors may be missing, nameless or come twice."""
    inv, po, li, lp = _documents(spark, 60, 5)
    named = [(0, "acme"), (1, "acne"), (1, "acme"), (2, None), (None, "x")]
    owners = spark.createDataFrame(named, "vendor_id bigint, normalized_name string")
    met = [(i, (i * 7 + k) % 60, k) for i in range(60) for k in (1, 2)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = match.band_pairs(inv, po, owners, spark.createDataFrame(met, "invoice_id bigint, po_id bigint, place int"))
        dealt, got = _shuffled_by(pairs), pairs.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    name = lambda v: [n for o, n in named if o == v] or [None]
    want = Counter((i, p, k, None if a is None or b is None else 100.0 if a == b else 75.0) for i, p, k in met for a in name(li[i][2]) for b in name(lp[p][2]))
    assert Counter((r.invoice_id, r.po_id, r.place, r.vendor_score) for r in got if None not in name(li[r.invoice_id][2]) + name(lp[r.po_id][2])) == Counter({k: n for k, n in want.items() if None not in name(li[k[0]][2]) + name(lp[k[1]][2])})
    assert len(got) == sum(want.values()) and not [x for x in pairs.columns if x.endswith("norm")]
    assert dealt.count("vendor_id") == 4 and not [keys for keys in dealt if "vendor_id" in keys and keys != "vendor_id"]


def test_fuzzy_candidates_lose_nothing(spark, entities):
    inv, po = entities.invoices.filter("invoice_id % 5 = 0"), entities.purchase_orders
    fast = {tuple(r) for r in candidates.fuzzy_candidates(inv, po).select("invoice_id", "po_id").collect()}
    i, p = inv.alias("i"), po.alias("p")
    full = i.join(p, (c("i.tenant_id") == c("p.tenant_id")) & c("p.po_date").between(F.date_sub("i.invoice_date", 30), F.date_add("i.invoice_date", 7)) & (c("p.status") != "archived"))
    a, b = c("i.total_amount"), c("p.total_amount")
    gap = scores.day_gap(c("i.invoice_date"), c("p.po_date"))
    reach = 0.4 + scores.unit_amount_score(scores.variance_share(a, b), scores.within_tolerance(a, b, 0.05, 10.0)) * 0.4 + scores.unit_date_score(gap, gap <= 7) * 0.2
    slow = {tuple(r) for r in full.filter(reach >= 0.7 - 0.00005).select("i.invoice_id", "p.po_id").collect()}
    assert fast == slow and fast


def test_pruned_best_equals_full_scoring(spark, entities):
    pairs = candidates.fuzzy_candidates(entities.invoices.filter("invoice_id % 3 = 0"), entities.purchase_orders)
    full = {tuple(r) for r in match.best_candidate(match.fuzzy_scores(pairs, entities.vendors)).select("invoice_id", "po_id", "confidence").collect()}
    quick = {tuple(r) for r in match.best_fuzzy(pairs, entities.vendors).select("invoice_id", "po_id", "confidence").collect()}
    assert full == quick and full


def test_best_lines_equal_all_pairs(spark, entities):
    found = match.find_orders(
        entities.invoices, entities.purchase_orders).filter("invoice_id % 20 = 1")
    fast = {tuple(r) for r in match.best_lines(entities.invoice_lines, entities.po_lines, found).collect()}
    right = entities.po_lines.select("po_id", "po_line_id", c("line_number").alias("n"), c("item_code").alias("p_code"), c("description").alias("p_description"),
                                     c("unit_price").alias("p_price"), c("quantity").alias("p_quantity"))
    every = entities.invoice_lines.join(found, "invoice_id").join(right, "po_id").withColumn("k", match.line_confidence()).filter("k >= 0.7")
    best = every.groupBy("invoice_line_id").agg(F.min(F.struct(-c("k"), c("n"), c("po_line_id"), c("k"))).alias("b"))
    slow = {(r[0], r[1][2], r[1][3]) for r in best.collect()}
    assert fast == slow and fast


def _shuffled_by(df):
    """The keys by which the plan deals rows."""
    return [re.sub(r"#[0-9]+L?", "", keys) for keys in re.findall(r"hashpartitioning\(([^)]*?), [0-9]+\)", df._jdf.queryExecution().executedPlan().toString())]


def test_best_lines_deal_lines_by_order_once(spark):
    """Lines without code, order or words, and equal lines; no line is shuffled once per key."""
    rnd = random.Random(4)
    pick = lambda *x: rnd.choice(x)
    line = lambda i: (i, pick("A1", "a1 ", "B2", "", None), pick("red pipe", "Pipe red", "red  pipe red", "bolt", "", None), pick(Decimal(1), Decimal(2), Decimal(0)), pick(Decimal(3), Decimal(4)))
    fields = "item_code string, description string, unit_price decimal(15,4), quantity decimal(15,4)"
    il = spark.createDataFrame([(pick(1, 2, 3, None), *line(i)) for i in range(60)], "invoice_id bigint, invoice_line_id bigint, " + fields)
    pl = spark.createDataFrame([(pick(1, 2, None), i % 7, *line(i)) for i in range(60)], "po_id bigint, line_number int, po_line_id bigint, " + fields)
    found = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 1), (None, 1)], "invoice_id bigint, po_id bigint")
    fast = match.best_lines(il, pl, found)
    right = pl.select("po_id", "po_line_id", c("line_number").alias("n"), c("item_code").alias("p_code"), c("description").alias("p_description"), c("unit_price").alias("p_price"), c("quantity").alias("p_quantity"))
    best = il.join(found, "invoice_id").join(right, "po_id").withColumn("k", match.line_confidence()).filter("k >= 0.7").groupBy("invoice_line_id").agg(F.min(F.struct(-c("k"), c("n"), c("po_line_id"), c("k"))).alias("b")).collect()
    assert {tuple(r) for r in fast.collect()} == {(r[0], r[1][2], r[1][3]) for r in best} != set()
    assert not [keys for keys in _shuffled_by(fast) if "key" in keys]


def test_line_matches_deal_lines_by_order_once(spark):
    """Equal to best lines, order lines and receipt totals joined one after the other; documents and
    lines may come twice, and codes, orders, amounts and receipts may be missing."""
    rnd = random.Random(9)
    pick = lambda *x: rnd.choice(x)
    twice = lambda rows: rows + rows[::4]
    line = lambda: (pick("A1", "a1 ", "B2", "", None), pick("red pipe", "Pipe red", "red  pipe red", "bolt", None), pick(Decimal(1), Decimal(2), Decimal(0), None), pick(Decimal(3), Decimal(4), Decimal(0)), pick(Decimal(6), Decimal(8), None))
    fields = "item_code string, description string, unit_price decimal(15,4), quantity decimal(15,4), line_total decimal(15,2)"
    il = spark.createDataFrame(twice([(pick(1, 2, 3, 4, 5, None), i, *line()) for i in range(60)]), "invoice_id bigint, invoice_line_id bigint, " + fields)
    pl = spark.createDataFrame(twice([(pick(1, 2, 3, None), i % 7, i, *line()) for i in range(60)]), "po_id bigint, line_number int, po_line_id bigint, " + fields)
    matched = spark.createDataFrame(twice([(1, 1), (2, 2), (3, 2), (4, 3), (5, None), (None, 1)]), "invoice_id bigint, po_id bigint")
    day = dt.date(2020, 1, 1)
    of = spark.createDataFrame(twice([(i, 1 if i == 1 else 2, r, day + dt.timedelta(days=r % 3)) for i, r in ((1, 7), (1, 8), (2, 9), (3, 9), (2, 7))]), "invoice_id bigint, po_id bigint, receipt_id bigint, receipt_date date")
    rl = spark.createDataFrame(twice([(pick(7, 8, 9, None), 100 + i, pick(*range(60), None), pick(Decimal(0), Decimal(3), None), Decimal(5)) for i in range(200)]),
                               "receipt_id bigint, receipt_line_id bigint, po_line_id bigint, quantity_received decimal(15,4), line_value decimal(15,2)")
    fast = match.line_matches(il, pl, matched, of, rl)
    totals = match.receipt_totals(of, rl)
    slow = (il.join(matched.select("invoice_id"), "invoice_id", "left_semi").select("invoice_id", "invoice_line_id", "quantity", "line_total")
            .join(match.best_lines(il, pl, matched), "invoice_line_id", "left")
            .join(pl.select("po_line_id", c("quantity").alias("po_quantity"), c("line_total").alias("po_amount")), "po_line_id", "left").join(totals, ["invoice_id", "po_line_id"], "left").collect())
    off = lambda x, y: None if x is None or y is None else 1.0 if y == 0 else abs(float(x) - float(y)) / float(y)
    want = Counter((r.invoice_id, r.invoice_line_id, r.po_line_id, r.receipt_line_id, r.po_line_id is not None, r.confidence or 0.0,
                    off(r.received_quantity if (r.received_quantity or 0) > 0 else r.quantity, r.po_quantity) if r.po_line_id is not None else 1.0,
                    (1.0 if r.po_amount == 0 else off(r.line_total, r.po_amount)) if r.po_line_id is not None else 1.0) for r in slow)
    got = fast.collect()
    assert Counter(tuple(r)[:8] for r in got) == want and sum(r.is_matched for r in got) > 20 and any(r.receipt_line_id for r in got)
    assert not [keys for keys in _shuffled_by(fast) if "line" in keys]


def test_nearest_amount_deals_cells_not_days(spark):
    inv, po, _, _ = _documents(spark)
    dealt = _shuffled_by(candidates.nearest_amount(inv, po))
    assert "tenant_id, vendor_id, cell" in dealt and "tenant_id, vendor_id, po_date" not in dealt


def test_tfidf_texts_are_spread_over_tasks(spark):
    some = [(0, f"supplier {i:03d}") for i in range(60)]
    corpus = spark.createDataFrame(some, "tenant_id int, name string")
    pairs = spark.createDataFrame([(0, f"supplier {i:03d} inc", f"supplier {i:03d}") for i in range(60)], "tenant_id int, text string, candidate string")
    found = names.tfidf_match(pairs, corpus, texts_per_task=5)
    dealt = re.findall(r"hashpartitioning\(tenant_id#\d+, text#\d+, (\d+)\), REPARTITION_BY_NUM", found._jdf.queryExecution().executedPlan().toString())
    assert "12" in dealt
    assert sorted(found.collect()) == sorted(names.tfidf_match(pairs, corpus, texts_per_task=1000).collect()) and found.filter("score > 0").count() == 60


def _similar(a, b):
    return 60.0 * (1 - levenshtein(a[2], b[2]) / max(len(a[2]), len(b[2]))) + (20.0 if a[3] and b[3] and a[3].lower() == b[3].lower() else 0) + (
        10.0 if a[4] and b[4] and digits(a[4]) == digits(b[4]) else 0) + (10.0 if a[5] and a[5] == b[5] else 0)


def digits(s):
    return "".join(x for x in s if x.isdigit())


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_duplicate_pairs_and_leaders_equal_brute_force(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(80):
        k = rnd.randrange(12)
        rows.append((0, i, f"VENDOR {'AB'[k % 2]}{k // rnd.choice([1, 2, 3])}", rnd.choice([f"m{k}@x.y", f"M{k}@x.y", None]), rnd.choice([f"+1 {k}", None]), rnd.choice([f"T{k}", None])))
    df = spark.createDataFrame(rows, "tenant_id int, vendor_id bigint, normalized_name string, email string, phone string, tax_id string")
    pairs = vendors.duplicate_pairs(df)
    near = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and _similar(a, b) >= 80 - 1e-9}
    assert {(r.vendor_id, r.other_id) for r in pairs.collect()} == near
    leader, want = {}, {}
    for r in rows:
        mine = [x for x in leader if (x, r[1]) in near]
        if mine:
            want[r[1]] = min(mine)
        else:
            leader[r[1]] = True
    got = {r.member_id: r.leader_id for r in vendors.leader_groups(pairs, spark).collect()}
    assert got == want
    assert {r.member_id: r.leader_id for r in vendors.duplicate_groups(df, spark).collect()} == want


def test_running_since_reset_equals_a_loop(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(3), i, rnd.randrange(1000), rnd.random() < 0.1) for i in range(400)]
    df = spark.createDataFrame(rows, "key int, id int, at int, reset boolean")
    got = {r.id: r.total for r in security.running_since_reset(df, "key", ["at", "id"], F.floor(c("at") / 50), c("reset"), F.lit(1), "total").collect()}
    run, want = Counter(), {}
    for key, i, _, reset in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        run[key] = 1 if reset else run[key] + 1
        want[i] = run[key]
    assert got == want


def test_rate_limit_equals_a_loop(spark):
    rnd = random.Random(4)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, rnd.choice([1, 1, 1, 2]), base + dt.timedelta(seconds=rnd.randrange(0, 200000, 7))) for i in range(500)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp_ntz")
    got = {r.event_id: (r.allowed, r.remaining) for r in rate_limit(df, 3, 3600, F.date_trunc("DAY", c("ts"))).collect()}
    kept, want = {1: set(), 2: set()}, {}
    for i, user, ts in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        live = {t for t in kept[user] if t > ts - dt.timedelta(hours=1)}
        full = len(live) >= 3
        kept[user] = live - {ts} if full else live | {ts}
        want[i] = (not full, 0 if full else 3 - len(kept[user]))
    assert got == want


def test_stream_and_batch_rate_limits_agree(spark, sf_dir):
    """On the rows that are not too late and that the last watermark has passed."""
    from ledgerlink.sources import arrivals
    from ledgerlink.streaming import limits

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts").filter(~arrivals.late())
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    passed = (events.agg(F.max(micros)).first()[0] // 1000 - 7200000) * 1000
    names_ = ["event_id", "user_id", "allowed", "remaining", "reset_at", "retry_after"]
    batch = {tuple(r) for r in limits.rate_limit(events.filter(micros <= passed), 3, 43200, F.date_trunc("DAY", F.col("ts"))).select(*names_).collect()}
    stream = {tuple(r) for r in QUERIES["t01_rate_limit_stream"].run(spark, sf_dir).select(*names_).collect()}
    assert batch == stream and len(batch) > 900


def test_vendor_codes_are_unique(spark):
    df = spark.createDataFrame([(0, f"Supplier {i}") for i in range(150)] + [(0, "Supp 02"), (0, "A")], "tenant_id int, vendor_name string")
    codes = names.assign_vendor_codes(df)
    taken = {r.vendor_code for r in codes.collect()}
    assert len(taken) >= 151 and "AXX" in taken
    more = names.assign_vendor_codes(spark.createDataFrame([(0, f"Supplied {i}") for i in range(5)], "tenant_id int, vendor_name string"), codes)
    assert not taken & {r.vendor_code for r in more.collect()}


def test_tfidf_equals_all_pairs(spark):
    corpus = ["acme tools", "acme trading", "beta supplies", "beta supply co", "gamma"]
    asked = [("acme tool", "acme tools"), ("acme tool", "acme trading"), ("beta suplies", "beta supplies"), ("zzz", "gamma")]
    grams = lambda s: Counter(f" {w} "[i:i + n] for w in s.split() for n in (2, 3) for i in range(len(w) + 3 - n))
    df = Counter(g for s in corpus for g in grams(s))
    def vec(s):
        v = {g: t * (math.log((len(corpus) + 1) / (df[g] + 1)) + 1) for g, t in grams(s).items() if g in df}
        n = math.sqrt(sum(x * x for x in v.values())) or 1
        return {g: x / n for g, x in v.items()}
    cos = lambda a, b: sum(x * vec(b).get(g, 0) for g, x in vec(a).items())
    want = {p: (cos(*p) if all(cos(p[0], o) <= cos(*p) + 1e-9 for o in corpus) else 0.0) for p in asked}
    pairs = spark.createDataFrame([(0, *p) for p in asked], "tenant_id int, text string, candidate string")
    got = names.tfidf_match(pairs, spark.createDataFrame([(0, s) for s in corpus], "tenant_id int, name string")).collect()
    for r in got:
        assert abs(r.score - want[(r.text, r.candidate)]) < 1e-5


def test_changes_are_idempotent(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, status string, n int")
    edits = spark.createDataFrame([(1, "x", None, 1), (1, "y", 9, 2), (3, "new", 1, 1)], "id int, status string, n int, at int")
    once = changes.apply_changes(base, edits, "id", ["status"], ["at"])
    assert {tuple(r) for r in once.collect()} == {(1, "y", 5), (2, "b", 6), (3, "new", None)}
    twice = changes.apply_changes(once, edits, "id", ["status"], ["at"])
    assert {tuple(r) for r in twice.collect()} == {tuple(r) for r in once.collect()}


def test_one_decision_per_invoice(spark, sf_dir):
    for name in ("r02_band_run", "r07_three_way_run", "r08_two_way_run"):
        df = QUERIES[name].run(spark, sf_dir)
        assert df.count() == df.select("invoice_id").distinct().count()


def test_composite_similarity_of_pairs(spark, entities):
    got = QUERIES["n16_composite_similarity"].run(spark, entities.sf_dir).limit(40).collect()
    for r in got:
        a, b = r.inv_vendor.lower().strip(), r.po_vendor.lower().strip()
        if a == b:
            assert r.score == 1.0
            continue
        tok = lambda s: "".join(x if x.isalnum() else " " for x in s).split()
        s1, s2 = " ".join(sorted(tok(a))), " ".join(sorted(tok(b)))
        shared = " ".join(sorted(set(tok(a)) & set(tok(b))))
        l = (shared + " " + " ".join(sorted(set(tok(a)) - set(tok(b))))).strip()
        m = (shared + " " + " ".join(sorted(set(tok(b)) - set(tok(a))))).strip()
        ratio = fuzzy.percent_ratio
        want = 0.3 * (1 - levenshtein(a, b) / max(len(a), len(b))) + 0.4 * ratio(s1, s2) / 100 + 0.3 * max(ratio(shared, l), ratio(shared, m), ratio(l, m)) / 100
        assert abs(r.score - want) < 1e-5


def test_role_closure_follows_long_chains_and_circles(spark):
    chain = [(k, k + 1 if k < 20 else None) for k in range(21)] + [(30, 31), (31, 30), (40, 99)]
    got = {tuple(r) for r in security.role_closure(spark.createDataFrame(chain, "role_id int, parent_role_id int")).collect()}
    assert got == {(a, b) for a in range(21) for b in range(a, 21)} | {(a, b) for a in (30, 31) for b in (30, 31)} | {(40, 40)}


def test_permission_checks_join_the_requests_that_exist(spark):
    requests = spark.createDataFrame([(1, "invoice", "read"), (1, "invoice", "write"), (2, "po", "read"), (9, "po", "read")], "user_id long, resource string, action string")
    held = spark.createDataFrame([(1, "invoice:read"), (2, "po:*")], "user_id long, permission string")
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    got = {tuple(r) for r in security.check_permissions(users, requests, held).collect()}
    assert got == {(1, "invoice", "read", True), (1, "invoice", "write", False), (2, "po", "read", True)}


def test_best_vendor_equals_all_pairs(spark):
    rnd = random.Random(6)
    stored = ["Microsoft", "Acme Tools Inc", "Tools & More", "Ромашка", "Рассвет", "株式会社", "zz__", "Acme_Trading"]
    stored += ["".join(rnd.choice("abc01 ") for _ in range(rnd.randrange(1, 9))) for _ in range(40)]
    asked = ["Micr0s0ft", "microsft", "Ромашко", "Acne Tool", "Tols", "___", " ", "5UPPLY 80B", "Acme Tools Inc", "株式"]
    asked += ["".join(rnd.choice("abc01 ") for _ in range(rnd.randrange(1, 9))) for _ in range(30)]
    texts = spark.createDataFrame([(0, t) for t in asked] + [(1, "alone"), (0, ""), (0, None), (2, "xyz")], "tenant_id int, text string")
    held = spark.createDataFrame([(0, s) for s in stored] + [(2, "qu"), (0, ""), (0, None)], "tenant_id int, name string")
    pairs = texts.filter("text <> ''").distinct().withColumn("variant", F.explode(fuzzy.ocr_variants(c("text")))).join(held.filter("name <> ''"), "tenant_id")
    scored = pairs.withColumn("k", -fuzzy.similarity(c("variant"), c("name"))).filter("k < 0").groupBy("tenant_id", "text").agg(F.min(F.struct("k", "name")).alias("b"))
    want = {(r[0], r[1]): (r[2][1], -r[2][0]) for r in scored.collect()}
    for sizes in ((256, 2048), (7, 5)):
        got = {(r[0], r[1]): (r[2], r[3]) for r in names.best_vendor(texts, held, *sizes).collect()}
        assert set(got) == {(r[0], r[1]) for r in texts.collect()}
        for key, (match_, score) in got.items():
            name, full = want.get(key, ("", 0.0))
            assert match_ == name and abs(score - full) < 1e-6, key
    assert got[(0, "Micr0s0ft")][0] == "Microsoft" and got[(0, "Ромашко")][0] == "Ромашка" and got[(1, "alone")] == ("", 0.0)


def _metrics(total, decisions):
    mean = sum(r.confidence for r in decisions) / len(decisions)
    kinds = Counter(r.match_type for r in decisions)
    return (total, kinds["exact"], kinds["fuzzy"], total - len(decisions), sum(r.auto_approved for r in decisions),
            sum(r.requires_review for r in decisions)), mean


def test_batch_metrics_count_both_tiers(spark, entities, sf_dir):
    decisions = match.two_way_run(entities.invoices, entities.purchase_orders, entities.vendors).collect()
    want, mean = _metrics(entities.invoices.count(), decisions)
    got = QUERIES["a08_batch_metrics"].run(spark, sf_dir).collect()[0]
    assert tuple(got)[:6] == want and want[2] > 0 and abs(got.average_confidence - mean) < 1e-4
    run = QUERIES["r08_two_way_run"].run(spark, sf_dir)
    left = entities.invoices.join(entities.match_results.filter("approval_status <> 'rejected'").select("invoice_id"), "invoice_id", "left_anti")
    want, mean = _metrics(left.count(), run.collect())
    got = match.batch_metrics(left, run).collect()[0]
    assert tuple(got)[:6] == want and abs(got.average_confidence - mean) < 1e-4


def test_best_only_scores_fewer_references(spark):
    inv, po, _, _ = _documents(spark, 200)
    inv = inv.withColumn("po_reference", F.concat(F.lit("PO0"), c("invoice_id") * 7 % 300))
    po = po.withColumn("po_number", F.concat(F.lit("PO0"), c("po_id")))
    owners = spark.createDataFrame([(0, "Acme Trading"), (1, "Acme Trading Co"), (2, "Miller & Sons")], "vendor_id bigint, name string")
    pairs = candidates.fuzzy_candidates(inv, po)
    every, few = (match.fuzzy_scores(pairs, owners, best_only=x) for x in (False, True))
    assert 0 < few.count() < every.count()
    assert sorted(match.best_candidate(few).collect()) == sorted(match.best_candidate(every).collect())


def test_batches_share_folders_and_are_replaced(spark, tmp_path):
    rows = spark.range(900).select(F.when(c("id") % 300 != 7, c("id") % 300).alias("import_batch_id"), c("id").alias("row_number"), F.lit("a").alias("v"))
    again = rows.filter("(import_batch_id % 2 = 0 or import_batch_id is null) and row_number < 600").withColumn("v", F.lit("b"))
    path = str(tmp_path / "batches")
    vendors.write_batches(rows, path)
    vendors.write_batches(again, path)
    first, second = rows.collect(), again.collect()
    anew = {r.import_batch_id for r in second}
    want = Counter([tuple(r) for r in first if r.import_batch_id not in anew] + [tuple(r) for r in second])
    assert Counter(tuple(r) for r in vendors.read_batches(spark, path).select("import_batch_id", "row_number", "v").collect()) == want
    assert len(list((tmp_path / "batches").glob("*=*"))) <= vendors.FOLDERS


def test_small_files_are_opened_once(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"batch={i}").mkdir()
        (tmp_path / f"batch={i}" / "rows.csv").write_text(f"a,b\n{i},x\n\n{i},y\n")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    lines, rows = csv_files.read_lines(spark, str(tmp_path)), csv_files.read_csv(spark, str(tmp_path), ["a", "b"])
    assert all(f.endswith(".parquet") for f in lines.inputFiles() + rows.inputFiles())
    assert sorted((r.line_number, r.line) for r in lines.collect()) == sorted((n, x) for i in range(3) for n, x in ((1, "a,b"), (2, f"{i},x"), (3, ""), (4, f"{i},y")))
    assert sorted((r.a, r.b, r.row_number) for r in rows.collect()) == sorted((str(i), x, n) for i in range(3) for x, n in (("x", 2), ("y", 3)))
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before


def _driver_tables(spark, path, orders=40):
    """Small driver tables with invented rows: order o has lines of the supplier o % 3."""
    rnd, day = random.Random(3), dt.datetime(1998, 1, 1)
    tables = {
        "nation": ([(n, f"N{n}") for n in range(4)], "n_nationkey int, n_name string"),
        "supplier": ([(s, f"Supplier#{s:09d}", s % 4) for s in range(3)], "s_suppkey bigint, s_name string, s_nationkey int"),
        "part": ([(p, f"part {p}", "TIN", 1.0) for p in range(9)], "p_partkey bigint, p_name string, p_type string, p_retailprice double"),
        "orders": ([(o, "OFP"[o % 3], day + dt.timedelta(days=o % 9)) for o in range(orders)], "o_orderkey bigint, o_orderstatus string, o_orderdate timestamp_ntz"),
        "lineitem": ([(o, rnd.randrange(11), o % 3, n, float(rnd.randrange(1, 50)), rnd.randrange(100, 90000) / 100, 0.05, 0.02, "N", "O", day) for o in range(orders) for n in range(o % 4 + 1)],
                     "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_receipts_store_no_lines(spark, tmp_path):
    path = _driver_tables(spark, tmp_path)
    stored = StoredEntities(spark, path).receipts
    names = {name for _, folder, name in entities_module._WRITTEN if folder == path}
    assert "receipts" in names and not names & {"po_lines", "receipt_lines"}
    assert sorted(stored.collect()) == sorted(Entities(spark, path).receipts.collect()) != []


def test_documents_read_row_by_row_are_not_stored(spark, tmp_path):
    path = _driver_tables(spark, tmp_path)
    stored, plain = StoredEntities(spark, path), Entities(spark, path)
    for name in ("invoices", "invoice_lines", "receipt_lines"):
        assert sorted(getattr(stored, name).collect(), key=repr) == sorted(getattr(plain, name).collect(), key=repr) != []
    assert {name for _, folder, name in entities_module._WRITTEN if folder == path} == {"po_lines", "purchase_orders"}


def test_best_order_candidates_lose_no_best(spark):
    """Every candidate that could win is kept, most others are not; names and keys may be missing or repeat."""
    rnd = random.Random(11)
    day = dt.date(2020, 1, 1)
    name = ["Supplier#000000012 Trading Co", "Supplier#000000021 Trading Co", "Supplier#000000112", "Acme & Sons LLC", None]

    def document(i):
        return (rnd.choice([0, 0, 0, 1, None]), i, rnd.choice([0, 1, 2, 3, 4, 5, 9, None]), rnd.choice([f"PO{i % 60:06d}", f"POO{i % 60:05d}", "PO 7 x", "", " ", None]),
                rnd.choice([Decimal(rnd.randrange(-5, 300)), Decimal(rnd.randrange(900, 1300)), None]), day + dt.timedelta(days=rnd.randrange(40)))

    inv = spark.createDataFrame([document(i % 380) for i in range(400)], "tenant_id int, invoice_id bigint, vendor_id bigint, po_reference string, total_amount decimal(15,2), invoice_date date")
    po = spark.createDataFrame([(*document(i), rnd.choice(["approved", "archived"])) for i in range(400)],
                               "tenant_id int, po_id bigint, vendor_id bigint, po_number string, total_amount decimal(15,2), po_date date, status string")
    owners = spark.createDataFrame([*enumerate(name), (5, name[0]), (5, name[3]), (5, None), (None, name[1])], "vendor_id bigint, name string")
    for weights, least in ((scores.UNIT_WEIGHTS, 0.7), ({"vendor_name": 0.1, "amount": 0.2, "date": 0.3, "reference": 0.4}, 0.6)):
        every = candidates.fuzzy_candidates(inv, po, weights, least)
        few = candidates.best_order_candidates(inv, po, owners, weights, least)
        assert sorted(few.columns) == sorted(every.columns)
        extra = few.exceptAll(every.select(few.columns)).collect()
        assert not extra, extra[:5]
        best = sorted(match.best_fuzzy(every, owners, weights, least).collect())
        assert best == sorted(match.best_fuzzy(few, owners, weights, least).collect()) and len(best) > 100
        assert few.count() < every.count()


def test_marks_bound_edit_distances(spark):
    """Marks of two texts never take more than their edit distance and their common characters allow."""
    rnd = random.Random(12)
    text = lambda: "".join(rnd.choice("ab01#é😀 ") for _ in range(rnd.randrange(0, 12))) * rnd.choice([1, 1, 3])
    some = [text() for _ in range(300)] + ["supplier#000012345 inc", "supplier#000012354 inc", "po000000123456", "po000000132456", ""]
    pairs = spark.createDataFrame([(rnd.choice(some), rnd.choice(some)) for _ in range(600)] + [(some[-5], some[-4]), (some[-3], some[-2]), ("a", None)], "ref string, number string")
    rows = candidates._marked(candidates._marked(pairs, "ref"), "number").select(
        "ref", "number", candidates._taken_least("ref", "number", 1.0, 0.0).alias("edit"), candidates._taken_least("ref", "number", 0.0, 1.0).alias("both")).collect()
    for r in rows:
        if r.ref and r.number:
            n, m = len(r.ref), len(r.number)
            assert r.edit <= fuzzy.edit_distance(r.ref, r.number) / max(n, m) + 1e-12
            assert r.both <= (n + m - 2 * fuzzy.common_subsequence(r.ref, r.number)) / (n + m) + 1e-12
    assert sum((r.edit or 0) > 0 for r in rows) > 300 and [r.edit for r in rows if r.number is None] == [None]


def test_best_order_join_is_not_one_long_method(spark):
    """The pairs of the band meet outside whole-stage code, and bits are compared before edit distances."""
    inv, po, _, _ = _documents(spark, 30)
    inv, po = inv.withColumn("po_reference", F.lit("PO1")), po.withColumn("po_number", F.lit("PO2"))
    plan = candidates.best_order_candidates(inv, po, spark.createDataFrame([(0, "Acme")], "vendor_id bigint, name string"))._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x and "levenshtein" in x]
    assert joins and all("bit_count" in x[:x.index("levenshtein")] and "lambdafunction" in x for x in joins)
