"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlink.plans.catalog import QUERIES  # noqa: E402
from ledgerlink.session import build_session, clear_run  # noqa: E402
from ledgerlink.sources.entities import STORED, StoredEntities  # noqa: E402

HEADLINE = [
    "j01_exact_match", "r08_two_way_run", "r02_band_run", "r07_three_way_run", "j10_line_matching", "j07_nearest_amount",
    "j02_fuzzy_candidates", "v14_row_disposition", "k09_batch_summary", "a01_invoice_totals", "a11_tenant_statistics",
    "a17_daily_metrics", "a22_brute_force", "a37_permission_checks", "w11_sliding_count", "t04_progressive_lockout", "d01_duplicate_groups",
]
# Timed as well, not part of the headline.
MORE = ["x17_training_rows", "x20_tiered_match", "x02_jaro_similarity", "w04_best_vendor_for_name", "t01_rate_limit_stream"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def clock(name: str, run) -> None:
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    entities = StoredEntities(spark, sf_dir)
    clock("prepare_tables", lambda: [getattr(entities, name) for name in STORED])
    invoices, orders = entities.invoices.count(), entities.purchase_orders.count()
    for name in HEADLINE:
        clock(name, lambda: QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save())
    total = round(sum(times.values()), 3)
    for name in MORE:
        clock(name, lambda: QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1],
        "invoices": invoices, "brute_force_pairs": invoices * orders,
        "invoices_per_second": {n: round(invoices / times[n]) for n in ("r08_two_way_run", "r02_band_run", "r07_three_way_run", "v14_row_disposition")},
    }))
    clear_run(spark)
    spark.stop()


if __name__ == "__main__":
    main()
