"""Every registered query against its DuckDB statement, or for rows when it has none."""

import compare
import pytest

from ledgerlink.plans.catalog import QUERIES

# Legitimately empty at the smallest scale.
MAY_BE_EMPTY = {"v15_invoice_filters", "v17_audit_filters", "j20_visible_lines", "a27_users_over_session_limit"}


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql is not None))
def test_equals_check_statement(spark, duck, sf_dir, name):
    found = compare.differences(spark, duck, QUERIES[name], sf_dir)
    if name in MAY_BE_EMPTY:
        found = [f for f in found if f != "EMPTY"]
    assert found == []


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql is None))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name].run(spark, sf_dir)
    assert df.columns == [n for n, _ in QUERIES[name].columns]
    assert df.count() > 0
