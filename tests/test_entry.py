"""Registered queries against their expected-result SQL at the smallest scale.

All of them with QUILLFOLIO_FULL=1; by default one or two per family.
"""
import os

import pytest

import __spark_entry__ as entry
from compare import compare, expected_db

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "a07_holdings_by_symbol", "w14_sale_gains", "w05_drawdown", "k02_upsert_coalesce", "a02_year_metrics", "j06_cumulative_factors", "w11_yearly_returns",
    "a16_paid_dividends", "w22_target_alerts", "s09_pasted_dividends", "j10_x03_name_matches", "d01q_transaction_rules", "k05_import_outcomes", "a27_import_blockers", "z1_price_stream",
]
NAMES = sorted(entry.queries()) if os.environ.get("QUILLFOLIO_FULL") else SAMPLE


@pytest.fixture(scope="module")
def db():
    return expected_db(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, db, name):
    verdict, _, _ = compare(spark, db, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert verdict.startswith("ok" if name in entry.oracle_sql() else "rows"), verdict


def test_every_finance_query_has_sql():
    """Only queries of the training-data folder may go without, and these are tested against brute force."""
    without = set(entry.queries()) - set(entry.oracle_sql())
    assert all(name == "pipeline" or name.startswith("op") for name in without) and not set(entry.oracle_sql()) - set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
