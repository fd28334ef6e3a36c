"""Cost basis: hand-worked cases, and the windowed form against a plain loop."""
import datetime as dt
import random

import pytest

from quillfolio.operators import ledger as L
from quillfolio.operators import scan

SCHEMA = (
    "account_id string, symbol string, trade_date date, txn_type string, quantity double, price_per_share double, "
    "gross_amount double, commission double, tax_withheld double, source string, record_date date, txn_id long"
)
AS_OF = "2026-09-21"


def row(kind, day, q=None, p=None, fee=0.0, gross=None, tax=0.0, n=0, account="A", symbol="X"):
    return (account, symbol, dt.date.fromisoformat(day), kind, q, p, gross, fee, tax, "manual", None, n)


def ledger(spark, *rows):
    return spark.createDataFrame([r[:-1] + (i + 1 if r[-1] == 0 else r[-1],) for i, r in enumerate(rows)], SCHEMA)


def one(df):
    (r,) = df.collect()
    return r


def plain_fold(rows):
    """The same rules, one event at a time."""
    rank = {"buy": 0, "rights": 1, "bonus": 2}
    q = c = realised = 0.0
    steps = {}
    for r in sorted(rows, key=lambda r: (r[2], rank.get(r[3], 3), r[11])):
        kind, qty, price, fee = r[3], r[4] or 0.0, r[5] or 0.0, r[7]
        gain = 0.0
        if kind in ("buy", "rights"):
            q, c = q + qty, c + qty * price + fee
        elif kind == "bonus":
            q += qty
        elif kind == "sell":
            sold = min(qty, q)
            average = c / q if q > 0 else 0.0
            gain = sold * price - fee - average * sold
            realised += gain
            q, c = q - sold, c - average * sold
            if q < 1e-9:
                q = c = 0.0
        steps[(r[2], r[11])] = (q, c, gain)
    return q, c, realised, steps


def test_commission_is_part_of_cost(spark):
    r = one(L.positions(ledger(spark, row("buy", "2026-01-05", 100.0, 200.0, 100.0)), None, AS_OF))
    assert (r.cost_basis, r.average_cost, r.market_value) == (20100.0, 201.0, None)


def test_averaging_and_bonus(spark):
    x = ledger(spark, row("buy", "2026-01-05", 100.0, 200.0), row("buy", "2026-02-05", 100.0, 240.0), row("bonus", "2026-03-05", 20.0))
    r = one(L.positions(x, None, AS_OF))
    assert (r.quantity, r.cost_basis) == (220.0, 44000.0)
    assert r.average_cost == pytest.approx(200.0)
    assert r.realised_gain == 0.0


def test_sale_leaves_average_cost_and_full_exit_resets(spark):
    x = ledger(spark, row("buy", "2026-01-05", 10.0, 100.0), row("sell", "2026-02-05", 4.0, 120.0), row("sell", "2026-03-05", 6.0, 90.0), row("buy", "2026-04-05", 2.0, 50.0))
    r = one(L.positions(x, None, AS_OF))
    assert (r.quantity, r.cost_basis, r.realised_gain, r.net_cost) == (2.0, 100.0, 20.0, 1000.0 - 480.0 - 540.0 + 100.0)


def test_oversell_is_clamped_and_warned(spark):
    x = ledger(spark, row("buy", "2026-01-05", 10.0, 100.0), row("sell", "2026-02-05", 6.0, 110.0, n=1), row("sell", "2026-02-05", 6.0, 120.0, 5.0, n=2))
    r = one(L.positions(x, None, AS_OF))
    assert (r.quantity, r.warnings, r.realised_gain) == (0.0, 1, 60.0 + 4 * 20.0 - 5.0)
    w = one(L.oversells(x))
    assert (w.txn_id, w.held) == (2, 4.0)


def test_costs_never_cross_accounts(spark):
    x = ledger(spark, row("buy", "2026-01-05", 10.0, 100.0), row("buy", "2026-01-05", 10.0, 50.0, account="B"), row("sell", "2026-02-05", 10.0, 80.0, account="B"))
    merged = one(L.merge_by_symbol(L.positions(x, spark.createDataFrame([("X", 90.0)], "symbol string, close double"), AS_OF)))
    assert (merged.realised_gain, merged.cost_basis, merged.account_count, merged.market_value) == (300.0, 1000.0, 2, 900.0)


def test_merged_value_unknown_if_a_part_is(spark):
    x = ledger(spark, row("buy", "2026-01-05", 1.0, 1.0), row("buy", "2026-01-05", 1.0, 1.0, account="B"))
    pos = L.positions(x, None, AS_OF)
    assert one(L.merge_by_symbol(pos)).market_value is None
    assert one(L.account_summary(pos).filter("account_id = 'A'")).total_market_value == 0.0


def test_trailing_dividends_and_yield(spark):
    x = ledger(spark, row("buy", "2024-01-05", 10.0, 100.0), row("dividend", "2025-09-20", gross=50.0, tax=5.0), row("dividend", "2025-09-21", gross=30.0, tax=3.0))
    r = one(L.positions(x, None, AS_OF))
    assert (r.dividends_gross, r.dividends_net, r.dividends_ttm, r.yield_on_cost) == (80.0, 72.0, 30.0, 0.03)
    assert r.last_trade == dt.date(2024, 1, 5)


def random_rows(rng, accounts, events):
    rows, n = [], 0
    for a in range(accounts):
        for _ in range(events):
            n += 1
            kind = rng.choice(["buy", "buy", "sell", "sell", "bonus", "rights", "dividend"])
            day = (dt.date(2024, 11, 1) + dt.timedelta(days=rng.randrange(120))).isoformat()
            q = float(rng.randrange(1, 60))
            rows.append(row(kind, day, None if kind == "dividend" else q, round(rng.uniform(1, 90), 2) if kind in ("buy", "sell", "rights") else None,
                            round(rng.uniform(0, 3), 2) if kind in ("buy", "sell") else 0.0, 10.0 if kind == "dividend" else None, n=n, account=f"A{a}"))
    return rows


@pytest.mark.parametrize("bucket", [50_000, 2])
def test_windowed_form_equals_plain_fold(spark, monkeypatch, bucket):
    # A bucket of two rows cuts every busy day, which must change nothing.
    monkeypatch.setattr(scan, "BUCKET_ROWS", bucket)
    rows = random_rows(random.Random(7), 12, 60)
    x = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.account_id: r for r in L.positions(x, None, AS_OF).collect()}
    gains = {(r.account_id, r.txn_id): r.gain for r in L.sale_gains(x).collect()}
    for a, r in got.items():
        mine = [t for t in rows if t[0] == a]
        q, c, realised, steps = plain_fold(mine)
        assert (r.quantity, r.cost_basis, r.realised_gain) == pytest.approx((q, c, realised), abs=1e-6)
        for t in mine:
            if t[3] == "sell":
                assert gains[(a, t[11])] == pytest.approx(steps[(t[2], t[11])][2], abs=1e-6)


def test_many_partial_sales_do_not_underflow(spark):
    rows = []
    for i in range(700):
        day = (dt.date(2020, 1, 1) + dt.timedelta(days=i)).isoformat()
        rows.append(row("buy", day, 1000.0, 10.0 + i % 7, n=2 * i + 1))
        rows.append(row("sell", day, 999.0 if i else 990.0, 11.0, n=2 * i + 2))
    q, c, realised, _ = plain_fold(rows)
    r = one(L.positions(spark.createDataFrame(rows, SCHEMA), None, AS_OF))
    assert (r.quantity, r.cost_basis, r.realised_gain) == pytest.approx((q, c, realised), rel=1e-9)


@pytest.mark.parametrize("bucket", [50_000, 2])
def test_timeline_ends_where_positions_do(spark, monkeypatch, bucket):
    monkeypatch.setattr(scan, "BUCKET_ROWS", bucket)
    rows = random_rows(random.Random(3), 3, 40)
    x = spark.createDataFrame(rows, SCHEMA)
    steps = L.cost_timeline(x).collect()
    assert len(steps) == len(rows)
    rank = {"buy": 0, "rights": 1, "bonus": 2}
    last = max(steps, key=lambda s: (s.trade_date, rank.get(s.txn_type, 3), s.txn_id, s.account_id))
    merged = one(L.merge_by_symbol(L.positions(x, None, AS_OF)))
    assert (last.held, last.net_cost) == pytest.approx((merged.quantity, merged.net_cost), abs=1e-6)


def test_commission_rate_needs_three_trades(spark):
    few = ledger(spark, row("buy", "2026-01-05", 100.0, 100.0, 90.0), row("buy", "2026-01-06", 100.0, 100.0, 90.0))
    assert {r.rate for r in L.commission_rates(few).collect()} == {0.004}
    three = ledger(spark, *[row("buy", f"2026-01-0{i}", 100.0, 100.0, 40.0) for i in (5, 6, 7)])
    assert {r.rate for r in L.commission_rates(three).collect()} == {0.004}
