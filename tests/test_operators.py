"""Small hand-worked cases of the other operator families."""
import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from quillfolio.operators import dividends as Dv
from quillfolio.operators import fundamentals as Fu
from quillfolio.operators import insights as I
from quillfolio.operators import names as Nm
from quillfolio.operators import prices as P
from quillfolio.operators import reconcile as R
from quillfolio.operators import returns as Re
from quillfolio.plans import daily_job
from quillfolio.sources import price_tables as PT


def closes(spark, values, start=dt.date(2025, 1, 1), symbol="X"):
    rows = [(symbol, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, trade_date date, close double")


def test_drawdown_takes_the_earliest_on_ties(spark):
    r = P.drawdown(closes(spark, [10, 12, 12, 6, 6, 9])).first()
    assert (r.worst, r.peak_date, r.trough_date, r.from_peak) == (-0.5, dt.date(2025, 1, 2), dt.date(2025, 1, 4), -0.25)
    r = P.drawdown(closes(spark, [1, 2, 3])).first()
    assert (r.worst, r.peak_date, r.trough_date) == (0.0, None, None)


def test_moving_average_waits_for_a_full_window(spark):
    rows = P.moving_averages(closes(spark, range(1, 61)), (50,)).orderBy("trade_date").collect()
    assert rows[48].ma50 is None and rows[49].ma50 == 25.5 and rows[59].ma50 == 35.5


def test_volatility_of_the_last_250_returns(spark):
    rng = random.Random(1)
    v = [100.0]
    for _ in range(300):
        v.append(v[-1] * (1 + rng.uniform(-0.03, 0.03)))
    rets = [b / a - 1 for a, b in zip(v, v[1:])][-250:]
    m = sum(rets) / 250
    want = math.sqrt(sum((x - m) ** 2 for x in rets) / 249 * 250)
    r = P.price_stats(closes(spark, v)).first()
    assert r.volatility == pytest.approx(want) and r.change_year == pytest.approx(v[-1] / v[-251] - 1)


def test_peers_leave_the_company_itself_out(spark):
    rng = random.Random(5)
    vals = [rng.choice([None, -1.0, 0.0] + [float(rng.randrange(1, 12)) for _ in range(6)]) for _ in range(60)]
    rows = spark.createDataFrame([(f"S{i}", v) for i, v in enumerate(vals)], "symbol string, pe double")
    got = {r.symbol: r for r in I.compare_with_peers(rows, ["pe"]).collect()}
    for i, v in enumerate(vals):
        if v is None or v <= 0:
            assert f"S{i}" not in got
            continue
        others = sorted(x for j, x in enumerate(vals) if j != i and x is not None and x > 0)
        mid = len(others) / 2
        median = others[int(mid)] if len(others) % 2 else (others[int(mid) - 1] + others[int(mid)]) / 2
        rank = (sum(x < v for x in others) + sum(x == v for x in others) / 2) / len(others)
        r = got[f"S{i}"]
        assert (r.peers, r.median, r.cheaper_than) == (len(others), median, sum(x > v for x in others))
        assert r.rank == pytest.approx(rank)


def test_adjustment_counts_only_later_actions(spark):
    cols = "symbol string, action_type string, ex_date date, stock_pct double, rights_new double, rights_per double, rights_price double, cum_price double, split_from double, split_to double"
    d = dt.date
    acts = spark.createDataFrame([
        ("X", "stock_dividend", d(2025, 6, 30), 25.0, None, None, None, None, None, None), ("X", "stock_dividend", d(2025, 7, 1), 25.0, None, None, None, None, None, None),
        ("X", "split", d(2025, 8, 1), None, None, None, None, None, 1.0, 2.0), ("X", "rights_issue", None, None, 1.0, 2.0, None, None, None, None),
        ("X", "rights_issue", d(2026, 1, 1), None, 1.0, 3.0, 20.0, 40.0, None, None), ("X", "stock_dividend", d(2024, 1, 1), -100.0, None, None, None, None, None, None),
    ], cols)
    probes = spark.createDataFrame([("X", d(2025, 6, 30)), ("X", d(2027, 1, 1))], "symbol string, at date")
    got = {r["at"]: r.factor for r in Fu.cumulative_factors(acts, probes).collect()}
    assert got[d(2025, 6, 30)] == pytest.approx(0.8 * 0.5 * (3 * 40 + 20) / 4 / 40)
    assert got[d(2027, 1, 1)] == 1.0
    assert Fu.impossible_actions(acts).count() == 1


def test_xirr(spark):
    d = dt.date
    rows = [("a", d(2024, 1, 1), -1000.0), ("a", d(2024, 12, 31), 1100.0), ("b", d(2024, 1, 1), -1000.0), ("c", d(2024, 1, 1), -1.0), ("c", d(2024, 12, 31), 30.0), ("d", d(2024, 1, 1), -1000.0), ("d", d(2024, 12, 31), 400.0)]
    flows = spark.createDataFrame(rows, "account_id string, flow_date date, amount double")
    got = {r.account_id: r.rate for r in Re.xirr(flows, ["account_id"]).collect()}
    assert got["a"] == pytest.approx(0.1) and got["b"] is None and got["c"] == pytest.approx(29.0) and got["d"] == pytest.approx(-0.6, abs=1e-6)


def test_name_match_refuses_ties(spark):
    companies = spark.createDataFrame([("SQ", "Square Pharmaceuticals Ltd.", "Square Pharma"), ("ST", "Square Textiles Limited", None), ("GP", "Grameenphone Ltd", None)], "symbol string, name string, short_name string")
    names = spark.createDataFrame([("SQUARE PHARMACEUTICALS PLC",), ("Square",), ("Square Textiles Mills",), ("Unknown Co",), ("Grameenphone",)], "company_name string")
    got = {r.company_name: r.symbol for r in Nm.match_companies(names, companies).collect()}
    assert got == {"SQUARE PHARMACEUTICALS PLC": "SQ", "Square": None, "Square Textiles Mills": "ST", "Unknown Co": None, "Grameenphone": "GP"}


def test_manual_trades_match_one_to_one(spark):
    rng = random.Random(11)
    base = dt.date(2025, 3, 1)
    cols = "account_id string, symbol string, trade_date date, txn_type string, quantity double, txn_id long"
    make = lambda n, off: [("A", rng.choice("XY"), base + dt.timedelta(days=rng.randrange(40)), rng.choice(["buy", "sell"]), float(rng.choice([5, 10])), off + i) for i in range(n)]
    manual, ledger = make(120, 0), make(90, 1000)
    want = {}
    free = sorted(ledger, key=lambda r: (r[2], r[5]))
    for m in sorted(manual, key=lambda r: (r[2], r[5])):
        hit = next((l for l in free if (l[1], l[3], l[4]) == (m[1], m[3], m[4]) and abs((l[2] - m[2]).days) <= 3), None)
        want[m[5]] = hit is not None
        if hit:
            free.remove(hit)
    out = R.match_manual_trades(spark.createDataFrame(manual, cols), spark.createDataFrame(ledger, cols))
    assert {r.txn_id: r.replaced for r in out.collect()} == want


def test_paid_dividends_are_split_by_what_was_due(spark):
    d = dt.date
    recs = spark.createDataFrame([("A", d(2025, 1, 31), "P", "P", 100.0, d(2025, 1, 5)), ("A", d(2025, 1, 31), "Q", "Q", 300.0, None), ("A", d(2025, 1, 31), "R", "R", 50.0, None), ("A", d(2025, 2, 28), "R", "R", 50.0, None)],
                                 "account_id string, as_of date, company_name string, symbol string, entitlement double, record_date date")
    credit = spark.createDataFrame([("A", d(2025, 1, 31), d(2025, 2, 28), 360.0)], "account_id string, as_of date, next_as_of date, credited double")
    paid = {r.symbol: (r.gross, r.tax_withheld, r.check_split) for r in Dv.detect_paid(recs, credit).collect()}
    assert paid == {"P": (100.0, 10.0, False), "Q": (300.0, 30.0, False)}


def test_price_files_choose_columns_and_last_line(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Date,Price,Close,LTP*,Vol.,Symbol\n22/09/2026,1,"1,010.5",2,1.5K,abc\n\n22/09/2026,1,1020,2,2K,abc\n,,,,,\n03/09/2026,1,0,2,1,abc\n')
    (tmp_path / "b.csv").write_text("Trade Date;CLOSEP*;Open\n22/09/2026;5;4\n09/22/2026;6;5\n")
    good, bad = PT.read_price_rows(*PT.cells_of_lines(PT.read_price_lines(spark, str(tmp_path))), fallback_symbol="ZZZ")
    (g,) = good.collect()
    assert (g.symbol, g.trade_date, g.close, g.volume) == ("ABC", dt.date(2026, 9, 22), 1020.0, 2000)
    assert sorted(r.reason for r in bad.collect()) == ["close not positive", "day and month order is unclear", "day and month order is unclear"]


def test_board_names_absent_symbols_on_its_own_day_only(spark):
    quote = '{"close": "10", "high": "11", "low": "9", "volume": "5", "updated_at": "%s 14:00"}'
    boards = spark.createDataFrame([
        ("2025-01-01", '{"aa": %s, "BB": {"close": "0"}, "ZZ": {"close": "1"}}' % quote % "2025-01-01"),
        ("2025-01-02", '{"AA": %s, "CC": null}' % quote % "2025-01-02"),
    ], "board_id string, payload string")
    wanted = spark.createDataFrame([("aa",), ("AA",), ("BB",), ("CC",)], "symbol string")
    stored = spark.createDataFrame([], "symbol string, trade_date date, open double, high double, low double, close double, volume double, turnover double")
    day = daily_job.ingest_day(boards, wanted, stored)
    assert sorted((r.symbol, str(r.trade_date), r.close) for r in day["prices"].collect()) == [("AA", "2025-01-01", 10.0), ("AA", "2025-01-02", 10.0)]
    assert sorted(tuple(r) for r in day["skips"].collect()) == [
        ("2025-01-01", "BB", "close missing"), ("2025-01-02", "BB", "missing from the board"), ("2025-01-02", "CC", "missing from the board"),
    ]
    assert sorted((r.board_id, r.written, r.skipped, r.ok) for r in day["summary"].collect()) == [("2025-01-01", 1, 2, True), ("2025-01-02", 1, 2, True)]
    assert daily_job.ingest_day(boards.limit(0), wanted, stored)["skips"].count() == 0
