"""Steps that must not grow faster than their input: state calls, sorts, joins and repeated work."""
import contextlib
import datetime as dt
import io
import sys

import pandas as pd

from quillfolio.operators import apply as A
from quillfolio.operators import ledger as L
from quillfolio.operators import scan
from quillfolio.operators import targets as Tg
from quillfolio.sources.testtables import TestTables
from quillfolio.streaming.alerts import AlertDays

D = dt.date(2024, 1, 1)


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


class Handle:
    """A state store of one key that counts its writes."""

    def __init__(self):
        self.held, self.writes = {}, 0

    def getMapState(self, *args):
        return self

    def iterator(self):
        return iter(list(self.held.items()))

    def updateValue(self, key, value):
        self.held[key], self.writes = value, self.writes + 1


def test_alert_state_is_written_once_a_year_not_a_day():
    handle, side = Handle(), AlertDays()
    side.init(handle)
    rows = [(D + dt.timedelta(i), 5.0 + i % 3, 6.0, i % 3 < 2, True, 0) for i in range(400)]
    frame = pd.DataFrame(rows, columns=["trade_date", "close", "level", "reached", "can_send", "arrived"])
    first = pd.concat(side.handleInputRows((1, "buy"), iter([frame]), None))
    assert handle.writes == 2 and list(first.event[:2]) == ["send", "rearm"] and len(first) == 267
    again = pd.concat(side.handleInputRows((1, "buy"), iter([frame]), None))
    assert handle.writes == 2 and len(again) == 0
    late = pd.DataFrame([(D, 9.0, 6.0, False, True, 0)], columns=frame.columns)
    out = pd.concat(side.handleInputRows((1, "buy"), iter([late]), None))
    assert handle.writes == 3 and [(r.trade_date, r.event, r.change) for r in out.itertuples()] == [(D, "send", -1), (D + dt.timedelta(1), "send", 1)]


def test_alert_days_are_judged_without_a_call_a_day():
    def calls(n):
        frame = pd.DataFrame([(D + dt.timedelta(i), 5.0, 4.0, False, True, 0) for i in range(n)], columns=["trade_date", "close", "level", "reached", "can_send", "arrived"])
        handle, side, seen = Handle(), AlertDays(), []
        side.init(handle)
        for part in (frame, frame.assign(close=6.0)):
            sys.setprofile(lambda _, event, arg: seen.append(event) if event in ("call", "c_call") else None)
            try:
                list(side.handleInputRows((1, "buy"), iter([part]), None))
            finally:
                sys.setprofile(None)
        assert sum(len(held[0]) for held in handle.held.values()) > 20 * n
        return len(seen)

    calls(10)  # what is imported and cached on first use
    assert calls(3600) < 2 * calls(36)


def test_alerts_take_one_order_of_the_days(spark):
    days = [(1, "buy", D + dt.timedelta(i), float(i), 1.0, r, c) for i, (r, c) in enumerate([(True, False), (True, True), (True, True), (None, True), (False, True), (True, True)])]
    got = Tg.alerts(spark.createDataFrame(days, "target_id long, side string, trade_date date, close double, level double, reached boolean, can_send boolean"))
    assert plan_of(got).count("+- Sort ") == 1
    assert [(r.trade_date.day, r.event) for r in got.orderBy("trade_date").collect()] == [(2, "send"), (5, "rearm"), (6, "send")]


def test_sides_are_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(scan, "TASK_ROWS", 10)
    targets = spark.createDataFrame([(i, f"S{i}", None, 2.0, 3.0) for i in range(4)], "target_id long, symbol string, account_id string, buy_below double, sell_above double")
    prices = spark.createDataFrame([(f"S{i}", D + dt.timedelta(j), 1.0 * j) for i in range(4) for j in range(5)], "symbol string, trade_date date, close double")
    held = spark.createDataFrame([(None, "S1", D, 5.0)], "account_id string, symbol string, trade_date date, quantity double")
    days = Tg.target_days(targets, prices, held)
    assert "REPARTITION_BY_NUM" in plan_of(days) and days.rdd.getNumPartitions() == 5  # 40 days and 1 holding
    assert days.count() == 40 and days.filter("can_send and side = 'sell'").count() == 5


def test_only_short_days_are_joined_to_what_they_could_deliver(spark):
    schema = "account_id string, symbol string, trade_date date, txn_type string, quantity double, price_per_share double, commission double, gross_amount double, tax_withheld double, txn_id long"
    rows = [("A", "X", D, "buy", 10.0, 2.0, 0.0, None, 0.0, 1), ("A", "X", D, "sell", 4.0, 3.0, 1.0, None, 0.0, 2), ("A", "X", D + dt.timedelta(1), "sell", 5.0, 3.0, 0.0, None, 0.0, 3),
            ("A", "X", D + dt.timedelta(1), "sell", 5.0, 3.0, 0.0, None, 0.0, 4), ("A", "Y", D, "sell", 1.0, 3.0, 0.0, None, 0.0, 5)]
    got = L.sale_gains(spark.createDataFrame(rows, schema))
    assert "_short" in plan_of(got) and plan_of(got).count("Union") == 1  # covered sales come in beside the join
    out = {r.txn_id: (r.filled, r.gain, r.oversold_from) for r in got.collect()}
    assert out == {2: (4.0, 3.0, None), 3: (5.0, 5.0, None), 4: (1.0, 1.0, 1.0), 5: (0.0, 0.0, 0.0)}


def test_order_lines_are_joined_once(spark, tmp_path):
    tables = {
        "customer": ([(7, "S")], "c_custkey long, c_mktsegment string"), "orders": ([(1, 7)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(1, 2, 3, 1, 2.0, 10.0, 0.1, "N", "O", dt.datetime(2024, 1, 1))],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    txns = TestTables(spark, str(tmp_path)).transactions("c_custkey")
    assert [(r.account_id, r.symbol, r.price_per_share) for r in txns.collect()] == [("7", "S000003", 5.0)]
    lines = plan_of(txns).splitlines()
    at = lambda column: next(len(x) - len(x.lstrip(" :+-")) for x in lines if "FileScan" in x and column in x)
    assert at("l_orderkey") < at("c_custkey")  # the order lines come in above the customers


def test_import_outcomes_are_computed_once(spark):
    trade = "account_id string, symbol string, trade_date date, txn_type string, quantity double, price_per_share double, commission double, txn_id long"
    plans = spark.createDataFrame([("A", D, D, True, 0.0, 1.0)], "account_id string, period_from date, period_to date, confirmed boolean, opening_balance double, closing_balance double")
    empty = spark.createDataFrame([], trade)
    new = spark.createDataFrame([("A", "X", D, "buy", 1.0, 1.0, 0.0, 1)], trade)
    cash = spark.createDataFrame([], "account_id string, move_date date, kind string, amount double, movement_id long")
    periods = spark.createDataFrame([], "account_id string, period_from date, period_to date, opening_balance double")
    companies = spark.createDataFrame([], "symbol string, name string")
    got = A.apply_import(plans, empty, empty, empty, new, cash, cash, periods, companies)
    assert "Join" not in plan_of(got["outcomes"]) and "Aggregate" not in plan_of(got["outcomes"])
    assert [(r.account_id, r.trades) for r in got["periods"].collect()] == [("A", 1)]
