"""Registered queries of the returns, cash and income-year families."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import reconcile as R
from ..operators import returns as Re
from ..operators import tax as T
from .ledger_queries import AS_OF, positions
from .registry import query


@query("a18_lifetime_returns", "account_id as_of:d money_in:2 worth:2 gain:2 total_return:6 realised:2 dividends:2 unrealised:2 unexplained:2")
def _(t):
    return Re.lifetime_returns(Re.latest_snapshots(t.snapshots()))


@query("a19_combined_accounts", "accounts:i missing:i known:b cash:2 cash_as_of:d deposited:2 withdrawn:2 net_invested:2 equity:2 gain:2 total_return:6")
def _(t):
    accounts = t.raw("customer").select(F.col("c_mktsegment").alias("account_id")).distinct()
    return Re.combined(Re.latest_snapshots(t.snapshots()), accounts)


@query("w08_snapshot_movements", "account_id from_date:d to_date:d deposited:2 withdrawn:2 dividends:2 transferred_in:2 transferred_out:2 ipo_net:2")
def _(t):
    return Re.snapshot_movements(t.snapshots())


@query("w10_p10_period_returns", "account_id from_date:d to_date:d flow:2 return:6")
def _(t):
    return Re.period_returns(t.snapshots())


@query("w11_yearly_returns", "account_id year:i return:6 from_date:d to_date:d complete:b")
def _(t):
    return Re.yearly_returns(t.snapshots())


@query("w12_return_since_first", "account_id from_date:d to_date:d days:i return:6")
def _(t):
    return Re.since_first_snapshot(t.snapshots())


def _flows(t):
    return L.with_cash_flow(t.transactions()).select("account_id", F.col("trade_date").alias("flow_date"), F.col("cash").alias("amount"))


@query("w23_xirr_by_account", "account_id first_flow:d days:i rate:6")
def _(t):
    worth = L.account_summary(positions(t)).select("account_id", F.col("total_market_value").alias("worth"))
    return Re.portfolio_returns(_flows(t), worth, AS_OF, ["account_id"])


@query("w23_xirr_portfolio", "scope first_flow:d days:i rate:6")
def _(t):
    worth = L.portfolio_summary(positions(t)).select(F.lit("all").alias("scope"), F.col("total_market_value").alias("worth"))
    return Re.portfolio_returns(_flows(t).withColumn("scope", F.lit("all")), worth, AS_OF, ["scope"])


@query("w23_account_money_weighted", "account_id as_of:d first_date:d days:i rate:6")
def _(t):
    return Re.account_returns(t.cash_movements(), Re.latest_snapshots(t.snapshots()))


@query("a20_cash_overview", "account_id as_of:d cash:2 worth:2 deposited:2 withdrawn:2 net_invested:2 dividends:2 ipo_pending:2 later_trades:i dated:b")
def _(t):
    early = t.snapshots().filter("as_of < '2001-06-01'")
    return Re.cash_overview(early, t.transactions(), t.cash_movements())


@query("a20_investing_costs", "account_id commission:2 dividend_tax:2 fees:2 total_cost:2")
def _(t):
    return Re.investing_costs(t.transactions(), t.cash_movements())


@query("a34_undated_movements", "account_id from_date:d to_date:d deposited:2 withdrawn:2 dividends:2 transferred_in:2 transferred_out:2 ipo_net:2")
def _(t):
    return Re.undated_movements(t.snapshots(), t.cash_movements().filter("account_id <> 'HOUSEHOLD'"))


@query("a21_d6_income_year_lines", "account_id year:i dividend_gross:2 dividend_tax:2 dividend_net:2 sales:i realised:2 commission:2 deposited:2 withdrawn:2 fees:2")
def _(t):
    return T.year_lines(t.transactions(), t.cash_movements())


@query("a21_held_at_year_ends", "account_id symbol year:i year_end:d quantity:4 cost_basis:4 average_cost:4")
def _(t):
    return T.held_at_year_ends(t.transactions(), 2001)


@query("a22_year_end_values", "account_id symbol year:i quantity:4 close:4 value:4")
def _(t):
    from ..operators import prices as P

    held = T.held_at_year_ends(t.transactions(), 2001)
    closes = P.closes_as_of(t.stock_prices(), held.select("symbol", "year_end"), "year_end")
    return held.join(closes, ["symbol", "year_end"], "left").withColumn("value", F.col("quantity") * F.col("close"))


@query("a21_cash_at_year_ends", "account_id year:i known:b cash_at_end:2")
def _(t):
    return T.cash_at_year_ends(t.transactions(), t.cash_movements(), R.ledger_coverage(t.ledger_imports()), 2001)


@query("w17_ledger_coverage", "account_id start:d reach:d first_from:d last_to:d complete:b")
def _(t):
    reach = R.ledger_coverage(t.ledger_imports())
    return reach.withColumn("complete", F.coalesce(F.col("reach") >= F.lit("2001-06-30").cast("date"), F.lit(False)))
