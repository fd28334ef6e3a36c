"""Registered queries of the ledger family."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import ledger as L
from ..operators import prices as P
from ..sources.testtables import TestTables
from .registry import query

AS_OF = "2001-09-30"

POSITION_SPEC = (
    "symbol quantity:4 cost_basis:4 average_cost:4 realised_gain:4 dividends_gross:4 dividends_net:4 dividends_ttm:4 "
    "yield_on_cost:6 invested:4 returned:4 net_cost:4 net_cost_per_share:4 market_value:4 unrealised_gain:4 "
    "unrealised_pct:6 first_trade:d last_trade:d warnings:i"
)


def stock_quotes(t: TestTables) -> DataFrame:
    return P.latest_quotes(t.stock_prices())


def positions(t: TestTables) -> DataFrame:
    return L.positions(t.transactions(), stock_quotes(t), AS_OF)


@query("a06_positions", "account_id " + POSITION_SPEC)
def _(t):
    return positions(t)


@query("a07_holdings_by_symbol", "account_count:i " + POSITION_SPEC)
def _(t):
    return L.by_value(L.merge_by_symbol(positions(t)))


@query("a08_account_totals", "account_id total_cost:2 total_market_value:2 total_unrealised:2 total_realised:2 total_dividends_gross:2 open_positions:i")
def _(t):
    return L.account_summary(positions(t)).orderBy(F.col("total_market_value").desc(), "account_id")


@query("a08_portfolio_totals", "total_cost:2 total_market_value:2 total_unrealised:2 total_unrealised_pct:6 total_realised:2 total_dividends_gross:2 total_dividends_net:2 largest_weight:6")
def _(t):
    return L.portfolio_summary(positions(t))


@query("a09_sector_weights", "sector market_value:2 weight:6")
def _(t):
    return L.sector_weights(L.merge_by_symbol(positions(t)), t.listings()).orderBy(F.col("market_value").desc())


@query("a10_a11_trading_stats", "sales:i wins:i losses:i win_rate:6 realised:2 commission:2 turnover:2 average_win:4 average_loss:4 commission_share:6")
def _(t):
    x = t.transactions()
    return L.trading_stats(x, L.sale_gains(x))


@query("a10_symbol_stats", "symbol buys:i sells:i commission:4 realised:4")
def _(t):
    x = t.transactions()
    return L.symbol_stats(x, L.sale_gains(x)).orderBy(F.col("realised").desc(), "symbol")


@query("a12_commission_rates", "account_id trades:i rate:8")
def _(t):
    return L.commission_rates(t.transactions())


@query("w13_cost_timeline", "symbol trade_date:d txn_id account_id txn_type quantity:4 price_per_share:4 cash:4 held:4 average_cost:4 net_cost_per_share:4 net_cost:4")
def _(t):
    return L.cost_timeline(t.transactions())


@query("w14_sale_gains", "account_id symbol trade_date:d txn_id quantity:4 proceeds:4 gain:4")
def _(t):
    return L.sale_gains(t.transactions())


@query("a06_oversell_warnings", "account_id symbol trade_date:d txn_id quantity:4 held:4")
def _(t):
    return L.oversells(t.transactions())


@query("p05_cash_flows", "account_id symbol trade_date:d txn_id txn_type cash:4")
def _(t):
    return L.with_cash_flow(t.transactions())


@query("t05_event_order", "account_id symbol txn_id trade_date:d place:i")
def _(t):
    return L.event_order(t.transactions())


@query("w21_holding_before_record_date", "account_id symbol record_date:d quantity:4")
def _(t):
    x = t.transactions()
    dates = x.filter("record_date is not null").select("account_id", "symbol", "record_date")
    return L.holdings_at(L.day_states(x), dates, "record_date", strict=True)


@query("f10_free_share_plans", "symbol sell:4 keep:4")
def _(t):
    return L.free_share_plan(L.merge_by_symbol(positions(t)), stock_quotes(t))


@query("f11_j17_what_if_trades", "account_id symbol plan_id:i invalid:b new_quantity:4 new_average_cost:6 new_net_cost:6 new_net_cost_per_share:6 plan_gain:6 cash_needed:6")
def _(t):
    pos = positions(t)
    plan = pos.select("account_id", "symbol").join(stock_quotes(t), "symbol").select(
        "account_id", "symbol", F.col("close"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("plan_id")
    )
    plans = plan.select(
        "account_id", "symbol", "plan_id", (F.col("plan_id") * 40.0).alias("sell_qty"), (F.col("close") * 1.1).alias("sell_price"),
        (F.col("plan_id") * 30.0).alias("buy_qty"), (F.col("close") * 0.9).alias("buy_price"), F.lit(0.005).alias("rate"),
    )
    return L.what_if(pos, plans)


@query("x07_masked_accounts", "account_id masked trades:i")
def _(t):
    from ..functions.text import masked

    return t.transactions().groupBy("account_id").agg(F.count(F.lit(1)).alias("trades")).withColumn("masked", masked(F.col("account_id")))
