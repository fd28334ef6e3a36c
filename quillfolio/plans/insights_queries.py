"""Registered queries of the insight and target families."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import features as Ft
from ..operators import fundamentals as Fu
from ..operators import insights as I
from ..operators import ledger as L
from ..operators import prices as P
from ..operators import targets as Tg
from ..sources.scratch import written
from .bundles import stock_insights
from .fundamentals_queries import restated, screener, wide
from .ledger_queries import positions, stock_quotes
from .registry import query

TODAY = "2001-11-30"


def _now(t):
    latest = restated(t).groupBy("symbol").agg(F.max_by("eps_basic", "fiscal_year").alias("eps"))
    return P.latest_quotes(t.daily_prices()).select("symbol", F.col("close").alias("price")).join(latest, "symbol", "left")


def _band(t):
    return I.pe_band(t.daily_prices(), I.earnings_timeline(wide(t), t.companies()), _now(t), D.years_ago(F.lit(TODAY).cast("date"), 5))


@query("j04_earnings_known_by_day", "symbol trade_date:d close:4 eps:6")
def _(t):
    return I.earnings_known(t.daily_prices(), I.earnings_timeline(wide(t), t.companies()))


@query("w07_pe_bands", "symbol samples:i from_date:d to_date:d low:4 median:4 high:4 current:4 rank:6 price_at_low:4 price_at_median:4 price_at_high:4")
def _(t):
    return _band(t)


@query("a29_j18_peers", "symbol metric value:6 peers:i median:6 rank:6 cheaper_than:i")
def _(t):
    return I.compare_with_peers(screener(t), ["pe", "pb", "dividend_yield"])


@query("a29_peers_of_stocks", "symbol metric value:6 peers:i median:6 rank:6 cheaper_than:i")
def _(t):
    return I.compare_with_peers(L.merge_by_symbol(positions(t)), ["average_cost", "market_value"])


@query("a33_stock_insight", "symbol name price:4 trade_date:d change_pct:6 pe:4 pb:4 dividend_yield:6 year_high:4 year_low:4 own_position:6 band_median:4 band_rank:6 worst_fall:6 days:i pe_peers:i pe_rank:6")
def _(t):
    figures = written(wide(t))
    features = written(Ft.daily_features(t.daily_prices(), I.earnings_timeline(figures, t.companies())))
    return stock_insights(features, Fu.restate(figures, t.companies(), t.corporate_actions()), t.companies(), TODAY)


@query("a33_features", "symbol trade_date:d close:4 ycp:4 yearly_high:4 yearly_low:4 peak:4 fall:6 days:i eps:6")
def _(t):
    """The feature table brought forward in two steps: up to May 2000, and from there by the days since."""
    prices, earnings = written(t.daily_prices()), written(I.earnings_timeline(wide(t), t.companies()))
    early = written(Ft.daily_features(prices.filter("trade_date < date'2000-05-17'"), earnings))
    return early.unionByName(Ft.advance_features(early, prices, earnings, "2000-05-17"))


def _scenario_rows(t):
    listing = t.listings().select("symbol", "company")
    held = L.merge_by_symbol(positions(t)).select("symbol", "quantity", "cost_basis", "average_cost")
    band = _band(t).select(F.col("symbol").alias("company"), "price_at_low", "price_at_median", "price_at_high")
    px = t.stock_prices()
    quotes = P.latest_quotes(px).select("symbol", F.col("close").alias("price"))
    year = P.range_over(px, F.lit("2000-11-30").cast("date"), P.latest_quotes(px)).select("symbol", F.col("low").alias("year_low"), F.col("high").alias("year_high"))
    goal = t.targets().select("symbol", "buy_below", "sell_above")
    rate = L.commission_rates(t.transactions()).filter("account_id is null").select("rate").scalar()
    rows = held.join(listing, "symbol").join(band, "company", "left").join(quotes, "symbol").join(year, "symbol", "left").join(goal, "symbol", "left")
    return rows.withColumn("break_even", F.when((F.col("quantity") > 0) & (F.col("average_cost") != 0), Tg.break_even(F.col("average_cost"), rate)))


@query("f09_scenarios", "symbol label basis level:4 move:6 value:4 gain:4 gain_pct:6")
def _(t):
    return I.scenarios(_scenario_rows(t))


@query("p08_break_even_prices", "account_id symbol average_cost:4 break_even:4 plus_five:4 plus_ten:4")
def _(t):
    rates = L.commission_rates(t.transactions()).select("account_id", "rate")
    rows = positions(t).filter("quantity > 0").join(rates, "account_id")
    a, r = F.col("average_cost"), F.col("rate")
    return rows.withColumns({"break_even": Tg.break_even(a, r), "plus_five": Tg.price_for_gain(a, 0.05, r), "plus_ten": Tg.price_for_gain(a, 0.10, r)})


def _statuses(t):
    pos = positions(t)
    scoped = Tg.scoped_positions(pos, L.merge_by_symbol(pos))
    return Tg.evaluate(t.targets(), stock_quotes(t), scoped, L.commission_rates(t.transactions()))


@query("f12_j16_target_status", "target_id:i symbol account_id price:4 quantity:4 break_even:4 buy_reached:b buy_near:b buy_to_go:6 sell_reached:b sell_near:b sell_to_go:6 warning_text")
def _(t):
    return _statuses(t).withColumn("warning_text", F.array_join("warnings", "; "))


@query("t03_targets_by_urgency", "target_id:i symbol urgency:i")
def _(t):
    return Tg.by_urgency(_statuses(t))


@query("w22_target_alerts", "target_id:i side trade_date:d close:4 level:4 event")
def _(t):
    states = written(L.day_states(t.transactions()).select("account_id", "symbol", "trade_date", "q", "q_open"))
    return Tg.alerts(Tg.target_days(written(t.targets()), written(t.stock_prices()), written(Tg.daily_holdings(states))))


@query("d08_trading_calendar", "symbol trade_date:d trading_day:b previous_session:d sessions_to_date:i")
def _(t):
    d = F.col("trade_date")
    return t.daily_prices().select(
        "symbol", "trade_date", D.is_trading_day(d).alias("trading_day"), D.previous_trading_day(d).alias("previous_session"),
        D.trading_days_between(d, F.lit("2001-11-30").cast("date")).alias("sessions_to_date"),
    )


@query("d15q_price_freshness", "symbol latest:d expected:d missed:i status")
def _(t):
    now = F.to_timestamp(F.lit("2001-11-07 13:30:00"))
    held = positions(t).filter("quantity > 0").select("symbol").distinct()
    rows = stock_quotes(t).join(held, "symbol").select("symbol", F.col("trade_date").alias("latest"), D.expected_latest_close(now).alias("expected"))
    return rows.withColumns({"missed": D.missed_sessions(F.col("latest"), F.col("expected")), "status": D.freshness(F.col("latest"), F.col("expected"))})
