"""Registered queries of the price family."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prices as P
from .registry import query

PROBE_DATE = "1999-06-15"
RANGE_START = "2000-11-30"
PX = "symbol trade_date:d open:4 high:4 low:4 close:4 volume:2"


@query("w18_q_latest_quotes", PX + " turnover:2 trade_count:i")
def _(t):
    return P.latest_quotes(t.daily_prices())


@query("j05_closes_on_or_before", "symbol trade_date:d close:4")
def _(t):
    return P.closes_on_or_before(t.stock_prices(), PROBE_DATE)


@query("j05_closes_as_of_many_dates", "symbol at_date:d close:4")
def _(t):
    px = t.stock_prices()
    ends = px.select("symbol", F.last_day("trade_date").alias("at_date"))
    return P.closes_as_of(px, ends, "at_date")


@query("q_price_history", "symbol trade_date:d close:4")
def _(t):
    return t.daily_prices().select("symbol", "trade_date", "close").orderBy("symbol", "trade_date")


@query("w01_moving_averages", "symbol trade_date:d close:4 ma50:4 ma200:4")
def _(t):
    return P.moving_averages(t.daily_prices())


@query("w02_daily_returns", "symbol trade_date:d return:8")
def _(t):
    return P.daily_returns(t.daily_prices())


@query("w03_price_stats", "symbol typical_daily_move:6 volatility:6 change_month:6 change_quarter:6 change_year:6 ma50:4 ma200:4 above_ma50:6 above_ma200:6")
def _(t):
    return P.price_stats(t.daily_prices())


@query("w04_price_ranges", "symbol high:4 low:4 high_date:d low_date:d position:6 below_high:6 above_low:6 days:i")
def _(t):
    px = t.daily_prices()
    return P.range_over(px, F.lit(RANGE_START).cast("date"), P.latest_quotes(px))


@query("w05_drawdown", "symbol days:i worst:6 peak_date:d trough_date:d from_peak:6")
def _(t):
    return P.drawdown(t.daily_prices())


@query("w05_drawdown_by_stock", "symbol days:i worst:6 peak_date:d trough_date:d from_peak:6")
def _(t):
    return P.drawdown(t.stock_prices())


@query("w06_seasonality", "symbol extreme month:i month_name times:i years:i place:i")
def _(t):
    return P.seasonality(t.daily_prices())


@query("w20_chart_window", "symbol trade_date:d close:4 ma50:4 ma200:4")
def _(t):
    return P.chart_window(t.daily_prices(), "6M")


@query("a30_price_coverage", "symbol days:i from_date:d to_date:d full_years:i has_year:b has_band:b has_seasons:b")
def _(t):
    return P.coverage(t.daily_prices())


@query("f06_change_on_previous_close", "symbol trade_date:d close:4 ycp:4 change_pct:6 yearly_high:4 yearly_low:4")
def _(t):
    return P.change_on_previous(P.quoted(t.daily_prices()))


def _split(t):
    """Stored days, and an incoming file that corrects some of them and adds others."""
    px = t.daily_prices().select("symbol", "trade_date", "open", "high", "low", "close", "volume")
    day = F.dayofyear("trade_date")
    stored = px.filter(day % 3 != 0)
    incoming = px.filter((day % 2 == 0) | (day % 3 == 0)).withColumns({
        "close": F.col("close") + 1, "open": F.when(day % 4 == 0, F.col("open") + 1), "volume": F.when(day % 5 != 0, F.col("volume")),
        "low": F.lit(None).cast("double"),
    })
    return stored, incoming


@query("k01_upsert_replace", PX)
def _(t):
    return P.replace_prices(*_split(t))


@query("k02_upsert_coalesce", PX)
def _(t):
    return P.merge_prices(*_split(t))


@query("k03_merge_preview", "symbol rows:i from_date:d to_date:d replaces:i stored:i")
def _(t):
    return P.merge_preview(*_split(t))


@query("z3_daily_bars_from_ticks", "symbol day:d open:4 high:4 low:4 close:4 ticks:i")
def _(t):
    from ..streaming.bars import daily_bars

    return daily_bars(t.raw("events"))
