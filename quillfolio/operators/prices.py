"""Daily price series: latest quotes, averages, ranges, drawdowns, seasons, merges.

A series holds at most one row per (symbol, calendar day), so a window over a
symbol is bounded by the calendar.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import ratio

# Fixed values.
TRADING_DAYS = 250
CHART_RANGES = {"1M": 21, "3M": 63, "6M": 126, "1Y": 250}
YEAR_DAYS, BAND_DAYS, SEASON_DAYS = 200, 250, 180
YEAR_SPAN = 365
MONTH_NAMES = "January February March April May June July August September October November December".split()


def series(*order) -> "W":
    return W.partitionBy("symbol").orderBy(*(order or ("trade_date",)))


def latest_quotes(prices: DataFrame) -> DataFrame:
    """Newest row per symbol."""
    rest = [c for c in prices.columns if c not in ("symbol", "trade_date")]
    # Column by column: fixed-width buffers keep this a hash aggregation.
    return prices.groupBy("symbol").agg(F.max("trade_date").alias("trade_date"), *[F.max_by(c, "trade_date").alias(c) for c in rest])


def closes_on_or_before(prices: DataFrame, date) -> DataFrame:
    """Last close at or before one date, per symbol."""
    return latest_quotes(prices.filter(F.col("trade_date") <= F.lit(date).cast("date")).select("symbol", "trade_date", "close"))


def closes_as_of(prices: DataFrame, probes: DataFrame, date_col: str) -> DataFrame:
    """Last close at or before each probe date: ``probes`` hold (symbol, date)."""
    ask = probes.select("symbol", F.col(date_col).alias("_d")).distinct()
    rows = prices.select("symbol", F.col("trade_date").alias("_d"), F.lit(0).alias("_k"), "close").unionByName(
        ask.select("symbol", "_d", F.lit(1).alias("_k"), F.lit(None).cast("double").alias("close"))
    )
    seen = series("_d", "_k").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("close", F.last("close", ignorenulls=True).over(seen)).filter("_k = 1").select(
        "symbol", F.col("_d").alias(date_col), "close"
    )


def quoted(prices: DataFrame) -> DataFrame:
    """Prices with the previous close and the 52-week range up to each day."""
    day = F.unix_date("trade_date")
    year = W.partitionBy("symbol").orderBy(day).rangeBetween(-YEAR_SPAN, 0)
    return prices.select(
        "*", F.lag("close").over(series()).alias("ycp"),
        F.max("high").over(year).alias("yearly_high"), F.min("low").over(year).alias("yearly_low"),
    )


def _moving(n: int) -> Column:
    w = series().rowsBetween(-(n - 1), 0)
    return F.when(F.count("close").over(w) == n, F.avg("close").over(w))


def moving_averages(prices: DataFrame, windows=(50, 200)) -> DataFrame:
    """Mean of the last n closes; null until n are there."""
    return prices.select("*", *[_moving(n).alias(f"ma{n}") for n in windows])


def daily_returns(prices: DataFrame) -> DataFrame:
    """Day-to-day returns; days after a non-positive close are left out."""
    before = F.lag("close").over(series())
    return (
        prices.select("symbol", "trade_date", "close", before.alias("previous"))
        .filter("previous > 0")
        .withColumn("return", F.try_divide(F.col("close"), F.col("previous")) - 1)
    )


def price_stats(prices: DataFrame) -> DataFrame:
    """Typical move, volatility, changes and distance from averages, on the last day."""
    def change(days: int) -> Column:
        then = F.lag("close", days).over(series())
        return F.when(then > 0, F.try_divide(F.col("close"), then) - 1)

    rows = prices.select(
        "symbol", "trade_date", "close",
        F.lag("close").over(series()).alias("_was"),
        F.row_number().over(series(F.desc("trade_date"))).alias("_back"),
        change(21).alias("change_month"), change(63).alias("change_quarter"), change(TRADING_DAYS).alias("change_year"),
        _moving(50).alias("ma50"), _moving(200).alias("ma200"),
    )
    move = F.when(F.col("_was") > 0, F.try_divide(F.col("close"), F.col("_was")) - 1)
    rows = rows.withColumn("_move", move)
    # The last 250 returns, not the last 250 rows: days without one do not count.
    nth = F.count("_move").over(series(F.desc("trade_date")).rowsBetween(W.unboundedPreceding, W.currentRow))
    recent = F.when(F.col("_n") <= TRADING_DAYS, F.col("_move"))
    out = rows.withColumn("_n", nth).groupBy("symbol").agg(
        F.avg(F.abs(recent)).alias("typical_daily_move"),
        F.sqrt(F.var_samp(recent) * TRADING_DAYS).alias("volatility"),
        *[F.max_by(c, "trade_date").alias(c) for c in ("close", "change_month", "change_quarter", "change_year", "ma50", "ma200")],
    )
    above = lambda ma: F.when(F.col(ma) > 0, F.try_divide(F.col("close"), F.col(ma)) - 1)
    return out.withColumns(
        {"above_ma50": above("ma50"), "above_ma200": above("ma200")}
    )


def range_over(prices: DataFrame, start: Column, quotes: DataFrame) -> DataFrame:
    """High, low (first day of each on ties) and where the price sits, since ``start``."""
    early = -F.unix_date("trade_date")
    window = prices.filter(F.col("trade_date") >= start).groupBy("symbol").agg(
        F.max(F.struct("close", early.alias("d"))).alias("_h"),
        F.min(F.struct("close", F.unix_date("trade_date").alias("d"))).alias("_l"),
        F.count(F.lit(1)).alias("days"),
    )
    flat = window.select(
        "symbol", "days", F.col("_h.close").alias("high"), F.date_from_unix_date(-F.col("_h.d")).alias("high_date"),
        F.col("_l.close").alias("low"), F.date_from_unix_date(F.col("_l.d")).alias("low_date"),
    ).join(quotes.select("symbol", F.col("close").alias("price")), "symbol")
    p, hi, lo = F.col("price"), F.col("high"), F.col("low")
    return flat.withColumns({
        "position": F.when(hi > lo, F.try_divide(p - lo, hi - lo)),
        "below_high": F.when(hi > 0, F.try_divide(p, hi) - 1).otherwise(F.lit(0.0)),
        "above_low": F.when(lo > 0, F.try_divide(p, lo) - 1).otherwise(F.lit(0.0)),
    })


def drawdown(prices: DataFrame) -> DataFrame:
    """Deepest fall from a running peak, its dates, and the fall from the peak now."""
    run = series().rowsBetween(W.unboundedPreceding, W.currentRow)
    # The earliest day of the highest close so far.
    peak = F.max(F.struct("close", (-F.unix_date("trade_date")).alias("d"))).over(run)
    falls = prices.select("symbol", "trade_date", "close", peak.alias("_p")).withColumn(
        "fall", F.try_divide(F.col("close"), F.col("_p.close")) - 1
    )
    out = falls.groupBy("symbol").agg(
        F.min(F.struct("fall", "trade_date", F.col("_p.d").alias("d"))).alias("_w"),
        F.max_by(F.struct("fall", "_p"), "trade_date").alias("_l"),
        F.count(F.lit(1)).alias("days"),
    ).filter("days >= 2")
    below = F.col("_w.fall") < 0
    return out.select(
        "symbol", "days", F.least(F.col("_w.fall"), F.lit(0.0)).alias("worst"),
        F.when(below, F.date_from_unix_date(-F.col("_w.d"))).alias("peak_date"),
        F.when(below, F.col("_w.trade_date")).alias("trough_date"),
        F.when(F.col("_l._p.close") > 0, F.col("_l.fall")).otherwise(F.lit(0.0)).alias("from_peak"),
    )


def _full_years(prices: DataFrame, min_days: int) -> DataFrame:
    day = F.unix_date("trade_date")
    return prices.groupBy("symbol", F.year("trade_date").alias("year")).agg(
        F.count(F.lit(1)).alias("days"),
        F.max(F.struct("close", (-day).alias("d"))).alias("_h"),
        F.min(F.struct("close", day.alias("d"))).alias("_l"),
    ).filter(F.col("days") >= min_days)


def seasonality(prices: DataFrame, min_days: int = SEASON_DAYS) -> DataFrame:
    """Months in which a full year's high and low fell, counted, with their rank."""
    years = _full_years(prices, min_days).select(
        "symbol", "year",
        F.explode(F.array(
            F.struct(F.lit("high").alias("extreme"), F.month(F.date_from_unix_date(-F.col("_h.d"))).alias("month")),
            F.struct(F.lit("low").alias("extreme"), F.month(F.date_from_unix_date(F.col("_l.d"))).alias("month")),
        )).alias("e"),
    ).select("symbol", "e.*")
    counts = years.groupBy("symbol", "extreme", "month").agg(F.count(F.lit(1)).alias("times"))
    group = W.partitionBy("symbol", "extreme")
    name = F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.col("month"))
    return (
        counts.withColumn("years", F.sum("times").over(group)).filter("years >= 2")
        .withColumn("place", F.row_number().over(group.orderBy(F.desc("times"), "month")))
        .withColumn("month_name", name)
    )


def coverage(prices: DataFrame) -> DataFrame:
    """How much history there is and what it is enough for."""
    years = prices.groupBy("symbol", F.year("trade_date").alias("year")).agg(
        F.count(F.lit(1)).alias("d"), F.min("trade_date").alias("a"), F.max("trade_date").alias("b")
    )
    out = years.groupBy("symbol").agg(
        F.sum("d").alias("days"), F.min("a").alias("from_date"), F.max("b").alias("to_date"),
        F.count_if(F.col("d") >= SEASON_DAYS).alias("full_years"),
    )
    return out.withColumns({
        "has_year": F.col("days") >= YEAR_DAYS, "has_band": F.col("days") >= BAND_DAYS, "has_seasons": F.col("full_years") >= 2,
    })


def chart_window(prices: DataFrame, span: str = "6M") -> DataFrame:
    """Closes and averages for a chart: averages over all history, then cut."""
    rows = moving_averages(prices.select("symbol", "trade_date", "close")).withColumn(
        "_back", F.row_number().over(series(F.desc("trade_date")))
    )
    return rows.filter(F.col("_back") <= CHART_RANGES[span]).drop("_back")


def change_on_previous(quotes: DataFrame) -> DataFrame:
    return quotes.withColumn("change_pct", F.when(F.col("ycp") > 0, F.try_divide(F.col("close"), F.col("ycp")) - 1))


# -- keyed merges ---------------------------------------------------------------

KEY = ["symbol", "trade_date"]


def replace_prices(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert on (symbol, day): an incoming row replaces the stored one whole."""
    return stored.join(incoming.select(*KEY), KEY, "left_anti").unionByName(incoming, allowMissingColumns=True)


def merge_prices(stored: DataFrame, incoming: DataFrame, fields: Sequence[str] = ("close", "open", "high", "low", "volume")) -> DataFrame:
    """Upsert keeping a stored field where the new one is missing."""
    old = stored.select(*KEY, *[F.col(c).alias(f"_o_{c}") for c in fields])
    new = incoming.select(*KEY, *[F.col(c).alias(f"_n_{c}") for c in fields])
    return old.join(new, KEY, "full_outer").select(
        *KEY, *[F.coalesce(F.col(f"_n_{c}"), F.col(f"_o_{c}")).alias(c) for c in fields]
    )


def merge_preview(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows, span, days that would be replaced and days stored, per symbol."""
    have = stored.select(*KEY).withColumn("_s", F.lit(True))
    return have.join(incoming.select(*KEY).withColumn("_i", F.lit(True)), KEY, "full_outer").groupBy("symbol").agg(
        F.count("_i").alias("rows"),
        F.min(F.when(F.col("_i"), F.col("trade_date"))).alias("from_date"),
        F.max(F.when(F.col("_i"), F.col("trade_date"))).alias("to_date"),
        F.count_if(F.col("_i") & F.col("_s")).alias("replaces"),
        F.count("_s").alias("stored"),
    ).filter("rows > 0")
