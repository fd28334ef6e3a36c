"""A daily feature table per symbol, which the pages read instead of the price history.

One row per (symbol, trading day) holds what the pages derive from the past: the previous close,
the 52-week range, the highest close so far, the number of days and the earnings known that day.
It is computed in one pass, or brought forward by some days from the rows that are stored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import ratio
from .prices import BAND_DAYS, YEAR_DAYS, YEAR_SPAN

FEATURES = ["symbol", "trade_date", "close", "high", "low", "ycp", "yearly_high", "yearly_low", "peak", "fall", "days", "eps"]


def _rows(df: DataFrame, kind: int, date: str = "trade_date", **known: Column) -> DataFrame:
    """Rows of one kind for the pass: earnings (0), stored days (1), new days (2)."""
    cols = {"close": "double", "high": "double", "low": "double", "_peak": "double", "_days": "long", "_year": "int", "_eps": "double"}
    return df.select("symbol", F.col(date).alias("_d"), F.lit(kind).alias("_k"), *[known.get(c, F.lit(None)).cast(t).alias(c) for c, t in cols.items()])


def _pass(rows: DataFrame) -> DataFrame:
    by_day = W.partitionBy("symbol").orderBy("_d", "_k", "_year")
    run, past = by_day.rowsBetween(W.unboundedPreceding, W.currentRow), by_day.rowsBetween(W.unboundedPreceding, -1)
    day = F.unix_date("_d")
    year = W.partitionBy("symbol").orderBy(day).rangeBetween(-YEAR_SPAN, 0)
    new = F.col("_k") == 2
    out = rows.select(
        "*", F.last("close", ignorenulls=True).over(past).alias("ycp"), F.max("high").over(year).alias("yearly_high"), F.min("low").over(year).alias("yearly_low"),
        F.max(F.greatest("close", F.coalesce("_peak", F.col("close")))).over(run).alias("peak"), F.last("_eps", ignorenulls=True).over(run).alias("eps"),
        (F.coalesce(F.max("_days").over(run), F.lit(0)) + F.count_if(new).over(run)).alias("days"),
    ).filter(new)
    return out.select("symbol", F.col("_d").alias("trade_date"), "close", "high", "low", "ycp", "yearly_high", "yearly_low", "peak", (F.try_divide(F.col("close"), F.col("peak")) - 1).alias("fall"), "days", "eps")


def daily_features(prices: DataFrame, earnings: DataFrame) -> DataFrame:
    """Features of every day: ``prices`` hold (symbol, trade_date, close, high, low), ``earnings`` (symbol, from_date, fiscal_year, eps).

    Earnings count from their day on; of two known from one day the later fiscal year does.
    A series holds at most one row a day, so a symbol's pass is bounded by the calendar.
    """
    priced = _rows(prices, 2, close=F.col("close"), high=F.col("high"), low=F.col("low"))
    return _pass(priced.unionByName(_rows(earnings, 0, "from_date", _year=F.col("fiscal_year"), _eps=F.col("eps"))))


def advance_features(stored: DataFrame, prices: DataFrame, earnings: DataFrame, since) -> DataFrame:
    """Features of the days from ``since`` on, from the stored rows before it and the days' prices.

    Of the stored rows only the last year's (for the 52-week range) and each symbol's newest (for what runs on)
    are used; of the earnings those that became known after it.  A corrected day or figure is
    taken in by advancing again from its day.
    """
    start = F.lit(since).cast("date")
    before = stored.filter(F.col("trade_date") < start)
    newest = before.groupBy("symbol").agg(F.max("trade_date").alias("trade_date"), *[F.max_by(c, "trade_date").alias(c) for c in ("close", "high", "low", "peak", "days", "eps")])
    tail = before.filter(F.col("trade_date") >= F.date_sub(start, YEAR_SPAN)).join(newest.select("symbol", F.col("trade_date").alias("_n")), "symbol").filter("trade_date < _n")
    carried = dict(close=F.col("close"), high=F.col("high"), low=F.col("low"), _peak=F.col("peak"), _days=F.col("days"), _eps=F.col("eps"))
    kept = _rows(newest, 1, **carried).unionByName(_rows(tail, 1, close=F.col("close"), high=F.col("high"), low=F.col("low")))
    later = earnings.join(newest.select("symbol", F.col("trade_date").alias("_n")), "symbol", "left").filter("_n is null or from_date > _n")
    priced = _rows(prices.filter(F.col("trade_date") >= start), 2, close=F.col("close"), high=F.col("high"), low=F.col("low"))
    return _pass(kept.unionByName(priced).unionByName(_rows(later, 0, "from_date", _year=F.col("fiscal_year"), _eps=F.col("eps"))))


def latest_features(features: DataFrame, year_start: Column) -> DataFrame:
    """Per symbol: its newest row's features, the worst fall, and where the newest close sits in the closes since ``year_start``.

    One aggregation over the feature table; a page joins it to what it knows of the company.
    """
    newest = [c for c in FEATURES if c not in ("symbol", "trade_date", "fall")]
    recent = F.when(F.col("trade_date") >= year_start, F.col("close"))
    out = features.groupBy("symbol").agg(
        F.max("trade_date").alias("trade_date"), *[F.max_by(c, "trade_date").alias(c) for c in newest],
        F.least(F.min("fall"), F.lit(0.0)).alias("worst_fall"), F.max(recent).alias("_hi"), F.min(recent).alias("_lo"),
    )
    place = F.when(F.col("_hi") > F.col("_lo"), ratio(F.col("close") - F.col("_lo"), F.col("_hi") - F.col("_lo")))
    return out.withColumns({"own_position": place, "has_year": F.col("days") >= YEAR_DAYS, "has_band": F.col("days") >= BAND_DAYS}).drop("_hi", "_lo")
