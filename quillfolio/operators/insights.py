"""Valuation against a company's own past and its peers, and price scenarios."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.dates import PUBLICATION_LAG_DAYS
from ..sources.scratch import written
from .fundamentals import with_period_end
from .scan import ranges, running_sums

# Fixed value: days a ratio must be known for before a band is shown.
MIN_BAND_DAYS = 60
MIN_PEERS = 3


def earnings_timeline(wide: DataFrame, companies: DataFrame) -> DataFrame:
    """Earnings per share as reported, from the day the market could know them."""
    return with_period_end(wide, companies).filter("eps_basic is not null").select(
        "symbol", F.date_add("period_end", PUBLICATION_LAG_DAYS).alias("from_date"), "fiscal_year", F.col("eps_basic").alias("eps")
    )


def earnings_known(prices: DataFrame, earnings: DataFrame) -> DataFrame:
    """Each trading day with the latest earnings known on it (same day included)."""
    days = prices.select("symbol", F.col("trade_date").alias("_d"), F.lit(1).alias("_k"), "close", F.lit(None).cast("int").alias("_fy"), F.lit(None).cast("double").alias("eps"))
    known = earnings.select("symbol", F.col("from_date").alias("_d"), F.lit(0).alias("_k"), F.lit(None).cast("double").alias("close"), F.col("fiscal_year").cast("int").alias("_fy"), "eps")
    w = W.partitionBy("symbol").orderBy("_d", "_k", "_fy").rowsBetween(W.unboundedPreceding, W.currentRow)
    return days.unionByName(known).withColumn("eps", F.last("eps", ignorenulls=True).over(w)).filter("_k = 1").select(
        "symbol", F.col("_d").alias("trade_date"), "close", "eps"
    )


def pe_band(prices: DataFrame, earnings: DataFrame, now: DataFrame, start: Column) -> DataFrame:
    """Quartiles of the price-earnings ratio since ``start`` and where today's sits.

    ``now`` holds (symbol, price, eps).  Days with earnings at or below zero are
    dropped, not filled from an older figure.
    """
    return band_of_days(earnings_known(prices.filter(F.col("trade_date") >= start), earnings), now)


def band_of_days(days: DataFrame, now: DataFrame) -> DataFrame:
    """The band of ``pe_band`` from days that carry their close and the earnings known on them."""
    ratios = days.filter("eps > 0").select("symbol", "trade_date", F.try_divide(F.col("close"), F.col("eps")).alias("pe"))
    joined = ratios.join(now.select("symbol", "price", F.col("eps").alias("eps_now")), "symbol")
    current = F.when(F.col("eps_now") > 0, F.try_divide(F.col("price"), F.col("eps_now")))
    out = joined.withColumn("current", current).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("samples"), F.min("trade_date").alias("from_date"), F.max("trade_date").alias("to_date"),
        F.percentile("pe", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_p"),
        F.max("current").alias("current"), F.max("eps_now").alias("eps_now"),
        F.count_if(F.col("pe") < F.col("current")).alias("_below"), F.count_if(F.col("pe") == F.col("current")).alias("_equal"),
    ).filter(F.col("samples") >= MIN_BAND_DAYS)
    at = lambda i: F.get("_p", F.lit(i))
    priced = lambda i: F.when(F.col("eps_now") > 0, at(i) * F.col("eps_now"))
    return out.select(
        "symbol", "samples", "from_date", "to_date", at(0).alias("low"), at(1).alias("median"), at(2).alias("high"), "current",
        F.when(F.col("current").isNotNull(), F.try_divide(F.col("_below") + F.col("_equal") / 2, F.col("samples"))).alias("rank"),
        priced(0).alias("price_at_low"), priced(1).alias("price_at_median"), priced(2).alias("price_at_high"),
    )


def compare_with_peers(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Each company's ratio against the same ratio of all the others.

    ``rows`` hold (symbol, metrics...).  Instead of pairing companies, equal
    values are counted once, their counts accumulated in value order over
    buckets, and the company itself is taken out of the totals.  The values and their
    counts are read several times, so both are written to scratch tables.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    long = written(rows.select("symbol", F.inline(pairs)).filter((F.col("value") > 0) & (F.col("value") < float("inf"))))
    counts = long.groupBy("metric", "value").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # Buckets are cut by how many values there are, however they crowd together.
    counts = ranges(counts, ["metric", "value"], long.count())
    ranked = running_sums(counts, ["metric"], ["bucket"], ["value"], {"upto": "n"}).withColumn("below", F.col("upto") - F.col("n"))
    totals = counts.groupBy("metric").agg(F.sum("n").alias("total"))
    ranked = ranked.join(totals, "metric")
    others = F.col("total") - 1
    low = F.floor((others - 1) / 2)
    # The few values around the middle; the company's own place shifts them by one.
    middle = ranked.filter((F.col("upto") > low) & (F.col("below") <= low + 2)).groupBy("metric").agg(
        F.collect_list(F.struct("below", "upto", "value")).alias("_mid")
    )
    j = long.join(ranked, ["metric", "value"]).join(middle, "metric").filter(others >= MIN_PEERS)

    def at(k: Column) -> Column:
        place = k + F.when(k >= F.col("below"), 1).otherwise(0)
        return F.get(F.filter("_mid", lambda m: (m["below"] <= place) & (place < m["upto"])), F.lit(0))["value"]

    median = F.when(others % 2 == 1, at(low)).otherwise((at(low) + at(low + 1)) / 2)
    return j.select(
        "symbol", "metric", "value", others.cast("long").alias("peers"), median.alias("median"),
        F.try_divide(F.col("below") + (F.col("n") - 1) / 2, others).alias("rank"), (F.col("total") - F.col("upto")).cast("long").alias("cheaper_than"),
    )


# The levels that a scenario looks at, what each is called, and what it rests on.
LEVELS = [
    ("year_low", "lowest price of the year", "prices"),
    ("year_high", "highest price of the year", "prices"),
    ("price_at_low", "price at the lower quartile of past ratios", "earnings"),
    ("price_at_median", "price at the median of past ratios", "earnings"),
    ("price_at_high", "price at the upper quartile of past ratios", "earnings"),
    ("break_even", "sale without gain or loss", "cost and commission"),
    ("buy_below", "level to buy at", "target"),
    ("sell_above", "level to sell at", "target"),
]


def scenarios(rows: DataFrame) -> DataFrame:
    """What each level means for a holding: the move to it, value and gain there."""
    levels = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(basis).alias("basis"), F.col(c).alias("level")) for c, label, basis in LEVELS])
    out = rows.select("symbol", "price", "quantity", "cost_basis", F.inline(levels)).filter("level > 0")
    value = F.when(F.col("quantity") > 0, F.col("quantity") * F.col("level"))
    return out.select(
        "symbol", "label", "basis", "level", F.when(F.col("price") > 0, F.try_divide(F.col("level"), F.col("price")) - 1).otherwise(F.lit(0.0)).alias("move"),
        value.alias("value"), (value - F.col("cost_basis")).alias("gain"),
        F.when(F.col("cost_basis") > 0, F.try_divide(value - F.col("cost_basis"), F.col("cost_basis"))).alias("gain_pct"),
    ).orderBy("symbol", "level")
