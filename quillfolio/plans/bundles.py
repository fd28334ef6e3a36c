"""Compositions of operators that answer one page for every company at once."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import years_ago
from ..operators import features as Ft
from ..operators import fundamentals as Fu
from ..operators import insights as I
from ..sources.scratch import written


def stock_insights(features: DataFrame, restated: DataFrame, companies: DataFrame, today) -> DataFrame:
    """Range, valuation, band, fall and peers of every tracked company.

    ``features`` is the daily feature table, read once for the newest rows and once for
    the band.  The band uses earnings as reported against prices as traded; today's
    multiples use restated figures.
    """
    day = F.lit(today).cast("date")
    newest = written(Ft.latest_features(features, years_ago(day, 1)))
    rows = written(Fu.screener(companies, restated, newest))
    now = rows.select("symbol", "price", F.col("eps_basic").alias("eps"))
    band = I.band_of_days(features.filter(F.col("trade_date") >= years_ago(day, 5)), now).select(
        "symbol", F.col("median").alias("band_median"), F.col("rank").alias("band_rank")
    )
    peers = I.compare_with_peers(rows, ["pe"]).select("symbol", F.col("peers").alias("pe_peers"), F.col("rank").alias("pe_rank"))
    out = rows
    for part in (newest.select("symbol", "days", "has_year", "has_band", "own_position", "worst_fall"), band, peers):
        out = out.join(part, "symbol", "left")
    year_ok, band_ok = F.coalesce("has_year", F.lit(False)), F.coalesce("has_band", F.lit(False))
    return out.select(
        "symbol", F.coalesce("short_name", "name").alias("name"), "price", "trade_date", "change_pct", "pe", "pb", "dividend_yield",
        F.col("yearly_high").alias("year_high"), F.col("yearly_low").alias("year_low"),
        F.when(year_ok, F.col("own_position")).alias("own_position"), F.when(band_ok, F.col("band_median")).alias("band_median"),
        F.when(band_ok, F.col("band_rank")).alias("band_rank"), F.when(year_ok, F.col("worst_fall")).alias("worst_fall"),
        F.coalesce("days", F.lit(0)).alias("days"), "pe_peers", "pe_rank",
    )
