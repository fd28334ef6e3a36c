"""Income-year (July to June) reports from the ledger and cash movements."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.dates import income_year, income_year_end
from .ledger import POSITION, TRADES, cash_flow, day_states, sale_gains


def year_lines(txns: DataFrame, movements: DataFrame) -> DataFrame:
    """Per (account, income year): dividends, sales, commission and cash flows."""
    kind = F.col("txn_type")
    moved = txns.groupBy("account_id", income_year(F.col("trade_date")).alias("year")).agg(
        F.sum(F.when(kind == "dividend", F.col("gross_amount"))).alias("dividend_gross"),
        F.sum(F.when(kind == "dividend", F.col("tax_withheld"))).alias("dividend_tax"),
        F.count_if(kind == "sell").alias("sales"),
        F.sum(F.when(kind.isin(*TRADES), F.col("commission"))).alias("commission"),
    )
    gains = sale_gains(txns).groupBy("account_id", income_year(F.col("trade_date")).alias("year")).agg(F.sum("gain").alias("realised"))
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("amount")))
    cash = movements.groupBy("account_id", income_year(F.col("move_date")).alias("year")).agg(
        of("deposit").alias("deposited"), F.abs(of("withdrawal")).alias("withdrawn"), F.abs(of("fee")).alias("fees")
    )
    keys = ["account_id", "year"]
    out = moved.join(gains, keys, "left").join(cash, keys, "full_outer")
    sums = ["dividend_gross", "dividend_tax", "sales", "commission", "realised", "deposited", "withdrawn", "fees"]
    out = out.select(*keys, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in sums])
    return out.withColumn("dividend_net", F.col("dividend_gross") - F.col("dividend_tax"))


def held_at_year_ends(txns: DataFrame, last_year: int) -> DataFrame:
    """Shares and cost on every 30 June from a position's first trade on.

    Only years with a trade have a state of their own; the state is carried to
    the years in between by opening each state up to the year before the next.
    """
    states = day_states(txns).withColumn("year", income_year(F.col("trade_date")))
    ends = states.groupBy(*POSITION, "year").agg(F.max_by("q", "trade_date").alias("q"), F.max_by("c", "trade_date").alias("c"))
    following = F.coalesce(F.lead("year").over(W.partitionBy(*POSITION).orderBy("year")) - 1, F.lit(last_year))
    spread = ends.withColumn("_to", following).filter("_to >= year").select(
        *POSITION, F.explode(F.sequence("year", "_to")).alias("year"), "q", "c"
    )
    return spread.filter("q > 0").select(
        *POSITION, "year", income_year_end(F.col("year")).alias("year_end"), F.col("q").alias("quantity"),
        F.col("c").alias("cost_basis"), F.try_divide(F.col("c"), F.col("q")).alias("average_cost"),
    )


def cash_at_year_ends(txns: DataFrame, movements: DataFrame, covered: DataFrame, last_year: int) -> DataFrame:
    """Cash rebuilt from movements and trades, for accounts a ledger covers in full.

    ``covered`` holds (account_id, complete, reach): accounts whose imports run
    from a zero opening without gaps, and the date they reach.
    """
    trades = txns.filter(F.col("txn_type").isin(*TRADES)).select("account_id", income_year(F.col("trade_date")).alias("year"), cash_flow().alias("cash"))
    moves = movements.select("account_id", income_year(F.col("move_date")).alias("year"), F.col("amount").alias("cash"))
    yearly = trades.unionByName(moves).groupBy("account_id", "year").agg(F.sum("cash").alias("cash"))
    w = W.partitionBy("account_id").orderBy("year")
    run = yearly.select(
        "account_id", "year", F.sum("cash").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("cash_at_end"),
        F.coalesce(F.lead("year").over(w) - 1, F.lit(last_year)).alias("_to"),
    )
    out = run.filter("_to >= year").select("account_id", F.explode(F.sequence("year", "_to")).alias("year"), "cash_at_end")
    out = out.join(covered.select("account_id", "reach"), "account_id", "left")
    known = F.coalesce(F.col("reach") >= income_year_end(F.col("year")), F.lit(False))
    return out.select("account_id", "year", known.alias("known"), F.when(known, F.col("cash_at_end")).alias("cash_at_end"))
