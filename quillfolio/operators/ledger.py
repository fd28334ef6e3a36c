"""Holdings, gains and cash derived from a trade ledger.

Cost is weighted average per (account, symbol) in trade-date order, and never
crosses accounts.  The order within a day is buys, rights, bonus, then sales and
dividends; sales of a day in ``txn_id`` order.

Shape of the computation: all additions of a day come before its sales, and a
sale leaves average cost alone, so the state after a day depends only on the
day's sums.  ``net_days`` therefore reduces the ledger to one row per (account,
symbol, day) with map-side partial aggregation, which bounds a key's sequence
by the calendar however many trades it holds; the windows run over that.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import near, ratio
from ..sources.scratch import written
from .scan import day_buckets, running_sums

POSITION = ["account_id", "symbol"]
DAY = POSITION + ["trade_date"]

# Fixed values.
EMPTY_BELOW = 1e-9
TRAILING_DAYS = 365

# Restart the running product of kept fractions at this (negative) logarithm.
STRETCH_LOG = 600.0

ADDS = ("buy", "rights", "bonus")
PAID = ("buy", "rights")
TRADES = ("buy", "sell", "rights")


def event_rank(txn_type: Column) -> Column:
    return F.when(txn_type == "buy", 0).when(txn_type == "rights", 1).when(txn_type == "bonus", 2).otherwise(3)


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def trade_value() -> Column:
    return _n("quantity") * _n("price_per_share")


def cash_flow() -> Column:
    """Cash leaving (negative) or arriving for one ledger row; bonus shares move none."""
    kind = F.col("txn_type")
    return (
        F.when(kind.isin(*PAID), -(trade_value() + _n("commission")))
        .when(kind == "sell", trade_value() - _n("commission"))
        .when(kind == "dividend", _n("gross_amount") - _n("tax_withheld"))
        .otherwise(F.lit(0.0))
    )


def with_cash_flow(txns: DataFrame) -> DataFrame:
    return txns.withColumn("cash", cash_flow())


def net_days(txns: DataFrame) -> DataFrame:
    """One row per (account, symbol, day): everything the day did, summed."""
    kind = F.col("txn_type")

    def total(cond: Column, value: Column) -> Column:
        return F.sum(F.when(cond, value).otherwise(F.lit(0.0)))

    sell, div = kind == "sell", kind == "dividend"
    return txns.groupBy(*DAY).agg(
        total(kind.isin(*ADDS), _n("quantity")).alias("in_qty"),
        total(kind.isin(*PAID), trade_value() + _n("commission")).alias("in_cost"),
        total(sell, _n("quantity")).alias("out_qty"),
        total(sell, trade_value()).alias("out_value"),
        total(sell, _n("commission")).alias("out_commission"),
        F.count_if(sell).alias("sales"),
        total(div, _n("gross_amount")).alias("dividend_gross"),
        total(div, _n("tax_withheld")).alias("dividend_tax"),
        F.count_if(~div).alias("trades"),
    )


def share_walk(txns: DataFrame) -> DataFrame:
    """Netted days with shares before and after each.

    Shares walk up and down and stop at zero: a running sum less its running
    minimum below zero.
    """
    key = W.partitionBy(*POSITION).orderBy("trade_date")
    run = key.rowsBetween(W.unboundedPreceding, W.currentRow)
    zero = F.lit(0.0)
    past = key.rowsBetween(W.unboundedPreceding, -1)
    walk = net_days(txns).withColumn("_cum", F.sum(F.col("in_qty") - F.col("out_qty")).over(run))

    def held(cum: Column, least: Column) -> Column:
        left = cum - F.least(zero, least)
        return F.when(left < EMPTY_BELOW, zero).otherwise(left)

    # Shares before a day from the sums before it, so that one window gives both.
    walk = walk.withColumns({"q": held(F.col("_cum"), F.min("_cum").over(run)), "q_open": F.coalesce(held(F.lag("_cum").over(key), F.min("_cum").over(past)), zero)})
    return walk.drop("_cum")


def day_states(txns: DataFrame) -> DataFrame:
    """Netted days with shares and cost before and after each.

    Each day's sales leave the fraction ``_r`` of the cost, so between full
    exits the cost is F * sum(paid * _r / F), F the running product of ``_r``.
    F restarts before it can underflow ("stretch"); the cost brought in from the
    stretch before is added, and any older one has by then been scaled below
    e**-600.
    """
    key = W.partitionBy(*POSITION)
    run = key.orderBy("trade_date").rowsBetween(W.unboundedPreceding, W.currentRow)
    past = key.orderBy("trade_date").rowsBetween(W.unboundedPreceding, -1)
    zero, one = F.lit(0.0), F.lit(1.0)

    walk = share_walk(txns)
    held = F.col("q_open") + F.col("in_qty")
    emptied = (F.col("sales") > 0) & (F.col("q") == 0)
    walk = walk.withColumn("_r", F.when(emptied | (held <= 0), one).otherwise(F.try_divide(F.col("q"), held)))
    walk = walk.select(
        "*",
        F.coalesce(F.sum(emptied.cast("int")).over(past), F.lit(0)).alias("_island"),
        F.floor(-F.sum(F.ln("_r")).over(run) / STRETCH_LOG).alias("_stretch"),
    )
    island = W.partitionBy(*POSITION, "_island").orderBy("_stretch", "trade_date")
    stretch = W.partitionBy(*POSITION, "_island", "_stretch").orderBy("trade_date").rowsBetween(W.unboundedPreceding, W.currentRow)
    cost = walk.withColumn("_f", F.product("_r").over(stretch))
    cost = cost.withColumn("_c", F.col("_f") * F.sum(F.try_divide(F.col("in_cost") * F.col("_r"), F.col("_f"))).over(stretch))
    cost = cost.withColumn("_before", F.coalesce(F.lag("_c").over(island), zero))
    cost = cost.withColumn("_c", F.col("_c") + F.col("_f") * F.first("_before").over(stretch))
    cost = cost.withColumn("c_open", F.coalesce(F.lag("_c").over(island), zero))
    out = cost.select(
        "*", F.when(emptied, zero).otherwise(F.col("_c")).alias("c"), F.least(F.col("out_qty"), held).alias("sold"),
        F.coalesce(F.try_divide(F.col("c_open") + F.col("in_cost"), held), zero).alias("average"),
    )
    return out.drop("_r", "_island", "_stretch", "_f", "_c", "_before")


def _sales(txns: DataFrame) -> DataFrame:
    return txns.filter(F.col("txn_type") == "sell").select(
        *DAY, "txn_id", _n("quantity").alias("quantity"), _n("price_per_share").alias("price_per_share"), _n("commission").alias("commission")
    )


def _short() -> Column:
    """Whether a day sold more than was held."""
    return F.coalesce(F.col("out_qty") > F.col("q_open") + F.col("in_qty"), F.lit(False))


def _fills(sales: DataFrame) -> DataFrame:
    """Sales of days that sold more than was held (written rows with ``available``): what each could deliver, in ``txn_id`` order within its day."""
    run = running_sums(day_buckets(sales, DAY, "txn_id"), DAY, ["bucket"], ["txn_id"], {"upto": "quantity"}).drop("bucket")
    left = F.greatest(F.col("available") - (F.col("upto") - F.col("quantity")), F.lit(0.0))
    return run.withColumn("left_before", left).withColumn("filled", F.least(F.col("quantity"), left)).drop("upto")


def _short_fills(txns: DataFrame, days: DataFrame) -> DataFrame:
    """``_fills`` of netted days with their shares.

    Only these days need the order of their sales; they are written to a scratch table, since the running sums read them twice.
    """
    short = days.filter(_short()).select(*DAY, (F.col("q_open") + F.col("in_qty")).alias("available"))
    return _fills(written(_sales(txns).join(short, DAY)))


def sale_gains(txns: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Every sale with the gain it realised against average cost that day.

    The sales are written once with their day's figures; only those of short days are read again and joined to what they could deliver.
    """
    states = day_states(txns) if states is None else states
    day = states.filter(F.col("sales") > 0).select(*DAY, "average", (F.col("q_open") + F.col("in_qty")).alias("available"), _short().alias("_short"))
    sales = written(_sales(txns).join(day, DAY))
    short = sales.filter("_short").drop("_short")
    fills = _fills(short).select(*DAY, "txn_id", "quantity", "filled", "left_before")
    row = DAY + ["txn_id", "quantity"]
    covered = sales.filter("not _short").drop("_short").withColumns({"filled": F.col("quantity"), "left_before": F.col("available")})
    filled = covered.unionByName(short.join(fills, row, "left").withColumns(
        {"filled": F.coalesce("filled", "quantity"), "left_before": F.coalesce("left_before", "available")}
    ))
    return filled.select(
        *DAY, "txn_id", "quantity", "price_per_share", "commission", "filled",
        (F.col("quantity") * F.col("price_per_share") - F.col("commission")).alias("proceeds"),
        (F.col("filled") * F.col("price_per_share") - F.col("commission")).alias("filled_proceeds"),
        (F.col("filled") * (F.col("price_per_share") - F.col("average")) - F.col("commission")).alias("gain"),
        F.when(F.col("quantity") > F.col("left_before") + EMPTY_BELOW, F.col("left_before")).alias("oversold_from"),
    )


def oversells(txns: DataFrame) -> DataFrame:
    """Sales of more shares than were held, with what was held.  The shares alone tell, without the cost."""
    fills = _short_fills(txns, share_walk(txns))
    return fills.filter(F.col("quantity") > F.col("left_before") + EMPTY_BELOW).select(*DAY, "txn_id", "quantity", F.col("left_before").alias("held"))


def day_ledger(txns: DataFrame) -> DataFrame:
    """Day states with the gain, proceeds and warnings of each day.

    The states are written to a scratch table, since they are read twice; only short days are joined to their sales.
    """
    states = written(day_states(txns).drop("c_open"))
    filled = (
        _short_fills(txns, states)
        .groupBy(*DAY)
        .agg(
            F.sum(F.col("filled") * F.col("price_per_share")).alias("filled_value"),
            F.count_if(F.col("quantity") > F.col("left_before") + EMPTY_BELOW).alias("oversold"),
        )
    )
    value = F.coalesce(F.col("filled_value"), F.col("out_value"))
    none = {"filled_value": F.lit(None).cast("double"), "oversold": F.lit(None).cast("long")}
    return (
        states.filter(~_short()).withColumns(none).unionByName(states.filter(_short()).join(filled, DAY, "left"))
        .withColumn("returned_sales", value - F.col("out_commission"))
        .withColumn("realised", F.col("returned_sales") - F.col("average") * F.col("sold"))
        .withColumn("warnings", F.coalesce(F.col("oversold"), F.lit(0)))
        .drop("filled_value", "oversold")
    )


def _valued(df: DataFrame) -> DataFrame:
    """The figures of a position that follow from its sums and a price."""
    q, c = F.col("quantity"), F.col("cost_basis")
    return (
        df.withColumn("unrealised_gain", F.col("market_value") - c)
        .withColumn("unrealised_pct", F.when(c > 0, F.try_divide(F.col("unrealised_gain"), c)))
        .withColumn("average_cost", F.when(q > 0, F.try_divide(c, q)))
        .withColumn("yield_on_cost", F.when((c > 0) & (F.col("dividends_ttm") > 0), F.try_divide(F.col("dividends_ttm"), c)))
        .withColumn("net_cost", F.col("invested") - F.col("returned"))
        .withColumn("net_cost_per_share", F.when(q > 0, F.try_divide(F.col("invested") - F.col("returned"), q)))
    )


def positions(txns: DataFrame, quotes: DataFrame | None, as_of, ledger: DataFrame | None = None) -> DataFrame:
    """One row per (account, symbol).  ``quotes`` hold (symbol, close)."""
    as_of = F.lit(as_of).cast("date")
    days = day_ledger(txns) if ledger is None else ledger
    traded = F.when(F.col("trades") > 0, F.col("trade_date"))
    recent = F.when(F.col("trade_date") >= F.date_sub(as_of, TRAILING_DAYS), F.col("dividend_gross")).otherwise(F.lit(0.0))
    net_dividend = F.col("dividend_gross") - F.col("dividend_tax")
    summed = days.groupBy(*POSITION).agg(
        F.max_by("q", "trade_date").alias("quantity"),
        F.max_by("c", "trade_date").alias("cost_basis"),
        F.sum("realised").alias("realised_gain"),
        F.sum("dividend_gross").alias("dividends_gross"),
        F.sum(net_dividend).alias("dividends_net"),
        F.sum(recent).alias("dividends_ttm"),
        F.sum("in_cost").alias("invested"),
        F.sum(F.col("returned_sales") + net_dividend).alias("returned"),
        F.min(traded).alias("first_trade"),
        F.max(traded).alias("last_trade"),
        F.sum("warnings").alias("warnings"),
    )
    base = summed
    if quotes is None:
        base = base.withColumn("close", F.lit(None).cast("double"))
    else:
        base = base.join(quotes.select("symbol", "close"), "symbol", "left")
    value = F.when(F.col("quantity") > 0, F.col("quantity") * F.col("close")).when(F.col("quantity") == 0, F.lit(0.0))
    return _valued(base.withColumn("market_value", value)).drop("close")


def merge_by_symbol(pos: DataFrame) -> DataFrame:
    """Positions summed over accounts; value is unknown if any part's is."""
    counts = (F.col("quantity") > 0) | (F.col("realised_gain") != 0)
    whole = F.when(F.count("market_value") == F.count(F.lit(1)), F.sum("market_value"))
    sums = ["quantity", "cost_basis", "realised_gain", "dividends_gross", "dividends_net", "dividends_ttm", "invested", "returned", "warnings"]
    merged = pos.groupBy("symbol").agg(
        F.when(F.count(F.lit(1)) == 1, F.lit(1)).otherwise(F.count_if(counts)).alias("account_count"),
        *[F.sum(c).alias(c) for c in sums],
        whole.alias("market_value"),
        F.min("first_trade").alias("first_trade"),
        F.max("last_trade").alias("last_trade"),
    )
    return _valued(merged)


def by_value(holdings: DataFrame) -> DataFrame:
    """Largest market value first; an unknown value counts as zero."""
    return holdings.orderBy(F.coalesce(F.col("market_value"), F.lit(0.0)).desc(), F.col("symbol"))


def account_summary(pos: DataFrame) -> DataFrame:
    """Totals per account; here an unknown value counts as zero."""
    return (
        pos.groupBy("account_id")
        .agg(
            F.sum("cost_basis").alias("total_cost"),
            F.coalesce(F.sum("market_value"), F.lit(0.0)).alias("total_market_value"),
            F.sum("realised_gain").alias("total_realised"),
            F.sum("dividends_gross").alias("total_dividends_gross"),
            F.count_if(F.col("quantity") > 0).alias("open_positions"),
        )
        .withColumn("total_unrealised", F.col("total_market_value") - F.col("total_cost"))
    )


def portfolio_summary(pos: DataFrame) -> DataFrame:
    """One row for everything in scope, with the weight of the largest holding."""
    holdings = pos.groupBy("symbol").agg(
        # A merged holding with an unpriced part has no value of its own.
        F.when(F.count("market_value") == F.count(F.lit(1)), F.sum("market_value")).alias("whole"),
        F.sum("market_value").alias("part"),
        *[F.sum(c).alias(c) for c in ("cost_basis", "realised_gain", "dividends_gross", "dividends_net")],
    )
    total = holdings.agg(
        F.sum("cost_basis").alias("total_cost"),
        F.coalesce(F.sum("part"), F.lit(0.0)).alias("total_market_value"),
        F.sum("realised_gain").alias("total_realised"),
        F.sum("dividends_gross").alias("total_dividends_gross"),
        F.sum("dividends_net").alias("total_dividends_net"),
        F.max(F.coalesce(F.col("whole"), F.lit(0.0))).alias("_largest"),
    )
    cost, value = F.col("total_cost"), F.col("total_market_value")
    return (
        total.withColumn("total_unrealised", value - cost)
        .withColumn("total_unrealised_pct", F.when(cost > 0, F.try_divide(value - cost, cost)))
        .withColumn("largest_weight", F.when(value > 0, F.try_divide(F.col("_largest"), value)))
        .drop("_largest")
    )


def sector_weights(holdings: DataFrame, sectors: DataFrame) -> DataFrame:
    """Market value and share of it per sector, over open holdings."""
    by_sector = (
        holdings.filter(F.col("quantity") > 0)
        .join(sectors.select("symbol", "sector"), "symbol", "left")
        .groupBy(F.coalesce(F.col("sector"), F.lit("Unclassified")).alias("sector"))
        .agg(F.sum(F.coalesce(F.col("market_value"), F.lit(0.0))).alias("market_value"))
    )
    total = by_sector.agg(F.sum("market_value")).scalar()
    return by_sector.withColumn("weight", ratio(F.col("market_value"), total))


def trading_stats(txns: DataFrame, gains: DataFrame) -> DataFrame:
    """Wins, losses, commission and turnover over every trade in scope."""
    scored = gains.agg(
        F.count(F.lit(1)).alias("sales"),
        F.count_if(F.col("gain") > 0).alias("wins"),
        F.count_if(F.col("gain") < 0).alias("losses"),
        F.sum("gain").alias("realised"),
        F.avg(F.when(F.col("gain") > 0, F.col("gain"))).alias("average_win"),
        F.avg(F.when(F.col("gain") < 0, F.col("gain"))).alias("average_loss"),
    )
    traded = txns.filter(F.col("txn_type").isin(*TRADES)).agg(
        F.struct(F.sum(_n("commission")).alias("commission"), F.sum(trade_value()).alias("turnover")).alias("both")
    )
    return (
        scored.withColumn("_t", traded.scalar()).select("*", "_t.commission", "_t.turnover").drop("_t")
        .withColumn("win_rate", ratio(F.col("wins"), F.col("sales")))
        .withColumn("commission_share", F.when(F.col("realised") + F.col("commission") > 0, ratio(F.col("commission"), F.col("realised") + F.col("commission"))))
    )


def symbol_stats(txns: DataFrame, gains: DataFrame) -> DataFrame:
    """Trades, commission and realised gain per symbol."""
    traded = txns.filter(F.col("txn_type").isin(*TRADES)).groupBy("symbol").agg(
        F.count_if(F.col("txn_type") != "sell").alias("buys"),
        F.count_if(F.col("txn_type") == "sell").alias("sells"),
        F.sum(_n("commission")).alias("commission"),
    )
    scored = gains.groupBy("symbol").agg(F.sum("gain").alias("_gain"))
    return traded.join(scored, "symbol", "left").withColumn("realised", F.coalesce(F.col("_gain"), F.lit(0.0))).drop("_gain")


def cost_timeline(txns: DataFrame) -> DataFrame:
    """Position in a symbol after every event, summed over accounts.

    Each event's change to its own account needs no running state beyond its
    day's; the changes are written to a scratch table and then accumulated per symbol, day by day.
    """
    kind, zero = F.col("txn_type"), F.lit(0.0)
    cols = ["symbol", "trade_date", "txn_id", "account_id", "txn_type", "quantity", "price_per_share", "cash"]
    paid = F.when(kind.isin(*PAID), trade_value() + _n("commission")).otherwise(zero)
    other = txns.filter(kind != "sell").withColumn("cash", cash_flow()).select(
        *cols, F.when(kind.isin(*ADDS), _n("quantity")).otherwise(zero).alias("dq"), paid.alias("dc"),
        F.when(kind == "dividend", -F.col("cash")).otherwise(paid).alias("dn"),
    )
    sold = sale_gains(txns).select(
        "symbol", "trade_date", "txn_id", "account_id", F.lit("sell").alias("txn_type"), "quantity", "price_per_share",
        F.col("proceeds").alias("cash"), (-F.col("filled")).alias("dq"),
        (F.col("gain") - F.col("filled_proceeds")).alias("dc"), (-F.col("filled_proceeds")).alias("dn"),
    )
    change = written(other.unionByName(sold).withColumn("rank", event_rank(kind)))
    change = day_buckets(change, ["symbol", "trade_date"], "txn_id")
    out = running_sums(
        change, ["symbol"], ["trade_date", "rank", "bucket"], ["txn_id", "account_id"],
        {"held": "dq", "cost": "dc", "net_cost": "dn"},
    )
    open_ = F.col("held") > EMPTY_BELOW
    return out.select(
        *cols, "held",
        F.when(open_, F.try_divide(F.col("cost"), F.col("held"))).alias("average_cost"),
        F.when(open_, F.try_divide(F.col("net_cost"), F.col("held"))).alias("net_cost_per_share"),
        "net_cost",
    )


def holdings_at(states: DataFrame, dates: DataFrame, date_col: str = "at", strict: bool = False) -> DataFrame:
    """Shares and cost at given dates: ``dates`` hold (account, symbol, date).

    The last state on or before the date (before it, when ``strict``).
    """
    nothing = F.lit(None).cast("double")
    probe = dates.select(*POSITION, F.col(date_col).alias("_d")).distinct().select(
        *POSITION, "_d", F.lit(0 if strict else 2).alias("_k"), nothing.alias("q"), nothing.alias("c")
    )
    known = states.select(*POSITION, F.col("trade_date").alias("_d"), F.lit(1).alias("_k"), "q", "c")
    w = W.partitionBy(*POSITION).orderBy("_d", "_k").rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = known.unionByName(probe).select(
        *POSITION, "_d", "_k",
        F.last("q", ignorenulls=True).over(w).alias("quantity"),
        F.last("c", ignorenulls=True).over(w).alias("cost_basis"),
    )
    return filled.filter(F.col("_k") != 1).select(*POSITION, F.col("_d").alias(date_col), "quantity", "cost_basis")


def commission_rates(txns: DataFrame) -> DataFrame:
    """Commission actually paid per account, and one row (null account) for all."""
    trades = txns.filter(F.col("txn_type").isin("buy", "sell"))
    per = trades.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("trades"), F.sum(trade_value()).alias("value"), F.sum(_n("commission")).alias("commission")
    )
    everyone = per.agg(
        F.lit(None).cast("string").alias("account_id"), F.sum("trades").alias("trades"),
        F.sum("value").alias("value"), F.sum("commission").alias("commission"),
    )
    few = (F.coalesce(F.col("trades"), F.lit(0)) < 3) | (F.coalesce(F.col("value"), F.lit(0.0)) <= 0)
    # Fixed value: the rate assumed until trades say otherwise.
    rate = F.when(few, F.lit(0.004)).otherwise(F.try_divide(F.col("commission"), F.col("value")))
    return per.unionByName(everyone).select("account_id", "trades", rate.alias("rate"))


def free_share_plan(holdings: DataFrame, quotes: DataFrame, rate: float = 0.005) -> DataFrame:
    """The sale that recovers all net cost and leaves the rest free, if there is one."""
    joined = holdings.join(quotes.select("symbol", "close"), "symbol", "left")
    sell = F.ceil(F.try_divide(F.col("net_cost"), F.col("close") * (1 - rate)) - 1e-9)
    ok = (F.col("close") > 0) & (F.col("quantity") > 0) & (F.col("net_cost") > 0) & (sell < F.col("quantity"))
    return joined.filter(ok).select("symbol", sell.alias("sell"), (F.col("quantity") - sell).alias("keep"))


def what_if(pos: DataFrame, plans: DataFrame) -> DataFrame:
    """Outcome of a sale then a buy-back for every (position, plan)."""
    j = pos.select(*POSITION, "quantity", "cost_basis", "net_cost").join(plans, POSITION)
    q, c, n = F.col("quantity"), F.col("cost_basis"), F.col("net_cost")
    average = F.when(q > 0, F.try_divide(c, q)).otherwise(F.lit(0.0))
    proceeds = F.col("sell_qty") * F.col("sell_price") * (1 - F.col("rate"))
    outlay = F.col("buy_qty") * F.col("buy_price") * (1 + F.col("rate"))
    bad = F.col("sell_qty") > q + 1e-9
    new_q = F.when(bad, q).otherwise(q - F.col("sell_qty") + F.col("buy_qty"))
    new_c = F.when(bad, c).otherwise(c - average * F.col("sell_qty") + outlay)
    new_n = F.when(bad, n).otherwise(n - proceeds + outlay)
    out = j.select(
        *POSITION, "plan_id", bad.alias("invalid"), new_q.alias("new_quantity"), new_c.alias("_c"), new_n.alias("new_net_cost"),
        F.when(bad, 0.0).otherwise(proceeds - average * F.col("sell_qty")).alias("plan_gain"),
        F.when(bad, 0.0).otherwise(outlay - proceeds).alias("cash_needed"),
    )
    return out.select(
        *[c for c in out.columns if c != "_c"],
        F.when(F.col("new_quantity") > 0, F.try_divide(F.col("_c"), F.col("new_quantity"))).alias("new_average_cost"),
        F.when(F.col("new_quantity") > 0, F.try_divide(F.col("new_net_cost"), F.col("new_quantity"))).alias("new_net_cost_per_share"),
    )


def event_order(txns: DataFrame) -> DataFrame:
    """Place of every event within its (account, symbol, day)."""
    ranked = day_buckets(txns.withColumn("rank", event_rank(F.col("txn_type"))).withColumn("_one", F.lit(1.0)), DAY, "txn_id")
    return running_sums(ranked, DAY, ["rank", "bucket"], ["txn_id"], {"place": "_one"}).drop("_one", "bucket")
