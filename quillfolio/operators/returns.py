"""Account returns from statement snapshots, and money-weighted returns from flows.

An account has at most one snapshot per day, and flows are netted per day, so
every per-account sequence is bounded by the calendar.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import round_half_up

# Fixed values.
MIN_DAYS_TO_ANNUALISE = 365
LOWEST_RATE = -0.9999


def net_contributions() -> Column:
    return F.col("deposit") + F.col("share_transfer_in") - F.col("withdraw") - F.col("share_transfer_out")


def account_worth() -> Column:
    return F.col("market_value") + F.col("cash_balance")


def latest_snapshots(snaps: DataFrame) -> DataFrame:
    rest = [c for c in snaps.columns if c not in ("account_id", "as_of")]
    return snaps.groupBy("account_id").agg(F.max("as_of").alias("as_of"), *[F.max_by(c, "as_of").alias(c) for c in rest])


def lifetime_returns(latest: DataFrame) -> DataFrame:
    """Gain over money put in, and what the named lines do not explain."""
    unrealised = F.col("market_value") - F.col("cost_of_holdings")
    rows = latest.select(
        "account_id", "as_of", net_contributions().alias("money_in"), account_worth().alias("worth"),
        F.col("realised_gain").alias("realised"), F.col("cash_dividend").alias("dividends"), unrealised.alias("unrealised"),
    ).withColumn("gain", F.col("worth") - F.col("money_in"))
    return rows.withColumns({
        "total_return": F.when(F.col("money_in") > 0, F.try_divide(F.col("gain"), F.col("money_in"))),
        "unexplained": F.col("gain") - (F.col("realised") + F.col("dividends") + F.col("unrealised")),
    })


def combined(latest: DataFrame, accounts: DataFrame) -> DataFrame:
    """All accounts on their latest snapshots; dated by the oldest, known only if none is missing."""
    j = accounts.select("account_id").join(latest, "account_id", "left")
    out = j.agg(
        F.count("as_of").alias("accounts"), F.count_if(F.col("as_of").isNull()).alias("missing"),
        F.sum("cash_balance").alias("cash"), F.min("as_of").alias("cash_as_of"),
        F.sum(F.col("deposit") + F.col("share_transfer_in")).alias("deposited"),
        F.sum(F.col("withdraw") + F.col("share_transfer_out")).alias("withdrawn"),
        F.sum(account_worth()).alias("equity"),
    )
    net = F.col("deposited") - F.col("withdrawn")
    return out.withColumns({
        "known": (F.col("accounts") > 0) & (F.col("missing") == 0), "net_invested": net, "gain": F.col("equity") - net,
        "total_return": F.when(net > 0, F.try_divide(F.col("equity") - net, net)),
    })


def _order() -> "W":
    return W.partitionBy("account_id").orderBy("as_of")


def period_returns(snaps: DataFrame) -> DataFrame:
    """Return between consecutive snapshots, flows taken at mid-period; null without a base."""
    rows = snaps.select("account_id", F.col("as_of").alias("to_date"), account_worth().alias("v1"), net_contributions().alias("n1"))
    w = W.partitionBy("account_id").orderBy("to_date")
    rows = rows.withColumns({
        "from_date": F.lag("to_date").over(w), "v0": F.lag("v1").over(w), "flow": F.col("n1") - F.lag("n1").over(w),
    }).filter("from_date is not null")
    base = F.col("v0") + 0.5 * F.col("flow")
    return rows.select(
        "account_id", "from_date", "to_date", "flow",
        F.when(base > 0, F.try_divide(F.col("v1") - F.col("v0") - F.col("flow"), base)).alias("return"),
    )


def yearly_returns(snaps: DataFrame) -> DataFrame:
    """Periods chained within the calendar year they end in."""
    out = period_returns(snaps).filter("return is not null").groupBy("account_id", F.year("to_date").alias("year")).agg(
        (F.product(1 + F.col("return")) - 1).alias("return"), F.min("from_date").alias("from_date"), F.max("to_date").alias("to_date")
    )
    whole = (F.col("from_date") <= F.make_date("year", F.lit(1), F.lit(7))) & (F.col("to_date") >= F.make_date("year", F.lit(12), F.lit(24)))
    return out.withColumn("complete", whole)


def since_first_snapshot(snaps: DataFrame) -> DataFrame:
    span = snaps.groupBy("account_id").agg(F.min("as_of").alias("from_date"), F.max("as_of").alias("to_date"), F.count(F.lit(1)).alias("n"))
    grown = period_returns(snaps).groupBy("account_id").agg((F.coalesce(F.product(1 + F.col("return")), F.lit(1.0)) - 1).alias("return"))
    return span.join(grown, "account_id", "left").select(
        "account_id", "from_date", "to_date", F.datediff("to_date", "from_date").alias("days"), F.when(F.col("n") > 1, F.col("return")).alias("return")
    )


def snapshot_movements(snaps: DataFrame) -> DataFrame:
    """Cash moved between consecutive statements; periods with no movement are left out."""
    change = lambda value: round_half_up(value - F.lag(value).over(_order()))
    moved = {
        "deposited": F.col("deposit"), "withdrawn": F.col("withdraw"), "dividends": F.col("cash_dividend"),
        "transferred_in": F.col("share_transfer_in"), "transferred_out": F.col("share_transfer_out"),
        "ipo_net": F.coalesce(F.col("ipo_refund"), F.lit(0.0)) - F.coalesce(F.col("ipo_payment"), F.lit(0.0)),
    }
    rows = snaps.select(
        "account_id", F.lag("as_of").over(_order()).alias("from_date"), F.col("as_of").alias("to_date"),
        *[change(v).alias(k) for k, v in moved.items()],
    ).filter("from_date is not null")
    return rows.filter(F.greatest(*[F.abs(F.col(k)) for k in moved]) >= 0.005)


def undated_movements(snaps: DataFrame, movements: DataFrame) -> DataFrame:
    """Snapshot movements of accounts that have no dated movements at all."""
    return snapshot_movements(snaps).join(movements.select("account_id").distinct(), "account_id", "left_anti")


# -- money-weighted return ------------------------------------------------------


def _value_and_slope(flows: Column, rate: Column) -> Column:
    """Present value of the flows at a rate, and its derivative."""
    def add(acc: Column, f: Column) -> Column:
        worth = f["a"] * F.pow(1 + rate, -f["t"])
        return F.struct((acc["v"] + worth).alias("v"), (acc["d"] - f["t"] * worth / (1 + rate)).alias("d"))

    return F.aggregate(flows, F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("d")), add)


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def _state(rate: Column, state) -> Column:
    return F.struct(rate.alias("rate"), (state if isinstance(state, Column) else F.lit(state)).alias("state"))


def _newton(flows: Column) -> Column:
    """Rate from 10% by Newton's steps, or null if they do not settle."""
    def step(acc: Column, _: Column) -> Column:
        def move(ignored: Column, s: Column) -> Column:
            nxt = acc["rate"] - F.try_divide(s["v"], s["d"])
            lost = nxt.isNull() | ~_finite(nxt) | (nxt <= LOWEST_RATE)
            settled = F.abs(nxt - acc["rate"]) < 1e-9
            return (
                F.when(F.abs(s["v"]) < 1e-7, _state(acc["rate"], 1)).when(lost | ~_finite(s["d"]), _state(acc["rate"], 2))
                .otherwise(_state(nxt, F.when(settled, 1).otherwise(0)))
            )

        # One evaluation of the value, used several times by the move.
        moved = F.aggregate(F.array(_value_and_slope(flows, acc["rate"])), acc, move)
        return F.when(acc["state"] != 0, acc).otherwise(moved)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(60)), _state(F.lit(0.1), 0), step)
    return F.when(end["state"] == 1, end["rate"])


def _bisected(flows: Column) -> Column:
    """Rate by halving [-0.9999, high], the bracket widened tenfold until its signs differ."""
    sign = lambda rate: F.signum(_value_and_slope(flows, rate)["v"])
    low = F.lit(LOWEST_RATE)
    highs = F.filter(F.array(*[F.lit(float(10**k)) for k in range(1, 7)]), lambda h: sign(h) * sign(low) <= 0)
    high = F.get(highs, F.lit(0))

    def halve(acc: Column, _: Column) -> Column:
        mid = acc["low"] + acc["width"] / 2
        return F.struct(F.when(sign(mid) == acc["sign"], mid).otherwise(acc["low"]).alias("low"), (acc["width"] / 2).alias("width"), acc["sign"].alias("sign"))

    start = F.struct(low.alias("low"), (high - low).alias("width"), sign(low).alias("sign"))
    return F.when(high.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, halve, lambda a: a["low"] + a["width"] / 2))


def xirr(flows: DataFrame, keys: list[str]) -> DataFrame:
    """Annual money-weighted return per key; ``flows`` hold (keys, flow_date, amount).

    Flows are netted per day first, so a key's array has at most one entry per
    calendar day.  Null without both a payment in and one out.
    """
    days = flows.groupBy(*keys, "flow_date").agg(
        F.sum("amount").alias("a"), F.count(F.lit(1)).alias("n"), F.min("amount").alias("least"), F.max("amount").alias("most")
    )
    per = days.groupBy(*keys).agg(
        F.collect_list(F.struct("flow_date", "a")).alias("_f"), F.min("flow_date").alias("first_date"),
        F.sum("n").alias("flows"), F.min("least").alias("least"), F.max("most").alias("most"),
    )
    timed = F.transform(
        F.array_sort("_f"), lambda f: F.struct((F.datediff(f["flow_date"], F.col("first_date")) / 365.0).alias("t"), f["a"].alias("a"))
    )
    per = per.withColumn("_f", timed)
    defined = (F.col("flows") >= 2) & (F.col("least") < 0) & (F.col("most") > 0)
    rate = F.when(defined, F.coalesce(_newton(F.col("_f")), _bisected(F.col("_f"))))
    return per.select(*keys, "first_date", "flows", rate.alias("rate"))


def portfolio_returns(flows: DataFrame, worth: DataFrame, as_of, keys: list[str]) -> DataFrame:
    """Money-weighted return per key: dated flows, then the worth at ``as_of`` as if sold.

    ``worth`` holds (keys, worth).  No rate below a year of history.
    """
    day = F.lit(as_of).cast("date")
    real = flows.filter("amount <> 0").select(*keys, "flow_date", "amount")
    closing = worth.filter("worth > 0").select(*keys, day.alias("flow_date"), F.col("worth").alias("amount"))
    first = real.groupBy(*keys).agg(F.min("flow_date").alias("first_flow"))
    out = first.join(xirr(real.unionByName(closing), keys).select(*keys, "rate"), keys, "left")
    days = F.datediff(day, F.col("first_flow"))
    return out.withColumn("days", days).withColumn("rate", F.when(F.col("days") >= MIN_DAYS_TO_ANNUALISE, F.col("rate")))


def account_returns(movements: DataFrame, latest: DataFrame) -> DataFrame:
    """Money-weighted return of each account from its deposits and withdrawals and its last worth."""
    external = movements.filter(F.col("kind").isin("deposit", "withdrawal"))
    mine = external.select("account_id", F.col("move_date").alias("flow_date"), (-F.col("amount")).alias("amount"))
    closing = latest.select("account_id", F.col("as_of").alias("flow_date"), account_worth().alias("amount"))
    first = external.groupBy("account_id").agg(F.min("move_date").alias("first_date"))
    rates = xirr(mine.unionByName(closing), ["account_id"]).select("account_id", "rate")
    out = latest.select("account_id", "as_of").join(first, "account_id", "left").join(rates, "account_id", "left")
    days = F.coalesce(F.datediff("as_of", "first_date"), F.lit(0))
    return out.withColumn("days", days).withColumn("rate", F.when(F.col("days") >= MIN_DAYS_TO_ANNUALISE, F.col("rate")))


# -- cash page and income years -------------------------------------------------


def cash_overview(snaps: DataFrame, txns: DataFrame, movements: DataFrame) -> DataFrame:
    """Cash, flows and pending applications of each account, from its latest statement."""
    latest = latest_snapshots(snaps)
    later = (
        txns.filter("txn_type <> 'bonus'").join(latest.select("account_id", "as_of"), "account_id")
        .filter("trade_date > as_of").groupBy("account_id").agg(F.count(F.lit(1)).alias("later_trades"))
    )
    dated = movements.select("account_id").distinct().withColumn("dated", F.lit(True))
    return latest.join(later, "account_id", "left").join(dated, "account_id", "left").select(
        "account_id", "as_of", F.col("cash_balance").alias("cash"), account_worth().alias("worth"),
        (F.col("deposit") + F.col("share_transfer_in")).alias("deposited"), (F.col("withdraw") + F.col("share_transfer_out")).alias("withdrawn"),
        net_contributions().alias("net_invested"), F.col("cash_dividend").alias("dividends"),
        F.greatest(F.lit(0.0), F.col("ipo_payment") - F.col("ipo_refund")).alias("ipo_pending"),
        F.coalesce("later_trades", F.lit(0)).alias("later_trades"), F.coalesce("dated", F.lit(False)).alias("dated"),
    )


def investing_costs(txns: DataFrame, movements: DataFrame) -> DataFrame:
    """What investing has cost per account: commission, fees and tax on dividends."""
    traded = txns.groupBy("account_id").agg(
        F.sum("commission").alias("commission"), F.sum(F.when(F.col("txn_type") == "dividend", F.col("tax_withheld")).otherwise(0.0)).alias("dividend_tax")
    )
    fees = movements.filter("kind = 'fee'").groupBy("account_id").agg((-F.sum("amount")).alias("fees"))
    out = traded.join(fees, "account_id", "full_outer").na.fill(0.0, ["commission", "dividend_tax", "fees"])
    return out.withColumn("total_cost", F.col("commission") + F.col("fees") + F.col("dividend_tax"))
