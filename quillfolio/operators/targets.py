"""Price targets: where the price stands against them, and when they are crossed."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scan import dealt

# Fixed value: within this share of the price counts as near.
NEAR = 0.02


def break_even(average_cost: Column, rate: Column) -> Column:
    return F.try_divide(average_cost, 1 - rate)


def price_for_gain(average_cost: Column, gain: float, rate: Column) -> Column:
    return F.try_divide(average_cost * (1 + gain), 1 - rate)


def scoped_positions(pos: DataFrame, merged: DataFrame) -> DataFrame:
    """Positions by account, and by symbol over all accounts (null account)."""
    cols = ["symbol", "quantity", "average_cost", "net_cost_per_share"]
    return pos.select("account_id", *cols).unionByName(merged.select(F.lit(None).cast("string").alias("account_id"), *cols))


def _scope(df: DataFrame) -> DataFrame:
    # A null account means every account; it gets a key of its own to join on.
    return df.withColumn("_scope", F.coalesce(F.concat(F.lit("="), F.col("account_id")), F.lit("*")))


def evaluate(targets: DataFrame, quotes: DataFrame, positions: DataFrame, rates: DataFrame) -> DataFrame:
    """Status of each target's two sides against the latest close and the position it is about."""
    held = _scope(positions).filter("quantity > 0").select("_scope", "symbol", "quantity", "average_cost", "net_cost_per_share")
    rate = _scope(rates).select("_scope", "rate")
    j = (
        _scope(targets).join(quotes.select("symbol", F.col("close").alias("price"), F.col("trade_date").alias("price_date")), "symbol", "left")
        .join(held, ["_scope", "symbol"], "left").join(rate, "_scope", "left")
        .withColumn("rate", F.coalesce("rate", F.lit(0.004)))
    )
    price, buy, sell = F.col("price"), F.col("buy_below"), F.col("sell_above")
    even = F.when(F.col("average_cost") != 0, break_even(F.col("average_cost"), F.col("rate")))

    def side(level: Column, reached: Column) -> dict[str, Column]:
        to_go = F.try_divide(level - price, price)
        hit = F.when(level.isNotNull(), F.coalesce(reached, F.lit(False)))
        return {
            "reached": hit,
            "near": F.when(level.isNotNull(), F.coalesce(~reached & (F.abs(to_go) <= NEAR), F.lit(False))),
            "to_go": F.when(level.isNotNull() & price.isNotNull(), F.when(reached, F.lit(0.0)).otherwise(to_go)),
        }

    b, s = side(buy, price <= buy), side(sell, price >= sell)
    nothing = sell.isNotNull() & F.col("quantity").isNull()
    warnings = F.array_compact(F.array(
        F.when(nothing & F.col("account_id").isNotNull(), F.lit("account has no shares to sell")),
        F.when(nothing & F.col("account_id").isNull(), F.lit("no shares to sell")),
        F.when(sell < even, F.lit("sale level is under break-even")),
        F.when(price.isNull(), F.lit("price unknown")),
    ))
    return j.withColumn("break_even", even).select(
        "target_id", "symbol", "account_id", "price", "price_date", "buy_below", "sell_above", "quantity", "break_even",
        *[v.alias(f"buy_{k}") for k, v in b.items()], *[v.alias(f"sell_{k}") for k, v in s.items()], warnings.alias("warnings"),
    )


def urgency() -> Column:
    reached = F.coalesce("buy_reached", F.lit(False)) | F.coalesce("sell_reached", F.lit(False))
    near = F.coalesce("buy_near", F.lit(False)) | F.coalesce("sell_near", F.lit(False))
    return F.when(reached, 0).when(near, 1).otherwise(2)


def by_urgency(statuses: DataFrame) -> DataFrame:
    return statuses.withColumn("urgency", urgency()).orderBy("urgency", "symbol", "target_id")


def daily_holdings(states: DataFrame) -> DataFrame:
    """Shares after each ledger day: by account, and over all accounts (null account)."""
    total = states.groupBy("symbol", "trade_date").agg(F.sum(F.col("q") - F.col("q_open")).alias("_d"))
    run = W.partitionBy("symbol").orderBy("trade_date").rowsBetween(W.unboundedPreceding, W.currentRow)
    merged = total.select(F.lit(None).cast("string").alias("account_id"), "symbol", "trade_date", F.sum("_d").over(run).alias("quantity"))
    return states.select("account_id", "symbol", "trade_date", F.col("q").alias("quantity")).unionByName(merged)


def target_sides(targets: DataFrame) -> DataFrame:
    """target_id, symbol, account_id, side, level: one row for each level that a target has."""
    return targets.select(
        "target_id", "symbol", "account_id",
        F.inline(F.array(F.struct(F.lit("buy").alias("side"), F.col("buy_below").alias("level")), F.struct(F.lit("sell").alias("side"), F.col("sell_above").alias("level")))),
    ).filter("level is not null")


def _pairs(a: DataFrame, b: DataFrame, keys: list[str]) -> int:
    """Rows of the join of two tables on keys."""
    n = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias(c)) for df, c in ((a, "_a"), (b, "_b"))]
    return n[0].join(n[1], keys).agg(F.sum(F.col("_a") * F.col("_b"))).first()[0] or 0


def target_days(targets: DataFrame, prices: DataFrame, holdings: DataFrame) -> DataFrame:
    """Every close against every target side: whether it is reached, and whether an alert may go out.

    A side's days are bounded by the calendar.  A sell alert needs shares held
    that day (the ledger's state on or before it).  Rows are counted first, so that the sides are
    dealt to as many tasks as they need: the tables should be cheap to read (written).
    """
    sides = target_sides(targets)
    selling = _scope(sides.filter("side = 'sell'")).select("target_id", "_scope", "symbol")
    size = _pairs(sides, prices, ["symbol"]) + _pairs(_scope(holdings), selling, ["_scope", "symbol"])
    close, level = F.col("close"), F.col("level")
    days = sides.join(prices.select("symbol", "trade_date", "close"), "symbol").withColumn(
        "reached", F.when(F.col("side") == "buy", close <= level).otherwise(close >= level)
    )
    held = _scope(holdings).join(selling, ["_scope", "symbol"]).select(
        "target_id", "trade_date", F.lit("sell").alias("side"), "quantity"
    )
    cols = {"level": "double", "close": "double", "reached": "boolean"}
    nothing = [F.lit(None).cast(t).alias(c) for c, t in cols.items()]
    rows = days.select("target_id", "side", "trade_date", F.lit(1).alias("_k"), *cols, F.lit(None).cast("double").alias("quantity")).unionByName(
        held.select("target_id", "side", "trade_date", F.lit(0).alias("_k"), *nothing, "quantity")
    )
    w = W.partitionBy("target_id", "side").orderBy("trade_date", "_k").rowsBetween(W.unboundedPreceding, W.currentRow)
    shares = F.coalesce(F.last("quantity", ignorenulls=True).over(w), F.lit(0.0))
    return dealt(rows, ["target_id", "side"], size).withColumn("held", shares).filter("_k = 1").select(
        "target_id", "side", "trade_date", *cols, ((F.col("side") == "buy") | (F.col("held") > 1e-9)).alias("can_send")
    )


def alerts(days: DataFrame) -> DataFrame:
    """Alerts sent and sides re-armed over a history of closes.

    An alert goes out on the first day of a run of reached days on which it can,
    and the side is armed again by the first close that no longer reaches.
    """
    key = W.partitionBy("target_id", "side").orderBy("trade_date")
    run = key.rowsBetween(W.unboundedPreceding, W.currentRow)
    eligible = (F.col("reached") & F.col("can_send")).cast("int")
    rows = days.withColumn("_all", F.sum(eligible).over(run))
    # Sent in this run: all so far less those up to the last day that was not reached, so that one order of the days does.
    rows = rows.withColumn("_sent", F.col("_all") - F.coalesce(F.max(F.when(~F.col("reached"), F.col("_all"))).over(run), F.lit(0)))
    before = F.coalesce(F.lag("_sent").over(key), F.lit(0)) > 0
    event = F.when((eligible == 1) & (F.col("_sent") == 1), "send").when(~F.col("reached") & before, "rearm")
    return rows.withColumn("event", event).filter("event is not null").select("target_id", "side", "trade_date", "close", "level", "event")


# -- one run over stored state ----------------------------------------------------


def plan_alerts(targets: DataFrame, state: DataFrame, closes: DataFrame, holdings: DataFrame) -> DataFrame:
    """What one run sends and re-arms: target_id, side, trade_date, close, level, event.

    ``state`` holds the sides with an alert outstanding (target_id, side, alerted_on), ``closes``
    one close per symbol (symbol, trade_date, close) and ``holdings`` the shares held now
    (account_id, null for all accounts; symbol; quantity).  A reached side without an alert
    outstanding sends, a sell side only with shares to sell; a side that is not reached
    any more is armed again.  Sides without a close, or with one from before their alert, are left alone.
    """
    sides = target_sides(targets).join(closes.select("symbol", "trade_date", "close"), "symbol")
    held = _scope(holdings).filter("quantity > 1e-9").select("_scope", "symbol", F.lit("sell").alias("side"), F.lit(True).alias("_held"))
    rows = _scope(sides).join(held, ["_scope", "symbol", "side"], "left").join(state.select("target_id", "side", "alerted_on"), ["target_id", "side"], "left")
    close, level = F.col("close"), F.col("level")
    reached = F.when(F.col("side") == "buy", close <= level).otherwise(close >= level)
    can_send = (F.col("side") == "buy") | F.col("_held").isNotNull()
    event = F.when(reached & can_send & F.col("alerted_on").isNull(), "send").when(~reached & (F.col("alerted_on") <= F.col("trade_date")), "rearm")
    return rows.withColumn("event", event).filter("event is not null").select("target_id", "side", "trade_date", "close", "level", "event")


def advance_state(targets: DataFrame, state: DataFrame, events: DataFrame, delivered: DataFrame | None = None) -> DataFrame:
    """The state after a run: sent sides come in, re-armed ones and those of targets or levels that are gone leave.

    With ``delivered`` (target_id, side) an alert only counts as sent if it reached somebody; else the next run sends it again.
    """
    key = ["target_id", "side"]
    sent = events.filter("event = 'send'")
    if delivered is not None:
        sent = sent.join(delivered.select(*key), key, "left_semi")
    armed = events.filter("event = 'rearm'").select(*key)
    kept = state.select(*key, "alerted_on").join(armed, key, "left_anti").join(target_sides(targets).select(*key), key, "left_semi")
    return kept.unionByName(sent.select(*key, F.col("trade_date").alias("alerted_on")))


def outstanding(history: DataFrame) -> DataFrame:
    """The state that a history of events (see ``alerts``) leaves."""
    last = history.groupBy("target_id", "side").agg(F.max_by("event", "trade_date").alias("event"), F.max("trade_date").alias("alerted_on"))
    return last.filter("event = 'send'").select("target_id", "side", "alerted_on")
