"""Writing a ledger import: per account all of it or nothing, behind checks on the history that it would leave."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.scratch import written as stored
from .ledger import ADDS, DAY, EMPTY_BELOW, POSITION

#: Up to so many accounts the ledger is cut to those of an import before it is netted; beyond, it is netted whole, as a join would shuffle it once more.
FEW_ACCOUNTS = 10_000

#: What tells a trade from all others.
ROW = DAY + ["txn_id"]

# Why an account's import is refused, in the order in which reasons are looked for.
STALE = "trades changed since the preview"
UNSEEN = "removes a trade that the preview did not show"
OVERSOLD = "sells shares that were never bought"
UNCONFIRMED = "changes holdings without confirmation"


def before_and_after(existing: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """Trades of a ledger before and after a change, each once: flags say which of the two histories hold it."""
    mark = gone.select(*ROW, F.lit(True).alias("_gone")).distinct()
    old = existing.join(mark, ROW, "left").withColumns({"before": F.lit(True), "after": F.col("_gone").isNull()}).drop("_gone")
    return old.unionByName(new.withColumns({"before": F.lit(False), "after": F.lit(True)}), allowMissingColumns=True)


def changed_holdings(versions: DataFrame) -> DataFrame:
    """Per (account, symbol): shares at the end of both histories, and the first day on which the new one sells more than is held.

    Both histories are netted to days in one aggregation and walked in one window over the
    netted days, so the ledger is read once however many trades a key holds.
    """
    return _walked(_netted(versions))


def _netted(versions: DataFrame) -> DataFrame:
    kind, quantity = F.col("txn_type"), F.coalesce("quantity", F.lit(0.0))
    total = lambda cond: F.sum(F.when(cond, quantity).otherwise(0.0))
    sides = {"in": kind.isin(*ADDS), "out": kind == "sell"}
    return versions.groupBy(*DAY).agg(*[total(F.col(v) & c).alias(f"{v}_{s}") for v in ("before", "after") for s, c in sides.items()])


def _walked(days: DataFrame) -> DataFrame:
    key = W.partitionBy(*POSITION).orderBy("trade_date")
    run = key.rowsBetween(W.unboundedPreceding, W.currentRow)
    days = days.withColumns({f"{v}_sum": F.sum(F.col(f"{v}_in") - F.col(f"{v}_out")).over(run) for v in ("before", "after")})

    def held(v: str) -> Column:
        left = F.col(f"{v}_sum") - F.least(F.lit(0.0), F.min(f"{v}_sum").over(run))
        return F.when(left < EMPTY_BELOW, 0.0).otherwise(left)

    days = days.withColumns({"_b": held("before"), "_a": held("after")})
    opened = F.coalesce(F.lag("_a").over(key), F.lit(0.0)) + F.col("after_in")
    days = days.withColumn("_short", F.col("after_out") > opened + EMPTY_BELOW)
    return days.groupBy(*POSITION).agg(
        F.max_by("_b", "trade_date").alias("before"), F.max_by("_a", "trade_date").alias("after"), F.min(F.when(F.col("_short"), F.col("trade_date"))).alias("oversold_on")
    )


def _inside(first, last) -> Column:
    """Whether a trade's day lies in a range; false if either is unknown."""
    return F.coalesce(F.col("trade_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.lit(False))


def _between(trades: DataFrame, first, last) -> DataFrame:
    return trades.filter(_inside(first, last))


def import_outcomes(plans: DataFrame, existing: DataFrame, seen: DataFrame, remove: DataFrame, new: DataFrame) -> DataFrame:
    """Whether each account's import may be written: account_id, period, applied, reason, and the first symbol (and how many) behind the reason.

    plans: account_id, period_from, period_to, confirmed; an account has one plan.  ``seen``
    are the rows (ROW) of the account's buys and sells in the period as the preview showed
    them, ``remove`` those to be deleted, ``new`` the trades to be added.  ``existing`` is
    read three times, so it should be cheap to read (written); only its days that plans or removed rows reach are
    matched by row.  Steps are written to scratch tables, so that the disk holds the shuffles of one at a time.
    """
    period = plans.select("account_id", "period_from", "period_to", F.coalesce("confirmed", F.lit(False)).alias("confirmed"))
    now = _between(existing, *plans.agg(F.min("period_from"), F.max("period_to")).first()).join(period, "account_id").filter(F.col("txn_type").isin("buy", "sell") & F.col("trade_date").between(F.col("period_from"), F.col("period_to")))
    one = F.lit(1)
    shown = (
        now.select(*ROW, one.alias("_now"), F.lit(0).alias("_seen"), F.lit(0).alias("_gone"))
        .unionByName(seen.select(*ROW, F.lit(0).alias("_now"), one.alias("_seen"), F.lit(0).alias("_gone")))
        .unionByName(remove.select(*ROW, F.lit(0).alias("_now"), F.lit(0).alias("_seen"), one.alias("_gone")))
    ).groupBy(*ROW).agg(*[F.max(c).alias(c) for c in ("_now", "_seen", "_gone")])
    preview = stored(shown.groupBy("account_id").agg(
        F.count_if(F.col("_now") != F.col("_seen")).alias("stale"), F.count_if((F.col("_gone") == 1) & (F.col("_seen") == 0)).alias("unseen"),
        F.min(F.when(F.col("_now") != F.col("_seen"), F.col("symbol"))).alias("stale_symbol"), F.min(F.when((F.col("_gone") == 1) & (F.col("_seen") == 0), F.col("symbol"))).alias("unseen_symbol"),
    ))
    mine = plans.select("account_id")
    if mine.limit(FEW_ACCOUNTS + 1).count() <= FEW_ACCOUNTS:
        existing, new = existing.join(mine, "account_id", "left_semi"), new.join(mine, "account_id", "left_semi")
    reach = remove.agg(F.min("trade_date"), F.max("trade_date")).first()
    # Rows of other days can't be removed ones: they stand in both histories.
    rest = existing.filter(~_inside(*reach)).withColumns({"before": F.lit(True), "after": F.lit(True)})
    cut = [*DAY, "txn_type", "quantity", "before", "after"]
    versions = stored(before_and_after(_between(existing, *reach), remove, new).select(*cut)).unionByName(rest.select(*cut))
    moved = F.col("before") != F.col("after")
    holdings = _walked(stored(_netted(versions))).groupBy("account_id").agg(
        F.count("oversold_on").alias("oversold"), F.min(F.when(F.col("oversold_on").isNotNull(), F.col("symbol"))).alias("oversold_symbol"),
        F.count_if(moved).alias("moved"), F.min(F.when(moved, F.col("symbol"))).alias("moved_symbol"),
    )
    j = period.join(preview, "account_id", "left").join(holdings, "account_id", "left").na.fill(0, ["stale", "unseen", "oversold", "moved"])
    tests = [(F.col("stale") > 0, STALE, "stale"), (F.col("unseen") > 0, UNSEEN, "unseen"), (F.col("oversold") > 0, OVERSOLD, "oversold"), ((F.col("moved") > 0) & ~F.col("confirmed"), UNCONFIRMED, "moved")]
    verdict = F.coalesce(*[F.when(bad, F.struct(F.lit(text).alias("reason"), F.col(f"{k}_symbol").alias("symbol"), F.col(k).alias("rows"))) for bad, text, k in tests])
    return j.withColumn("_v", verdict).select("account_id", "period_from", "period_to", F.col("_v").isNull().alias("applied"), "_v.reason", "_v.symbol", F.coalesce("_v.rows", F.lit(0)).alias("rows"))


def apply_import(
    plans: DataFrame, existing: DataFrame, seen: DataFrame, remove: DataFrame, new: DataFrame,
    cash: DataFrame, new_cash: DataFrame, periods: DataFrame, companies: DataFrame,
) -> dict[str, DataFrame]:
    """The tables after importing each account's ledger: trades, cash, periods, companies, and the outcomes.

    A refused account keeps its rows in every table.  An applied one loses its ``remove``
    rows and gets the new trades; its cash movements in the period are replaced by the new ones; its
    period is added with its balances; symbols that nobody has listed are added as untracked.
    The outcomes decide by a join on the account, so no account is half written; they are
    written to a scratch table, since every table asks for them, some more than once.
    """
    outcomes = stored(import_outcomes(plans, existing, seen, remove, new))
    done = outcomes.filter("applied").select("account_id", "period_from", "period_to")
    ids = done.select("account_id")
    added = new.join(ids, "account_id", "left_semi")
    gone = remove.select(*ROW).join(ids, "account_id", "left_semi")
    trades = existing.join(gone, ROW, "left_anti").unionByName(added, allowMissingColumns=True)
    in_period = F.col("period_from").isNotNull() & F.col("move_date").between(F.col("period_from"), F.col("period_to"))
    kept_cash = cash.join(done, "account_id", "left").filter(~in_period).select(*cash.columns)
    lines = new_cash.join(ids, "account_id", "left_semi")
    counts = added.groupBy("account_id").agg(F.count(F.lit(1)).alias("trades")).join(lines.groupBy("account_id").agg(F.count(F.lit(1)).alias("cash_lines")), "account_id", "full_outer")
    written = plans.join(ids, "account_id", "left_semi").join(counts, "account_id", "left").select(
        "account_id", "period_from", "period_to", "opening_balance", "closing_balance", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("trades", "cash_lines")]
    )
    fresh = added.select("symbol").distinct().join(companies, "symbol", "left_anti").select("symbol", F.col("symbol").alias("name"), F.lit(False).alias("is_tracked"))
    return {
        "outcomes": outcomes,
        "trades": trades,
        "cash": kept_cash.unionByName(lines, allowMissingColumns=True),
        "periods": periods.unionByName(written, allowMissingColumns=True),
        "companies": companies.unionByName(fresh, allowMissingColumns=True),
    }
