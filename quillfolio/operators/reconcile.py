"""Broker statements and reports against the ledger, and import plans."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import near, round_half_up
from ..sources.scratch import written
from .apply import before_and_after, changed_holdings
from .ledger import DAY, POSITION, TRADES, cash_flow, day_states, oversells, positions, sale_gains
from .names import match_companies
from .scan import day_buckets, running_sums


def ledger_coverage(imports: DataFrame) -> DataFrame:
    """How far each account's imports reach from a zero opening without a gap.

    Periods are netted per starting day first; a day between two periods may be
    missing, no more.
    """
    start = imports.filter(F.abs(F.col("opening_balance")) <= 0.005 + 1e-9).groupBy("account_id").agg(
        F.min(F.struct("period_from", "period_to")).alias("_s")
    )
    spans = imports.groupBy("account_id", "period_from").agg(F.max("period_to").alias("period_to")).join(start, "account_id", "left")
    order = W.partitionBy("account_id").orderBy("period_from")
    before = F.greatest(F.col("_s.period_to"), F.max("period_to").over(order.rowsBetween(W.unboundedPreceding, -1)))
    rows = spans.withColumn("_gap", (F.col("period_from") > F.date_add(before, 1)).cast("int"))
    rows = rows.withColumn("_broken", F.max("_gap").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.groupBy("account_id").agg(
        F.max("_s.period_from").alias("start"),
        F.max(F.when(F.col("_s").isNotNull(), F.greatest(F.col("_s.period_to"), F.when(F.col("_broken") == 0, F.col("period_to"))))).alias("reach"),
        F.min("period_from").alias("first_from"), F.max("period_to").alias("last_to"),
    )


def reconcile_holdings(statement: DataFrame, pos: DataFrame) -> DataFrame:
    """What a statement's holdings suggest against the ledger's, per (account, symbol)."""
    s = statement.select(*POSITION, F.col("quantity").alias("statement_qty"), F.col("cost_amount").alias("statement_cost"))
    l = pos.filter("quantity > 0").select(*POSITION, F.col("quantity").alias("ledger_qty"), F.col("cost_basis").alias("ledger_cost"))
    j = s.join(l, POSITION, "full_outer")
    sq, lq = F.coalesce("statement_qty", F.lit(0.0)), F.coalesce("ledger_qty", F.lit(0.0))
    delta, lc, sc = sq - lq, F.coalesce("ledger_cost", F.lit(0.0)), F.col("statement_cost")
    # Fixed value: a cost counts as unchanged within half a percent, or one unit.
    same = F.abs(sc - lc) <= F.greatest(F.lit(1.0), F.abs(lc) * 0.005)
    kind = (
        F.when(F.col("ledger_qty").isNull(), "opening").when(F.col("statement_qty").isNull(), "exit")
        .when(delta == 0, "match").when(delta > 0, "increase").otherwise("decrease")
    )
    rows = j.select(*POSITION, sq.alias("statement_qty"), lq.alias("ledger_qty"), delta.alias("delta"), "statement_cost", lc.alias("ledger_cost"), kind.alias("kind"), same.alias("_same"))
    up = F.col("kind") == "increase"
    return rows.select(
        *rows.columns[:-1],
        F.when(F.col("kind") == "opening", "buy").when(up & F.col("_same"), "bonus").when(up, "buy").alias("proposed_type"),
        F.when(F.col("kind") == "opening", F.col("statement_qty")).when(up, F.col("delta")).alias("proposed_qty"),
        F.when(F.col("kind") == "opening", F.try_divide("statement_cost", "statement_qty")).when(up & F.col("_same"), F.lit(0.0))
        .when(up, F.try_divide(F.greatest(F.col("statement_cost") - F.col("ledger_cost"), F.lit(0.0)), F.col("delta"))).alias("proposed_price"),
        (F.col("kind") == "opening").alias("selected"),
    )


def account_checks(statements: DataFrame, holdings: DataFrame, txns: DataFrame, movements: DataFrame, coverage: DataFrame) -> DataFrame:
    """Our figures against each account's statement: one row per check, ``ok`` null if it cannot be made.

    ``statements`` hold one row per account with ``as_of`` and lifetime totals;
    ``holdings`` the statement's (account, symbol, quantity, cost_amount).
    """
    dates = statements.select("account_id", "as_of")
    upto = txns.join(dates, "account_id").filter("trade_date <= as_of").drop("as_of")
    # One row per holding, read by stock and by account.
    pos = written(positions(upto, None, "2000-01-01").select(*POSITION, "quantity", "cost_basis", "realised_gain"))
    kept = dates.join(holdings.groupBy("account_id").agg(F.count(F.lit(1)).alias("_kept")), "account_id", "left")
    ours = pos.select(*POSITION, F.col("quantity").alias("oq"), F.col("cost_basis").alias("oc"))
    theirs = holdings.select(*POSITION, F.col("quantity").alias("bq"), F.col("cost_amount").alias("bc"))
    by_stock = ours.join(theirs, POSITION, "full_outer").withColumn("oq", F.coalesce("oq", F.lit(0.0))).filter("oq <> 0 or bq is not null").join(kept, "account_id")
    same = F.col("oq") == F.coalesce("bq", F.lit(0.0))
    stock_lines = by_stock.select("account_id", "as_of", F.inline(F.array_compact(F.array(
        F.struct(F.concat("symbol", F.lit(" shares")).alias("label"), F.col("oq").alias("ours"), F.coalesce("bq", F.lit(0.0)).alias("broker"),
                 F.when(F.col("_kept").isNotNull(), same).alias("ok")),
        F.when(F.col("bq").isNotNull() & same, F.struct(F.concat("symbol", F.lit(" cost")).alias("label"), F.col("oc").alias("ours"), F.col("bc").alias("broker"), near(F.col("oc"), F.col("bc"), 0.05).alias("ok"))),
    ))))

    moves = movements.join(dates, "account_id").filter("move_date <= as_of").groupBy("account_id").agg(
        F.sum("amount").alias("moved"),
        *[F.sum(F.when(F.col("kind") == k, F.col("amount")).otherwise(0.0)).alias(k) for k in ("deposit", "withdrawal", "dividend")],
    ).withColumnsRenamed({"deposit": "m_deposit", "withdrawal": "m_withdrawal", "dividend": "m_dividend"})
    traded = upto.groupBy("account_id").agg(
        F.sum(F.when(F.col("txn_type").isin(*TRADES), cash_flow()).otherwise(0.0)).alias("traded"),
        F.sum(F.when(F.col("txn_type") == "dividend", cash_flow()).otherwise(0.0)).alias("recorded"),
    )
    gained = pos.groupBy("account_id").agg(F.sum("realised_gain").alias("gained"))
    reach = coverage.select("account_id", "reach")
    j = statements.join(moves, "account_id", "left").join(traded, "account_id", "left").join(gained, "account_id", "left").join(reach, "account_id", "left")
    j = j.na.fill(0.0, ["moved", "m_deposit", "m_withdrawal", "m_dividend", "traded", "recorded", "gained"])
    complete = F.coalesce(F.col("reach") >= F.col("as_of"), F.lit(False))

    def line(label: str, mine: Column, broker: str, tolerance: float) -> Column:
        ok = F.when(complete, near(mine, F.col(broker), tolerance))
        return F.struct(F.lit(label).alias("label"), mine.alias("ours"), F.col(broker).alias("broker"), ok.alias("ok"))

    # Labels and tolerances of the account lines.
    lines = F.array(
        line("Cash balance", F.col("moved") + F.col("traded"), "cash_balance", 0.015),
        line("Deposited", F.col("m_deposit"), "deposit", 0.005),
        line("Withdrawn", F.abs("m_withdrawal"), "withdraw", 0.005),
        line("Dividends into the account", F.col("m_dividend"), "cash_dividend", 0.005),
        line("Realised gain", F.col("gained"), "realised_gain", 0.05),
        F.struct(F.lit("Dividends recorded against stocks").alias("label"), F.col("recorded").alias("ours"), F.col("cash_dividend").alias("broker"),
                 F.when(complete, F.col("recorded") >= F.col("cash_dividend") - 0.01).alias("ok")),
    )
    return stock_lines.unionByName(j.select("account_id", "as_of", F.inline(lines)))


def check_summary(checks: DataFrame) -> DataFrame:
    return checks.groupBy("account_id").agg(
        F.count_if(F.col("ok")).alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok").isNull()).alias("unchecked")
    )


def compare_pnl(lines: DataFrame, txns: DataFrame, companies: DataFrame, start, end) -> DataFrame:
    """A broker's profit report against the ledger's gains in the period, per company.

    ``lines`` hold (account_id, company_name, buy_qty, sale_qty, profit).  A name
    that does not match falls back to the only untaken stock with the same
    quantities; stocks the report does not list follow as lines of their own.
    """
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    trades = txns.filter(F.col("trade_date").between(lo, hi) & F.col("txn_type").isin("buy", "sell")).groupBy(*POSITION).agg(
        F.sum(F.when(F.col("txn_type") == "buy", F.col("quantity")).otherwise(0.0)).alias("l_buy"),
        F.sum(F.when(F.col("txn_type") == "sell", F.col("quantity")).otherwise(0.0)).alias("l_sale"),
    )
    gains = sale_gains(txns.filter(F.col("trade_date") <= hi)).filter(F.col("trade_date") >= lo).groupBy(*POSITION).agg(F.sum("gain").alias("l_profit"))
    # One row per stock and one per report line, both read several times below.
    ledger = written(trades.join(gains, POSITION, "left").withColumn("l_profit", F.coalesce("l_profit", F.lit(0.0))))
    named = lines.join(match_companies(lines, companies), "company_name", "left")
    have = ledger.select(*POSITION).withColumn("_l", F.lit(True))
    named = written(named.join(have, POSITION, "left"))
    taken = named.filter("_l").select(*POSITION).distinct()
    free = ledger.join(taken, POSITION, "left_anti")
    qty = ["account_id", "buy_qty", "sale_qty"]
    only = free.groupBy("account_id", F.col("l_buy").alias("buy_qty"), F.col("l_sale").alias("sale_qty")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("symbol").alias("_only")
    ).filter("_n = 1")
    lost = named.filter("_l is null").groupBy(*qty).agg(F.count(F.lit(1)).alias("_m")).filter("_m = 1")
    fallback = only.join(lost, qty).select(*qty, "_only")
    matched = named.join(fallback, qty, "left").withColumn("symbol", F.when(F.col("_l"), F.col("symbol")).otherwise(F.coalesce("_only", "symbol"))).drop("_l", "_only")
    matched = written(matched)
    rows = matched.join(ledger, POSITION, "left").select(
        "account_id", "company_name", "symbol", "buy_qty", "sale_qty", "profit", "l_buy", "l_sale", "l_profit",
        F.coalesce((F.col("l_buy") == F.col("buy_qty")) & (F.col("l_sale") == F.col("sale_qty")), F.lit(False)).alias("complete"),
    )
    used = matched.filter("symbol is not null").select(*POSITION).distinct()
    zero = F.lit(0.0)
    rest = ledger.join(used, POSITION, "left_anti").join(matched.select("account_id").distinct(), "account_id", "left_semi").select(
        "account_id", F.col("symbol").alias("company_name"), "symbol", zero.alias("buy_qty"), zero.alias("sale_qty"), zero.alias("profit"),
        "l_buy", "l_sale", "l_profit", F.lit(False).alias("complete"),
    )
    return rows.unionByName(rest)


# -- ledger import --------------------------------------------------------------

LINE = ["import_id", "line_no"]


def with_previous_balance(lines: DataFrame, imports: DataFrame) -> DataFrame:
    """Each line with the balance before it: the line above's, or the opening one.

    Lines are numbered without gaps, so the line above is an equality join on
    (import, number) and no import is windowed in one task.
    """
    above = lines.select("import_id", (F.col("line_no") + 1).alias("line_no"), F.col("balance").alias("_above"))
    return lines.join(above, LINE, "left").join(imports.select("import_id", "opening_balance"), "import_id").withColumn(
        "previous", F.when(F.col("line_no") == 1, F.col("opening_balance")).otherwise(F.col("_above"))
    ).drop("_above", "opening_balance")


def balance_breaks(lines: DataFrame, imports: DataFrame) -> DataFrame:
    """Lines whose printed balance does not follow from the one before."""
    rows = with_previous_balance(lines, imports).withColumn("expected", round_half_up(F.col("previous") - F.col("debit") + F.col("credit")))
    return rows.filter(F.abs(F.col("expected") - F.col("balance")) > 0.011).select(*LINE, "previous", "debit", "credit", "balance", "expected")


def import_issues(lines: DataFrame, imports: DataFrame) -> DataFrame:
    """Imports whose closing balance or column totals disagree with their lines."""
    sums = lines.groupBy("import_id").agg(
        F.max_by("balance", "line_no").alias("last_balance"),
        *[round_half_up(F.sum(c)).alias(f"sum_{c}") for c in ("commission", "debit", "credit")],
    )
    j = imports.join(sums, "import_id", "left")
    rules = [(F.abs(F.coalesce("last_balance", F.col("opening_balance")) - F.col("closing_balance")) > 0.011, "closing balance")]
    rules += [(F.abs(F.col(f"sum_{c}") - F.col(f"total_{c}")) > 0.05, f"total {c}") for c in ("commission", "debit", "credit")]
    return j.select("import_id", F.explode(F.array_compact(F.array(*[F.when(b, F.lit(r)) for b, r in rules]))).alias("issue"))


def cash_effects(lines: DataFrame, imports: DataFrame) -> DataFrame:
    """What each line did to the cash: the change in balance where the printed columns agree with it.

    Trades also get their exact price (amount over quantity) and the commission
    that effect implies.
    """
    rows = with_previous_balance(lines, imports)
    change, printed = round_half_up(F.col("balance") - F.col("previous")), round_half_up(F.col("credit") - F.col("debit"))
    rows = rows.withColumn("effect", F.when(F.abs(change - printed) <= 0.011, change).otherwise(printed))
    buy, trade = F.col("kind") == "buy", F.col("kind").isin("buy", "sell")
    fee = F.when(buy, -F.col("effect") - F.col("amount")).otherwise(F.col("amount") - F.col("effect"))
    return rows.select(
        *LINE, "account_id", "line_date", "kind", "symbol", "quantity", "effect",
        F.when(trade, F.try_divide("amount", "quantity")).alias("exact_price"), F.when(trade, round_half_up(fee)).alias("exact_commission"),
    )


def match_manual_trades(manual: DataFrame, ledger: DataFrame, days: int = 3) -> DataFrame:
    """Hand-entered trades with whether a ledger trade within some days replaces each.

    One to one, per (account, symbol, side, quantity), both sides in (date, id)
    order, each manual trade taking the earliest ledger trade still free.  Equal
    trades of one day are interchangeable, so the matching runs over day counts:
    the next free ledger trade is a number that only moves forward, and a day of
    m trades moves it from p to max(p, min(max(p, L) + m, U)), where L and U are
    the ledger trades before and up to the end of the day's reach.
    """
    key = ["account_id", "symbol", "txn_type", "quantity"]
    m = manual.groupBy(*key, F.unix_date("trade_date").alias("d")).agg(F.count(F.lit(1)).alias("m"))
    l = ledger.groupBy(*key, F.unix_date("trade_date").alias("d")).agg(F.count(F.lit(1)).alias("l"))
    both = m.join(l, key + ["d"], "full_outer").na.fill(0, ["m", "l"])
    by_day = W.partitionBy(*key).orderBy("d")
    counts = both.select(
        *key, "d", "m",
        F.coalesce(F.sum("l").over(by_day.rangeBetween(W.unboundedPreceding, -days - 1)), F.lit(0)).alias("before"),
        F.sum("l").over(by_day.rangeBetween(W.unboundedPreceding, days)).alias("upto"),
    ).filter("m > 0")

    def take(acc: Column, day: Column) -> Column:
        p = acc["p"]
        first = F.greatest(p, day["before"])
        after = F.greatest(p, F.least(first + day["m"], day["upto"]))
        got = F.greatest(after - first, F.lit(0))
        return F.struct(after.alias("p"), F.array_append(acc["out"], F.struct(day["d"].alias("d"), got.cast("long").alias("got"))).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("p"), F.array().cast("array<struct<d:int,got:bigint>>").alias("out"))
    got = counts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("d", "m", "before", "upto"))).alias("_days")).select(
        *key, F.inline(F.aggregate("_days", start, take, lambda a: a["out"]))
    )
    rows = manual.withColumns({"d": F.unix_date("trade_date"), "_one": F.lit(1.0)})
    placed = running_sums(day_buckets(rows, key + ["d"], "txn_id"), key + ["d"], ["bucket"], ["txn_id"], {"_place": "_one"})
    return placed.join(got, key + ["d"], "left").select(*manual.columns, (F.col("_place") <= F.coalesce("got", F.lit(0))).alias("replaced"))


class LedgerImportPlan:
    """What importing a period of ledger trades would do, before anything is written.

    Trades of an earlier import in the period are replaced; hand-entered ones
    only where a ledger trade duplicates them.  The period's trades on both sides
    are small beside the ledger and each is read several times, so they are written to
    scratch tables; the ledger itself is read once for the holdings and twice for the blockers.
    """

    def __init__(self, ledger: DataFrame, existing: DataFrame, start, end, known: DataFrame):
        optional = [c for c in ("txn_id",) if c in ledger.columns]
        self.ledger = written(ledger.select("account_id", "symbol", "trade_date", "txn_type", "quantity", "price_per_share", "commission", *optional))
        self.existing, self.known = existing, known
        self._accounts = self.ledger.select("account_id").distinct()
        inside = F.col("txn_type").isin("buy", "sell") & F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        candidates = written(existing.join(self._accounts, "account_id", "left_semi").filter(inside))
        manual = match_manual_trades(candidates.filter("source = 'manual'"), self.ledger)
        #: The account's trades in the period, and whether each is replaced.
        self.decided = written(manual.unionByName(candidates.filter("source <> 'manual'").withColumn("replaced", F.lit(True))))

    @property
    def new(self) -> DataFrame:
        """The ledger's trades as they would be written."""
        return self.ledger.withColumns({"tax_withheld": F.lit(0.0), "source": F.lit("ledger")})

    @property
    def replaced(self) -> DataFrame:
        return self.decided.filter("replaced").select(*DAY, "txn_id")

    def after(self) -> DataFrame:
        """All trades as they would be afterwards."""
        return self.existing.join(self.replaced, DAY + ["txn_id"], "left_anti").unionByName(self.new, allowMissingColumns=True)

    def holdings(self) -> DataFrame:
        """Shares before and after, of every stock that the accounts hold or trade in the ledger."""
        scope = self.existing.join(self._accounts, "account_id", "left_semi")
        held = changed_holdings(before_and_after(scope, self.replaced, self.new))
        return held.select(*POSITION, "before", "after").filter("before <> 0 or after <> 0")

    def new_symbols(self) -> DataFrame:
        return self.ledger.select("symbol").distinct().join(self.known.select("symbol"), "symbol", "left_anti")

    def blockers(self) -> DataFrame:
        """Sales of the accounts' rebuilt history that sell shares never bought."""
        return oversells(self.after().join(self._accounts, "account_id", "left_semi"))


def import_summary(lines: DataFrame) -> DataFrame:
    """Counts and sums of an import by kind of line."""
    of = lambda k, v: F.sum(F.when(F.col("kind") == k, v).otherwise(0.0))
    return lines.groupBy("import_id").agg(
        F.count_if(F.col("kind") == "buy").alias("buys"), F.count_if(F.col("kind") == "sell").alias("sells"),
        F.sum(F.coalesce("exact_commission", F.lit(0.0))).alias("commission"),
        of("deposit", F.col("effect")).alias("deposits"), of("withdrawal", -F.col("effect")).alias("withdrawals"),
        of("fee", -F.col("effect")).alias("fees"), of("dividend", F.col("effect")).alias("dividends"),
    )


def replace_period(existing: DataFrame, new: DataFrame, start, end) -> DataFrame:
    """Ledger with an account's trades in a period replaced by new ones."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    touched = new.select("account_id").distinct().withColumn("_t", F.lit(True))
    gone = F.col("_t").isNotNull() & F.col("trade_date").between(lo, hi) & F.col("txn_type").isin("buy", "sell")
    return existing.join(touched, "account_id", "left").filter(~gone).drop("_t").unionByName(new)


def unchanged_since(preview: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that appeared or vanished since a preview; empty means safe to apply."""
    gone = preview.select(*keys).join(current, keys, "left_anti").withColumn("change", F.lit("vanished"))
    came = current.select(*keys).join(preview, keys, "left_anti").withColumn("change", F.lit("appeared"))
    return gone.unionByName(came)


def upsert_snapshots(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """One snapshot per account and day, the newest import winning (``imported`` orders them)."""
    rows = stored.unionByName(incoming, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in ("account_id", "as_of")]
    return rows.groupBy("account_id", "as_of").agg(*[F.max_by(c, "imported").alias(c) for c in rest])


def plan_dividend_import(lines: DataFrame, txns: DataFrame, companies: DataFrame) -> DataFrame:
    """Dividend report lines with tax, symbol, shares held before the record date and recorded flag.

    ``lines`` hold (report_id, line_id, account_id, company_name, paid_via, record_date, holding, gross, tax).
    """
    from .dividends import mark_recorded
    from .ledger import holdings_at

    rates = lines.filter("tax is not null and gross > 0").groupBy("report_id").agg(F.try_divide(F.sum("tax"), F.sum("gross")).alias("rate"))
    # Fixed value: the rate assumed when a report states no tax.
    j = lines.join(rates, "report_id", "left").withColumn("rate", F.coalesce("rate", F.lit(0.1)))
    j = j.join(match_companies(lines, companies), "company_name", "left")
    j = j.withColumn("tax_withheld", F.coalesce("tax", round_half_up(F.col("gross") * F.col("rate"))))
    asked = j.filter("symbol is not null").select("account_id", "symbol", "record_date")
    held = holdings_at(day_states(txns), asked, "record_date", strict=True).select(*POSITION, "record_date", F.col("quantity").alias("ledger_holding"))
    j = written(j.join(held, POSITION + ["record_date"], "left"))
    out = mark_recorded(j, txns)
    return out.withColumn(
        "suggested", ~F.col("recorded") & F.col("symbol").isNotNull() & (F.col("paid_via") == "broker")
    ).withColumn("holding_differs", F.coalesce(F.col("ledger_holding") != F.col("holding"), F.lit(False)))
