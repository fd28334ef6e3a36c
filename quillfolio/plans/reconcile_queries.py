"""Registered queries of the reconciliation and data-quality families."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import apply as A
from ..operators import fundamentals as Fu
from ..operators import ledger as L
from ..operators import quality as Q
from ..operators import reconcile as R
from ..operators import returns as Re
from ..operators.names import match_companies
from .ledger_queries import positions, stock_quotes
from ..sources.scratch import written
from ..sources.testtables import key_of, padded
from .registry import query

START, END = "1998-01-01", "1998-12-31"


@query("j09_reconcile_holdings", "account_id symbol kind statement_qty:4 ledger_qty:4 delta:4 statement_cost:4 ledger_cost:4 proposed_type proposed_qty:4 proposed_price:4 selected:b")
def _(t):
    statements = written(t.latest_statements())
    upto = t.transactions().join(statements.select("account_id", "as_of"), "account_id").filter("trade_date <= as_of").drop("as_of")
    return R.reconcile_holdings(t.statement_holdings(statements), L.positions(upto, None, END))


def _checks(t):
    statements = written(t.latest_statements())
    return R.account_checks(statements, written(t.statement_holdings(statements)), t.transactions(), t.cash_movements(), R.ledger_coverage(t.ledger_imports()))


@query("a23_account_checks", "account_id as_of:d label ours:2 broker:2 ok:b")
def _(t):
    return _checks(t)


@query("a24_check_summary", "account_id passed:i failed:i unchecked:i")
def _(t):
    return R.check_summary(_checks(t))


def _names(t):
    k = F.col("p_partkey")
    key = padded(k, 9)
    return t.raw("part").select(
        F.when(k % 5 == 0, F.concat(F.lit("The Supplier-"), key, F.lit(" LTD."))).when(k % 5 == 1, F.concat(F.lit("supplier "), key, F.lit(" International")))
        .when(k % 5 == 2, F.concat(F.lit("Supplier Co. of "), key)).when(k % 5 == 3, F.col("p_name")).otherwise(F.concat(F.lit("Supplier "), key)).alias("company_name")
    )


@query("j10_x03_name_matches", "company_name symbol")
def _(t):
    return match_companies(_names(t), t.listings().withColumn("short_name", F.lit(None).cast("string")))


def _pnl_lines(t):
    x = t.transactions().filter(F.col("trade_date").between(F.lit(START).cast("date"), F.lit(END).cast("date")) & F.col("txn_type").isin("buy", "sell"))
    k = key_of("symbol")
    lines = x.groupBy("account_id", "symbol").agg(
        F.sum(F.when(F.col("txn_type") == "buy", F.col("quantity")).otherwise(0.0)).alias("buy_qty"), F.sum(F.when(F.col("txn_type") == "sell", F.col("quantity")).otherwise(0.0)).alias("sale_qty"),
    ).filter(k % 10 != 9)
    name = F.when(k % 7 == 0, F.concat(F.lit("Unlisted "), "symbol")).otherwise(F.concat(F.lit("Supplier "), padded(k, 9), F.lit(" Limited")))
    return lines.select("account_id", name.alias("company_name"), (F.col("buy_qty") + F.when(k % 8 == 3, 1.0).otherwise(0.0)).alias("buy_qty"), "sale_qty", (k * 10.0).alias("profit"))


@query("a25_j11_j12_pnl_comparison", "account_id company_name symbol buy_qty:4 sale_qty:4 profit:4 l_buy:4 l_sale:4 l_profit:4 complete:b")
def _(t):
    return R.compare_pnl(written(_pnl_lines(t)), t.transactions(), t.listings().withColumn("short_name", F.lit(None).cast("string")), START, END)


@query("w15_balance_breaks", "import_id line_no:i previous:2 debit:2 credit:2 balance:2 expected:2")
def _(t):
    return R.balance_breaks(*t.ledger_lines())


@query("w15_import_issues", "import_id issue")
def _(t):
    return R.import_issues(*t.ledger_lines())


@query("w16_a27_cash_effects", "import_id line_no:i kind symbol effect:2 exact_price:4 exact_commission:2")
def _(t):
    return R.cash_effects(*t.ledger_lines())


@query("a26_import_summary", "import_id buys:i sells:i commission:2 deposits:2 withdrawals:2 fees:2 dividends:2")
def _(t):
    return R.import_summary(R.cash_effects(*t.ledger_lines()))


def _broker_trades(t):
    x = t.transactions().filter(F.col("trade_date").between(F.lit(START).cast("date"), F.lit(END).cast("date")) & F.col("txn_type").isin("buy", "sell") & (F.col("txn_id") % 7 != 0))
    shift = F.when(F.col("source") == "manual", (F.col("txn_id") % 5).cast("int")).otherwise(0)
    return x.withColumn("trade_date", F.least(F.date_add("trade_date", shift), F.lit(END).cast("date"))).withColumn("txn_id", F.col("txn_id") + 1)


def _plan(t):
    return R.LedgerImportPlan(_broker_trades(t), t.transactions(), START, END, t.listings().filter("symbol not like '%7'"))


@query("j13_a27_replaced_trades", "account_id symbol trade_date:d txn_id txn_type quantity:4 source replaced:b")
def _(t):
    return _plan(t).decided


@query("a27_holdings_before_after", "account_id symbol before:4 after:4")
def _(t):
    return _plan(t).holdings()


@query("a27_import_blockers", "account_id symbol trade_date:d quantity:4 held:4")
def _(t):
    return _plan(t).blockers()


@query("k08_new_symbols", "symbol")
def _(t):
    return _plan(t).new_symbols()


@query("k05_replace_period", "account_id symbol trade_date:d txn_id txn_type quantity:4")
def _(t):
    new = _broker_trades(t).filter("account_id in ('BUILDING', 'MACHINERY')")
    return R.replace_period(t.transactions(), new, START, END)


def _applied(t):
    """Imports of 1998 for every customer; the customer's number decides what the preview, the person and the opening lots are like."""
    acc = F.col("account_id").cast("long") % 6
    # Written once, as the preview, the removed and the new trades and both histories read it.
    x = written(t.transactions("c_custkey"))
    lots = written(x.filter(acc != 0).select("account_id", "symbol").distinct()).withColumn("txn_id", F.lit(0).cast("decimal(38,0)")).select(
        "account_id", "symbol", F.lit("1992-01-01").cast("date").alias("trade_date"), F.lit("buy").alias("txn_type"), F.lit(1e6).alias("quantity"),
        F.lit(10.0).alias("price_per_share"), F.lit(0.0).alias("commission"), F.lit(0.0).alias("tax_withheld"), F.lit("statement").alias("source"), "txn_id",
    )
    existing = x.unionByName(lots, allowMissingColumns=True)
    inside = F.col("txn_type").isin("buy", "sell") & F.col("trade_date").between(F.lit(START).cast("date"), F.lit(END).cast("date"))
    now = x.filter(inside)
    seen = now.filter(~((acc == 1) & (F.col("txn_id") % 11 == 0)))
    late = x.filter((acc == 2) & F.col("txn_type").isin("buy", "sell") & (F.year("trade_date") == 1997))
    remove = now.filter((F.col("source") != "manual") | (F.col("txn_id") % 5 == 0)).unionByName(late)
    new = now.filter(F.col("txn_id") % 7 != 0).select(
        "account_id", "symbol", "trade_date", "txn_type", "quantity", "price_per_share", "commission", F.lit(0.0).alias("tax_withheld"), F.lit("ledger").alias("source"), (F.col("txn_id") + 1).alias("txn_id"),
    )
    plans = written(new.groupBy("account_id").agg(F.sum("quantity").alias("opening_balance")).select(
        "account_id", F.lit(START).cast("date").alias("period_from"), F.lit(END).cast("date").alias("period_to"), "opening_balance", (F.col("opening_balance") + 1).alias("closing_balance"),
        acc.isin(3, 4).alias("confirmed"),
    ))
    cash = t.cash_movements("c_custkey")
    lines = cash.filter((F.year("move_date") == 1998) & (F.col("movement_id") % 3 != 0)).join(plans, "account_id", "left_semi").withColumn("movement_id", -F.col("movement_id"))
    periods = t.ledger_imports().select("account_id", "period_from", "period_to", "opening_balance")
    companies = t.listings().filter("symbol not like '%7'").select("symbol", "name")
    return A.apply_import(plans, existing, seen, remove, new, cash, lines, periods, companies)


@query("k05_import_outcomes", "account_id applied:b reason symbol rows:i")
def _(t):
    return _applied(t)["outcomes"]


@query("k05_import_trades", "account_id symbol trade_date:d txn_id txn_type quantity:4 source")
def _(t):
    return _applied(t)["trades"]


@query("k05_import_cash", "account_id move_date:d movement_id:i kind amount:2")
def _(t):
    return _applied(t)["cash"]


@query("k05_import_periods", "account_id period_from:d period_to:d opening_balance:2 closing_balance:2 trades:i cash_lines:i")
def _(t):
    return _applied(t)["periods"]


@query("k05_import_companies", "symbol name is_tracked:b")
def _(t):
    return _applied(t)["companies"]


@query("k07_snapshot_upsert", "account_id as_of:d deposit:2 imported:i")
def _(t):
    s = t.snapshots().select("account_id", "as_of", "deposit").withColumn("imported", F.lit(1))
    again = s.filter("month(as_of) % 2 = 0").withColumns({"deposit": F.col("deposit") + 10, "imported": F.lit(2)})
    late = s.filter("month(as_of) = 6").withColumns({"as_of": F.date_add("as_of", 3), "imported": F.lit(3)})
    return R.upsert_snapshots(s, again.unionByName(late))


@query("d12q_changed_since_preview", "account_id symbol trade_date:d txn_id change")
def _(t):
    x = t.transactions().select("account_id", "symbol", "trade_date", "txn_id")
    return R.unchanged_since(x.filter("txn_id % 11 <> 0"), x.filter("txn_id % 13 <> 0"), x.columns)


@query("a28_dividend_import_plan", "line_id company_name symbol record_date:d gross:2 tax_withheld:2 ledger_holding:4 recorded:b suggested:b holding_differs:b")
def _(t):
    return R.plan_dividend_import(written(t.report_lines()), t.transactions(), t.listings().withColumn("short_name", F.lit(None).cast("string")))


@query("r1_nested_receivables", "account_id as_of:d company_name entitlement:2 record_date:d lines:i")
def _(t):
    r = t.receivables("c_custkey")
    item = F.struct("company_name", "entitlement", F.date_format("record_date", "yyyy-MM-dd").alias("record_date"))
    # A statement of one customer and month end; a customer's dividends of a month are few.
    nested = r.groupBy("account_id", "as_of").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("receivables"))
    parsed = F.from_json("receivables", "array<struct<company_name: string, entitlement: double, record_date: string>>")
    rows = nested.withColumn("_a", F.coalesce(parsed, F.array().cast("array<struct<company_name: string, entitlement: double, record_date: string>>")))
    return rows.select("account_id", "as_of", F.size("_a").alias("lines"), F.explode_outer("_a").alias("e")).select("account_id", "as_of", "lines", "e.*")


# -- rules ----------------------------------------------------------------------


@query("d01q_transaction_rules", "txn_id symbol trade_date:d rule")
def _(t):
    n = F.col("txn_id") % 50
    rows = t.transactions().withColumns({
        "quantity": F.when(n == 1, -F.col("quantity")).when(n == 2, F.col("quantity") + 0.5).otherwise(F.col("quantity")),
        "commission": F.when(n == 3, F.lit(-1.0)).otherwise(F.col("commission")),
        "tax_withheld": F.when(n == 4, F.col("gross_amount") + 1).otherwise(F.col("tax_withheld")),
        "txn_type": F.when(n == 5, "gift").otherwise(F.col("txn_type")),
    })
    return Q.violations(rows, Q.transaction_rules(), ["txn_id", "symbol", "trade_date"])


@query("d02q_movement_rules", "movement_id:i rule")
def _(t):
    rows = t.cash_movements().withColumn("amount", F.when(F.col("movement_id") % 10 == 0, -F.col("amount")).when(F.col("movement_id") % 10 == 1, F.lit(0.0)).otherwise(F.col("amount")))
    return Q.violations(rows, Q.movement_rules(), ["movement_id"])


@query("d02q_target_rules", "target_id:i rule")
def _(t):
    rows = t.targets().withColumn("buy_below", F.when(F.col("target_id") % 4 == 0, F.col("sell_above")).otherwise(F.col("buy_below")))
    return Q.violations(rows, Q.target_rules(), ["target_id"])


@query("d02q_account_and_period_rules", "row_id rule")
def _(t):
    c = t.raw("customer").select(F.col("c_custkey").cast("string").alias("row_id"), F.lpad(F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 9 == 0, 15).otherwise(16), "1").alias("bo_number"))
    p = t.ledger_imports().select(F.concat_ws("/", "account_id", "period_from").alias("row_id"), F.when(F.month("period_from") == 7, F.date_sub("period_from", 1)).otherwise(F.col("period_to")).alias("period_to"), "period_from")
    return Q.violations(c, Q.account_rules(), ["row_id"]).unionByName(Q.violations(p, Q.period_rules(), ["row_id"]))


@query("d02q_factor_rules", "action_id:i rule")
def _(t):
    rows = t.corporate_actions().withColumns({
        "stock_pct": F.when(F.col("stock_pct") == 3, F.lit(-100.0)).otherwise(F.col("stock_pct")),
        "split_to": F.when(F.col("action_id") % 3 == 0, -F.col("split_to")).otherwise(F.col("split_to")),
    })
    return Q.violations(Fu.action_factors(rows), Q.factor_rules(), ["action_id"])


@query("d03q_unique_current_facts", "symbol fiscal_year:i tag rows:i")
def _(t):
    f = t.facts()
    return Q.duplicate_keys(f.unionByName(f.filter("tag = 'revenue' and fiscal_year % 2 = 0")).filter("is_current"), ["symbol", "fiscal_year", "tag"])


@query("d03q_unique_actions_null_dates_distinct", "symbol action_type ex_date:d rows:i")
def _(t):
    a = t.corporate_actions()
    return Q.duplicate_keys(a.unionByName(a.filter("action_id % 5 = 0")), ["symbol", "action_type", "ex_date"], nulls_distinct=True)


@query("d03q_unique_targets_null_accounts_equal", "symbol account_id rows:i")
def _(t):
    g = t.targets()
    return Q.duplicate_keys(g.unionByName(g.filter("target_id % 3 = 0")), ["symbol", "account_id"])


@query("d07q_ledger_line_rules", "import_id line_no:i rule")
def _(t):
    return Q.violations(t.ledger_lines()[0], Q.ledger_line_rules(), ["import_id", "line_no"])


def _holding_lines(t):
    pos = positions(t).filter("quantity > 0").join(stock_quotes(t), "symbol")
    k = key_of("symbol")
    cost = F.floor(F.col("cost_basis") * 100 + F.lit(0.5)) / 100
    lock = F.when(k % 5 == 0, 2.0).otherwise(0.0)
    rows = pos.select(
        "account_id", "symbol", "quantity", (F.col("quantity") - lock).alias("saleable_qty"), F.when(k % 10 == 0, 1.0).otherwise(lock).alias("lock_qty"), F.lit(0.0).alias("lien_qty"),
        (F.floor(F.try_divide("cost_basis", "quantity") * 100 + F.lit(0.5)) / 100 + F.when(k % 8 == 0, 1.0).otherwise(0.0)).alias("cost_price"), cost.alias("cost_amount"),
        F.col("close").alias("market_price"), (F.col("quantity") * F.col("close") + F.when(k % 6 == 0, 1.0).otherwise(0.0)).alias("market_value"),
    )
    return rows.withColumn("unrealised", F.col("market_value") - F.col("cost_amount") + F.when(k % 9 == 0, 0.5).otherwise(0.0))


@query("d08q_holding_rules", "account_id symbol rule")
def _(t):
    return Q.violations(_holding_lines(t), Q.holding_rules(), ["account_id", "symbol"])


@query("d08q_holding_totals", "account_id sum_cost:1 rule")
def _(t):
    lines = _holding_lines(t)
    totals = lines.groupBy("account_id").agg((F.sum("cost_amount") + F.when(F.col("account_id") == "BUILDING", 100.0).otherwise(0.0)).alias("total_cost"), (F.sum("market_value") - F.when(F.col("account_id") < "C", 50.0).otherwise(0.0)).alias("total_value"))
    return Q.holding_totals(lines, totals)


@query("d08q_status_rules", "account_id as_of:d rule")
def _(t):
    rows = t.snapshots().withColumns({
        "total_deposit": F.col("deposit") + F.col("ipo_refund") + F.col("cash_dividend") + F.col("share_transfer_in") + F.when(F.month("as_of") == 3, 1.0).otherwise(0.0),
        "total_withdraw": F.col("withdraw") + F.col("ipo_payment") + F.when(F.year("as_of") < 2001, F.col("share_transfer_out")).otherwise(0.0),
    })
    return Q.violations(rows, Q.status_rules(), ["account_id", "as_of"])


@query("d09q_dividend_line_rules", "line_id rule")
def _(t):
    k = key_of("symbol")
    rows = t.receivables().select(
        F.concat_ws("/", "account_id", "symbol", "record_date").alias("line_id"), "holding", F.col("entitlement").alias("gross"),
        (F.col("rate") * 10 + F.when(k % 4 == 0, 0.5).otherwise(0.0)).alias("percent"), (F.col("entitlement") * 0.1).alias("tax"),
        (F.col("entitlement") * 0.9 + F.when(k % 3 == 0, 0.05).otherwise(0.0)).alias("net"),
    )
    return Q.violations(rows, Q.dividend_line_rules(), ["line_id"])


@query("d10q_pnl_line_rules", "account_id company_name rule")
def _(t):
    k = F.col("profit") / 10
    rows = _pnl_lines(t).withColumns({"cost_price": F.lit(12.5), "sale_price": F.lit(15.0)})
    rows = rows.withColumns({
        "buy_amount": F.col("buy_qty") * 12.5 + F.when(k % 6 == 0, 50.0).otherwise(0.0), "sale_amount": F.col("sale_qty") * 15 + F.when(k % 11 == 0, 90.0).otherwise(0.0),
    })
    return Q.violations(rows, Q.pnl_line_rules(), ["account_id", "company_name"])


@query("d11q_plan_rules", "movement_id:i rule")
def _(t):
    rows = t.cash_movements().select("movement_id", F.col("move_date").alias("row_date"), "kind", "amount", F.lit(None).cast("double").alias("quantity"))
    rows = rows.withColumn("kind", F.when(F.col("movement_id") % 9 == 0, "sell").otherwise(F.col("kind")))
    return Q.violations(rows, Q.plan_rules("1996-01-01", "2000-12-31"), ["movement_id"])


@query("d14q_table_counts", "table_name rows:i")
def _(t):
    return Q.table_counts({"transactions": t.transactions(), "daily_prices": t.daily_prices(), "facts": t.facts(), "companies": t.companies(), "cash_movements": t.cash_movements()})


@query("p11_line_classes", "movement_id:i kind line_class")
def _(t):
    k, a = F.col("kind"), F.abs("amount")
    text = (
        F.when(k == "dividend", "Cash Dividend credited").when(k == "ipo", "IPO application").when(k == "deposit", "Received by cheque")
        .when(k == "fee", F.when(F.col("movement_id") % 2 == 0, "BO maintenance").otherwise("Excise duty")).when(k == "withdrawal", F.when(F.col("movement_id") % 2 == 0, "Paid to client").otherwise("BEFTN transfer")).otherwise("Journal")
    )
    debit, credit = F.when(k.isin("deposit", "dividend"), 0.0).otherwise(a), F.when(k.isin("deposit", "dividend"), a).otherwise(0.0)
    return t.cash_movements().withColumn("line_class", Q.classify_line(F.lit("Journal"), text, debit, credit))


@query("p12_note_backfill", "txn_id symbol trade_date:d source record_date:d")
def _(t):
    note = (
        F.when(F.col("source") == "ledger", "From the broker ledger 2000")
        .when(F.col("record_date").isNotNull(), F.concat(F.lit("From the broker cash dividend report, Record Date "), F.date_format("record_date", "yyyy-MM-dd")))
        .when(F.col("source") == "statement", "From reconciling the statement").otherwise("typed in")
    )
    return t.transactions().withColumn("_note", note).select("txn_id", "symbol", "trade_date", Q.backfill_source(F.col("_note")).alias("source"), Q.record_date_in(F.col("_note")).alias("record_date"))
