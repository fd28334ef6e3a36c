"""Dividend income, projections, payment detection and declared records."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import round_half_up
from ..sources.scratch import written

# Fixed values.
PAYMENT_WINDOW_DAYS = 120
PLAUSIBLE_NET_SHARE = 0.8


def income_by_year(txns: DataFrame) -> DataFrame:
    out = txns.filter("txn_type = 'dividend'").groupBy(F.year("trade_date").alias("year")).agg(
        F.sum(F.coalesce("gross_amount", F.lit(0.0))).alias("gross"), F.sum("tax_withheld").alias("tax"), F.count(F.lit(1)).alias("payments")
    )
    return out.withColumn("net", F.col("gross") - F.col("tax")).orderBy(F.desc("year"))


def project_income(holdings: DataFrame, dps: DataFrame) -> DataFrame:
    """A year's income per open holding if each company repeats its last dividend."""
    j = holdings.filter("quantity > 0").join(dps.select("symbol", "dividend_per_share", "fiscal_year"), "symbol", "left")
    income = F.col("dividend_per_share") * F.col("quantity")
    return j.select("symbol", "quantity", "cost_basis", "market_value", "dividend_per_share", "fiscal_year", income.alias("annual_income")).withColumns({
        "yield_on_value": F.when(F.col("market_value") > 0, F.try_divide(F.col("annual_income"), F.col("market_value"))),
        "yield_on_cost": F.when(F.col("cost_basis") > 0, F.try_divide(F.col("annual_income"), F.col("cost_basis"))),
    })


def projection_totals(rows: DataFrame) -> DataFrame:
    """Totals with yields over holdings whose dividend is known only."""
    known = F.col("annual_income").isNotNull()
    zero = F.lit(0.0)
    out = rows.agg(
        F.coalesce(F.sum("annual_income"), zero).alias("annual_income"),
        F.coalesce(F.sum(F.when(known, F.coalesce("market_value", zero))), zero).alias("value"),
        F.coalesce(F.sum(F.when(known, F.col("cost_basis"))), zero).alias("cost"),
    )
    return out.withColumns({
        "yield_on_value": F.when(F.col("value") > 0, F.try_divide(F.col("annual_income"), F.col("value"))),
        "yield_on_cost": F.when(F.col("cost") > 0, F.try_divide(F.col("annual_income"), F.col("cost"))),
    })


def gone_receivables(receivables: DataFrame, statements: DataFrame) -> DataFrame:
    """Receivables of a statement that the account's next statement no longer lists."""
    following = statements.select(
        "account_id", "as_of", F.lead("as_of").over(W.partitionBy("account_id").orderBy("as_of")).alias("next_as_of")
    ).filter("next_as_of is not null")
    due = receivables.join(following, ["account_id", "as_of"])
    still = receivables.select("account_id", F.col("as_of").alias("next_as_of"), "company_name", "record_date").alias("c")
    p = due.alias("p")
    same = (
        (F.col("p.account_id") == F.col("c.account_id")) & (F.col("p.next_as_of") == F.col("c.next_as_of"))
        & (F.col("p.company_name") == F.col("c.company_name")) & F.col("p.record_date").eqNullSafe(F.col("c.record_date"))
    )
    return p.join(still, same, "left_anti")


def detect_paid(receivables: DataFrame, credited: DataFrame) -> DataFrame:
    """Paid receivables with the cash that arrived split over them by what was due.

    ``credited`` holds (account_id, as_of, next_as_of, credited): the dividend
    cash that came in between two statements.
    """
    keys = ["account_id", "as_of"]
    gone = written(gone_receivables(receivables, credited.select(*keys).unionByName(credited.select("account_id", F.col("next_as_of").alias("as_of"))).distinct()))
    due = gone.groupBy(*keys).agg(F.sum("entitlement").alias("due"))
    share = due.join(credited.select(*keys, F.greatest(F.lit(0.0), F.col("credited")).alias("arrived")), keys)
    share = share.filter("arrived >= 0.005 and due > 0").withColumn("net_share", F.least(F.lit(1.0), F.try_divide(F.col("arrived"), F.col("due"))))
    gross = F.col("entitlement")
    return gone.join(share, keys).select(
        *keys, "next_as_of", "company_name", "symbol", "record_date", gross.alias("gross"), "net_share",
        round_half_up(gross - round_half_up(gross * F.col("net_share"))).alias("tax_withheld"),
        (F.col("net_share") < PLAUSIBLE_NET_SHARE).alias("check_split"),
    )


def unexplained_credits(paid: DataFrame, credited: DataFrame, receivables: DataFrame) -> DataFrame:
    """Dividend cash of a period that no receivable explains."""
    keys = ["account_id", "as_of"]
    explained = paid.groupBy(*keys).agg(F.sum(F.col("gross") - F.col("tax_withheld")).alias("accounted"))
    statements = credited.select(*keys).unionByName(credited.select("account_id", F.col("next_as_of").alias("as_of"))).distinct()
    due = gone_receivables(receivables, statements).groupBy(*keys).agg(F.sum("entitlement").alias("due"))
    arrived = F.greatest(F.lit(0.0), F.col("credited"))
    out = credited.join(explained, keys, "left").join(due, keys, "left")
    left = (
        F.when(F.col("due").isNull(), arrived).when(arrived < 0.005, F.lit(0.0)).when(F.col("due") <= 0, arrived)
        .otherwise(round_half_up(F.greatest(F.lit(0.0), arrived - F.coalesce("accounted", F.lit(0.0)))))
    )
    return out.select(*keys, "next_as_of", "credited", left.alias("unexplained"))


def mark_recorded(lines: DataFrame, txns: DataFrame) -> DataFrame:
    """Add ``recorded``: whether the ledger already holds each line's dividend.

    Split so that each part is an equality join, whatever one (account, symbol)
    holds: by record date where both sides have one, else by amount.  Amounts
    within a cent share the nearest cent or a neighbouring one.
    """
    paid = txns.filter("txn_type = 'dividend'").select(
        "account_id", "symbol", F.col("record_date").alias("_rd"), F.coalesce("gross_amount", F.lit(0.0)).alias("_g"), F.col("trade_date").alias("_td")
    )
    ids = lines.select("line_id", "account_id", "symbol", "gross", "record_date")
    dated = paid.filter("_rd is not null").select("account_id", "symbol", F.col("_rd").alias("record_date")).distinct()
    by_date = ids.join(dated, ["account_id", "symbol", "record_date"], "left_semi").select("line_id")

    cent = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("long")
    # One row per cent, day and dated-or-not, whatever number of payments share it.
    amounts = paid.groupBy("account_id", "symbol", "_td", F.col("_rd").isNotNull().alias("_dated"), "_g").agg(F.count(F.lit(1)).alias("_n"))
    near = ids.withColumn("_c", F.explode(F.array(cent("gross") - 1, cent("gross"), cent("gross") + 1))).alias("l")
    money = amounts.withColumn("_c", cent("_g")).alias("p")
    equal = [F.col(f"l.{k}") == F.col(f"p.{k}") for k in ("account_id", "symbol", "_c")]
    date, paid_on = F.col("l.record_date"), F.col("p._td")
    fits = (F.abs(F.col("p._g") - F.col("l.gross")) < 0.01) & ~(date.isNotNull() & F.col("p._dated")) & (
        date.isNull() | paid_on.between(date, F.date_add(date, PAYMENT_WINDOW_DAYS))
    )
    hit = near.join(money, equal[0] & equal[1] & equal[2] & fits, "left_semi").select("line_id")
    found = by_date.unionByName(hit).distinct().withColumn("_hit", F.lit(True))
    return lines.join(found, "line_id", "left").withColumn("recorded", F.coalesce("_hit", F.lit(False))).drop("_hit")


def dividend_record(declared: DataFrame) -> DataFrame:
    """Paying years, streak, change and average of each company's declared dividends.

    ``declared`` holds (symbol, ex_date, amount, restated).
    """
    years = declared.filter("amount > 0").groupBy("symbol", F.year("ex_date").alias("year")).agg(
        F.sum("amount").alias("total"), F.count(F.lit(1)).alias("announced"), F.max("restated").alias("restated"),
        F.max("ex_date").alias("last_ex"), F.max_by("amount", "ex_date").alias("last_amount"),
    )
    newest_first = W.partitionBy("symbol").orderBy(F.desc("year"))
    n = F.row_number().over(newest_first)
    rows = years.select(
        "*", n.alias("n"), (F.max("year").over(W.partitionBy("symbol")) - F.col("year") + 1 == n).alias("unbroken"),
        F.lead("total").over(newest_first).alias("prior_total"), F.lead("year").over(newest_first).alias("prior_year"),
    )
    first, five = F.col("n") == 1, F.col("n") <= 5
    change = F.when((F.col("prior_year") == F.col("year") - 1) & (F.col("prior_total") > 0), F.try_divide(F.col("total"), F.col("prior_total")) - 1)
    return rows.groupBy("symbol").agg(
        F.max("last_ex").alias("latest_ex_date"), F.max_by("last_amount", "last_ex").alias("latest_amount"),
        F.count(F.lit(1)).alias("paid_years"), (F.max("year") - F.min("year") + 1).alias("span_years"),
        F.count_if("unbroken").alias("streak"), F.max(F.when(first, change)).alias("change_on_prior_year"),
        F.avg(F.when(five, F.col("total"))).alias("five_year_average"), F.max(five & F.col("restated")).alias("restated_inside"),
    )


def dividend_years(declared: DataFrame) -> DataFrame:
    """The five newest paying years of each company."""
    years = declared.filter("amount > 0").groupBy("symbol", F.year("ex_date").alias("year")).agg(
        F.sum("amount").alias("total"), F.count(F.lit(1)).alias("announced"), F.max("restated").alias("restated")
    )
    return years.withColumn("place", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("year")))).filter("place <= 5")


def dividend_yield(amount: Column, price: Column) -> Column:
    return F.when((amount > 0) & (price > 0), F.try_divide(amount, price))


def looks_restated(amount: Column) -> Column:
    """More decimals than a declared dividend can have."""
    return F.abs(amount * 100 - F.floor(amount * 100 + 0.5)) > 1e-9


def percent_of_face(amount: Column, face: Column) -> Column:
    return F.when(face > 0, F.format_string("%.6f", F.try_divide(amount, face) * 100))


def merge_dividends(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert on (symbol, ex date), each row marked inserted, updated or kept."""
    keys = ["symbol", "ex_date"]
    j = stored.select(*keys, F.col("amount").alias("_o"), F.lit(True).alias("_have")).join(
        incoming.select(*keys, F.col("amount").alias("_n"), F.lit(True).alias("_new")), keys, "full_outer"
    )
    state = F.when(F.col("_have").isNull(), "inserted").when(F.col("_new"), "updated").otherwise("kept")
    differs = F.col("_have") & F.col("_new") & (F.col("_o").isNull() | (F.abs(F.col("_o") - F.col("_n")) > 0.005))
    return j.select(*keys, F.coalesce("_n", "_o").alias("amount"), state.alias("state"), F.coalesce(differs, F.lit(False)).alias("differs"))
