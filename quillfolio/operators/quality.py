"""Data-quality rules: each returns one row per violation, with the rule it breaks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F



def violations(df: DataFrame, rules: dict[str, Column], keep: list[str]) -> DataFrame:
    """One row per (row, broken rule); a rule is a condition that must not hold."""
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return df.select(*keep, F.explode(found).alias("rule"))


def transaction_rules() -> dict[str, Column]:
    kind, q, p = F.col("txn_type"), F.col("quantity"), F.col("price_per_share")
    share = kind.isin("buy", "sell", "bonus", "rights")
    return {
        "unknown type": ~(share | (kind == "dividend")),
        "quantity must be positive": share & ~F.coalesce(q > 0, F.lit(False)),
        "quantity must be whole": share & (q != F.floor(q)),
        "price required": kind.isin("buy", "sell", "rights") & ~F.coalesce(p >= 0, F.lit(False)),
        "dividend needs an amount": (kind == "dividend") & ~F.coalesce(F.col("gross_amount") > 0, F.lit(False)),
        "negative commission or tax": (F.col("commission") < 0) | (F.col("tax_withheld") < 0),
        "tax above dividend": F.col("tax_withheld") > F.col("gross_amount"),
        "record date on a trade": F.col("record_date").isNotNull() & (kind != "dividend"),
        "commission on a bonus": (kind == "bonus") & (F.col("commission") > 0),
    }


def movement_rules() -> dict[str, Column]:
    kind, a = F.col("kind"), F.col("amount")
    return {
        "unknown kind": ~kind.isin("deposit", "withdrawal", "fee", "dividend", "ipo", "other"),
        "amount is zero": a == 0,
        "must come in": kind.isin("deposit", "dividend") & (a < 0),
        "must go out": kind.isin("withdrawal", "fee") & (a > 0),
    }


def target_rules() -> dict[str, Column]:
    b, s = F.col("buy_below"), F.col("sell_above")
    return {"no level": b.isNull() & s.isNull(), "level must be positive": (b <= 0) | (s <= 0), "buy level not under sell level": b >= s}


def period_rules() -> dict[str, Column]:
    return {"period ends before it starts": F.col("period_to") < F.col("period_from")}


def account_rules() -> dict[str, Column]:
    return {"account number must have 16 digits": ~F.col("bo_number").rlike(r"^\d{16}$")}


def factor_rules() -> dict[str, Column]:
    return {"impossible terms": F.col("factor").isNull(), "factor must be positive": F.col("factor") <= 0}


def duplicate_keys(df: DataFrame, keys: list[str], nulls_distinct: bool = False) -> DataFrame:
    """Keys held by more than one row; with distinct nulls, keys with a missing part never clash."""
    rows = df
    if nulls_distinct:
        for k in keys:
            rows = rows.filter(F.col(k).isNotNull())
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def ledger_line_rules() -> dict[str, Column]:
    """Arithmetic of a printed ledger trade; the rate is rounded, so half a cent a share is allowed."""
    q, a, fee = F.col("quantity"), F.col("amount"), F.col("commission")
    off = lambda x, y, t: F.abs(x - y) > t
    return {
        "shares are not a positive whole number": ~F.coalesce((q > 0) & (q == F.floor(q)), F.lit(False)),
        "amount differs from shares at the rate": off(q * F.col("rate"), a, q * 0.005 + 0.011),
        "debit is not amount plus commission": (F.col("kind") == "buy") & off(a + fee, F.col("debit"), 0.011),
        "credit is not amount less commission": (F.col("kind") == "sell") & off(a - fee, F.col("credit"), 0.011),
    }


def holding_rules() -> dict[str, Column]:
    """Arithmetic of a statement's holding line."""
    q, cost, value = F.col("quantity"), F.col("cost_amount"), F.col("market_value")
    off = lambda x, y, t: F.abs(x - y) > t
    return {
        "parts do not add up": F.col("saleable_qty") + F.col("lock_qty") + F.col("lien_qty") != q,
        "cost is not quantity times price": off(q * F.col("cost_price"), cost, q * 0.005 + 0.02),
        "value is not quantity times price": off(q * F.col("market_price"), value, 0.05),
        "open gain differs from value minus cost": off(value - cost, F.col("unrealised"), 0.05),
        "no positive quantity": q <= 0,
        "fraction of a share": q != F.floor(q),
    }


def holding_totals(lines: DataFrame, totals: DataFrame) -> DataFrame:
    """Statements whose printed totals line disagrees with the sum of its holdings."""
    sums = lines.groupBy("account_id").agg(
        F.sum("cost_amount").alias("sum_cost"), F.sum("market_value").alias("sum_value"), F.count(F.lit(1)).alias("lines")
    )
    slack = 0.05 * F.greatest(F.col("lines"), F.lit(1))
    j = totals.join(sums, "account_id")
    return violations(j, {
        "holdings cost does not sum to the total": F.abs(F.col("sum_cost") - F.col("total_cost")) > slack,
        "holdings value does not sum to the total": F.abs(F.col("sum_value") - F.col("total_value")) > slack,
    }, ["account_id", "sum_cost", "sum_value"])


def status_rules() -> dict[str, Column]:
    """Lines of an account's status against its printed sums."""
    n = lambda c: F.coalesce(c, F.lit(0.0))
    paid_in = n("deposit") + n("ipo_refund") + n("cash_dividend") + n("share_transfer_in")
    paid_out = n("withdraw") + n("ipo_payment") + n("share_transfer_out")
    return {
        "deposit lines do not sum to the total": F.abs(paid_in - F.col("total_deposit")) > 0.05,
        "withdrawal lines do not sum to the total": F.abs(paid_out - F.col("total_withdraw")) > 0.05,
    }


def dividend_line_rules() -> dict[str, Column]:
    return {
        "net is not gross less tax": F.abs(F.col("gross") - F.col("tax") - F.col("net")) > 0.011,
        "gross is not holding at this percent of face value": F.abs(F.col("holding") * F.col("percent") * 0.1 - F.col("gross")) > 0.05,
    }


def pnl_line_rules() -> dict[str, Column]:
    bq, sq = F.col("buy_qty"), F.col("sale_qty")
    off = lambda x, y, t: F.abs(x - y) > t
    return {
        "buy amount is not quantity times price": off(bq * F.col("cost_price"), F.col("buy_amount"), bq * 0.005 + 0.02),
        "sale amount is not quantity times price": off(sq * F.col("sale_price"), F.col("sale_amount"), sq * 0.005 + 0.02),
        # Only a closed position's profit follows from the period's own figures.
        "profit is not sale less cost": (bq == sq) & off(F.col("sale_amount") - F.col("buy_amount"), F.col("profit"), 0.05),
    }


def plan_rules(start, end) -> dict[str, Column]:
    """Rows of an import plan sent back to be applied."""
    day = F.col("row_date")
    return {
        "date outside the period": ~day.between(F.lit(start).cast("date"), F.lit(end).cast("date")),
        "unknown kind": ~F.col("kind").isin("buy", "sell", "deposit", "withdrawal", "fee", "dividend", "ipo"),
        "shares must be positive": F.col("kind").isin("buy", "sell") & ~F.coalesce(F.col("quantity") > 0, F.lit(False)),
        "must come in": F.col("kind").isin("deposit", "dividend") & (F.col("amount") < 0),
        "must go out": F.col("kind").isin("withdrawal", "fee") & (F.col("amount") > 0),
    }


def classify_line(label: Column, description: Column, debit: Column, credit: Column) -> Column:
    """What a ledger line is, from its label and particulars.

    The keyword lists are fixed values.
    """
    text = F.upper(description)
    out = (debit > 0) & (credit == 0)
    return (
        F.when(F.lower(label) == "buy", "buy").when(F.lower(label).isin("sale", "sall"), "sell")
        .when(text.contains("DIVIDEND"), "dividend").when(text.rlike(r"\bIPO\b"), "ipo").when((credit > 0) & (debit == 0), "deposit")
        .when(out & text.rlike("FEE|CHARGE|MAINTENANCE|CDBL|EXCISE|DUTY"), "fee")
        .when(out & text.rlike("WITHDRAW|PAYMENT|CHEQUE|CHQ|BEFTN|RTGS|NPSB|FUND TRANSFER|PAID TO"), "withdrawal")
        .otherwise("other")
    )


def backfill_source(notes: Column) -> Column:
    """Where a ledger row came from, by the words of its note (fixed values)."""
    return (
        F.when(notes.like("From the % ledger %"), "ledger").when(notes.like("From the % cash dividend report%"), "dividend_report")
        .when(notes.like("Opening position from the %") | notes.like("From reconciling the %") | notes.like("Paid between statements%"), "statement")
        .otherwise("manual")
    )


def record_date_in(notes: Column) -> Column:
    found = F.regexp_extract(notes, r"(?i)record date (\d{4}-\d{2}-\d{2})", 1)
    return F.try_to_date(F.nullif(found, F.lit("")), "yyyy-MM-dd")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows")) for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
