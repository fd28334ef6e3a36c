"""Registered queries of the dividend family."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dividends as Dv
from ..operators import fundamentals as Fu
from ..operators import ledger as L
from .fundamentals_queries import restated
from .ledger_queries import positions, stock_quotes
from ..sources.scratch import written
from ..sources.testtables import key_of
from .registry import query


@query("a13_income_by_year", "year:i gross:2 tax:2 net:2 payments:i")
def _(t):
    return Dv.income_by_year(t.transactions())


def _projection(t):
    dps = Fu.latest_dps(restated(t)).withColumnRenamed("symbol", "company")
    dps = t.listings().select("symbol", "company").join(dps, "company")
    return Dv.project_income(L.merge_by_symbol(positions(t)), dps)


@query("a14_income_projection", "symbol quantity:4 dividend_per_share:6 fiscal_year:i annual_income:4 yield_on_value:6 yield_on_cost:6")
def _(t):
    return _projection(t).orderBy(F.coalesce("annual_income", F.lit(-1.0)).desc(), "symbol")


@query("a14_projection_totals", "annual_income:2 value:2 cost:2 yield_on_value:6 yield_on_cost:6")
def _(t):
    return Dv.projection_totals(_projection(t))


@query("j08_gone_receivables", "account_id as_of:d next_as_of:d company_name record_date:d entitlement:2")
def _(t):
    return Dv.gone_receivables(t.receivables(), t.snapshots().select("account_id", "as_of"))


@query("a16_paid_dividends", "account_id as_of:d next_as_of:d company_name symbol record_date:d gross:2 tax_withheld:2 check_split:b")
def _(t):
    return Dv.detect_paid(written(t.receivables()), written(t.credits()))


@query("a16_unexplained_credits", "account_id as_of:d next_as_of:d credited:2 unexplained:2")
def _(t):
    r, c = written(t.receivables()), written(t.credits())
    return Dv.unexplained_credits(Dv.detect_paid(r, c), c, r)


@query("j07_j19_recorded_receivables", "account_id as_of:d symbol record_date:d gross:2 recorded:b")
def _(t):
    lines = t.receivables().withColumn("line_id", F.concat_ws("/", "account_id", "symbol", "record_date")).withColumnRenamed("entitlement", "gross")
    half = key_of("symbol") % 2 == 0
    return Dv.mark_recorded(lines, t.transactions().filter(~half).withColumn("record_date", F.when(F.col("txn_id") % 3 != 0, F.col("record_date"))))


@query("a17_w09_dividend_record", "symbol latest_ex_date:d latest_amount:4 paid_years:i span_years:i streak:i change_on_prior_year:6 five_year_average:6 restated_inside:b")
def _(t):
    return Dv.dividend_record(t.declared())


@query("t04_top_five_dividend_years", "symbol year:i total:4 announced:i restated:b place:i")
def _(t):
    return Dv.dividend_years(t.declared())


@query("f07_dividend_yields", "symbol ex_date:d action_id:i yield:8")
def _(t):
    px = t.daily_prices().groupBy("symbol").agg(F.max_by("close", "trade_date").alias("close"))
    return t.declared().join(px, "symbol", "left").withColumn("yield", Dv.dividend_yield(F.col("amount"), F.col("close")))


@query("p09_restated_amounts", "symbol ex_date:d action_id:i amount:4 looks_restated:b percent")
def _(t):
    return t.declared().withColumns({"looks_restated": Dv.looks_restated(F.col("amount")), "percent": Dv.percent_of_face(F.col("amount"), F.lit(10.0))})


def _stored_and_incoming(t):
    d = t.declared().select("symbol", "ex_date", "amount", "action_id")
    changed = d.filter("action_id % 2 = 0").withColumn("amount", F.col("amount") + F.when(F.col("action_id") % 4 == 0, 0.5).otherwise(0.001))
    return d.filter("action_id % 3 <> 0"), changed


@query("k04_d13q_dividend_upsert", "symbol ex_date:d amount:4 state differs:b")
def _(t):
    return Dv.merge_dividends(*_stored_and_incoming(t))


@query("k04_upsert_counts", "state rows:i differing:i")
def _(t):
    return Dv.merge_dividends(*_stored_and_incoming(t)).groupBy("state").agg(F.count(F.lit(1)).alias("rows"), F.count_if("differs").alias("differing"))
