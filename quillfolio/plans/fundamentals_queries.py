"""Registered queries of the fundamentals family."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numeric as N
from ..operators import fundamentals as Fu
from ..operators import prices as P
from ..sources import stored
from ..sources.testtables import TAGS, key_of
from .registry import query

WIDE_SPEC = "symbol fiscal_year:i " + " ".join(f"{t}:{2 if i < 14 else 6}" for i, t in enumerate(TAGS))


def wide(t):
    return Fu.pivot_facts(Fu.current_facts(t.facts()), TAGS)


def restated(t):
    return Fu.restate(wide(t), t.companies(), t.corporate_actions())


def screener(t):
    return Fu.screener(t.companies(), restated(t), P.latest_quotes(P.quoted(t.daily_prices())))


SCREENER_SPEC = (
    "symbol name short_name sector price:4 change_pct:6 trade_date:d latest_fiscal_year:i years_entered:i pe:4 pb:4 dividend_yield:6 "
    "range_position:6 above_low:6 roe:6 roce:6 net_margin:6 debt_to_equity:6 cash_conversion:6 revenue_cagr:6 eps_cagr:6"
)


@query("a01_facts_pivoted", WIDE_SPEC)
def _(t):
    return wide(t)


@query("a02_year_metrics", "symbol fiscal_year:i " + " ".join(m + (":2" if m == "fcf" else ":6") for m in Fu.METRICS))
def _(t):
    return Fu.year_metrics(wide(t))


@query("a03_history_summary", "symbol years:i years_entered:i revenue_cagr:6 eps_cagr:6 net_profit_cagr:6 average_roe:6 average_roce:6 latest_debt_to_equity:6 positive_fcf_years:i fcf_years_counted:i")
def _(t):
    return Fu.history_summary(Fu.year_metrics(restated(t)))


@query("a04_restated_figures", WIDE_SPEC)
def _(t):
    return restated(t)


@query("f03_action_factors", "symbol action_type ex_date:d action_id:i factor:8")
def _(t):
    return Fu.action_factors(t.corporate_actions())


@query("j06_cumulative_factors", "symbol fiscal_year:i period_end:d factor:6")
def _(t):
    ended = Fu.with_period_end(wide(t), t.companies()).select("symbol", "fiscal_year", "period_end")
    f = Fu.cumulative_factors(t.corporate_actions(), ended.select("symbol", F.col("period_end").alias("at")))
    return ended.join(f.withColumnRenamed("at", "period_end"), ["symbol", "period_end"])


@query("a05_verification_counts", "symbol fiscal_year:i total:i unverified:i verified:i disputed:i")
def _(t):
    return Fu.verification_counts(t.facts())


@query("q_period_summaries", "symbol fiscal_year:i basis period_start:d period_end:d is_complete:b facts:i unverified:i verified:i disputed:i")
def _(t):
    return Fu.period_summaries(t.periods(), t.facts().withColumn("basis", F.lit("consolidated")))


@query("q_fact_history", WIDE_SPEC + " facts:i unverified:i disputed:i")
def _(t):
    return Fu.fact_history(t.facts(), TAGS)


@query("a15_latest_dps", "symbol dividend_per_share:6 fiscal_year:i")
def _(t):
    return Fu.latest_dps(restated(t))


@query("a32_j15_screener", SCREENER_SPEC)
def _(t):
    return screener(t)


for _name, _ranges in Fu.SCREENS.items():
    @query(f"p02_screen_{_name}", SCREENER_SPEC)
    def _(t, _ranges=_ranges):
        return Fu.screen(screener(t), ranges=_ranges)


@query("p02_screen_income_split", SCREENER_SPEC)
def _(t):
    """The income screen as if every share had been split in five and kept its dividend."""
    return Fu.screen(screener(t).withColumn("dividend_yield", F.col("dividend_yield") * 5), ranges=Fu.SCREENS["income"])


@query("p01_screen_filters", SCREENER_SPEC)
def _(t):
    return Fu.screen(screener(t), search="nation 1", sector="America", ranges={"pe": (0.0, None)}, with_data_only=True)


@query("t01_screener_sorted", SCREENER_SPEC)
def _(t):
    return Fu.sort_rows(screener(t), "pe", descending=True)


@query("f05_valuation", "symbol price:4 pe:4 pb:4 dividend_yield:6 range_position:6 above_low:6 below_high:6 earnings_yield:6")
def _(t):
    return screener(t)


@query("p06_scaled_values", "symbol fiscal_year:i tag value_base:4 scale natural_unit in_natural:6")
def _(t):
    base = Fu.current_facts(t.facts()).withColumn("natural_unit", N.natural_scale(F.col("value_base")))
    return base.withColumn("in_natural", N.from_base(F.col("value_base"), F.col("natural_unit")))


@query("p07_scale_by_unit", "symbol fiscal_year:i tag applied_scale")
def _(t):
    return stored.applied_scale(t.facts(), stored.line_items(t.spark))


@query("v1_a31_verification", "symbol fiscal_year:i tag stored:6 typed:6 outcome")
def _(t):
    return _verdicts(t)


@query("v1_verification_across_scales", "symbol fiscal_year:i tag stored:6 typed:6 outcome typed_scale")
def _(t):
    return _verdicts(t, mixed=True)


@query("k06_revisions_across_scales", "symbol fiscal_year:i tag revision:i is_current:b value_reported:6 scale value_base:4 verification")
def _(t):
    held = t.facts().filter((key_of("symbol").cast("int") + F.col("fiscal_year") + F.length("tag")) % 6 != 5)
    rows = Fu.append_revisions(held, _verdicts(t, mixed=True), stored.line_items(t.spark))
    return rows.withColumn("value_base", N.to_base(F.col("value_reported"), F.col("scale")))


def _verdicts(t, mixed: bool = False):
    """Typed figures against stored ones; mixed: money of even fiscal years is typed in crore."""
    facts = t.facts().filter("is_current")
    n = (key_of("symbol").cast("int") + F.col("fiscal_year") + F.length("tag")) % 6
    v = F.col("value_reported")
    whole = F.floor(v * 100) / 100
    crore = (F.col("scale") == "million") & (F.col("fiscal_year") % 2 == 0) & F.lit(mixed)
    printed = lambda x: F.when(crore, F.format_number(x / 10, 3)).otherwise(F.format_number(x, 2))
    text = (
        F.when(n == 0, "").when(n == 1, "n.m.").when(n == 2, F.concat(F.lit("("), printed(F.abs(whole)), F.lit(")")))
        .when(n == 3, printed(whole)).otherwise(printed(whole + 1))
    )
    scales = [[F.when(crore, "crore").otherwise(F.col("scale")).alias("typed_scale")], [F.col("scale").alias("stored_scale")]] if mixed else [[], []]
    typed = facts.select("symbol", "fiscal_year", "tag", text.alias("typed_text"), *scales[0])
    have = facts.filter(n != 5).select("symbol", "fiscal_year", "tag", F.when(n == 3, whole).otherwise(v).alias("stored"), *scales[1])
    return Fu.verify_figures(have, typed)


@query("a31_verdict_summary", "symbol fiscal_year:i confirmed:i corrected:i added:i skipped:i error:i")
def _(t):
    return Fu.verdict_summary(_verdicts(t))


@query("k06_revisions_after_verification", "symbol fiscal_year:i tag revision:i is_current:b value_reported:6 scale value_base:4 verification")
def _(t):
    held = t.facts().filter((key_of("symbol").cast("int") + F.col("fiscal_year") + F.length("tag")) % 6 != 5)
    rows = Fu.append_revisions(held, _verdicts(t), stored.line_items(t.spark))
    return rows.withColumn("value_base", N.to_base(F.col("value_reported"), F.col("scale")))


@query("d04q_import_checks", "symbol fiscal_year:i severity reason")
def _(t):
    w = wide(t)
    off = F.when(F.col("fiscal_year") % 6 == 1, 9e6).otherwise(0.0)
    published = Fu.year_metrics(w).select(
        "symbol", "fiscal_year", (F.col("net_operating_cash_flow") + F.col("capex") + off).alias("published_fcf"),
        (F.col("roe") * 100 + F.when(F.col("fiscal_year") % 5 == 2, 0.2).otherwise(0.0)).alias("published_roe_pct"),
    )
    return Fu.import_checks(w, published)


@query("f_latest_reported_year", "symbol latest_fiscal_year:i label range_label years")
def _(t):
    m, d = F.col("fye_month"), F.col("fye_day")
    year = D.latest_reported_fiscal_year(m, d, F.lit("2001-08-15").cast("date"))
    return t.companies().withColumn("latest_fiscal_year", year).select(
        "symbol", "latest_fiscal_year", D.fiscal_year_label(F.col("latest_fiscal_year")).alias("label"),
        D.fiscal_range_label(m, d, F.col("latest_fiscal_year")).alias("range_label"),
        F.array_join(D.fiscal_years_back(F.col("latest_fiscal_year"), 5).cast("array<string>"), ",").alias("years"),
    )


@query("d01_d03_fiscal_calendar", "symbol trade_date:d fiscal_year:i fy_start:d fy_end:d q2_start:d q2_end:d cumulative_end:d")
def _(t):
    days = t.daily_prices().select("symbol", "trade_date").join(t.companies(), "symbol")
    m, d, fy = F.col("fye_month"), F.col("fye_day"), F.col("fiscal_year")
    return days.withColumn("fiscal_year", D.fiscal_year_of(m, d, F.col("trade_date"))).withColumns({
        "fy_start": D.fiscal_year_start(m, d, fy), "fy_end": D.fiscal_year_end(m, d, fy),
        "q2_start": D.fiscal_quarter_start(m, d, fy, F.lit(2)), "q2_end": D.fiscal_quarter_end(m, d, fy, F.lit(2)),
        "cumulative_end": D.fiscal_quarter_end(m, d, fy, F.lit(3)),
    })
