"""Reported figures: pivot, restatement for corporate actions, metrics, valuation, screening.

A company reports once a year and acts at most once per kind and day, so every
per-company sequence here is bounded by the calendar.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import dates as D
from ..sources.scratch import written
from ..functions.numeric import cagr, growth, mean_of_known, near, ratio, same_number, scale_factor, to_base

# Figures a bonus, rights issue or split makes incomparable.
PER_SHARE_TAGS = ["eps_basic", "eps_diluted", "navps", "nocfps", "dividend_per_share"]
METRICS = [
    "revenue_growth", "eps_growth", "gross_margin", "operating_margin", "net_margin", "roe", "roce",
    "debt_to_equity", "current_ratio", "fcf", "cash_conversion", "payout_ratio",
]


def current_facts(facts: DataFrame) -> DataFrame:
    """Current revisions in base units."""
    return facts.filter("is_current").withColumn("value_base", to_base(F.col("value_reported"), F.col("scale")))


def pivot_facts(facts: DataFrame, tags: list[str]) -> DataFrame:
    """One wide row per (company, fiscal year); the tag list is always given."""
    return facts.groupBy("symbol", "fiscal_year").pivot("tag", tags).agg(F.first("value_base"))


def verification_counts(facts: DataFrame) -> DataFrame:
    state = F.col("verification")
    return facts.filter("is_current").groupBy("symbol", "fiscal_year").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(state == "unverified").alias("unverified"),
        F.count_if(state == "verified").alias("verified"), F.count_if(state == "disputed").alias("disputed"),
    )


def period_summaries(periods: DataFrame, facts: DataFrame) -> DataFrame:
    """Every period with its counts of current figures by state; a period without figures counts 0.

    Both hold symbol, fiscal_year and basis.
    """
    key, state = ["symbol", "fiscal_year", "basis"], F.col("verification")
    counts = facts.filter("is_current").groupBy(*key).agg(
        F.count(F.lit(1)).alias("facts"), *[F.count_if(state == s).alias(s) for s in ("unverified", "verified", "disputed")]
    )
    return periods.join(counts, key, "left").na.fill(0, ["facts", "unverified", "verified", "disputed"]).orderBy("symbol", "fiscal_year", "basis")


def fact_history(facts: DataFrame, tags: list[str]) -> DataFrame:
    """Figures in base units by year, with the company's number of figures and how many are unverified or disputed."""
    current, state = current_facts(facts), F.col("verification")
    counts = current.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("facts"), F.count_if(state == "unverified").alias("unverified"), F.count_if(state == "disputed").alias("disputed")
    )
    return pivot_facts(current, tags).join(counts, "symbol").orderBy("symbol", "fiscal_year")


# -- corporate actions ----------------------------------------------------------


def adjustment_factor() -> Column:
    """Factor one action puts on earlier per-share figures; null if its terms are impossible."""
    kind, pct = F.col("action_type"), F.col("stock_pct")
    new, per, price, cum = F.col("rights_new"), F.col("rights_per"), F.col("rights_price"), F.col("cum_price")
    a, b = F.col("split_from"), F.col("split_to")
    one = F.lit(1.0)

    def missing(*cols: Column) -> Column:
        gone = F.lit(False)
        for c in cols:
            gone = gone | c.isNull() | (c == 0)
        return gone

    bonus = F.when(pct > -100, F.try_divide(one, 1 + pct / 100))
    diluted = F.try_divide(per, per + new)
    ex_rights = F.try_divide(per * cum + new * price, per + new)
    rights = F.when(price.isNull() | cum.isNull() | (cum <= 0), diluted).otherwise(F.try_divide(ex_rights, cum))
    return (
        F.when(kind == "stock_dividend", F.when(missing(pct), one).otherwise(bonus))
        .when(kind == "rights_issue", F.when(missing(new, per), one).when((new > 0) & (per > 0), rights))
        .when(kind.isin("split", "reverse_split"), F.when(missing(a, b), one).when((a > 0) & (b > 0), F.try_divide(a, b)))
        .otherwise(one)
    )


def action_factors(actions: DataFrame) -> DataFrame:
    return actions.withColumn("factor", adjustment_factor())


def impossible_actions(actions: DataFrame) -> DataFrame:
    return action_factors(actions).filter("factor is null")


def cumulative_factors(actions: DataFrame, probes: DataFrame) -> DataFrame:
    """Product of factors of actions after each probe: ``probes`` hold (symbol, at).

    Actions are multiplied up per day, then accumulated from the newest back,
    so neither side of a range join is ever paired with the other.
    """
    daily = action_factors(actions).filter("ex_date is not null").groupBy("symbol", F.col("ex_date").alias("at")).agg(
        F.product("factor").alias("factor")
    )
    ask = probes.select("symbol", "at").distinct().select("symbol", "at", F.lit(0).alias("_k"), F.lit(1.0).alias("factor"))
    rows = daily.select("symbol", "at", F.lit(1).alias("_k"), "factor").unionByName(ask)
    # Newest first; an action on the probe's own date comes after it and is left out.
    later = W.partitionBy("symbol").orderBy(F.desc("at"), "_k").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("factor", F.product("factor").over(later)).filter("_k = 0").drop("_k")


def with_period_end(wide: DataFrame, companies: DataFrame) -> DataFrame:
    fye = companies.select("symbol", "fye_month", "fye_day")
    end = D.fiscal_year_end(F.col("fye_month"), F.col("fye_day"), F.col("fiscal_year"))
    return wide.join(fye, "symbol").withColumn("period_end", end)


def restate(wide: DataFrame, companies: DataFrame, actions: DataFrame) -> DataFrame:
    """Per-share figures on today's share base; the other figures as reported."""
    # A row a company and year, read for the dates and for the figures.
    ended = written(with_period_end(wide, companies))
    factors = cumulative_factors(actions, ended.select("symbol", F.col("period_end").alias("at")))
    joined = ended.join(factors.withColumnRenamed("at", "period_end"), ["symbol", "period_end"], "left")
    by = F.coalesce(F.col("factor"), F.lit(1.0))
    return joined.select(*[(F.col(c) * by).alias(c) if c in PER_SHARE_TAGS else c for c in wide.columns])


# -- metrics --------------------------------------------------------------------


def total_debt(prefix: str = "") -> Column:
    long, short, total = (F.col(prefix + c) for c in ("long_term_borrowings", "short_term_borrowings", "total_debt"))
    known = long.isNotNull() | short.isNotNull()
    return F.when(known, F.coalesce(long, F.lit(0.0)) + F.coalesce(short, F.lit(0.0))).otherwise(total)


def year_metrics(wide: DataFrame) -> DataFrame:
    """Growth, margins, returns and cash of each year against the year before it on file."""
    w = W.partitionBy("symbol").orderBy("fiscal_year")
    c = F.col
    employed = c("total_assets") - F.coalesce(c("current_liabilities"), F.lit(0.0))
    rows = wide.withColumn("_employed", employed)
    before = lambda name: F.lag(name).over(w)
    revenue, profit, equity = c("revenue"), c("net_profit"), c("total_equity")
    ocf = c("net_operating_cash_flow")
    return rows.select(
        *wide.columns,
        growth(revenue, before("revenue")).alias("revenue_growth"),
        growth(c("eps_basic"), before("eps_basic")).alias("eps_growth"),
        ratio(c("gross_profit"), revenue).alias("gross_margin"),
        ratio(c("operating_profit"), revenue).alias("operating_margin"),
        ratio(profit, revenue).alias("net_margin"),
        ratio(profit, mean_of_known(before("total_equity"), equity)).alias("roe"),
        ratio(c("operating_profit"), mean_of_known(before("_employed"), c("_employed"))).alias("roce"),
        ratio(total_debt(), equity).alias("debt_to_equity"),
        ratio(c("current_assets"), c("current_liabilities")).alias("current_ratio"),
        (ocf + F.coalesce(c("capex"), F.lit(0.0))).alias("fcf"),
        ratio(ocf, profit).alias("cash_conversion"),
        ratio(c("dividend_per_share"), c("eps_basic")).alias("payout_ratio"),
    )


def history_summary(metrics: DataFrame) -> DataFrame:
    """Span, end-to-end growth, mean returns and cash record of each company."""
    ends = ["revenue", "eps_basic", "net_profit"]
    out = metrics.groupBy("symbol").agg(
        (F.max("fiscal_year") - F.min("fiscal_year")).alias("years"),
        F.count(F.lit(1)).alias("years_entered"),
        *[F.min_by(c, "fiscal_year").alias(f"_a_{c}") for c in ends],
        *[F.max_by(c, "fiscal_year").alias(f"_z_{c}") for c in [*ends, "debt_to_equity"]],
        F.avg("roe").alias("average_roe"), F.avg("roce").alias("average_roce"),
        F.count_if(F.col("fcf") > 0).alias("positive_fcf_years"), F.count("fcf").alias("fcf_years_counted"),
    )
    rate = lambda tag: cagr(F.col(f"_a_{tag}"), F.col(f"_z_{tag}"), F.col("years"))
    return out.select(
        "symbol", "years", "years_entered", rate("revenue").alias("revenue_cagr"), rate("eps_basic").alias("eps_cagr"),
        rate("net_profit").alias("net_profit_cagr"), "average_roe", "average_roce",
        F.col("_z_debt_to_equity").alias("latest_debt_to_equity"), "positive_fcf_years", "fcf_years_counted",
    )


def latest_dps(restated: DataFrame) -> DataFrame:
    """Last reported dividend per share per company, from the last year that has one."""
    return restated.filter("dividend_per_share is not null").groupBy("symbol").agg(
        F.max_by("dividend_per_share", "fiscal_year").alias("dividend_per_share"), F.max("fiscal_year").alias("fiscal_year")
    )


# -- valuation and screening ----------------------------------------------------


def valuation(df: DataFrame) -> DataFrame:
    """Multiples and 52-week position of a quote joined to its latest per-share figures."""
    price, hi, lo = F.col("close"), F.col("yearly_high"), F.col("yearly_low")
    against = lambda tag: F.when(F.col(tag) > 0, F.try_divide(price, F.col(tag)))
    return df.withColumns({
        "pe": against("eps_basic"), "pb": against("navps"),
        "dividend_yield": F.when(F.col("dividend_per_share") >= 0, F.try_divide(F.col("dividend_per_share"), price)),
        "range_position": F.when(hi > lo, F.try_divide(price - lo, hi - lo)),
        "above_low": F.when(lo > 0, F.try_divide(price, lo) - 1),
        "below_high": F.when(hi > 0, F.try_divide(price, hi) - 1),
    }).withColumn("earnings_yield", F.try_divide(F.lit(1.0), F.col("pe")))


def screener(companies: DataFrame, restated: DataFrame, quotes: DataFrame) -> DataFrame:
    """One row per tracked company: price, valuation, returns and growth."""
    # A row a company and year, read for the latest year and for the whole span.
    metrics = written(year_metrics(restated))
    keep = ["eps_basic", "navps", "dividend_per_share", "roe", "roce", "net_margin", "debt_to_equity", "cash_conversion"]
    latest = metrics.groupBy("symbol").agg(
        F.max("fiscal_year").alias("latest_fiscal_year"), *[F.max_by(c, "fiscal_year").alias(c) for c in keep]
    )
    summary = history_summary(metrics).select("symbol", "years_entered", "revenue_cagr", "eps_cagr")
    quote = quotes.select("symbol", "trade_date", "close", "ycp", "yearly_high", "yearly_low")
    joined = (
        companies.filter("is_tracked").select("symbol", "name", "short_name", "sector")
        .join(latest, "symbol", "left").join(summary, "symbol", "left").join(quote, "symbol", "left")
    )
    rows = valuation(joined).withColumns({
        "change_pct": F.when(F.col("ycp") > 0, F.try_divide(F.col("close"), F.col("ycp")) - 1),
        "years_entered": F.coalesce(F.col("years_entered"), F.lit(0)),
    })
    return rows.withColumnRenamed("close", "price")


# The named screens.
SCREENS: dict[str, dict[str, tuple[float | None, float | None]]] = {
    "quality": {"roe": (0.15, None), "debt_to_equity": (None, 0.5)},
    "cash_backed": {"cash_conversion": (1.0, None)},
    "income": {"dividend_yield": (0.04, None)},
    "near_low": {"range_position": (None, 0.33)},
}


def screen(rows: DataFrame, search: str = "", sector: str | None = None, ranges: dict | None = None, with_data_only: bool = False) -> DataFrame:
    """Rows meeting every condition; a missing figure never meets a range."""
    needle = search.strip().upper()
    cond = F.lit(True)
    if needle:
        cond = cond & (F.col("symbol").contains(needle) | F.upper("name").contains(needle))
    if sector:
        cond = cond & (F.col("sector") == sector)
    if with_data_only:
        cond = cond & (F.col("years_entered") > 0)
    for field, (low, high) in (ranges or {}).items():
        cond = cond & F.col(field).isNotNull()
        if low is not None:
            cond = cond & (F.col(field) >= low)
        if high is not None:
            cond = cond & (F.col(field) <= high)
    return rows.filter(cond)


def sort_rows(rows: DataFrame, field: str, descending: bool = False) -> DataFrame:
    """Sort with missing numbers last both ways; text sorts with missing as empty."""
    if field in ("symbol", "sector", "name"):
        key = F.coalesce(F.col(field), F.lit(""))
        return rows.orderBy(key.desc() if descending else key.asc())
    key = F.col(field)
    return rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "symbol")


# -- corrections and checks -----------------------------------------------------


def verify_figures(stored: DataFrame, typed: DataFrame) -> DataFrame:
    """Verdict per figure: ``stored`` value, ``typed`` text.

    Both are in the period's scale, unless ``stored`` has a column stored_scale and
    ``typed`` one typed_scale: then the stored figure is brought to the typed one's.
    """
    from ..functions.numeric import reported_number

    keys = ["symbol", "fiscal_year", "tag"]
    j = typed.join(stored, keys, "left")
    if "stored_scale" in stored.columns and "typed_scale" in typed.columns:
        j = j.withColumn("stored", F.col("stored") * scale_factor(F.col("stored_scale")) / scale_factor(F.col("typed_scale")))
    text = F.trim(F.coalesce(F.col("typed_text"), F.lit("")))
    number = reported_number(text)
    outcome = (
        F.when(text == "", "skipped").when(number.isNull(), "error").when(F.col("stored").isNull(), "added")
        .when(same_number(F.col("stored"), number), "confirmed").otherwise("corrected")
    )
    scale = ["typed_scale"] if "typed_scale" in typed.columns else []
    return j.select(*keys, "stored", F.when(text != "", number).alias("typed"), outcome.alias("outcome"), *scale)


def verdict_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("symbol", "fiscal_year").agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("confirmed", "corrected", "added", "skipped", "error")]
    )


def append_revisions(facts: DataFrame, verdicts: DataFrame, items: DataFrame) -> DataFrame:
    """Facts with corrections applied: the old revision kept, a new one current.

    New revisions are in the verdicts' typed_scale; without one a correction keeps the figure's scale, and a
    figure that was missing takes the one that its item's unit is typed in (`items`: tag, unit).
    """
    keys = ["symbol", "fiscal_year", "tag"]
    scale = F.col("typed_scale") if "typed_scale" in verdicts.columns else F.lit(None).cast("string")
    fixes = verdicts.filter(F.col("outcome").isin("confirmed", "corrected", "added")).select(*keys, "typed", "outcome", scale.alias("_scale"))
    marked = facts.join(fixes, keys, "left")
    touched = F.col("is_current") & F.col("outcome").isNotNull()
    kept = marked.select(
        *keys, "revision", (F.col("is_current") & ~(touched & (F.col("outcome") == "corrected"))).alias("is_current"), "value_reported", "scale",
        F.when(touched & (F.col("outcome") == "confirmed"), "verified").otherwise(F.col("verification")).alias("verification"),
    )
    corrected = marked.filter(touched & (F.col("outcome") == "corrected")).select(
        *keys, (F.col("revision") + 1).alias("revision"), F.lit(True).alias("is_current"),
        F.col("typed").alias("value_reported"), F.coalesce("_scale", "scale").alias("scale"), F.lit("verified").alias("verification"),
    )
    typed_in = items.select("tag", F.when(F.col("unit").isin("currency", "count"), "million").otherwise("unit").alias("scale"))
    added = fixes.filter("outcome = 'added'").join(typed_in, "tag", "left").select(
        *keys, F.lit(1).alias("revision"), F.lit(True).alias("is_current"), F.col("typed").alias("value_reported"),
        F.coalesce("_scale", "scale", F.lit("unit")).alias("scale"), F.lit("verified").alias("verification"),
    )
    return kept.unionByName(corrected).unionByName(added)


def import_checks(wide: DataFrame, published: DataFrame) -> DataFrame:
    """Hard and soft failures of a year's figures, one row per failure.

    ``published`` hold (symbol, fiscal_year, fcf, roe_pct) as the source states them.
    """
    w = W.partitionBy("symbol").orderBy("fiscal_year")
    c = F.col
    rows = wide.join(published, ["symbol", "fiscal_year"], "left").withColumn("_equity_before", F.lag("total_equity").over(w))
    roe = ratio(c("net_profit"), (c("_equity_before") + c("total_equity")) / 2) * 100
    by_eps, by_nav = ratio(c("net_profit"), c("eps_basic")), ratio(c("total_equity"), c("navps"))
    # Tolerances, in base units of the figures (two millions).
    rules = [
        (F.abs(c("total_equity") + c("total_liabilities") - c("total_assets")) > 2e6, "hard", "balance sheet does not balance"),
        (F.abs(c("net_operating_cash_flow") + c("capex") - c("published_fcf")) > 2e6, "hard", "free cash flow is not as published"),
        (c("gross_profit") > c("revenue"), "hard", "gross profit exceeds revenue"),
        (c("operating_profit") > c("gross_profit"), "hard", "operating profit exceeds gross profit"),
        (F.abs(roe - c("published_roe_pct")) > 0.05, "hard", "return on equity is not as published"),
        (ratio(F.abs(by_eps - by_nav), by_nav) > 0.005, "soft", "share counts differ"),
    ]
    found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(s).alias("severity"), F.lit(r).alias("reason"))) for bad, s, r in rules]))
    return rows.select("symbol", "fiscal_year", F.explode(found).alias("f")).select("symbol", "fiscal_year", "f.severity", "f.reason")
