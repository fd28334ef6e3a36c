from quillfolio.operators.fundamentals import SCREENS

from .base import CTES, TAGS, cte
from .registry import oracle

oracle("a01_facts_pivoted", "SELECT * FROM wide", "wide")
G = "CASE WHEN p.{x} > 0 THEN w.{x} / p.{x} - 1 END"
DIV = "CASE WHEN {b} <> 0 THEN {a} / {b} END"
METRIC = """
SELECT w.*, CASE WHEN prev_revenue > 0 THEN revenue / prev_revenue - 1 END AS revenue_growth, CASE WHEN prev_eps > 0 THEN eps_basic / prev_eps - 1 END AS eps_growth,
 gross_profit / revenue AS gross_margin, operating_profit / revenue AS operating_margin, net_profit / revenue AS net_margin,
 net_profit / (coalesce(prev_eq, total_equity) + coalesce(total_equity, prev_eq)) * 2 AS roe,
 operating_profit / (coalesce(prev_ce, ce) + coalesce(ce, prev_ce)) * 2 AS roce,
 (CASE WHEN long_term_borrowings IS NULL AND short_term_borrowings IS NULL THEN total_debt ELSE coalesce(long_term_borrowings, 0) + coalesce(short_term_borrowings, 0) END) / total_equity AS debt_to_equity,
 CASE WHEN current_liabilities <> 0 THEN current_assets / current_liabilities END AS current_ratio, net_operating_cash_flow + coalesce(capex, 0) AS fcf,
 CASE WHEN net_profit <> 0 THEN net_operating_cash_flow / net_profit END AS cash_conversion, CASE WHEN eps_basic <> 0 THEN dividend_per_share / eps_basic END AS payout_ratio
FROM (SELECT *, total_assets - coalesce(current_liabilities, 0) AS ce, lag(revenue) OVER o AS prev_revenue, lag(eps_basic) OVER o AS prev_eps, lag(total_equity) OVER o AS prev_eq,
  lag(total_assets - coalesce(current_liabilities, 0)) OVER o AS prev_ce FROM {src} WINDOW o AS (PARTITION BY symbol ORDER BY fiscal_year)) w"""
cte("metric", METRIC.format(src="wide"), "wide")
cte("adj_metric", METRIC.format(src="adj"), "adj")
CAGR = "CASE WHEN max(fiscal_year) > min(fiscal_year) AND arg_min({x}, fiscal_year) FILTER (true) > 0 AND arg_max({x}, fiscal_year) > 0 THEN pow(arg_max({x}, fiscal_year) / arg_min({x}, fiscal_year), 1e0 / (max(fiscal_year) - min(fiscal_year))) - 1 END"
cte("summary", f"""SELECT symbol, max(fiscal_year) - min(fiscal_year) AS years, count(*) AS years_entered, {CAGR.format(x='revenue')} AS revenue_cagr, {CAGR.format(x='eps_basic')} AS eps_cagr,
 {CAGR.format(x='net_profit')} AS net_profit_cagr, avg(roe) AS average_roe, avg(roce) AS average_roce, arg_max_null(debt_to_equity, fiscal_year) AS latest_debt_to_equity,
 count(*) FILTER (fcf > 0) AS positive_fcf_years, count(fcf) AS fcf_years_counted FROM adj_metric GROUP BY symbol""", "adj_metric")
oracle("a02_year_metrics", "SELECT * FROM metric", "metric")
oracle("a03_history_summary", "SELECT * FROM summary", "summary")
oracle("a04_restated_figures", "SELECT * FROM adj", "adj")
oracle("f03_action_factors", "SELECT *, f AS factor FROM factor", "factor")
oracle("j06_cumulative_factors", "SELECT * FROM adj_factor", "adj_factor")
oracle("a05_verification_counts", """SELECT symbol, fiscal_year, count(*) AS total, count(*) FILTER (verification = 'unverified') AS unverified, count(*) FILTER (verification = 'verified') AS verified,
 count(*) FILTER (verification = 'disputed') AS disputed FROM base_facts GROUP BY ALL""", "base_facts")
oracle("q_period_summaries", """SELECT p.*, coalesce(n, 0) AS facts, coalesce(u, 0) AS unverified, coalesce(v, 0) AS verified, coalesce(d, 0) AS disputed FROM (
 SELECT symbol, fiscal_year, unnest(CASE WHEN (k + fiscal_year) % 4 = 0 THEN ['consolidated', 'standalone'] ELSE ['consolidated'] END) AS basis, (k + fiscal_year) % 3 <> 0 AS is_complete,
  make_date(fiscal_year - 1, fye_month, 1) + INTERVAL 1 MONTH AS first, CAST(first AS DATE) AS period_start, last_day(make_date(fiscal_year, fye_month, 1)) AS period_end FROM sold) p
LEFT JOIN (SELECT symbol, fiscal_year, 'consolidated' AS basis, count(*) AS n, count(*) FILTER (verification = 'unverified') AS u, count(*) FILTER (verification = 'verified') AS v,
  count(*) FILTER (verification = 'disputed') AS d FROM base_facts GROUP BY ALL) c USING (symbol, fiscal_year, basis)""", "sold", "base_facts")
oracle("q_fact_history", """SELECT * FROM wide JOIN (SELECT symbol, count(*) AS facts, count(*) FILTER (verification = 'unverified') AS unverified, count(*) FILTER (verification = 'disputed') AS disputed
 FROM base_facts GROUP BY symbol) USING (symbol)""", "wide", "base_facts")
cte("dps", "SELECT symbol, arg_max(dividend_per_share, fiscal_year) AS dividend_per_share, max(fiscal_year) AS fiscal_year FROM adj WHERE dividend_per_share IS NOT NULL GROUP BY symbol", "adj")
oracle("a15_latest_dps", "SELECT * FROM dps", "dps")
cte("screen", """
SELECT c.symbol, c.name, c.short_name, c.sector, q.close AS price, CASE WHEN ycp > 0 THEN q.close / ycp - 1 END AS change_pct, q.trade_date, m.fiscal_year AS latest_fiscal_year, coalesce(s.years_entered, 0) AS years_entered,
 CASE WHEN m.eps_basic > 0 THEN q.close / m.eps_basic END AS pe, CASE WHEN m.navps > 0 THEN q.close / m.navps END AS pb, CASE WHEN m.dividend_per_share >= 0 THEN m.dividend_per_share / q.close END AS dividend_yield,
 CASE WHEN yearly_high > yearly_low THEN (q.close - yearly_low) / (yearly_high - yearly_low) END AS range_position, CASE WHEN yearly_low > 0 THEN q.close / yearly_low - 1 END AS above_low,
 CASE WHEN yearly_high > 0 THEN q.close / yearly_high - 1 END AS below_high, CASE WHEN m.eps_basic > 0 THEN m.eps_basic / q.close END AS earnings_yield,
 m.roe, m.roce, m.net_margin, m.debt_to_equity, m.cash_conversion, s.revenue_cagr, s.eps_cagr
FROM company c LEFT JOIN (SELECT * FROM adj_metric QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY fiscal_year DESC) = 1) m USING (symbol) LEFT JOIN summary s USING (symbol) LEFT JOIN last_quote q USING (symbol) WHERE c.is_tracked
""", "company", "adj_metric", "summary", "last_quote")
oracle("a32_j15_screener", "SELECT * FROM screen", "screen")
oracle("f05_valuation", "SELECT * FROM screen", "screen")
oracle("t01_screener_sorted", "SELECT * FROM screen", "screen")
for name, ranges in SCREENS.items():
    conds = " AND ".join(f"{f} >= {lo}" if hi is None else f"{f} <= {hi}" for f, (lo, hi) in ranges.items())
    oracle(f"p02_screen_{name}", f"SELECT * FROM screen WHERE {conds}", "screen")
oracle("p02_screen_income_split", "SELECT * REPLACE (dividend_yield * 5 AS dividend_yield) FROM screen WHERE dividend_yield * 5 >= 0.04", "screen")
oracle("p01_screen_filters", "SELECT * FROM screen WHERE (contains(symbol, 'NATION 1') OR contains(upper(name), 'NATION 1')) AND sector = 'America' AND pe >= 0 AND years_entered > 0", "screen")
oracle("p06_scaled_values", """SELECT *, value_base / (CASE natural_unit WHEN 'crore' THEN 1e7 WHEN 'lakh' THEN 1e5 ELSE 1e0 END) AS in_natural FROM (
 SELECT *, CASE WHEN abs(value_base) >= 1e7 THEN 'crore' WHEN abs(value_base) >= 1e5 THEN 'lakh' ELSE 'unit' END AS natural_unit FROM base_facts)""", "base_facts")
oracle("p07_scale_by_unit", "SELECT *, scale AS applied_scale FROM base_facts", "base_facts")
cte("typed", """SELECT symbol, fiscal_year, tag, CASE n WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN -abs(w) WHEN 3 THEN w ELSE floor((w + 1) * 100 + 0.5) / 100 END AS typed, n, CASE WHEN n = 3 THEN w ELSE v END AS stored
 FROM (SELECT symbol, fiscal_year, tag, (CAST(symbol[2:] AS INTEGER) + fiscal_year + length(tag)) % 6 AS n, value_reported AS v, floor(value_reported * 100) / 100 AS w FROM base_facts)""", "base_facts")
cte("verdict", """SELECT symbol, fiscal_year, tag, CASE WHEN n <> 5 THEN stored END AS stored, typed,
 CASE WHEN n = 0 THEN 'skipped' WHEN n = 1 THEN 'error' WHEN n = 5 THEN 'added' WHEN abs(stored - typed) / greatest(abs(stored), abs(typed), 1) < 1e-9 THEN 'confirmed' ELSE 'corrected' END AS outcome FROM typed""", "typed")
oracle("v1_a31_verification", "SELECT * FROM verdict", "verdict")
oracle("a31_verdict_summary", "SELECT symbol, fiscal_year, " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in ("confirmed", "corrected", "added", "skipped", "error")) + " FROM verdict GROUP BY ALL", "verdict")
oracle("k06_revisions_after_verification", """
SELECT symbol, fiscal_year, tag, revision, is_current, value_reported, scale, value_reported * CASE scale WHEN 'million' THEN 1e6 ELSE 1 END AS value_base, verification FROM (
SELECT f.symbol, f.fiscal_year, f.tag, f.revision, f.is_current AND coalesce(v.outcome, '') <> 'corrected' AS is_current, f.value_reported, f.scale, CASE WHEN f.is_current AND v.outcome = 'confirmed' THEN 'verified' ELSE f.verification END AS verification
 FROM facts f LEFT JOIN verdict v USING (symbol, fiscal_year, tag) WHERE coalesce(v.outcome, '') <> 'added'
UNION ALL SELECT f.symbol, f.fiscal_year, f.tag, f.revision + 1, true, v.typed, f.scale, 'verified' FROM facts f JOIN verdict v USING (symbol, fiscal_year, tag) WHERE f.is_current AND v.outcome = 'corrected'
UNION ALL SELECT symbol, fiscal_year, tag, 1, true, typed, CASE WHEN tag IN ('eps_basic', 'navps', 'nocfps', 'dividend_per_share') THEN 'unit' ELSE 'million' END, 'verified' FROM verdict WHERE outcome = 'added')""", "facts", "verdict")
UNIT_TAGS = ("eps_basic", "navps", "nocfps", "dividend_per_share")
cte("mixed_verdict", f"""SELECT symbol, fiscal_year, tag, stored / per AS stored, typed / per AS typed, typed_scale, CASE WHEN outcome NOT IN ('confirmed', 'corrected') THEN outcome
  WHEN abs(stored - typed) / greatest(abs(stored), abs(typed), per) < 1e-9 THEN 'confirmed' ELSE 'corrected' END AS outcome
 FROM (SELECT *, CASE WHEN tag IN {UNIT_TAGS} THEN 'unit' WHEN fiscal_year % 2 = 0 THEN 'crore' ELSE 'million' END AS typed_scale, CASE typed_scale WHEN 'crore' THEN 10e0 ELSE 1e0 END AS per FROM verdict)""", "verdict")
oracle("v1_verification_across_scales", "SELECT * FROM mixed_verdict", "mixed_verdict")
oracle("k06_revisions_across_scales", """
SELECT *, value_reported * CASE scale WHEN 'million' THEN 1e6 WHEN 'crore' THEN 1e7 ELSE 1 END AS value_base FROM (
SELECT f.symbol, f.fiscal_year, f.tag, f.revision, f.is_current AND coalesce(v.outcome, '') <> 'corrected' AS is_current, f.value_reported, f.scale, CASE WHEN f.is_current AND v.outcome = 'confirmed' THEN 'verified' ELSE f.verification END AS verification
 FROM facts f LEFT JOIN mixed_verdict v USING (symbol, fiscal_year, tag) WHERE coalesce(v.outcome, '') <> 'added'
UNION ALL SELECT f.symbol, f.fiscal_year, f.tag, f.revision + 1, true, v.typed, v.typed_scale, 'verified' FROM facts f JOIN mixed_verdict v USING (symbol, fiscal_year, tag) WHERE f.is_current AND v.outcome = 'corrected'
UNION ALL SELECT symbol, fiscal_year, tag, 1, true, typed, typed_scale, 'verified' FROM mixed_verdict WHERE outcome = 'added')""", "facts", "mixed_verdict")
oracle("d04q_import_checks", """
SELECT symbol, fiscal_year, severity, reason FROM (SELECT symbol, fiscal_year, unnest(['hard','hard','hard','hard','hard','soft']) AS severity,
 unnest(['balance sheet does not balance','free cash flow is not as published','gross profit exceeds revenue','operating profit exceeds gross profit','return on equity is not as published','share counts differ']) AS reason,
 unnest([abs(total_equity + total_liabilities - total_assets) > 2e6, fiscal_year % 6 = 1 AND capex IS NOT NULL, gross_profit > revenue, operating_profit > gross_profit,
  fiscal_year % 5 = 2 AND lag(total_equity) OVER (PARTITION BY symbol ORDER BY fiscal_year) IS NOT NULL, abs(net_profit / eps_basic - total_equity / navps) / (total_equity / navps) > 0.005]) AS bad FROM wide) WHERE bad""", "wide")
oracle("f_latest_reported_year", """
SELECT symbol, y AS latest_fiscal_year, 'FY' || y AS label, 'FY' || y || ' (' || strftime(CAST(make_date(y - 1, fye_month, fye_day) + 1 AS DATE), '%b %Y') || ' – ' || strftime(make_date(y, fye_month, fye_day), '%b %Y') || ')' AS range_label,
 concat_ws(',', y, y - 1, y - 2, y - 3, y - 4) AS years FROM (SELECT *, CASE WHEN make_date(2001, fye_month, fye_day) <= DATE '2001-04-15' THEN 2001 ELSE 2000 END AS y FROM company)""", "company")
oracle("d01_d03_fiscal_calendar", """
SELECT *, CAST(make_date(fiscal_year - 1, fye_month, fye_day) AS DATE) + 1 AS fy_start, make_date(fiscal_year, fye_month, fye_day) AS fy_end,
 CAST(date_trunc('month', make_date(fiscal_year - 1, fye_month, fye_day)) + INTERVAL 4 MONTH AS DATE) AS q2_start, last_day(CAST(date_trunc('month', make_date(fiscal_year - 1, fye_month, fye_day)) + INTERVAL 6 MONTH AS DATE)) AS q2_end,
 last_day(CAST(date_trunc('month', make_date(fiscal_year - 1, fye_month, fye_day)) + INTERVAL 9 MONTH AS DATE)) AS cumulative_end
FROM (SELECT p.symbol, trade_date, fye_month, fye_day, year(trade_date) + CASE WHEN month(trade_date) > fye_month THEN 1 ELSE 0 END AS fiscal_year FROM px p JOIN company USING (symbol))""", "px", "company")
