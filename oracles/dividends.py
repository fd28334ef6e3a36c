from .base import cte, r2
from .registry import oracle

oracle("a13_income_by_year", "SELECT year(trade_date) AS year, sum(gross_amount) AS gross, sum(tax_withheld) AS tax, sum(gross_amount - tax_withheld) AS net, count(*) AS payments FROM txn WHERE txn_type = 'dividend' GROUP BY 1", "txn")
cte("projection", """SELECT h.symbol, quantity, cost_basis, market_value, d.dividend_per_share, d.fiscal_year, d.dividend_per_share * quantity AS annual_income,
 CASE WHEN market_value > 0 THEN d.dividend_per_share * quantity / market_value END AS yield_on_value, CASE WHEN cost_basis > 0 THEN d.dividend_per_share * quantity / cost_basis END AS yield_on_cost
 FROM held h LEFT JOIN listing l USING (symbol) LEFT JOIN dps d ON d.symbol = l.company WHERE quantity > 0""", "held", "listing", "dps")
oracle("a14_income_projection", "SELECT * FROM projection", "projection")
oracle("a14_projection_totals", """SELECT *, annual_income / value AS yield_on_value, annual_income / cost AS yield_on_cost FROM (
 SELECT sum(annual_income) AS annual_income, sum(coalesce(market_value, 0)) AS value, sum(cost_basis) AS cost FROM projection WHERE annual_income IS NOT NULL)""", "projection")
cte("receivable", """SELECT account_id, last_day(record_date) AS as_of, 'Company ' || symbol AS company_name, symbol, record_date, count(*) * 100e0 AS holding, sum(CAST(floor(gross_amount * 100 + 0.5) AS BIGINT)) / 100 AS entitlement
 FROM txn WHERE record_date IS NOT NULL GROUP BY ALL HAVING last_day(record_date) < max(trade_date)""", "txn")
cte("credit", f"SELECT account_id, as_of, next_as_of, {r2('nxt - cash_dividend')} AS credited FROM (SELECT *, lead(as_of) OVER o AS next_as_of, lead(cash_dividend) OVER o AS nxt FROM snap WINDOW o AS (PARTITION BY account_id ORDER BY as_of)) WHERE next_as_of IS NOT NULL", "snap")
cte("gone", """SELECT r.*, c.next_as_of FROM receivable r JOIN credit c USING (account_id, as_of)
 WHERE NOT EXISTS (SELECT 1 FROM receivable x WHERE x.account_id = r.account_id AND x.as_of = c.next_as_of AND x.company_name = r.company_name AND x.record_date IS NOT DISTINCT FROM r.record_date)""", "receivable", "credit")
oracle("j08_gone_receivables", "SELECT * FROM gone", "gone")
cte("paid", f"""SELECT account_id, as_of, next_as_of, company_name, symbol, record_date, entitlement AS gross, {r2('entitlement - ' + r2('entitlement * share'))} AS tax_withheld, share < 0.8 AS check_split FROM (
 SELECT g.*, least(1, greatest(0, credited) / sum(entitlement) OVER (PARTITION BY account_id, as_of)) AS share, credited FROM gone g JOIN credit USING (account_id, as_of)) WHERE credited >= 0.005""", "gone", "credit")
oracle("a16_paid_dividends", "SELECT * FROM paid", "paid")
oracle("a16_unexplained_credits", f"""SELECT c.*, CASE WHEN due IS NULL THEN greatest(0, credited) WHEN credited < 0.005 THEN 0 ELSE {r2('greatest(0, credited - coalesce(acc, 0))')} END AS unexplained FROM credit c
 LEFT JOIN (SELECT account_id, as_of, sum(entitlement) AS due FROM gone GROUP BY ALL) USING (account_id, as_of) LEFT JOIN (SELECT account_id, as_of, sum(gross - tax_withheld) AS acc FROM paid GROUP BY ALL) USING (account_id, as_of)""", "credit", "gone", "paid")
oracle("j07_j19_recorded_receivables", """SELECT account_id, as_of, symbol, record_date, entitlement AS gross, EXISTS (SELECT 1 FROM (SELECT *, CASE WHEN txn_id % 3 <> 0 THEN record_date END AS rd FROM txn WHERE txn_type = 'dividend' AND CAST(symbol[2:] AS BIGINT) % 2 = 1) x
 WHERE x.account_id = r.account_id AND x.symbol = r.symbol AND CASE WHEN x.rd IS NOT NULL THEN x.rd = r.record_date ELSE abs(x.gross_amount - r.entitlement) < 0.01 AND x.trade_date BETWEEN r.record_date AND r.record_date + 120 END) AS recorded FROM receivable r""", "txn", "receivable")
cte("decl", "SELECT symbol, ex_date, cash_pct / 10 + (CASE WHEN action_id % 6 = 0 THEN 0.0123e0 ELSE 0e0 END) AS amount, action_id % 6 = 0 AS restated, action_id FROM act WHERE action_type = 'cash_dividend' AND ex_date IS NOT NULL", "act")
cte("decl_year", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY year DESC) AS place FROM (SELECT symbol, year(ex_date) AS year, sum(amount) AS total, count(*) AS announced, bool_or(restated) AS restated FROM decl WHERE amount > 0 GROUP BY ALL)", "decl")
oracle("a17_w09_dividend_record", """SELECT y.symbol, (SELECT max(ex_date) FROM decl d WHERE d.symbol = y.symbol AND amount > 0) AS latest_ex_date, (SELECT arg_max(amount, ex_date) FROM decl d WHERE d.symbol = y.symbol AND amount > 0) AS latest_amount,
 count(*) AS paid_years, max(year) - min(year) + 1 AS span_years, count(*) FILTER (year = top - place + 1) AS streak, max(CASE WHEN place = 1 AND prev_year = year - 1 AND prev > 0 THEN total / prev - 1 END) AS change_on_prior_year,
 avg(total) FILTER (place <= 5) AS five_year_average, bool_or(restated AND place <= 5) AS restated_inside
 FROM (SELECT *, max(year) OVER (PARTITION BY symbol) AS top, lead(total) OVER (PARTITION BY symbol ORDER BY place) AS prev, lead(year) OVER (PARTITION BY symbol ORDER BY place) AS prev_year FROM decl_year) y GROUP BY y.symbol""", "decl", "decl_year")
oracle("t04_top_five_dividend_years", "SELECT * FROM decl_year WHERE place <= 5", "decl_year")
oracle("f07_dividend_yields", "SELECT d.*, CASE WHEN amount > 0 AND close > 0 THEN amount / close END AS yield FROM decl d LEFT JOIN (SELECT symbol, arg_max(close, trade_date) AS close FROM px GROUP BY symbol) USING (symbol)", "decl", "px")
oracle("p09_restated_amounts", "SELECT *, restated AS looks_restated, printf('%.6f', amount / 10 * 100) AS percent FROM decl", "decl")
cte("div_merge", """SELECT symbol, ex_date, coalesce(n.amount, o.amount) AS amount, CASE WHEN o.amount IS NULL THEN 'inserted' WHEN n.amount IS NOT NULL THEN 'updated' ELSE 'kept' END AS state, coalesce(abs(o.amount - n.amount) > 0.005, false) AS differs
 FROM (SELECT * FROM decl WHERE action_id % 3 <> 0) o FULL JOIN (SELECT symbol, ex_date, amount + (CASE WHEN action_id % 4 = 0 THEN 0.5e0 ELSE 0.001e0 END) AS amount FROM decl WHERE action_id % 2 = 0) n USING (symbol, ex_date)""", "decl")
oracle("k04_d13q_dividend_upsert", "SELECT * FROM div_merge", "div_merge")
oracle("k04_upsert_counts", "SELECT state, count(*) AS rows, count(*) FILTER (differs) AS differing FROM div_merge GROUP BY state", "div_merge")
