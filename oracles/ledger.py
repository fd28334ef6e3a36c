from .base import TXN  # noqa: F401
from .registry import oracle

oracle("a06_positions", "SELECT * FROM pos", "pos")
oracle("a07_holdings_by_symbol", "SELECT * FROM held", "held")
oracle("a08_account_totals", """
SELECT account_id, sum(cost_basis) AS total_cost, sum(coalesce(market_value,0)) AS total_market_value, sum(coalesce(market_value,0)) - sum(cost_basis) AS total_unrealised,
 sum(realised_gain) AS total_realised, sum(dividends_gross) AS total_dividends_gross, count(*) FILTER (quantity > 0) AS open_positions FROM pos GROUP BY account_id""", "pos")
oracle("a08_portfolio_totals", """
SELECT *, v AS total_market_value, v - total_cost AS total_unrealised, CASE WHEN total_cost > 0 THEN (v - total_cost) / total_cost END AS total_unrealised_pct, CASE WHEN v > 0 THEN big / v END AS largest_weight
FROM (SELECT sum(cost_basis) AS total_cost, (SELECT sum(market_value) FROM pos) AS v, sum(realised_gain) AS total_realised, sum(dividends_gross) AS total_dividends_gross,
 sum(dividends_net) AS total_dividends_net, max(coalesce(market_value, 0)) AS big FROM held)""", "held", "pos")
oracle("a09_sector_weights", """
SELECT sector, market_value, market_value / sum(market_value) OVER () AS weight FROM (
 SELECT coalesce(sector, 'Unclassified') AS sector, sum(coalesce(market_value, 0)) AS market_value FROM held LEFT JOIN listing USING (symbol) WHERE quantity > 0 GROUP BY 1)""", "held", "listing")
oracle("a10_a11_trading_stats", """
SELECT sales, wins, losses, wins / sales AS win_rate, realised, commission, turnover, average_win, average_loss, CASE WHEN realised + commission > 0 THEN commission / (realised + commission) END AS commission_share
FROM (SELECT count(*) FILTER (txn_type = 'sell') AS sales, count(*) FILTER (txn_type = 'sell' AND gain > 0) AS wins, count(*) FILTER (txn_type = 'sell' AND gain < 0) AS losses,
 sum(gain) AS realised, sum(commission) FILTER (txn_type IN ('buy','sell','rights')) AS commission, sum(val) FILTER (txn_type IN ('buy','sell','rights')) AS turnover,
 avg(gain) FILTER (txn_type = 'sell' AND gain > 0) AS average_win, avg(gain) FILTER (txn_type = 'sell' AND gain < 0) AS average_loss FROM steps)""", "steps")
oracle("a10_symbol_stats", """
SELECT symbol, count(*) FILTER (txn_type IN ('buy','rights')) AS buys, count(*) FILTER (txn_type = 'sell') AS sells,
 sum(commission) FILTER (txn_type IN ('buy','rights','sell')) AS commission, sum(gain) AS realised FROM steps GROUP BY symbol HAVING count(*) FILTER (txn_type IN ('buy','rights','sell')) > 0""", "steps")
RATES = "count(*) AS trades, CASE WHEN count(*) < 3 OR sum(val) <= 0 THEN 0.004e0 ELSE sum(commission) / sum(val) END AS rate FROM ev WHERE txn_type IN ('buy','sell')"
oracle("a12_commission_rates", f"SELECT account_id, {RATES} GROUP BY account_id UNION ALL SELECT NULL, {RATES}", "ev")
oracle("w13_cost_timeline", """
SELECT *, CASE WHEN held > 1e-9 THEN cost / held END AS average_cost, CASE WHEN held > 1e-9 THEN net_cost / held END AS net_cost_per_share FROM (
SELECT *, sum(q - q0) OVER w AS held, sum(c - c0) OVER w AS cost, sum(paid - back_cash) OVER w AS net_cost FROM (
 SELECT *, coalesce(lag(q) OVER a, 0) AS q0, coalesce(lag(c) OVER a, 0) AS c0 FROM steps WINDOW a AS (PARTITION BY account_id, symbol ORDER BY rn))
WINDOW w AS (PARTITION BY symbol ORDER BY trade_date, rnk, txn_id, account_id ROWS UNBOUNDED PRECEDING))""", "steps")
oracle("w14_sale_gains", "SELECT *, val - commission AS proceeds FROM steps WHERE txn_type = 'sell'", "steps")
oracle("a06_oversell_warnings", "SELECT *, over_from AS held FROM steps WHERE over_from IS NOT NULL", "steps")
oracle("p05_cash_flows", """SELECT *, CASE WHEN txn_type IN ('buy','rights') THEN -(quantity * price_per_share + commission) WHEN txn_type = 'sell' THEN quantity * price_per_share - commission
 WHEN txn_type = 'dividend' THEN gross_amount - tax_withheld ELSE 0 END AS cash FROM txn""", "txn")
oracle("t05_event_order", "SELECT *, row_number() OVER (PARTITION BY account_id, symbol, trade_date ORDER BY rnk, txn_id) AS place FROM txn", "txn")
oracle("w21_holding_before_record_date", """
SELECT d.account_id, d.symbol, d.record_date, max(s.q) AS quantity FROM (SELECT DISTINCT account_id, symbol, record_date FROM txn WHERE record_date IS NOT NULL) d
 ASOF LEFT JOIN (SELECT account_id, symbol, trade_date, arg_max(q, rn) AS q FROM steps GROUP BY ALL) s
 ON s.account_id = d.account_id AND s.symbol = d.symbol AND s.trade_date < d.record_date GROUP BY ALL""", "steps")
oracle("f10_free_share_plans", """
SELECT symbol, s AS sell, quantity - s AS keep FROM (SELECT h.symbol, quantity, net_cost, close, ceil(net_cost / (close * (1 - 0.005e0)) - 1e-9) AS s FROM held h JOIN stock_quote k USING (symbol))
WHERE close > 0 AND quantity > 0 AND net_cost > 0 AND s < quantity""", "held", "stock_quote")
oracle("f11_j17_what_if_trades", """
SELECT *, CASE WHEN new_quantity > 0 THEN nc / new_quantity END AS new_average_cost, CASE WHEN new_quantity > 0 THEN new_net_cost / new_quantity END AS new_net_cost_per_share FROM (
SELECT account_id, symbol, n AS plan_id, sq > quantity + 1e-9 AS invalid,
 CASE WHEN sq > quantity + 1e-9 THEN quantity ELSE quantity - sq + bq END AS new_quantity,
 CASE WHEN sq > quantity + 1e-9 THEN cost_basis ELSE cost_basis - av * sq + bq * bp * 1.005e0 END AS nc,
 CASE WHEN sq > quantity + 1e-9 THEN net_cost ELSE net_cost - sq * sp * 0.995e0 + bq * bp * 1.005e0 END AS new_net_cost,
 CASE WHEN sq > quantity + 1e-9 THEN 0 ELSE sq * sp * 0.995e0 - av * sq END AS plan_gain, CASE WHEN sq > quantity + 1e-9 THEN 0 ELSE bq * bp * 1.005e0 - sq * sp * 0.995e0 END AS cash_needed
FROM (SELECT *, n * 40e0 AS sq, close * 1.1e0 AS sp, n * 30e0 AS bq, close * 0.9e0 AS bp, CASE WHEN quantity > 0 THEN cost_basis / quantity ELSE 0 END AS av
 FROM pos JOIN stock_quote USING (symbol), (VALUES (1), (2), (3)) AS v(n)))""", "pos", "stock_quote")
oracle("x07_masked_accounts", "SELECT account_id, '…' || account_id[-4:] AS masked, count(*) AS trades FROM txn GROUP BY account_id", "txn")
