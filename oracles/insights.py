from .base import cte
from .registry import oracle

cte("earned", "SELECT symbol, fiscal_year, period_end + 120 AS from_date, eps_basic AS eps FROM ends WHERE eps_basic IS NOT NULL", "ends")
cte("known", "SELECT p.symbol, p.trade_date, p.close, e.eps FROM px p ASOF LEFT JOIN earned e ON e.symbol = p.symbol AND e.from_date <= p.trade_date", "px", "earned")
oracle("j04_earnings_known_by_day", "SELECT * FROM known", "known")
cte("eps_now", "SELECT c.symbol, arg_max(q.close, q.trade_date) AS price, (SELECT arg_max_null(eps_basic, fiscal_year) FROM adj a WHERE a.symbol = c.symbol) AS eps FROM company c JOIN px q USING (symbol) GROUP BY c.symbol", "company", "px", "adj")
cte("band", """SELECT symbol, samples, from_date, to_date, low, median, high, current, CASE WHEN current IS NOT NULL THEN (less + same / 2) / samples END AS rank, CASE WHEN eps > 0 THEN low * eps END AS price_at_low, CASE WHEN eps > 0 THEN median * eps END AS price_at_median, CASE WHEN eps > 0 THEN high * eps END AS price_at_high
 FROM (SELECT k.symbol, count(*) AS samples, min(trade_date) AS from_date, max(trade_date) AS to_date, quantile_cont(close / k.eps, 0.25) AS low, quantile_cont(close / k.eps, 0.5) AS median, quantile_cont(close / k.eps, 0.75) AS high,
  max(CASE WHEN n.eps > 0 THEN n.price / n.eps END) AS current, max(n.eps) AS eps, count(*) FILTER (close / k.eps < CASE WHEN n.eps > 0 THEN n.price / n.eps END) AS less, count(*) FILTER (close / k.eps = CASE WHEN n.eps > 0 THEN n.price / n.eps END) AS same
  FROM known k JOIN eps_now n USING (symbol) WHERE trade_date >= DATE '1996-11-30' AND k.eps > 0 GROUP BY k.symbol) WHERE samples >= 60""", "known", "eps_now")
oracle("w07_pe_bands", "SELECT * FROM band", "band")
PEERS = """SELECT a.symbol, a.metric, a.value, count(*) AS peers, median(b.value) AS median, (count(*) FILTER (b.value < a.value) + count(*) FILTER (b.value = a.value) / 2) / count(*) AS rank, count(*) FILTER (b.value > a.value) AS cheaper_than
 FROM {m} a JOIN {m} b ON a.metric = b.metric AND a.symbol <> b.symbol GROUP BY ALL HAVING count(*) >= 3"""
cte("peer_in", "SELECT symbol, unnest(['pe','pb','dividend_yield']) AS metric, unnest([pe, pb, dividend_yield]) AS value FROM screen", "screen")
cte("peer_m", "SELECT * FROM peer_in WHERE value > 0", "peer_in")
oracle("a29_j18_peers", PEERS.format(m="peer_m"), "peer_m")
cte("stock_m", "SELECT * FROM (SELECT symbol, unnest(['average_cost','market_value']) AS metric, unnest([average_cost, market_value]) AS value FROM held) WHERE value > 0", "held")
oracle("a29_peers_of_stocks", PEERS.format(m="stock_m"), "stock_m")
oracle("a33_stock_insight", f"""
SELECT s.symbol, s.short_name AS name, s.price, s.trade_date, s.change_pct, s.pe, s.pb, s.dividend_yield, q.yearly_high AS year_high, q.yearly_low AS year_low, c.days, CASE WHEN c.days >= 200 THEN r.pos END AS own_position,
 CASE WHEN c.days >= 250 THEN b.median END AS band_median, CASE WHEN c.days >= 250 THEN b.rank END AS band_rank, CASE WHEN c.days >= 200 THEN f.worst END AS worst_fall, p.peers AS pe_peers, p.rank AS pe_rank
FROM screen s JOIN last_quote q USING (symbol) JOIN (SELECT symbol, count(*) AS days FROM px GROUP BY symbol) c USING (symbol)
 LEFT JOIN (SELECT symbol, (arg_max(close, trade_date) - min(close)) / (max(close) - min(close)) AS pos FROM px WHERE trade_date >= DATE '2000-11-30' GROUP BY symbol) r USING (symbol)
 LEFT JOIN band b USING (symbol) LEFT JOIN (SELECT symbol, min(close / pk - 1) AS worst FROM (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS pk FROM px) GROUP BY symbol) f USING (symbol)
 LEFT JOIN ({PEERS.format(m='peer_m')}) p ON p.symbol = s.symbol AND p.metric = 'pe'""", "screen", "last_quote", "px", "band", "peer_m")
oracle("a33_features", """SELECT symbol, trade_date, close, lag(close) OVER d AS ycp, max(high) OVER y AS yearly_high, min(low) OVER y AS yearly_low, max(close) OVER d AS peak, close / (max(close) OVER d) - 1 AS fall, row_number() OVER d AS days,
 eps
 FROM px JOIN (SELECT symbol, trade_date, eps FROM known) USING (symbol, trade_date) WINDOW d AS (PARTITION BY symbol ORDER BY trade_date), y AS (PARTITION BY symbol ORDER BY trade_date RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND CURRENT ROW)""", "px", "known")
RATES = "SELECT CASE WHEN count(*) < 3 OR sum(val) <= 0 THEN 0.004e0 ELSE sum(commission) / sum(val) END AS rate FROM ev WHERE txn_type IN ('buy','sell')"
oracle("f09_scenarios", f"""
SELECT symbol, label, basis, level, level / price - 1 AS move, CASE WHEN quantity > 0 THEN quantity * level END AS value, CASE WHEN quantity > 0 THEN quantity * level - cost_basis END AS gain,
 CASE WHEN quantity > 0 AND cost_basis > 0 THEN (quantity * level - cost_basis) / cost_basis END AS gain_pct FROM (
SELECT h.symbol, h.quantity, h.cost_basis, k.close AS price, unnest(['lowest price of the year','highest price of the year','price at the lower quartile of past ratios','price at the median of past ratios','price at the upper quartile of past ratios','sale without gain or loss','level to buy at','level to sell at']) AS label,
 unnest(['prices','prices','earnings','earnings','earnings','cost and commission','target','target']) AS basis,
 unnest([y.lo, y.hi, b.price_at_low, b.price_at_median, b.price_at_high, CASE WHEN h.quantity > 0 AND h.average_cost <> 0 THEN h.average_cost / (1 - (SELECT rate FROM ({RATES}))) END, t.buy_below, t.sell_above]) AS level
FROM held h JOIN listing l USING (symbol) JOIN stock_quote k USING (symbol) LEFT JOIN band b ON b.symbol = l.company LEFT JOIN (SELECT symbol, min(close) AS lo, max(close) AS hi FROM stock_px WHERE trade_date >= DATE '2000-11-30' GROUP BY symbol) y USING (symbol) LEFT JOIN target t USING (symbol)) WHERE level > 0""",
       "held", "listing", "stock_quote", "band", "stock_px", "target", "ev")
cte("acc_rate", f"SELECT account_id, CASE WHEN count(*) < 3 OR sum(val) <= 0 THEN 0.004e0 ELSE sum(commission) / sum(val) END AS rate FROM ev WHERE txn_type IN ('buy','sell') GROUP BY account_id UNION ALL SELECT NULL, rate FROM ({RATES})", "ev")
oracle("p08_break_even_prices", "SELECT account_id, symbol, average_cost, average_cost / (1 - rate) AS break_even, average_cost * 1.05e0 / (1 - rate) AS plus_five, average_cost * 1.1e0 / (1 - rate) AS plus_ten FROM pos JOIN acc_rate USING (account_id) WHERE quantity > 0", "pos", "acc_rate")
cte("status", """
SELECT *, CASE WHEN buy_below IS NOT NULL THEN price <= buy_below END AS buy_reached, CASE WHEN buy_below IS NOT NULL THEN price > buy_below AND abs((buy_below - price) / price) <= 0.02 END AS buy_near, CASE WHEN price <= buy_below THEN 0 ELSE (buy_below - price) / price END AS buy_to_go,
 CASE WHEN sell_above IS NOT NULL THEN price >= sell_above END AS sell_reached, CASE WHEN sell_above IS NOT NULL THEN price < sell_above AND abs((sell_above - price) / price) <= 0.02 END AS sell_near, CASE WHEN price >= sell_above THEN 0 ELSE (sell_above - price) / price END AS sell_to_go,
 concat_ws('; ', CASE WHEN sell_above IS NOT NULL AND quantity IS NULL AND account_id IS NOT NULL THEN 'account has no shares to sell' END, CASE WHEN sell_above IS NOT NULL AND quantity IS NULL AND account_id IS NULL THEN 'no shares to sell' END,
  CASE WHEN sell_above < break_even THEN 'sale level is under break-even' END) AS warning_text
FROM (SELECT t.*, k.close AS price, h.quantity, h.average_cost / (1 - r.rate) AS break_even FROM target t JOIN stock_quote k USING (symbol)
 LEFT JOIN (SELECT account_id, symbol, quantity, average_cost FROM pos UNION ALL SELECT NULL, symbol, quantity, average_cost FROM held) h ON h.symbol = t.symbol AND h.account_id IS NOT DISTINCT FROM t.account_id AND h.quantity > 0
 LEFT JOIN acc_rate r ON r.account_id IS NOT DISTINCT FROM t.account_id)""", "target", "stock_quote", "pos", "held", "acc_rate")
oracle("f12_j16_target_status", "SELECT * FROM status", "status")
oracle("t03_targets_by_urgency", "SELECT *, CASE WHEN coalesce(buy_reached, false) OR coalesce(sell_reached, false) THEN 0 WHEN coalesce(buy_near, false) OR coalesce(sell_near, false) THEN 1 ELSE 2 END AS urgency FROM status", "status")
# One close at a time: the state is whether an alert is outstanding.
cte("q_day", "SELECT account_id, symbol, trade_date, arg_max(q, rn) AS q FROM steps GROUP BY ALL", "steps")
cte("t_days", """
SELECT t.target_id, t.side, p.trade_date, p.close, t.level, CASE WHEN side = 'buy' THEN p.close <= level ELSE p.close >= level END AS reached,
 CASE WHEN side = 'buy' THEN true ELSE (SELECT coalesce(sum(x), 0) FROM (SELECT arg_max(d.q, d.trade_date) AS x FROM q_day d WHERE d.symbol = t.symbol AND d.trade_date <= p.trade_date AND (t.account_id IS NULL OR d.account_id = t.account_id) GROUP BY d.account_id)) > 1e-9 END AS ok,
 row_number() OVER (PARTITION BY t.target_id, t.side ORDER BY p.trade_date) AS n
FROM (SELECT target_id, symbol, account_id, unnest(['buy','sell']) AS side, unnest([buy_below, sell_above]) AS level FROM target) t JOIN stock_px p ON p.symbol = t.symbol WHERE level IS NOT NULL""", "q_day", "target", "stock_px")
cte("t_state", """
SELECT target_id, side, CAST(0 AS BIGINT) AS n, false AS out, CAST(NULL AS VARCHAR) AS event FROM (SELECT DISTINCT target_id, side FROM t_days)
UNION ALL SELECT d.target_id, d.side, d.n, CASE WHEN NOT d.reached THEN false ELSE s.out OR d.ok END, CASE WHEN d.reached AND d.ok AND NOT s.out THEN 'send' WHEN NOT d.reached AND s.out THEN 'rearm' END
FROM t_state s JOIN t_days d ON d.target_id = s.target_id AND d.side = s.side AND d.n = s.n + 1""", "t_days")
oracle("w22_target_alerts", "SELECT d.target_id, d.side, d.trade_date, d.close, d.level, s.event FROM t_state s JOIN t_days d USING (target_id, side, n) WHERE s.event IS NOT NULL", "t_days", "t_state")
oracle("d08_trading_calendar", """SELECT symbol, trade_date, dayofweek(trade_date) <= 4 AS trading_day, (SELECT max(d) FROM (SELECT trade_date - unnest([1, 2, 3]) AS d) WHERE dayofweek(d) <= 4) AS previous_session,
 (SELECT count(*) FROM days WHERE d > trade_date AND d <= DATE '2001-11-30') AS sessions_to_date FROM px""".replace("FROM days", "FROM (SELECT CAST(unnest(generate_series(DATE '1994-12-01', DATE '2001-11-30', INTERVAL 1 DAY)) AS DATE) AS d) WHERE dayofweek(d) <= 4 AND 1=1 AND").replace("AND WHERE", "AND"), "px")
oracle("d15q_price_freshness", """SELECT *, CASE WHEN missed = 0 THEN 'fresh' WHEN missed = 1 THEN 'behind' ELSE 'stale' END AS status FROM (
 SELECT symbol, trade_date AS latest, DATE '2001-11-07' AS expected, (SELECT count(*) FROM (SELECT CAST(unnest(generate_series(DATE '1994-12-01', DATE '2001-11-07', INTERVAL 1 DAY)) AS DATE) AS d) WHERE dayofweek(d) <= 4 AND d > trade_date) AS missed
 FROM stock_quote WHERE symbol IN (SELECT symbol FROM pos WHERE quantity > 0))""", "stock_quote", "pos")
