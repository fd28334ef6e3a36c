from .base import cte
from .registry import oracle

cte("active", "SELECT symbol FROM company WHERE is_active", "company")
cte("job_item", """SELECT b.d, m.symbol, i.open, i.high, i.low, i.close, i.volume, i.symbol IS NOT NULL AND n NOT IN (1, 2, 5, 6) AND close <= high * 1.001 AND close >= low * 0.999 AS good
 FROM (SELECT DISTINCT trade_date AS d FROM board_item WHERE n <> 6) b JOIN active m ON true LEFT JOIN board_item i ON i.symbol = m.symbol AND i.trade_date = b.d""", "board_item", "active")
oracle("s14_daily_job_summary", "SELECT strftime(d, '%Y-%m-%d') AS board_id, count(*) FILTER (good) AS written, count(*) FILTER (NOT coalesce(good, false)) AS skipped, count(*) FILTER (good) > 0 AS ok FROM job_item GROUP BY d", "job_item")
STORE = """SELECT symbol, d AS trade_date, open, high, low, close, volume FROM job_item WHERE good
 UNION ALL SELECT symbol, trade_date, open, high, low, close + 1, volume FROM px WHERE year(trade_date) < 1999 AND NOT EXISTS (SELECT 1 FROM job_item j WHERE j.good AND j.symbol = px.symbol AND j.d = px.trade_date)"""
oracle("k01_daily_job_prices", STORE, "job_item", "px")
oracle("k01_job_store", STORE, "job_item", "px")
oracle("w22_new_alerts", "SELECT d.target_id, d.side, d.trade_date, s.event FROM t_state s JOIN t_days d USING (target_id, side, n) WHERE s.event IS NOT NULL AND d.trade_date >= DATE '2001-01-01'", "t_days", "t_state")
oracle("w22_day_runs", "SELECT d.target_id, d.side, d.trade_date, s.event FROM t_state s JOIN t_days d USING (target_id, side, n) WHERE s.event IS NOT NULL AND d.trade_date BETWEEN DATE '2000-06-14' AND DATE '2000-06-16'", "t_days", "t_state")
oracle("z2_alert_stream", "SELECT d.target_id, d.side, d.trade_date, d.close, d.level, s.event FROM t_state s JOIN t_days d USING (target_id, side, n) WHERE s.event IS NOT NULL", "t_days", "t_state")
oracle("z1_price_stream", """SELECT symbol, trade_date, CASE WHEN never THEN NULL ELSE open END AS open, high, low, close, CASE WHEN never THEN NULL ELSE volume END AS volume
 FROM (SELECT *, day(trade_date) % 5 = 0 AND day(trade_date) % 4 = 3 AS never FROM px)""", "px")
