from .registry import oracle

oracle("w18_q_latest_quotes", "SELECT * FROM px QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1", "px")
oracle("j05_closes_on_or_before", "SELECT symbol, max(trade_date) AS trade_date, arg_max(close, trade_date) AS close FROM stock_px WHERE trade_date <= DATE '1999-06-15' GROUP BY symbol", "stock_px")
oracle("j05_closes_as_of_many_dates", """SELECT d.symbol, d.at_date, p.close FROM (SELECT DISTINCT symbol, last_day(trade_date) AS at_date FROM stock_px) d
 ASOF JOIN stock_px p ON p.symbol = d.symbol AND p.trade_date <= d.at_date""", "stock_px")
oracle("q_price_history", "SELECT * FROM px", "px")
MA = "CASE WHEN count(*) OVER w{n} = {n} THEN avg(close) OVER w{n} END AS ma{n}"
WIN = "w{n} AS (PARTITION BY symbol ORDER BY trade_date ROWS {m} PRECEDING)"
AVG = f"SELECT *, {MA.format(n=50)}, {MA.format(n=200)} FROM px WINDOW {WIN.format(n=50, m=49)}, {WIN.format(n=200, m=199)}"
oracle("w01_moving_averages", AVG, "px")
RET = "SELECT symbol, trade_date, close / p - 1 AS return FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS p FROM px) WHERE p > 0"
oracle("w02_daily_returns", RET, "px")
oracle("w03_price_stats", f"""
SELECT *, CASE WHEN ma50 > 0 THEN close / ma50 - 1 END AS above_ma50, CASE WHEN ma200 > 0 THEN close / ma200 - 1 END AS above_ma200 FROM
(SELECT symbol, avg(abs(return)) AS typical_daily_move, sqrt(var_samp(return) * 250) AS volatility FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS n FROM ({RET})) WHERE n <= 250 GROUP BY symbol)
JOIN (SELECT symbol, close, ma50, ma200, close / c21 - 1 AS change_month, close / c63 - 1 AS change_quarter, close / c250 - 1 AS change_year FROM (
 SELECT *, lag(close, 21) OVER o AS c21, lag(close, 63) OVER o AS c63, lag(close, 250) OVER o AS c250 FROM ({AVG}) WINDOW o AS (PARTITION BY symbol ORDER BY trade_date))
 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1) USING (symbol)""", "px")
oracle("w04_price_ranges", """
SELECT *, CASE WHEN high > low THEN (price - low) / (high - low) END AS position, price / high - 1 AS below_high, price / low - 1 AS above_low FROM (
 SELECT symbol, max(close) AS high, min(close) AS low, count(*) AS days, arg_max(close, trade_date) AS price FROM px WHERE trade_date >= DATE '2000-11-30' GROUP BY symbol)
 JOIN (SELECT p.symbol, min(p.trade_date) FILTER (p.close = m.h) AS high_date, min(p.trade_date) FILTER (p.close = m.l) AS low_date FROM px p JOIN
  (SELECT symbol, max(close) AS h, min(close) AS l FROM px WHERE trade_date >= DATE '2000-11-30' GROUP BY symbol) m USING (symbol) WHERE p.trade_date >= DATE '2000-11-30' GROUP BY p.symbol) USING (symbol)""", "px")
DD = """
SELECT symbol, days, least(worst, 0e0) AS worst, CASE WHEN worst < 0 THEN peak END AS peak_date, CASE WHEN worst < 0 THEN trough END AS trough_date, fall AS from_peak FROM (
SELECT symbol, count(*) OVER s AS days, min(fall) OVER s AS worst, first_value(trade_date) OVER (PARTITION BY symbol ORDER BY fall, trade_date) AS trough,
 first_value(peak_on) OVER (PARTITION BY symbol ORDER BY fall, trade_date) AS peak, fall, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS back FROM (
 SELECT p.symbol, p.trade_date, p.close / p.pk - 1 AS fall, (SELECT min(x.trade_date) FROM {px} x WHERE x.symbol = p.symbol AND x.close = p.pk) AS peak_on
 FROM (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS pk FROM {px}) p) WINDOW s AS (PARTITION BY symbol)) WHERE back = 1 AND days >= 2"""
oracle("w05_drawdown", DD.format(px="px"), "px")
oracle("w05_drawdown_by_stock", DD.format(px="stock_px"), "stock_px")
oracle("w06_seasonality", """
SELECT *, sum(times) OVER (PARTITION BY symbol, extreme) AS years, row_number() OVER (PARTITION BY symbol, extreme ORDER BY times DESC, month) AS place, monthname(make_date(2000, month, 1)) AS month_name FROM (
SELECT symbol, extreme, month, count(*) AS times FROM (
 SELECT DISTINCT symbol, year(trade_date) AS y, unnest(['high','low']) AS extreme, month(unnest([first_value(trade_date) OVER (PARTITION BY symbol, year(trade_date) ORDER BY close DESC, trade_date),
  first_value(trade_date) OVER (PARTITION BY symbol, year(trade_date) ORDER BY close, trade_date)])) AS month, unnest([count(*) OVER (PARTITION BY symbol, year(trade_date)), count(*) OVER (PARTITION BY symbol, year(trade_date))]) AS n FROM px) WHERE n >= 180 GROUP BY ALL)
QUALIFY sum(times) OVER (PARTITION BY symbol, extreme) >= 2""", "px")
oracle("w20_chart_window", f"SELECT * FROM ({AVG}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) <= 126", "px")
oracle("a30_price_coverage", """SELECT *, days >= 200 AS has_year, days >= 250 AS has_band, full_years >= 2 AS has_seasons FROM (
 SELECT symbol, sum(n) AS days, min(a) AS from_date, max(b) AS to_date, count(*) FILTER (n >= 180) AS full_years FROM (SELECT symbol, year(trade_date) AS y, count(*) AS n, min(trade_date) AS a, max(trade_date) AS b FROM px GROUP BY ALL) GROUP BY symbol)""", "px")
oracle("f06_change_on_previous_close", "SELECT *, CASE WHEN ycp > 0 THEN close / ycp - 1 END AS change_pct FROM quote", "quote")
STORED = "SELECT * FROM px WHERE dayofyear(trade_date) % 3 <> 0"
INC = """SELECT symbol, trade_date, CASE WHEN dayofyear(trade_date) % 4 = 0 THEN open + 1 END AS open, high, CAST(NULL AS DOUBLE) AS low, close + 1 AS close,
 CASE WHEN dayofyear(trade_date) % 5 <> 0 THEN volume END AS volume FROM px WHERE dayofyear(trade_date) % 2 = 0 OR dayofyear(trade_date) % 3 = 0"""
oracle("k01_upsert_replace", f"SELECT symbol, trade_date, open, high, low, close, volume FROM ({INC}) UNION ALL SELECT symbol, trade_date, open, high, low, close, volume FROM ({STORED}) WHERE dayofyear(trade_date) % 2 <> 0", "px")
oracle("k02_upsert_coalesce", f"SELECT symbol, trade_date, coalesce(i.open, s.open) AS open, coalesce(i.high, s.high) AS high, coalesce(i.low, s.low) AS low, coalesce(i.close, s.close) AS close, coalesce(i.volume, s.volume) AS volume FROM ({INC}) i FULL JOIN ({STORED}) s USING (symbol, trade_date)", "px")
oracle("k03_merge_preview", """SELECT symbol, count(*) FILTER (i) AS rows, min(trade_date) FILTER (i) AS from_date, max(trade_date) FILTER (i) AS to_date, count(*) FILTER (i AND s) AS replaces, count(*) FILTER (s) AS stored
 FROM (SELECT symbol, trade_date, (dayofyear(trade_date) % 2 = 0 OR dayofyear(trade_date) % 3 = 0) AS i, dayofyear(trade_date) % 3 <> 0 AS s FROM px) GROUP BY symbol HAVING count(*) FILTER (i) > 0""", "px")
oracle("z3_daily_bars_from_ticks", """SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS day, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS ticks
 FROM events GROUP BY ALL""")
