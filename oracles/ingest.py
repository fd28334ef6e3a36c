from .base import cte
from .registry import oracle

FILE = "symbol || '_Stock-Price+History (1).csv'"
oracle("s01_s06_price_files", f"SELECT {FILE} AS file, * FROM px", "px")
oracle("s01_price_files_on_disk", "SELECT * FROM px", "px")
JUNK = "CASE CAST(symbol[2:] AS INTEGER) % 4 WHEN 2 THEN 'not a date;x;-' WHEN 1 THEN 'not a date' || chr(9) || 'x' || chr(9) || '-' || chr(9) || '-' ELSE 'not a date,x,-' END"
oracle("s05_price_file_rejects", f"SELECT {FILE} AS file, (trade_date - DATE '1990-01-01') * 4 + 2 AS line_no, {JUNK} AS raw, 'unreadable date' AS reason FROM px WHERE dayofyear(trade_date) % 17 = 0", "px")
PLACES = "(VALUES (0, 0, 6, 5, 3, 4, 8, 1), (1, 0, 3, 6, 4, 5, 7, 1), (2, 0, 2, 3, 4, 5, 6, 1), (3, 0, 2, 3, 4, 5, 6, 1)) v(style, at_date, at_close, at_open, at_high, at_low, at_volume, at_symbol)"
oracle("s02_price_file_columns", f"SELECT {FILE} AS file, v.* FROM (SELECT DISTINCT symbol FROM px) JOIN {PLACES} ON style = CAST(symbol[2:] AS INTEGER) % 4", "px")
oracle("s03_date_orders", f"""SELECT {FILE} AS file, sum(CASE WHEN s IN (1, 2) THEN 1 + CASE WHEN dayofyear(trade_date) % 10 = 0 THEN 1 ELSE 0 END ELSE 0 END) AS slashed, s = 2 AND bool_or(day(trade_date) > 12) AS month_first, s IN (1, 2) AND bool_or(day(trade_date) > 12) AS certain, false AS conflict
 FROM (SELECT *, CAST(symbol[2:] AS INTEGER) % 4 AS s FROM px) GROUP BY symbol, s""", "px")
oracle("s04_dates_read", "SELECT symbol, trade_date, trade_date AS iso, trade_date AS named, trade_date AS american, trade_date AS day_first, trade_date AS month_first, NULL AS bad FROM px", "px")
cte("board_item", """SELECT symbol, trade_date, open, low, volume, trade_count AS trades, turnover, n, CASE WHEN n = 1 THEN low / 2 ELSE high END AS high, CASE WHEN n = 2 THEN 0 WHEN n = 3 THEN high * 1.01 WHEN n = 4 THEN low * 0.9 ELSE close END AS close
 FROM (SELECT *, (CAST(symbol[2:] AS INTEGER) + dayofyear(trade_date)) % 40 AS n FROM px)""", "px")
cte("member", "SELECT symbol FROM company WHERE is_active AND is_tracked", "company")
cte("board_all", """SELECT strftime(b.d, '%Y-%m-%d') AS board_id, m.symbol, i.* EXCLUDE (symbol), CASE WHEN i.symbol IS NULL OR n = 6 THEN 'missing from the board' WHEN n = 2 THEN 'close missing' WHEN n = 5 THEN 'day unreadable'
 WHEN high < low THEN 'day''s high under its low' WHEN close > high * 1.001 THEN 'close over the day''s high' WHEN close < low * 0.999 THEN 'close under the day''s low' END AS reason
 FROM (SELECT DISTINCT trade_date AS d FROM board_item WHERE n <> 6) b JOIN member m ON true LEFT JOIN board_item i ON i.symbol = m.symbol AND i.trade_date = b.d""", "board_item", "member")
oracle("s07_d05q_board_quotes", "SELECT * FROM board_all WHERE reason IS NULL", "board_all")
oracle("s07_board_skips", "SELECT * FROM board_all WHERE reason IS NOT NULL AND (reason <> 'missing from the board' OR board_id = (SELECT max(board_id) FROM board_all))", "board_all")
oracle("s08_archive_pages", "SELECT symbol || '/' || year(trade_date) AS file, * FROM px", "px")
oracle("s09_pasted_dividends", """SELECT symbol AS doc_id, ex_date, amount, ex_date + 30 AS payment_date, CASE WHEN CAST(symbol[2:] AS INTEGER) % 3 = 0 THEN 'Annual' END AS kind, restated AS looks_restated FROM decl WHERE amount > 0""", "decl")
oracle("s09_unreadable_dividend_rows", """SELECT symbol AS doc_id, count(*) + CASE WHEN CAST(symbol[2:] AS INTEGER) % 3 = 2 THEN 0 ELSE 1 END AS pos, CASE WHEN CAST(symbol[2:] AS INTEGER) % 3 = 1 THEN 'none | -' ELSE 'no figures here' END AS raw FROM decl GROUP BY symbol
 UNION ALL SELECT symbol, n, 'row | ' || strftime(ex_date, '%Y-%m-%d') || ' | - | 0.0000 | ' || strftime(ex_date + 30, '%Y-%m-%d') FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ex_date) - 1 AS n FROM decl) WHERE amount = 0 AND CAST(symbol[2:] AS INTEGER) % 3 = 2""", "decl")
cte("win", """SELECT symbol, greatest(s, e - i * 301 - 300) AS from_date, e - i * 301 AS to_date FROM (SELECT symbol, min(trade_date) - 700 AS s, max(trade_date) + 20 AS e FROM stock_px GROUP BY symbol) JOIN (SELECT CAST(unnest(range(200)) AS INTEGER) AS i) ON e - i * 301 >= s""", "stock_px")
oracle("s10_backfill_windows", "SELECT * FROM win", "win")
oracle("s11_backfill_coverage", """SELECT symbol, from_date, to_date, rows, CASE WHEN rows > 0 THEN 'filled' WHEN to_date < (SELECT min(trade_date) FROM stock_px p WHERE p.symbol = w.symbol AND year(trade_date) <> 1998) THEN 'before archive' ELSE 'gap' END AS status
 FROM (SELECT *, (SELECT count(*) FROM stock_px p WHERE p.symbol = win.symbol AND year(trade_date) <> 1998 AND trade_date BETWEEN from_date AND to_date) AS rows FROM win) w""", "win", "stock_px")
oracle("s13_dataset_facts", """SELECT symbol, fiscal_year, tag, value_reported * CASE scale WHEN 'million' THEN 1e6 ELSE 1 END AS value_reported, scale FROM facts WHERE is_current""", "facts")
oracle("s15_last_job_runs", "SELECT o_orderpriority[3:] AS job_name, o_orderstatus = 'F' AS succeeded, o_orderkey AS rows_affected FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate + to_seconds(o_orderkey % 86000) DESC, o_orderkey DESC) = 1")
oracle("q_tracked_companies", "SELECT c.symbol, name, sector, (SELECT count(DISTINCT fiscal_year) FROM facts f WHERE f.symbol = c.symbol) AS periods FROM company c WHERE is_tracked", "company", "facts")
oracle("q_company_by_symbol", "SELECT * FROM company WHERE symbol = 'N03'", "company")
oracle("q_core_items_by_template", """SELECT symbol, tag, template AS statement_template, display_order FROM (SELECT symbol, CASE WHEN k % 4 = 0 THEN 'bank' ELSE 'general' END AS template FROM company)
 JOIN (VALUES ('revenue', 0), ('gross_profit', 1), ('operating_profit', 2), ('net_profit', 3), ('total_equity', 5), ('eps_basic', 14), ('navps', 15), ('dividend_per_share', 17)) AS v(tag, display_order) ON tag <> 'gross_profit' OR template = 'general'""", "company")
oracle("q_period_with_facts", "SELECT * FROM facts WHERE symbol = 'N05' AND fiscal_year = 1999 AND is_current", "facts")
oracle("q_actions_by_symbol", "SELECT * FROM act", "act")
oracle("q_announced_dividends", "SELECT *, action_id % 3 = 0 AS restated FROM act WHERE action_type = 'cash_dividend' AND ex_date IS NOT NULL", "act")
ACC = "(SELECT DISTINCT c_mktsegment AS account_id, 'Broker ' || c_mktsegment[1] AS broker, c_mktsegment <> 'FURNITURE' AS is_active FROM customer)"
oracle("j01_ledger_listing", f"SELECT * FROM txn JOIN listing USING (symbol) JOIN {ACC} USING (account_id)", "txn", "listing")
oracle("q_company_names", "SELECT symbol, name, short_name FROM company", "company")
oracle("q_source_documents", "SELECT doc_id, 'N' || lpad(CAST(doc_id % 25 AS VARCHAR), 2, '0') AS symbol, 1992 + doc_id % 8 AS fiscal_year, source, md5(text) AS title FROM documents")
oracle("q_accounts", f"SELECT * FROM {ACC}")
oracle("q_targets_listing", f"SELECT t.target_id, t.symbol, l.name, t.account_id, a.broker FROM target t JOIN listing l USING (symbol) LEFT JOIN {ACC} a ON a.account_id = t.account_id", "target", "listing")
oracle("p04_quoted_members", "SELECT * FROM company c WHERE is_active AND (is_tracked OR EXISTS (SELECT 1 FROM px WHERE px.symbol = c.symbol))", "company", "px")
oracle("j02_alt_symbols", "SELECT symbol, sector, CASE WHEN k % 2 = 0 THEN 'A' || k ELSE '' END AS alt_symbols FROM company", "company")
oracle("j14_w19_duplicate_documents", """SELECT doc_id, keep_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY CASE WHEN lang <> 'en' THEN lang END, md5(text)) AS keep_id FROM documents) WHERE doc_id > keep_id""")
oracle("j14_unreferenced_documents", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
oracle("x04_names_from_files", f"SELECT DISTINCT {FILE} AS file, symbol AS company FROM px", "px")
oracle("x01_x02_numbers_read", "SELECT symbol, trade_date, close AS plain, -close AS negative, close * 1000 AS thousands, close * 1000000 AS millions, NULL AS missing FROM px", "px")
oracle("x05_wrapped_text", r"""SELECT page_id, coalesce(list_aggregate(list_transform(l, lambda x, i: x || CASE WHEN i = len(l) OR (i >= 2 AND length(x) >= 9 AND NOT contains(x, ' ')) THEN '' ELSE ' ' END), 'string_agg', ''), '') AS text,
 CASE WHEN regexp_full_match(j, '[A-Z0-9][A-Z0-9&.-]{1,19}') THEN j END AS code
 FROM (SELECT page_id, l, translate(coalesce(l[1], '') || coalesce(l[2], ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS j FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1) AS l FROM pages))""")
oracle("x06_cell_text", r"""SELECT page_id, place, regexp_replace(regexp_replace(regexp_replace(CASE WHEN contains(bare, '&') THEN
  replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(bare, '&amp;', chr(1)), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''),
  '(?i)&([a-z]+|#x?[0-9a-f]+);', ' ', 'g'), chr(1), '&') ELSE bare END, '\s+', ' ', 'g'), '^ *["'']? *', ''), ' *["'']? *$', '') AS text
 FROM (SELECT page_id, i - 1 AS place, regexp_replace(cells[i], '<[^>]*>', ' ', 'g') AS bare FROM (SELECT page_id, cells, unnest(range(1, len(cells) + 1)) AS i
  FROM (SELECT page_id, regexp_extract_all(html, '(?s)<(?:p|h1|title|footer)\b[^>]*>(.*?)</(?:p|h1|title|footer)>', 1) AS cells FROM pages)))""")
oracle("d06q_price_row_recheck", "SELECT * FROM (SELECT CASE WHEN dayofyear(trade_date) % 9 = 1 THEN lower(symbol) ELSE symbol END AS symbol, trade_date, CASE dayofyear(trade_date) % 9 WHEN 1 THEN 'symbol' WHEN 2 THEN 'close' WHEN 3 THEN 'negative price' WHEN 4 THEN 'negative volume' END AS reason FROM px) WHERE reason IS NOT NULL", "px")
oracle("q_account_snapshots", f"SELECT * FROM snap JOIN {ACC} USING (account_id)", "snap")
oracle("q_cash_movements", f"SELECT * FROM moves JOIN {ACC} USING (account_id)", "moves")
oracle("q_ledger_imports", "SELECT * FROM imports", "imports")
