from .base import CTES, TXN, cte, r2
from .registry import oracle

cte("stmt_day", """SELECT * FROM snap WHERE NOT (ascii(account_id) % 4 = 1 AND as_of > DATE '2001-05-31') QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY as_of DESC) = 1""", "snap")
cte("early", """SELECT account_id, symbol, arg_max(q, rn) AS q, arg_max(c, rn) AS c, sum(gain) AS gain FROM steps JOIN stmt_day USING (account_id) WHERE trade_date <= as_of GROUP BY ALL""", "steps", "stmt_day")
cte("stmt", """SELECT * FROM (SELECT account_id, symbol, q + (CASE WHEN k % 9 = 0 THEN 10e0 WHEN k % 9 = 1 THEN -1e0 ELSE 0e0 END) AS quantity, c + (CASE WHEN k % 7 = 0 THEN 1e0 WHEN k % 9 = 0 THEN c * 0.1e0 ELSE 0e0 END) AS cost_amount
 FROM (SELECT *, CAST(symbol[2:] AS BIGINT) AS k FROM early) WHERE (q > 0 OR k % 13 = 0) AND k % 11 <> 0) WHERE quantity > 0""", "early")
oracle("j09_reconcile_holdings", """
SELECT account_id, symbol, kind, sq AS statement_qty, lq AS ledger_qty, sq - lq AS delta, cost_amount AS statement_cost, lc AS ledger_cost,
 CASE WHEN kind = 'opening' THEN 'buy' WHEN kind = 'increase' AND same THEN 'bonus' WHEN kind = 'increase' THEN 'buy' END AS proposed_type, CASE WHEN kind = 'opening' THEN sq WHEN kind = 'increase' THEN sq - lq END AS proposed_qty,
 CASE WHEN kind = 'opening' THEN cost_amount / sq WHEN kind = 'increase' AND same THEN 0 WHEN kind = 'increase' THEN greatest(cost_amount - lc, 0) / (sq - lq) END AS proposed_price, kind = 'opening' AS selected
FROM (SELECT account_id, symbol, coalesce(s.quantity, 0) AS sq, coalesce(l.q, 0) AS lq, coalesce(l.c, 0) AS lc, s.cost_amount, abs(s.cost_amount - coalesce(l.c, 0)) <= greatest(1, abs(coalesce(l.c, 0)) * 0.005) AS same,
 CASE WHEN l.q IS NULL THEN 'opening' WHEN s.quantity IS NULL THEN 'exit' WHEN s.quantity = l.q THEN 'match' WHEN s.quantity > l.q THEN 'increase' ELSE 'decrease' END AS kind
 FROM stmt s FULL JOIN (SELECT * FROM early WHERE q > 0) l USING (account_id, symbol))""", "stmt", "early")
cte("checks", """
SELECT account_id, as_of, symbol || ' shares' AS label, coalesce(e.q, 0) AS ours, coalesce(s.quantity, 0) AS broker, coalesce(e.q, 0) = coalesce(s.quantity, 0) AS ok
 FROM early e FULL JOIN stmt s USING (account_id, symbol) JOIN stmt_day USING (account_id) WHERE coalesce(e.q, 0) <> 0 OR s.quantity IS NOT NULL
UNION ALL SELECT account_id, as_of, symbol || ' cost', e.c, s.cost_amount, abs(e.c - s.cost_amount) <= 0.05 + 1e-9 FROM early e JOIN stmt s USING (account_id, symbol) JOIN stmt_day USING (account_id) WHERE e.q = s.quantity
UNION ALL SELECT account_id, as_of, label, ours, broker, CASE WHEN reach >= as_of THEN CASE WHEN label = 'Dividends recorded against stocks' THEN ours >= broker - 0.01 ELSE abs(ours - broker) <= tol + 1e-9 END END FROM (
 SELECT s.account_id, s.as_of, r.reach, unnest(['Cash balance','Deposited','Withdrawn','Dividends into the account','Realised gain','Dividends recorded against stocks']) AS label,
  unnest([m.moved + x.traded, m.dep, abs(m.wd), m.dv, x.gained, x.recorded]) AS ours, unnest([cash_balance, deposit, withdraw, cash_dividend, realised_gain, cash_dividend]) AS broker, unnest([0.015e0, 0.005e0, 0.005e0, 0.005e0, 0.05e0, 0e0]) AS tol
 FROM stmt_day s LEFT JOIN reach r USING (account_id)
  LEFT JOIN (SELECT account_id, sum(amount) AS moved, coalesce(sum(amount) FILTER (kind = 'deposit'), 0) AS dep, coalesce(sum(amount) FILTER (kind = 'withdrawal'), 0) AS wd, coalesce(sum(amount) FILTER (kind = 'dividend'), 0) AS dv FROM moves JOIN stmt_day USING (account_id) WHERE move_date <= as_of GROUP BY 1) m USING (account_id)
  LEFT JOIN (SELECT account_id, sum(cash) FILTER (txn_type IN ('buy','sell','rights')) AS traded, sum(gain) AS gained, sum(cash) FILTER (txn_type = 'dividend') AS recorded FROM steps JOIN stmt_day USING (account_id) WHERE trade_date <= as_of GROUP BY 1) x USING (account_id))""", "early", "stmt", "stmt_day", "moves", "steps", "reach")
oracle("a23_account_checks", "SELECT * FROM checks", "checks")
oracle("a24_check_summary", "SELECT account_id, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok IS NULL) AS unchecked FROM checks GROUP BY 1", "checks")

TOK = "list_filter(string_split(trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ('limited','ltd','plc','company','co','the','inc'))"


def match_sql(names: str) -> str:
    return f"""SELECT company_name, CASE WHEN count(DISTINCT symbol) FILTER (score = best) = 1 THEN max(symbol) FILTER (score = best) END AS symbol FROM (
 SELECT n.company_name, c.symbol, least(len(n.t), len(c.t)) AS score, max(least(len(n.t), len(c.t))) OVER (PARTITION BY n.company_name) AS best
 FROM (SELECT DISTINCT company_name, {TOK.format(x='company_name')} AS t FROM {names}) n LEFT JOIN (SELECT symbol, unnest([{TOK.format(x='name')}, {TOK.format(x='symbol')}]) AS t FROM listing) c
  ON len(c.t) > 0 AND len(n.t) > 0 AND c.t[1] = n.t[1] AND (n.t[1:len(c.t)] = c.t OR c.t[1:len(n.t)] = n.t)) GROUP BY company_name"""


cte("asked", """SELECT CASE k % 5 WHEN 0 THEN 'The Supplier-' || key || ' LTD.' WHEN 1 THEN 'supplier ' || key || ' International' WHEN 2 THEN 'Supplier Co. of ' || key WHEN 3 THEN p_name ELSE 'Supplier ' || key END AS company_name
 FROM (SELECT p_name, p_partkey AS k, lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(9, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') AS key FROM part)""")
oracle("j10_x03_name_matches", match_sql("asked"), "asked", "listing")

P = "trade_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"
cte("traded", f"""SELECT account_id, symbol, CAST(symbol[2:] AS BIGINT) AS k, coalesce(sum(quantity) FILTER (txn_type = 'buy'), 0) AS l_buy, coalesce(sum(quantity) FILTER (txn_type = 'sell'), 0) AS l_sale, sum(gain) AS l_profit FROM steps WHERE {P} AND txn_type IN ('buy','sell') GROUP BY ALL""", "steps")
cte("pnl", """SELECT account_id, CASE WHEN k % 7 = 0 THEN 'Unlisted ' || symbol ELSE 'Supplier ' || lpad(CAST(k AS VARCHAR), CAST(greatest(9, length(CAST(k AS VARCHAR))) AS INTEGER), '0') || ' Limited' END AS company_name, l_buy + CASE WHEN k % 8 = 3 THEN 1 ELSE 0 END AS buy_qty, l_sale AS sale_qty, k * 10e0 AS profit FROM traded WHERE k % 10 <> 9""", "traded")
cte("pnl_named", f"""SELECT p.*, m.symbol, EXISTS (SELECT 1 FROM traded t WHERE t.account_id = p.account_id AND t.symbol = m.symbol) AS hit FROM pnl p LEFT JOIN ({match_sql('pnl')}) m USING (company_name)""", "pnl", "listing", "traded")
cte("pnl_free", "SELECT * FROM traded t WHERE NOT EXISTS (SELECT 1 FROM pnl_named p WHERE p.hit AND p.account_id = t.account_id AND p.symbol = t.symbol)", "traded", "pnl_named")
cte("pnl_matched", """SELECT p.account_id, company_name, buy_qty, sale_qty, profit, CASE WHEN hit THEN symbol
 WHEN (SELECT count(*) FROM pnl_free f WHERE f.account_id = p.account_id AND f.l_buy = buy_qty AND f.l_sale = sale_qty) = 1 AND (SELECT count(*) FROM pnl_named o WHERE NOT o.hit AND o.account_id = p.account_id AND o.buy_qty = p.buy_qty AND o.sale_qty = p.sale_qty) = 1
 THEN (SELECT max(symbol) FROM pnl_free f WHERE f.account_id = p.account_id AND f.l_buy = buy_qty AND f.l_sale = sale_qty) ELSE symbol END AS symbol FROM pnl_named p""", "pnl_named", "pnl_free")
oracle("a25_j11_j12_pnl_comparison", """SELECT m.*, l_buy, l_sale, l_profit, coalesce(l_buy = buy_qty AND l_sale = sale_qty, false) AS complete FROM pnl_matched m LEFT JOIN traded t USING (account_id, symbol)
UNION ALL BY NAME SELECT account_id, symbol AS company_name, symbol, 0 AS buy_qty, 0 AS sale_qty, 0 AS profit, l_buy, l_sale, l_profit, false AS complete FROM traded t WHERE NOT EXISTS (SELECT 1 FROM pnl_matched m WHERE m.account_id = t.account_id AND m.symbol = t.symbol)""", "pnl_matched", "traded")

cte("line", f"""SELECT account_id AS import_id, line_no, kind, symbol, quantity, txn_id, a / 100 AS amount, f / 100 AS commission, a, f, cash, {r2('price_per_share')} AS rate,
 CASE WHEN kind = 'buy' THEN (a + f + CASE WHEN txn_id % 89 = 0 THEN 7 ELSE 0 END) / 100 ELSE 0 END AS debit, CASE WHEN kind = 'sell' THEN (a - f) / 100 ELSE 0 END AS credit,
 1000000 + (sum(cash) OVER (PARTITION BY account_id ORDER BY line_no) + CASE WHEN txn_id % 97 = 0 THEN 500 ELSE 0 END) / 100 AS balance
FROM (SELECT *, CASE WHEN kind = 'buy' THEN -(a + f) ELSE a - f END AS cash, row_number() OVER (PARTITION BY account_id ORDER BY trade_date, symbol, txn_id) AS line_no
 FROM (SELECT *, CASE WHEN txn_type = 'sell' THEN 'sell' ELSE 'buy' END AS kind, CAST(floor(quantity * price_per_share * 100 + 0.5) AS BIGINT) AS a, CAST(floor(commission * 100 + 0.5) AS BIGINT) AS f FROM ctxn WHERE txn_type IN ('buy','sell','rights')))""", "ctxn")
cte("line_p", "SELECT *, coalesce(lag(balance) OVER (PARTITION BY import_id ORDER BY line_no), 1000000) AS previous FROM line", "line")
oracle("w15_balance_breaks", f"SELECT * FROM (SELECT *, {r2('previous - debit + credit')} AS expected FROM line_p) WHERE abs(expected - balance) > 0.011", "line_p")
oracle("w15_import_issues", """SELECT import_id, issue FROM (SELECT import_id, unnest(['closing balance','total commission','total debit','total credit']) AS issue,
 unnest([arg_max(txn_id, line_no) % 97 = 0, false, count(*) FILTER (txn_id % 89 = 0 AND kind = 'buy') > 0 AND round(sum(debit) * 100) - sum(CASE WHEN kind = 'buy' THEN a + f ELSE 0 END) > 5, CAST(import_id AS BIGINT) % 50 = 0]) AS bad FROM line GROUP BY import_id) WHERE bad""", "line")
cte("effects", f"""SELECT *, amount / quantity AS exact_price, {r2("CASE WHEN kind = 'buy' THEN -effect - amount ELSE amount - effect END")} AS exact_commission FROM (
 SELECT *, CASE WHEN abs({r2('balance - previous')} - {r2('credit - debit')}) <= 0.011 THEN {r2('balance - previous')} ELSE {r2('credit - debit')} END AS effect FROM line_p)""", "line_p")
oracle("w16_a27_cash_effects", "SELECT * FROM effects", "effects")
oracle("a26_import_summary", "SELECT import_id, count(*) FILTER (kind = 'buy') AS buys, count(*) FILTER (kind = 'sell') AS sells, sum(exact_commission) AS commission, 0 AS deposits, 0 AS withdrawals, 0 AS fees, 0 AS dividends FROM effects GROUP BY import_id", "effects")
oracle("d07q_ledger_line_rules", """SELECT import_id, line_no, rule FROM (SELECT import_id, line_no, unnest(['amount differs from shares at the rate','debit is not amount plus commission']) AS rule,
 unnest([abs(quantity * rate - amount) > quantity * 0.005 + 0.011, kind = 'buy' AND abs(amount + commission - debit) > 0.011]) AS bad FROM line) WHERE bad""", "line")

BROKER = f"""SELECT account_id, symbol, least(CAST(trade_date + CAST(CASE WHEN source = 'manual' THEN txn_id % 5 ELSE 0 END AS INTEGER) AS DATE), DATE '1998-12-31') AS trade_date, txn_type, quantity, price_per_share, gross_amount, commission, tax_withheld, source, record_date, txn_id + 1 AS txn_id, rnk
 FROM txn WHERE {P} AND txn_type IN ('buy','sell') AND txn_id % 7 <> 0"""
cte("broker", BROKER, "txn")
KEY = "account_id, symbol, txn_type, quantity"
cte("by_hand", f"SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY trade_date, txn_id) AS n FROM txn WHERE {P} AND txn_type IN ('buy','sell') AND source = 'manual'", "txn")
cte("offers", f"SELECT {KEY}, list({{'d': trade_date, 'id': txn_id}} ORDER BY trade_date, txn_id) AS items FROM broker GROUP BY ALL", "broker")
# One hand-entered trade at a time, each taking the first offer within three days not taken yet.
cte("greedy", f"""SELECT {KEY}, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(d DATE, id BIGINT)[]) AS taken, false AS hit FROM (SELECT DISTINCT {KEY} FROM by_hand)
UNION ALL SELECT {KEY}, n, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, pick IS NOT NULL FROM (
 SELECT g.account_id, g.symbol, g.txn_type, g.quantity, m.n, g.taken, list_filter(o.items, lambda x: abs(x.d - m.trade_date) <= 3 AND NOT list_contains(g.taken, x))[1] AS pick
 FROM greedy g JOIN by_hand m ON m.account_id = g.account_id AND m.symbol = g.symbol AND m.txn_type = g.txn_type AND m.quantity = g.quantity AND m.n = g.n + 1
 LEFT JOIN offers o ON o.account_id = g.account_id AND o.symbol = g.symbol AND o.txn_type = g.txn_type AND o.quantity = g.quantity)""", "by_hand", "offers")
cte("decided", f"""SELECT m.account_id, m.symbol, m.trade_date, m.txn_id, m.txn_type, m.quantity, m.source, g.hit AS replaced FROM by_hand m JOIN greedy g USING ({KEY}, n)
 UNION ALL SELECT account_id, symbol, trade_date, txn_id, txn_type, quantity, source, true FROM txn WHERE {P} AND txn_type IN ('buy','sell') AND source <> 'manual'""", "txn", "by_hand", "greedy")
oracle("j13_a27_replaced_trades", "SELECT * FROM decided", "decided")
cte("after_txn", """SELECT account_id, symbol, trade_date, txn_type, quantity, price_per_share, gross_amount, commission, tax_withheld, source, record_date, txn_id, rnk FROM txn t
 WHERE NOT EXISTS (SELECT 1 FROM decided d WHERE d.replaced AND d.account_id = t.account_id AND d.symbol = t.symbol AND d.trade_date = t.trade_date AND d.txn_id = t.txn_id) UNION ALL SELECT * FROM broker""", "txn", "decided", "broker")
for name in ("ev", "fold", "steps"):
    needs, sql = CTES[name]
    for old, new in ((" txn\n", " after_txn\n"), ("FROM ev", "FROM a_ev"), ("JOIN ev", "JOIN a_ev"), ("FROM fold", "FROM a_fold"), ("JOIN fold", "JOIN a_fold")):
        sql = sql.replace(old, new)
    cte("a_" + name, sql, *[{"txn": "after_txn"}.get(n, "a_" + n) for n in needs])
oracle("a27_holdings_before_after", """SELECT account_id, symbol, coalesce(b.q, 0) AS before, coalesce(a.q, 0) AS after FROM (SELECT account_id, symbol, arg_max(q, rn) AS q FROM steps GROUP BY ALL) b
 FULL JOIN (SELECT account_id, symbol, arg_max(q, rn) AS q FROM a_steps GROUP BY ALL) a USING (account_id, symbol) WHERE coalesce(b.q, 0) <> 0 OR coalesce(a.q, 0) <> 0""", "steps", "a_steps")
oracle("a27_import_blockers", "SELECT *, over_from AS held FROM a_steps WHERE over_from IS NOT NULL", "a_steps")
oracle("k08_new_symbols", "SELECT DISTINCT symbol FROM broker WHERE symbol NOT IN (SELECT symbol FROM listing WHERE symbol NOT LIKE '%7')", "broker", "listing")
oracle("k05_replace_period", f"""SELECT account_id, symbol, trade_date, txn_id, txn_type, quantity FROM txn WHERE NOT (account_id IN ('BUILDING','MACHINERY') AND {P} AND txn_type IN ('buy','sell'))
 UNION ALL SELECT account_id, symbol, trade_date, txn_id, txn_type, quantity FROM broker WHERE account_id IN ('BUILDING','MACHINERY')""", "txn", "broker")
# Imports by customer: the ledger after the import is folded one event at a time.
cte("k5_now", f"SELECT *, CAST(account_id AS BIGINT) % 6 AS g FROM ctxn WHERE {P} AND txn_type IN ('buy','sell')", "ctxn")
cte("k5_lots", "SELECT DISTINCT account_id, symbol, DATE '1992-01-01' AS trade_date, 'buy' AS txn_type, 1e6 AS quantity, 'statement' AS source, CAST(0 AS HUGEINT) AS txn_id, 0 AS rnk FROM ctxn WHERE CAST(account_id AS BIGINT) % 6 <> 0", "ctxn")
cte("k5_old", "SELECT account_id, symbol, trade_date, txn_type, quantity, source, txn_id, rnk FROM ctxn UNION ALL SELECT * FROM k5_lots", "ctxn", "k5_lots")
cte("k5_gone", """SELECT account_id, symbol, trade_date, txn_id FROM k5_now WHERE source <> 'manual' OR txn_id % 5 = 0
 UNION ALL SELECT account_id, symbol, trade_date, txn_id FROM ctxn WHERE CAST(account_id AS BIGINT) % 6 = 2 AND txn_type IN ('buy','sell') AND year(trade_date) = 1997""", "k5_now", "ctxn")
cte("k5_new", "SELECT account_id, symbol, trade_date, txn_type, quantity, 'ledger' AS source, txn_id + 1 AS txn_id, rnk, g FROM k5_now WHERE txn_id % 7 <> 0", "k5_now")
cte("k5_plan", "SELECT account_id, g, sum(quantity) AS opening, count(*) AS trades FROM k5_new GROUP BY ALL", "k5_new")
cte("k5_after", "SELECT * FROM k5_old o WHERE NOT EXISTS (SELECT 1 FROM k5_gone x WHERE x.account_id = o.account_id AND x.symbol = o.symbol AND x.trade_date = o.trade_date AND x.txn_id = o.txn_id) UNION ALL SELECT * EXCLUDE (g) FROM k5_new", "k5_old", "k5_gone", "k5_new")
for side, src in (("b", "k5_old"), ("a", "k5_after")):
    cte(f"k5_{side}ev", f"SELECT *, row_number() OVER (PARTITION BY account_id, symbol ORDER BY trade_date, rnk, txn_id) AS rn FROM {src} WHERE account_id IN (SELECT account_id FROM k5_plan)", src, "k5_plan")
    cte(f"k5_{side}", f"""SELECT account_id, symbol, CAST(0 AS BIGINT) AS rn, 0e0 AS q, 0 AS short FROM (SELECT DISTINCT account_id, symbol FROM k5_{side}ev)
     UNION ALL SELECT e.account_id, e.symbol, e.rn, CASE WHEN e.txn_type = 'sell' THEN greatest(f.q - e.quantity, 0) WHEN e.txn_type = 'dividend' THEN f.q ELSE f.q + e.quantity END, CASE WHEN e.txn_type = 'sell' AND e.quantity > f.q + 1e-9 THEN 1 ELSE f.short END
      FROM k5_{side} f JOIN k5_{side}ev e ON e.account_id = f.account_id AND e.symbol = f.symbol AND e.rn = f.rn + 1""", f"k5_{side}ev")
cte("k5_held", """SELECT account_id, symbol, coalesce(b.q, 0) AS before, coalesce(a.q, 0) AS after, coalesce(a.short, 0) AS short FROM (SELECT account_id, symbol, arg_max(q, rn) AS q FROM k5_b GROUP BY ALL) b
 FULL JOIN (SELECT account_id, symbol, arg_max(q, rn) AS q, max(short) AS short FROM k5_a GROUP BY ALL) a USING (account_id, symbol)""", "k5_a", "k5_b")
cte("k5_outcome", """SELECT account_id, g, reason IS NULL AS applied, reason, CASE reason WHEN 'trades changed since the preview' THEN s1 WHEN 'removes a trade that the preview did not show' THEN s2 WHEN 'sells shares that were never bought' THEN s3 WHEN 'changes holdings without confirmation' THEN s4 END AS symbol,
 CASE reason WHEN 'trades changed since the preview' THEN n1 WHEN 'removes a trade that the preview did not show' THEN n2 WHEN 'sells shares that were never bought' THEN n3 WHEN 'changes holdings without confirmation' THEN n4 ELSE 0 END AS rows FROM (
 SELECT *, CASE WHEN n1 > 0 THEN 'trades changed since the preview' WHEN n2 > 0 THEN 'removes a trade that the preview did not show' WHEN n3 > 0 THEN 'sells shares that were never bought' WHEN n4 > 0 AND g NOT IN (3, 4) THEN 'changes holdings without confirmation' END AS reason
 FROM (SELECT account_id, g FROM k5_plan) LEFT JOIN (SELECT account_id, count(*) AS n1, min(symbol) AS s1 FROM k5_now WHERE g = 1 AND txn_id % 11 = 0 GROUP BY 1) USING (account_id)
  LEFT JOIN (SELECT account_id, count(*) AS n2, min(symbol) AS s2 FROM k5_gone WHERE year(trade_date) = 1997 GROUP BY 1) USING (account_id)
  LEFT JOIN (SELECT account_id, count(*) FILTER (short = 1) AS n3, min(symbol) FILTER (short = 1) AS s3, count(*) FILTER (before <> after) AS n4, min(symbol) FILTER (before <> after) AS s4 FROM k5_held GROUP BY 1) USING (account_id))""", "k5_plan", "k5_now", "k5_gone", "k5_held")
oracle("k05_import_outcomes", "SELECT * FROM k5_outcome", "k5_outcome")
DONE = "(SELECT account_id FROM k5_outcome WHERE applied)"
oracle("k05_import_trades", f"SELECT * FROM k5_after WHERE account_id IN {DONE} UNION ALL SELECT * FROM k5_old WHERE account_id NOT IN {DONE}", "k5_after", "k5_old", "k5_outcome")
cte("c_moves", f"""SELECT account_id, move_date, kind, movement_id, CASE kind WHEN 'deposit' THEN t WHEN 'withdrawal' THEN -{r2('t * 0.6e0')} WHEN 'fee' THEN -{r2('t * 0.001e0')} WHEN 'dividend' THEN {r2('t * 0.02e0')} ELSE -{r2('t * 0.01e0')} END AS amount
FROM (SELECT CAST(o_custkey AS VARCHAR) AS account_id, CAST(o_orderdate AS DATE) AS move_date, o_orderkey AS movement_id, o_totalprice AS t,
 CASE o_orderpriority[1] WHEN '1' THEN 'deposit' WHEN '2' THEN 'withdrawal' WHEN '3' THEN 'fee' WHEN '4' THEN 'dividend' ELSE CASE o_orderstatus WHEN 'F' THEN 'ipo' ELSE 'other' END END AS kind FROM orders)""")
oracle("k05_import_cash", f"""SELECT * FROM c_moves WHERE NOT (year(move_date) = 1998 AND account_id IN {DONE})
 UNION ALL SELECT * REPLACE (-movement_id AS movement_id) FROM c_moves WHERE year(move_date) = 1998 AND movement_id % 3 <> 0 AND account_id IN {DONE}""", "c_moves", "k5_outcome")
oracle("k05_import_periods", f"""SELECT account_id, period_from, period_to, opening_balance, NULL AS closing_balance, NULL AS trades, NULL AS cash_lines FROM imports
 UNION ALL SELECT account_id, DATE '1998-01-01', DATE '1998-12-31', opening, opening + 1, trades, coalesce(n, 0) FROM k5_plan LEFT JOIN (SELECT account_id, count(*) AS n FROM c_moves WHERE year(move_date) = 1998 AND movement_id % 3 <> 0 GROUP BY 1) USING (account_id) WHERE account_id IN {DONE}""", "imports", "k5_plan", "c_moves", "k5_outcome")
oracle("k05_import_companies", f"""SELECT symbol, name, NULL AS is_tracked FROM listing WHERE symbol NOT LIKE '%7' UNION ALL SELECT DISTINCT symbol, symbol, false FROM k5_new WHERE account_id IN {DONE} AND symbol NOT IN (SELECT symbol FROM listing WHERE symbol NOT LIKE '%7')""", "listing", "k5_new", "k5_outcome")
oracle("k07_snapshot_upsert", """SELECT account_id, as_of, CASE WHEN month(as_of) % 2 = 0 THEN deposit + 10 ELSE deposit END AS deposit, CASE WHEN month(as_of) % 2 = 0 THEN 2 ELSE 1 END AS imported FROM snap UNION ALL SELECT account_id, as_of + 3, deposit, 3 FROM snap WHERE month(as_of) = 6""", "snap")
oracle("d12q_changed_since_preview", "SELECT *, CASE WHEN txn_id % 11 <> 0 THEN 'vanished' ELSE 'appeared' END AS change FROM txn WHERE (txn_id % 11 <> 0) <> (txn_id % 13 <> 0)", "txn")
cte("report", f"""SELECT account_id, account_id || '/' || symbol || '/' || record_date AS line_id, 'Supplier#' || lpad(CAST(k AS VARCHAR), CAST(greatest(9, length(CAST(k AS VARCHAR))) AS INTEGER), '0') || CASE WHEN k % 3 = 0 THEN ' Ltd.' ELSE '' END AS company_name, CASE WHEN k % 5 = 0 THEN 'elsewhere' ELSE 'broker' END AS paid_via, symbol,
 CASE WHEN k % 4 = 0 THEN CAST(record_date + 200 AS DATE) ELSE record_date END AS record_date, gross + (CASE WHEN k % 6 = 0 THEN 1e0 ELSE 0e0 END) AS gross, CASE WHEN k % 7 <> 0 THEN {r2('gross * 0.1e0')} END AS tax
 FROM (SELECT account_id, symbol, CAST(symbol[2:] AS BIGINT) AS k, record_date, sum(CAST(floor(gross_amount * 100 + 0.5) AS BIGINT)) / 100 AS gross FROM txn WHERE record_date IS NOT NULL GROUP BY ALL)""", "txn")
oracle("a28_dividend_import_plan", f"""
SELECT *, NOT recorded AND paid_via = 'broker' AS suggested, coalesce(ledger_holding <> 100, false) AS holding_differs FROM (
SELECT r.line_id, r.company_name, r.paid_via, r.symbol, r.record_date, r.gross, coalesce(r.tax, floor(r.gross * rate * 100 + 0.5) / 100) AS tax_withheld,
 (SELECT arg_max(q, rn) FROM steps s WHERE s.account_id = r.account_id AND s.symbol = r.symbol AND s.trade_date < r.record_date) AS ledger_holding,
 EXISTS (SELECT 1 FROM txn x WHERE x.txn_type = 'dividend' AND x.account_id = r.account_id AND x.symbol = r.symbol AND CASE WHEN x.record_date IS NOT NULL THEN x.record_date = r.record_date
  ELSE abs(x.gross_amount - r.gross) < 0.01 AND x.trade_date BETWEEN r.record_date AND r.record_date + 120 END) AS recorded
FROM report r JOIN (SELECT account_id, sum(tax) / sum(gross) AS rate FROM report WHERE tax IS NOT NULL AND gross > 0 GROUP BY 1) USING (account_id))""", "report", "steps", "txn")
oracle("r1_nested_receivables", f"SELECT account_id, as_of, company_name, entitlement, record_date, count(*) OVER (PARTITION BY account_id, as_of) AS lines FROM ({CTES['receivable'][1].replace('FROM txn', 'FROM ctxn')})", "ctxn")
oracle("d01q_transaction_rules", """
SELECT txn_id, symbol, trade_date, rule FROM (SELECT txn_id, symbol, trade_date, unnest(['unknown type','quantity must be positive','quantity must be whole','dividend needs an amount','negative commission or tax','tax above dividend','record date on a trade']) AS rule,
 unnest([n = 5, n = 1 AND txn_type <> 'dividend', n = 2 AND txn_type <> 'dividend', false, n = 3, n = 4 AND txn_type = 'dividend', n = 5 AND record_date IS NOT NULL]) AS bad FROM (SELECT *, txn_id % 50 AS n FROM txn)) WHERE bad""", "txn")
oracle("d02q_movement_rules", """SELECT movement_id, CASE WHEN movement_id % 10 = 1 THEN 'amount is zero' WHEN kind IN ('deposit','dividend') THEN 'must come in' ELSE 'must go out' END AS rule FROM moves WHERE movement_id % 10 = 1 OR (movement_id % 10 = 0 AND kind IN ('deposit','dividend','withdrawal','fee'))""", "moves")
oracle("d02q_target_rules", """SELECT target_id, rule FROM (SELECT target_id, unnest(['no level','buy level not under sell level']) AS rule, unnest([b IS NULL AND sell_above IS NULL, b >= sell_above]) AS bad FROM (SELECT *, CASE WHEN target_id % 4 = 0 THEN sell_above ELSE buy_below END AS b FROM target)) WHERE bad""", "target")
oracle("d02q_account_and_period_rules", """SELECT CAST(c_custkey AS VARCHAR) AS row_id, 'account number must have 16 digits' AS rule FROM customer WHERE c_custkey % 9 = 0 UNION ALL SELECT account_id || '/' || period_from, 'period ends before it starts' FROM imports WHERE month(period_from) = 7""", "imports")
oracle("d02q_factor_rules", "SELECT action_id, 'impossible terms' AS rule FROM act WHERE (action_type = 'stock_dividend' AND stock_pct = 3) OR (action_type IN ('split','reverse_split') AND action_id % 3 = 0)", "act")
oracle("d03q_unique_current_facts", "SELECT symbol, fiscal_year, tag, 2 AS rows FROM facts WHERE is_current AND tag = 'revenue' AND fiscal_year % 2 = 0", "facts")
oracle("d03q_unique_actions_null_dates_distinct", "SELECT symbol, action_type, ex_date, 2 AS rows FROM act WHERE action_id % 5 = 0 AND ex_date IS NOT NULL", "act")
oracle("d03q_unique_targets_null_accounts_equal", "SELECT symbol, account_id, 2 AS rows FROM target WHERE target_id % 3 = 0", "target")
cte("hold_line", """SELECT account_id, symbol, k, quantity, floor(cost_basis * 100 + 0.5) / 100 AS cost_amount, floor(cost_basis / quantity * 100 + 0.5) / 100 + CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END AS cost_price, close, quantity * close + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS market_value
 FROM (SELECT p.*, CAST(p.symbol[2:] AS BIGINT) AS k, q.close FROM pos p JOIN stock_quote q USING (symbol) WHERE quantity > 0)""", "pos", "stock_quote")
oracle("d08q_holding_rules", """SELECT account_id, symbol, rule FROM (SELECT account_id, symbol, unnest(['parts do not add up','cost is not quantity times price','value is not quantity times price','open gain differs from value minus cost']) AS rule,
 unnest([k % 10 = 0, abs(quantity * cost_price - cost_amount) > quantity * 0.005 + 0.02, k % 6 = 0, k % 9 = 0]) AS bad FROM hold_line) WHERE bad""", "hold_line")
oracle("d08q_holding_totals", """SELECT account_id, sum_cost, rule FROM (SELECT account_id, sum(cost_amount) AS sum_cost, unnest(['holdings cost does not sum to the total','holdings value does not sum to the total']) AS rule,
 unnest([account_id = 'BUILDING' AND 100 > 0.05 * count(*), account_id < 'C' AND 50 > 0.05 * count(*)]) AS bad FROM hold_line GROUP BY account_id) WHERE bad""", "hold_line")
oracle("d08q_status_rules", """SELECT account_id, as_of, 'deposit lines do not sum to the total' AS rule FROM snap WHERE month(as_of) = 3 UNION ALL SELECT account_id, as_of, 'withdrawal lines do not sum to the total' FROM snap WHERE year(as_of) >= 2001""", "snap")
oracle("d09q_dividend_line_rules", """SELECT account_id || '/' || symbol || '/' || record_date AS line_id, rule FROM (SELECT *, unnest(['net is not gross less tax','gross is not holding at this percent of face value']) AS rule, unnest([CAST(symbol[2:] AS BIGINT) % 3 = 0, CAST(symbol[2:] AS BIGINT) % 4 = 0]) AS bad FROM receivable) WHERE bad""", "receivable")
oracle("d10q_pnl_line_rules", """SELECT account_id, company_name, rule FROM (SELECT account_id, company_name, unnest(['buy amount is not quantity times price','sale amount is not quantity times price','profit is not sale less cost']) AS rule,
 unnest([k % 6 = 0 AND 50 > buy_qty * 0.005 + 0.02, k % 11 = 0 AND 90 > sale_qty * 0.005 + 0.02, buy_qty = sale_qty AND abs(sale_qty * 15 + CASE WHEN k % 11 = 0 THEN 90 ELSE 0 END - buy_qty * 12.5 - CASE WHEN k % 6 = 0 THEN 50 ELSE 0 END - profit) > 0.05]) AS bad FROM (SELECT *, CAST(profit / 10 AS BIGINT) AS k FROM pnl)) WHERE bad""", "pnl")
oracle("d11q_plan_rules", """SELECT movement_id, rule FROM (SELECT movement_id, unnest(['date outside the period','unknown kind','shares must be positive']) AS rule,
 unnest([move_date NOT BETWEEN DATE '1996-01-01' AND DATE '2000-12-31', kind = 'other' AND movement_id % 9 <> 0, movement_id % 9 = 0]) AS bad FROM moves) WHERE bad""", "moves")
oracle("d14q_table_counts", "SELECT 'transactions' AS table_name, count(*) AS rows FROM txn UNION ALL SELECT 'daily_prices', count(*) FROM px UNION ALL SELECT 'facts', count(*) FROM facts UNION ALL SELECT 'companies', count(*) FROM company UNION ALL SELECT 'cash_movements', count(*) FROM moves", "txn", "px", "facts", "company", "moves")
oracle("p11_line_classes", "SELECT *, kind AS line_class FROM moves", "moves")
oracle("p12_note_backfill", """SELECT txn_id, symbol, trade_date, CASE WHEN source = 'ledger' THEN 'ledger' WHEN record_date IS NOT NULL THEN 'dividend_report' WHEN source = 'statement' THEN 'statement' ELSE 'manual' END AS source, CASE WHEN source <> 'ledger' THEN record_date END AS record_date FROM txn""", "txn")
