from .base import AS_OF, cte, r2
from .registry import oracle

WORTH = "market_value + cash_balance"
NET = "deposit + share_transfer_in - withdraw - share_transfer_out"
cte("last_snap", "SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY as_of DESC) = 1", "snap")
oracle("a18_lifetime_returns", f"""SELECT *, worth - money_in AS gain, CASE WHEN money_in > 0 THEN (worth - money_in) / money_in END AS total_return, worth - money_in - (realised + dividends + unrealised) AS unexplained
 FROM (SELECT account_id, as_of, {NET} AS money_in, {WORTH} AS worth, realised_gain AS realised, cash_dividend AS dividends, market_value - cost_of_holdings AS unrealised FROM last_snap)""", "last_snap")
oracle("a19_combined_accounts", f"""SELECT *, deposited - withdrawn AS net_invested, equity - (deposited - withdrawn) AS gain, (equity - (deposited - withdrawn)) / (deposited - withdrawn) AS total_return, missing = 0 AS known FROM (
 SELECT count(as_of) AS accounts, count(*) - count(as_of) AS missing, sum(cash_balance) AS cash, min(as_of) AS cash_as_of, sum(deposit + share_transfer_in) AS deposited, sum(withdraw + share_transfer_out) AS withdrawn, sum({WORTH}) AS equity
 FROM (SELECT DISTINCT c_mktsegment AS account_id FROM customer) LEFT JOIN last_snap USING (account_id))""", "last_snap")
PREV = "lag({x}) OVER (PARTITION BY account_id ORDER BY as_of)"
DELTA = ", ".join(r2(f"{x} - lag({x}) OVER o") + f" AS {n}" for x, n in [("deposit", "deposited"), ("withdraw", "withdrawn"), ("cash_dividend", "dividends"), ("share_transfer_in", "transferred_in"), ("share_transfer_out", "transferred_out")])
cte("snap_moves", f"""SELECT * FROM (SELECT account_id, lag(as_of) OVER o AS from_date, as_of AS to_date, {DELTA}, {r2('ipo_refund - ipo_payment - lag(ipo_refund - ipo_payment) OVER o')} AS ipo_net
 FROM snap WINDOW o AS (PARTITION BY account_id ORDER BY as_of)) WHERE from_date IS NOT NULL AND greatest(abs(deposited), abs(withdrawn), abs(dividends), abs(transferred_in), abs(transferred_out), abs(ipo_net)) >= 0.005""", "snap")
oracle("w08_snapshot_movements", "SELECT * FROM snap_moves", "snap_moves")
oracle("a34_undated_movements", "SELECT * FROM snap_moves WHERE account_id = 'HOUSEHOLD'", "snap_moves")
cte("period", f"""SELECT account_id, from_date, to_date, flow, CASE WHEN v0 + 0.5 * flow > 0 THEN (v1 - v0 - flow) / (v0 + 0.5 * flow) END AS return FROM (
 SELECT account_id, lag(as_of) OVER o AS from_date, as_of AS to_date, {WORTH} AS v1, lag({WORTH}) OVER o AS v0, ({NET}) - lag({NET}) OVER o AS flow FROM snap WINDOW o AS (PARTITION BY account_id ORDER BY as_of)) WHERE from_date IS NOT NULL""", "snap")
oracle("w10_p10_period_returns", "SELECT * FROM period", "period")
oracle("w11_yearly_returns", """SELECT *, from_date <= make_date(year, 1, 7) AND to_date >= make_date(year, 12, 24) AS complete FROM (
 SELECT account_id, year(to_date) AS year, product(1 + return) - 1 AS return, min(from_date) AS from_date, max(to_date) AS to_date FROM period WHERE return IS NOT NULL GROUP BY ALL)""", "period")
oracle("w12_return_since_first", """SELECT account_id, min(from_date) AS from_date, max(to_date) AS to_date, max(to_date) - min(from_date) AS days, product(1 + coalesce(return, 0)) - 1 AS return FROM period GROUP BY account_id""", "period")

# Newton's method from 10 %, one step per recursion, on flows netted by day.
XIRR = """
SELECT {key}, rate FROM (WITH RECURSIVE f AS MATERIALIZED (SELECT {key}, d, sum(a) AS a, CAST(d - min(min(d)) OVER (PARTITION BY {key}) AS DOUBLE) / 365 AS y FROM ({flows}) GROUP BY {key}, d),
it AS (SELECT DISTINCT {key}, 0 AS i, 0.1e0 AS rate, 1e9 AS move FROM f
 UNION ALL SELECT it.{key}, any_value(it.i) + 1, any_value(it.rate) - sum(f.a * pow(1 + it.rate, -f.y)) / sum(-f.y * f.a * pow(1 + it.rate, -f.y - 1)),
  abs(sum(f.a * pow(1 + it.rate, -f.y)) / sum(-f.y * f.a * pow(1 + it.rate, -f.y - 1)))
  FROM it JOIN f ON f.{key} = it.{key} WHERE it.i < 60 AND it.move >= 1e-9 AND it.rate > -0.9999 GROUP BY it.{key})
SELECT {key}, arg_max(rate, i) AS rate, arg_max(move, i) AS move FROM it GROUP BY {key}) WHERE move < 1e-9"""


def returns_sql(key: str, flows: str, worth: str, first: str) -> str:
    closing = f"SELECT {key}, d, a FROM ({flows}) WHERE a <> 0 UNION ALL SELECT {key}, d, a FROM ({worth}) WHERE a > 0"
    return f"""SELECT b.{key}, first_flow, days, CASE WHEN days >= 365 THEN x.rate END AS rate FROM ({first}) b LEFT JOIN ({XIRR.format(key=key, flows=closing)}) x USING ({key})"""


ACC_FLOWS = "SELECT account_id, trade_date AS d, cash AS a FROM steps"
oracle("w23_xirr_by_account", returns_sql("account_id", ACC_FLOWS, f"SELECT account_id, DATE '{AS_OF}' AS d, sum(coalesce(market_value, 0)) AS a FROM pos GROUP BY account_id",
       f"SELECT account_id, min(trade_date) AS first_flow, DATE '{AS_OF}' - min(trade_date) AS days FROM steps WHERE cash <> 0 GROUP BY account_id"), "steps", "pos")
oracle("w23_xirr_portfolio", returns_sql("scope", "SELECT 'all' AS scope, trade_date AS d, cash AS a FROM steps", f"SELECT 'all' AS scope, DATE '{AS_OF}' AS d, sum(coalesce(market_value, 0)) AS a FROM pos",
       f"SELECT 'all' AS scope, min(trade_date) AS first_flow, DATE '{AS_OF}' - min(trade_date) AS days FROM steps WHERE cash <> 0"), "steps", "pos")
EXT = "SELECT account_id, move_date AS d, -amount AS a FROM moves WHERE kind IN ('deposit','withdrawal')"
oracle("w23_account_money_weighted", f"""SELECT account_id, s.as_of, b.first_flow AS first_date, s.as_of - b.first_flow AS days, CASE WHEN s.as_of - b.first_flow >= 365 THEN x.rate END AS rate FROM last_snap s
 LEFT JOIN (SELECT account_id, min(d) AS first_flow FROM ({EXT}) GROUP BY 1) b USING (account_id)
 LEFT JOIN ({XIRR.format(key='account_id', flows=EXT + f' UNION ALL SELECT account_id, as_of AS d, {WORTH} AS a FROM last_snap')}) x USING (account_id)""", "last_snap", "moves")
oracle("a20_cash_overview", f"""SELECT s.account_id, as_of, cash_balance AS cash, {WORTH} AS worth, deposit + share_transfer_in AS deposited, withdraw + share_transfer_out AS withdrawn, {NET} AS net_invested, cash_dividend AS dividends,
 greatest(0, ipo_payment - ipo_refund) AS ipo_pending, (SELECT count(*) FROM txn x WHERE x.account_id = s.account_id AND x.trade_date > s.as_of AND txn_type <> 'bonus') AS later_trades, true AS dated
 FROM (SELECT * FROM snap WHERE as_of < DATE '2001-06-01' QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY as_of DESC) = 1) s""", "snap", "txn")
oracle("a20_investing_costs", """SELECT *, commission + fees + dividend_tax AS total_cost FROM (SELECT account_id, sum(commission) AS commission, coalesce(sum(tax_withheld) FILTER (txn_type = 'dividend'), 0) AS dividend_tax FROM txn GROUP BY 1)
 JOIN (SELECT account_id, -sum(amount) FILTER (kind = 'fee') AS fees FROM moves GROUP BY 1) USING (account_id)""", "txn", "moves")
IY = "year({d}) - CASE WHEN month({d}) < 7 THEN 1 ELSE 0 END"
oracle("a21_d6_income_year_lines", f"""SELECT account_id, year, coalesce(dividend_gross, 0) AS dividend_gross, coalesce(dividend_tax, 0) AS dividend_tax, coalesce(dividend_gross - dividend_tax, 0) AS dividend_net, coalesce(sales, 0) AS sales, coalesce(realised, 0) AS realised, coalesce(commission, 0) AS commission,
 coalesce(deposited, 0) AS deposited, coalesce(withdrawn, 0) AS withdrawn, coalesce(fees, 0) AS fees FROM (SELECT account_id, {IY.format(d='trade_date')} AS year, sum(gross_amount) AS dividend_gross, sum(tax_withheld) FILTER (txn_type = 'dividend') AS dividend_tax,
 count(*) FILTER (txn_type = 'sell') AS sales, sum(gain) AS realised, sum(commission) FILTER (txn_type IN ('buy','sell','rights')) AS commission FROM steps GROUP BY ALL)
 FULL JOIN (SELECT account_id, {IY.format(d='move_date')} AS year, sum(amount) FILTER (kind = 'deposit') AS deposited, abs(sum(amount) FILTER (kind = 'withdrawal')) AS withdrawn, abs(sum(amount) FILTER (kind = 'fee')) AS fees FROM moves GROUP BY ALL) USING (account_id, year)""", "steps", "moves")
cte("year_end", """SELECT account_id, symbol, y AS year, make_date(y + 1, 6, 30) AS year_end, arg_max(q, rn) AS quantity, arg_max(c, rn) AS cost_basis FROM steps JOIN (SELECT unnest(range(1994, 2002)) AS y) ON trade_date <= make_date(y + 1, 6, 30) GROUP BY ALL HAVING arg_max(q, rn) > 0""", "steps")
oracle("a21_held_at_year_ends", "SELECT *, cost_basis / quantity AS average_cost FROM year_end", "year_end")
oracle("a22_year_end_values", "SELECT y.account_id, y.symbol, y.year, y.quantity, p.close, y.quantity * p.close AS value FROM year_end y ASOF LEFT JOIN stock_px p ON p.symbol = y.symbol AND p.trade_date <= y.year_end", "year_end", "stock_px")
cte("reach", """SELECT account_id, start, CASE WHEN start IS NOT NULL THEN (SELECT max(period_to) FROM imports i WHERE i.account_id = s.account_id AND period_from < coalesce(s.gap_at, DATE '2100-01-01')) END AS reach, first_from, last_to FROM (
 SELECT account_id, min(period_from) FILTER (abs(opening_balance) <= 0.005) AS start, min(period_from) FILTER (period_from > prev + 1) AS gap_at, min(period_from) AS first_from, max(period_to) AS last_to
 FROM (SELECT *, max(period_to) OVER (PARTITION BY account_id ORDER BY period_from ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM imports) GROUP BY account_id) s""", "imports")
oracle("w17_ledger_coverage", "SELECT *, coalesce(reach >= DATE '2001-06-30', false) AS complete FROM reach", "reach")
oracle("a21_cash_at_year_ends", """SELECT account_id, year, coalesce(reach >= make_date(year + 1, 6, 30), false) AS known, CASE WHEN reach >= make_date(year + 1, 6, 30) THEN cash END AS cash_at_end FROM (
 SELECT account_id, y AS year, sum(cash) AS cash FROM (SELECT account_id, trade_date AS d, cash FROM steps WHERE txn_type IN ('buy','sell','rights') UNION ALL SELECT account_id, move_date, amount FROM moves)
 JOIN (SELECT unnest(range(1994, 2002)) AS y) ON d <= make_date(y + 1, 6, 30) GROUP BY ALL) LEFT JOIN reach USING (account_id)""", "steps", "moves", "reach")
