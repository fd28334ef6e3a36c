"""Shared table expressions for the expected results, and output formatting.

The ledger is folded one event at a time by a recursive query here; the library
nets days first, so the two do not share a mistake.
"""
from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (needs, sql)


def statement(body: str, *needs: str) -> str:
    """``body`` preceded by the table expressions it needs, in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for n in CTES[name][0]:
            add(n)
        ordered.append(name)

    for n in needs:
        add(n)
    if not ordered:
        return body
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered)
    return f"WITH RECURSIVE {head}\n{body}"


def formatted(spec: str, body: str, *needs: str) -> str:
    """Select the columns of ``spec`` (see ``plans.present``) from ``body``."""
    cols = []
    for item in spec.split():
        name, _, kind = item.partition(":")
        if kind.isdigit():
            unit = f"1e{kind}"
            cols.append(f"floor(CAST({name} AS DOUBLE) * {unit} + 0.501) / {unit} AS {name}")
        else:
            sql_type = {"": "VARCHAR", "d": "VARCHAR", "i": "BIGINT", "b": "BOOLEAN"}[kind]
            cols.append(f"CAST({name} AS {sql_type}) AS {name}")
    return statement(f"SELECT {', '.join(cols)} FROM ({body}) AS answer", *needs)


def r2(x: str) -> str:
    return f"(floor(({x}) * 100 + 0.5) / 100)"


TXN = """
SELECT {account} AS account_id, 'S' || lpad(CAST(l_suppkey AS VARCHAR), CAST(greatest(6, length(CAST(l_suppkey AS VARCHAR))) AS INTEGER), '0') AS symbol,
  CAST(l_shipdate AS DATE) AS trade_date, txn_type,
  CASE WHEN txn_type <> 'dividend' THEN l_quantity END AS quantity,
  CASE WHEN txn_type IN ('buy','sell','rights') THEN floor(l_extendedprice / l_quantity * 10000 + 0.5) / 10000 END AS price_per_share,
  CASE WHEN txn_type = 'dividend' THEN floor(l_extendedprice * 0.05e0 * 100 + 0.5) / 100 END AS gross_amount,
  CASE WHEN txn_type IN ('buy','sell','rights') THEN floor(l_extendedprice * 0.004e0 * 100 + 0.5) / 100 ELSE 0e0 END AS commission,
  CASE WHEN txn_type = 'dividend' THEN floor(floor(l_extendedprice * 0.05e0 * 100 + 0.5) / 100 * l_tax * 100 + 0.5) / 100 ELSE 0e0 END AS tax_withheld,
  CASE l_linenumber % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'ledger' ELSE 'statement' END AS source,
  CASE WHEN txn_type = 'dividend' AND l_linenumber % 2 = 0 THEN CAST(l_shipdate AS DATE) - 30 END AS record_date,
  (l_orderkey::HUGEINT * 8 + l_linenumber) * 1000000000000 + l_partkey AS txn_id,
  CASE txn_type WHEN 'buy' THEN 0 WHEN 'rights' THEN 1 WHEN 'bonus' THEN 2 ELSE 3 END AS rnk
FROM (SELECT *, CASE WHEN l_returnflag = 'N' THEN 'buy' WHEN l_returnflag = 'R' THEN 'sell' WHEN l_linestatus = 'F' THEN 'dividend'
             WHEN l_linenumber % 2 = 1 THEN 'rights' ELSE 'bonus' END AS txn_type
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
"""
cte("txn", TXN.format(account="c_mktsegment"))
cte("ctxn", TXN.format(account="CAST(c_custkey AS VARCHAR)"))

PRICES = """
SELECT symbol, trade_date, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close,
  sum(l_quantity) AS volume, sum(cents) / 100 AS turnover, count(*) AS trade_count
FROM (SELECT {symbol} AS symbol, CAST(l_shipdate AS DATE) AS trade_date, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS p, l_quantity,
        CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS cents,
        row_number() OVER (PARTITION BY {symbol}, l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k
      FROM lineitem {join})
GROUP BY symbol, trade_date
"""
cte("stock_px", PRICES.format(symbol="'S' || lpad(CAST(l_suppkey AS VARCHAR), CAST(greatest(6, length(CAST(l_suppkey AS VARCHAR))) AS INTEGER), '0')", join=""))
cte("px", PRICES.format(symbol="'N' || lpad(CAST(s_nationkey AS VARCHAR), CAST(greatest(2, length(CAST(s_nationkey AS VARCHAR))) AS INTEGER), '0')", join="JOIN supplier ON l_suppkey = s_suppkey"))
cte("stock_quote", "SELECT symbol, max(trade_date) AS trade_date, arg_max(close, trade_date) AS close FROM stock_px GROUP BY symbol", "stock_px")
cte("quote", """
SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS ycp,
  max(high) OVER y AS yearly_high, min(low) OVER y AS yearly_low, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS back
FROM px WINDOW y AS (PARTITION BY symbol ORDER BY trade_date RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND CURRENT ROW)
""", "px")
cte("last_quote", "SELECT * FROM quote WHERE back = 1", "quote")

cte("ev", """
SELECT *, row_number() OVER (PARTITION BY account_id, symbol ORDER BY trade_date, rnk, txn_id) AS rn,
  coalesce(quantity, 0) AS x, coalesce(quantity, 0) * coalesce(price_per_share, 0) AS val
FROM txn
""", "txn")
cte("fold", """
SELECT account_id, symbol, CAST(0 AS BIGINT) AS rn, CAST(0 AS DOUBLE) AS q, CAST(0 AS DOUBLE) AS c, CAST(0 AS DOUBLE) AS sold, CAST(0 AS DOUBLE) AS gain, CAST(NULL AS DOUBLE) AS over_from
FROM (SELECT DISTINCT account_id, symbol FROM ev)
UNION ALL
SELECT e.account_id, e.symbol, e.rn,
  CASE WHEN txn_type IN ('buy','rights','bonus') THEN f.q + x WHEN txn_type = 'sell' THEN (CASE WHEN f.q - least(x, f.q) < 1e-9 THEN 0e0 ELSE f.q - least(x, f.q) END) ELSE f.q END,
  CASE WHEN txn_type IN ('buy','rights') THEN f.c + (val + commission)
       WHEN txn_type = 'sell' THEN (CASE WHEN f.q - least(x, f.q) < 1e-9 THEN 0e0 ELSE f.c - (f.c / f.q) * least(x, f.q) END) ELSE f.c END,
  CASE WHEN txn_type = 'sell' THEN least(x, f.q) ELSE 0e0 END,
  CASE WHEN txn_type = 'sell' THEN least(x, f.q) * price_per_share - commission - (CASE WHEN f.q > 0 THEN f.c / f.q * least(x, f.q) ELSE 0e0 END) ELSE 0e0 END,
  CASE WHEN txn_type = 'sell' AND x > f.q + 1e-9 THEN f.q END
FROM fold f JOIN ev e ON e.account_id = f.account_id AND e.symbol = f.symbol AND e.rn = f.rn + 1
""", "ev")
cte("steps", """
SELECT e.*, f.q, f.c, f.sold, f.gain, f.over_from,
  CASE WHEN txn_type IN ('buy','rights') THEN val + commission ELSE 0e0 END AS paid,
  CASE WHEN txn_type = 'sell' THEN f.sold * price_per_share - commission WHEN txn_type = 'dividend' THEN gross_amount - tax_withheld ELSE 0e0 END AS back_cash,
  CASE WHEN txn_type IN ('buy','rights') THEN -(val + commission) WHEN txn_type = 'sell' THEN val - commission WHEN txn_type = 'dividend' THEN gross_amount - tax_withheld ELSE 0e0 END AS cash
FROM ev e JOIN fold f USING (account_id, symbol, rn)
""", "fold")


def position_sql(steps: str, as_of: str) -> str:
    return f"""
SELECT account_id, symbol, arg_max(q, rn) AS quantity, arg_max(c, rn) AS cost_basis, sum(gain) AS realised_gain,
  sum(coalesce(gross_amount, 0)) AS dividends_gross, sum(coalesce(gross_amount, 0) - tax_withheld) AS dividends_net,
  sum(CASE WHEN trade_date >= DATE '{as_of}' - 365 THEN coalesce(gross_amount, 0) ELSE 0 END) AS dividends_ttm,
  sum(paid) AS invested, sum(back_cash) AS returned,
  min(trade_date) FILTER (txn_type <> 'dividend') AS first_trade, max(trade_date) FILTER (txn_type <> 'dividend') AS last_trade,
  count(over_from) AS warnings
FROM {steps} GROUP BY account_id, symbol"""


def valued_sql(src: str, extra: str = "") -> str:
    return f"""
SELECT *, market_value - cost_basis AS unrealised_gain, CASE WHEN cost_basis > 0 THEN (market_value - cost_basis) / cost_basis END AS unrealised_pct,
  CASE WHEN quantity > 0 THEN cost_basis / quantity END AS average_cost,
  CASE WHEN cost_basis > 0 AND dividends_ttm > 0 THEN dividends_ttm / cost_basis END AS yield_on_cost,
  invested - returned AS net_cost, CASE WHEN quantity > 0 THEN (invested - returned) / quantity END AS net_cost_per_share {extra}
FROM ({src})"""


AS_OF = "2001-09-30"
cte("pos", valued_sql(f"SELECT p.*, CASE WHEN p.quantity > 0 THEN p.quantity * k.close WHEN p.quantity = 0 THEN 0e0 END AS market_value FROM ({position_sql('steps', AS_OF)}) p LEFT JOIN stock_quote k USING (symbol)"), "steps", "stock_quote")
cte("held", valued_sql("""
SELECT symbol, CASE WHEN count(*) = 1 THEN 1 ELSE count(*) FILTER (quantity > 0 OR realised_gain <> 0) END AS account_count, sum(quantity) AS quantity,
 sum(cost_basis) AS cost_basis, sum(realised_gain) AS realised_gain, sum(dividends_gross) AS dividends_gross, sum(dividends_net) AS dividends_net,
 sum(dividends_ttm) AS dividends_ttm, sum(invested) AS invested, sum(returned) AS returned, sum(warnings) AS warnings,
 CASE WHEN count(market_value) = count(*) THEN sum(market_value) END AS market_value, min(first_trade) AS first_trade, max(last_trade) AS last_trade
FROM pos GROUP BY symbol"""), "pos")

cte("company", """
SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), CAST(greatest(2, length(CAST(n_nationkey AS VARCHAR))) AS INTEGER), '0') AS symbol, 'Nation ' || n_nationkey AS short_name, 'Nation ' || n_nationkey || ' Mills Limited' AS name,
  CASE WHEN n_nationkey % 8 <> 7 THEN list_aggregate(list_transform(string_split(r_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') END AS sector,
  CASE n_nationkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 6 ELSE 12 END AS fye_month, CASE n_nationkey % 3 WHEN 1 THEN 30 ELSE 31 END AS fye_day,
  n_nationkey % 6 <> 5 AS is_tracked, n_nationkey % 9 <> 8 AS is_active, 10e0 AS face_value, n_nationkey AS k
FROM nation JOIN region ON n_regionkey = r_regionkey
""")
cte("listing", """
SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(6, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0') AS symbol, c.symbol AS company, s_name AS name, c.sector
FROM supplier JOIN company c ON c.k = s_nationkey
""", "company")
cte("sold", """
SELECT c.symbol, c.k, c.fye_month, CAST(year(l_shipdate) + CASE WHEN month(l_shipdate) > c.fye_month THEN 1 ELSE 0 END AS BIGINT) AS fiscal_year,
  sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) / 100 AS revenue
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN company c ON c.k = s_nationkey GROUP BY ALL
""", "company")
cte("figs", """
SELECT *, net_operating_cash_flow / ((k + 1) * 10000) AS nocfps, net_profit / ((k + 1) * 10000) AS eps_basic,
  total_equity / ((k + 1) * 10000) * (CASE WHEN (k + fiscal_year) % 7 = 0 THEN 1.02e0 ELSE 1e0 END) AS navps,
  CASE WHEN (k + fiscal_year) % 3 <> 0 THEN abs(net_profit) * 0.4e0 / ((k + 1) * 10000) END AS dividend_per_share,
  total_assets - total_equity + (CASE WHEN (k + fiscal_year) % 13 = 0 THEN 5e6 ELSE 0e0 END) AS total_liabilities
FROM (SELECT *, net_profit * (0.7e0 + (fiscal_year % 4) * 0.2e0) AS net_operating_cash_flow
FROM (SELECT symbol, k, fye_month, fiscal_year, revenue, revenue * (0.3e0 + (fiscal_year % 5) * 0.02e0) AS gross_profit, revenue * (0.15e0 + (fiscal_year % 3) * 0.03e0) AS operating_profit,
  revenue * (0.08e0 + ((k + fiscal_year) % 4) * 0.02e0 - CASE WHEN (k + fiscal_year) % 11 = 0 THEN 0.2e0 ELSE 0e0 END) AS net_profit,
  revenue * 1.5e0 AS total_assets, revenue * (0.6e0 + (k % 4) * 0.05e0) AS total_equity, revenue * 0.5e0 AS current_assets,
  CASE WHEN k % 7 <> 3 THEN revenue * 0.25e0 END AS current_liabilities, CASE WHEN k % 5 <> 1 THEN revenue * 0.2e0 END AS long_term_borrowings,
  CASE WHEN k % 5 NOT IN (1, 2) THEN revenue * 0.1e0 END AS short_term_borrowings, revenue * 0.33e0 AS total_debt,
  CASE WHEN k % 6 <> 5 THEN revenue * -0.05e0 END AS capex
FROM sold WHERE (k * 3 + fiscal_year) % 17 <> 0))
""", "sold")
TAGS = ("revenue gross_profit operating_profit net_profit total_assets total_equity total_liabilities current_assets current_liabilities "
        "long_term_borrowings short_term_borrowings total_debt net_operating_cash_flow capex eps_basic navps nocfps dividend_per_share").split()
_UNITS = ("eps_basic", "navps", "nocfps", "dividend_per_share")
cte("facts", f"""
SELECT symbol, fiscal_year, tag, rev AS revision, (k + fiscal_year) % 5 <> 0 OR rev = 2 AS is_current,
  (CASE WHEN tag IN {_UNITS} THEN v ELSE v / 1e6 END) * (CASE WHEN (k + fiscal_year) % 5 = 0 AND rev = 1 THEN 0.9e0 ELSE 1e0 END) AS value_reported,
  CASE WHEN tag IN {_UNITS} THEN 'unit' ELSE 'million' END AS scale,
  CASE (k + fiscal_year + length(tag)) % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'disputed' ELSE 'unverified' END AS verification
FROM (SELECT symbol, fiscal_year, k, unnest({TAGS}) AS tag, unnest([{', '.join(TAGS)}]) AS v FROM figs) JOIN (VALUES (1), (2)) AS r(rev) ON rev = 1 OR (k + fiscal_year) % 5 = 0
WHERE v IS NOT NULL
""", "figs")
cte("base_facts", "SELECT *, value_reported * (CASE scale WHEN 'million' THEN 1e6 ELSE 1e0 END) AS value_base FROM facts WHERE is_current", "facts")
cte("wide", "SELECT symbol, fiscal_year, " + ", ".join(f"max(value_base) FILTER (tag = '{t}') AS {t}" for t in TAGS) + " FROM base_facts GROUP BY symbol, fiscal_year", "base_facts")

cte("act_all", """
SELECT 'N' || lpad(CAST(p_partkey % 25 AS VARCHAR), CAST(greatest(2, length(CAST(p_partkey % 25 AS VARCHAR))) AS INTEGER), '0') AS symbol,
  ['cash_dividend','stock_dividend','rights_issue','split','reverse_split'][p_size % 5 + 1] AS action_type,
  CASE WHEN p_partkey % 20 <> 7 THEN DATE '1995-06-01' + CAST((p_partkey * 37) % 2400 AS INTEGER) END AS ex_date,
  CASE WHEN p_size % 5 = 0 THEN (p_partkey % 9) * 5e0 END AS cash_pct, CASE WHEN p_size % 5 = 1 THEN (p_partkey % 4) * 1e0 END AS stock_pct,
  CASE WHEN p_size % 5 = 2 THEN 1e0 END AS rights_new, CASE WHEN p_size % 5 = 2 AND p_partkey % 6 <> 0 THEN 20e0 + p_partkey % 3 END AS rights_per,
  CASE WHEN p_size % 5 = 2 AND p_partkey % 2 = 0 THEN 30e0 END AS rights_price, CASE WHEN p_size % 5 = 2 AND p_partkey % 4 = 0 THEN 33e0 END AS cum_price,
  CASE p_size % 5 WHEN 3 THEN 50e0 WHEN 4 THEN 51e0 END AS split_from, CASE p_size % 5 WHEN 3 THEN 51e0 WHEN 4 THEN 50e0 END AS split_to, p_partkey AS action_id
FROM part
""")
cte("act", "SELECT * FROM act_all WHERE ex_date IS NULL UNION ALL SELECT * FROM act_all WHERE ex_date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, action_type, ex_date ORDER BY action_id) = 1", "act_all")
cte("factor", """
SELECT *, CASE action_type WHEN 'stock_dividend' THEN (CASE WHEN coalesce(stock_pct, 0) = 0 THEN 1e0 ELSE 1 / (1 + stock_pct / 100) END)
  WHEN 'rights_issue' THEN (CASE WHEN rights_new IS NULL OR rights_per IS NULL OR rights_new = 0 OR rights_per = 0 THEN 1e0
     WHEN rights_price IS NULL OR cum_price IS NULL OR cum_price <= 0 THEN rights_per / (rights_per + rights_new)
     ELSE (rights_per * cum_price + rights_new * rights_price) / (rights_per + rights_new) / cum_price END)
  WHEN 'split' THEN split_from / split_to WHEN 'reverse_split' THEN split_from / split_to ELSE 1e0 END AS f
FROM act
""", "act")
cte("ends", """
SELECT w.*, make_date(w.fiscal_year, c.fye_month, c.fye_day) AS period_end, c.fye_month, c.fye_day FROM wide w JOIN company c USING (symbol)
""", "wide", "company")
cte("adj_factor", """
SELECT e.symbol, e.fiscal_year, e.period_end, coalesce(product(f.f), 1) AS factor FROM ends e LEFT JOIN factor f ON f.symbol = e.symbol AND f.ex_date > e.period_end GROUP BY ALL
""", "ends", "factor")
cte("adj", "SELECT w.* REPLACE (" + ", ".join(f"w.{t} * a.factor AS {t}" for t in _UNITS) + ") FROM wide w JOIN adj_factor a USING (symbol, fiscal_year)", "wide", "adj_factor")

cte("snap_m", """
SELECT account_id, last_day(trade_date) AS as_of, sum(CASE WHEN txn_type IN ('buy','rights') THEN floor(quantity * price_per_share * 100 + 0.5) ELSE 0 END) AS b,
  sum(CASE WHEN txn_type = 'sell' THEN floor(quantity * price_per_share * 100 + 0.5) ELSE 0 END) AS s,
  sum(CASE WHEN txn_type = 'dividend' THEN floor((gross_amount - tax_withheld) * 100 + 0.5) ELSE 0 END) AS d FROM txn GROUP BY ALL
""", "txn")
cte("snap", """
SELECT account_id, as_of, b * (0.9e0 + (month(as_of) % 7) * 0.03e0) - s * 0.5e0 AS market_value,
 CASE WHEN account_id <> 'MACHINERY' THEN b * 0.8e0 - s * 0.4e0 END AS cost_of_holdings, b * 0.1e0 + d AS cash_balance, b AS deposit,
 CASE WHEN year(as_of) > 1997 THEN 5000e0 ELSE 0e0 END AS share_transfer_in, s * 0.5e0 AS withdraw, CASE WHEN year(as_of) > 1999 THEN 2500e0 ELSE 0e0 END AS share_transfer_out,
 d AS cash_dividend, s * 0.1e0 AS realised_gain, b * 0.02e0 AS ipo_payment, b * 0.02e0 - (CASE WHEN month(as_of) % 4 = 0 THEN 1000e0 ELSE 0e0 END) AS ipo_refund
FROM (SELECT account_id, as_of, sum(b) OVER w / 100 AS b, sum(s) OVER w / 100 AS s, sum(d) OVER w / 100 AS d FROM snap_m WINDOW w AS (PARTITION BY account_id ORDER BY as_of))
""", "snap_m")
cte("moves", f"""
SELECT account_id, move_date, kind, movement_id, CASE kind WHEN 'deposit' THEN t WHEN 'withdrawal' THEN -{r2('t * 0.6e0')} WHEN 'fee' THEN -{r2('t * 0.001e0')} WHEN 'dividend' THEN {r2('t * 0.02e0')} ELSE -{r2('t * 0.01e0')} END AS amount
FROM (SELECT c_mktsegment AS account_id, CAST(o_orderdate AS DATE) AS move_date, o_orderkey AS movement_id, o_totalprice AS t,
 CASE o_orderpriority[1] WHEN '1' THEN 'deposit' WHEN '2' THEN 'withdrawal' WHEN '3' THEN 'fee' WHEN '4' THEN 'dividend' ELSE CASE o_orderstatus WHEN 'F' THEN 'ipo' ELSE 'other' END END AS kind
 FROM orders JOIN customer ON o_custkey = c_custkey)
""")
cte("target", """
SELECT s_suppkey AS target_id, symbol, CASE WHEN s_suppkey % 2 = 1 THEN ['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'][s_suppkey % 5 + 1] END AS account_id,
 CASE WHEN s_suppkey % 7 <> 0 THEN lo + (hi - lo) * 0.3e0 END AS buy_below, CASE WHEN s_suppkey % 11 <> 0 THEN lo + (hi - lo) * 0.7e0 END AS sell_above
FROM supplier JOIN (SELECT symbol, min(close) AS lo, max(close) AS hi FROM stock_px GROUP BY symbol) ON symbol = 'S' || lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(6, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0')
""", "stock_px")
cte("imports", """
SELECT account_id, period_from, CAST(period_from + INTERVAL 3 MONTH AS DATE) - 1 AS period_to, CASE WHEN n = 1 AND account_id <> 'FURNITURE' THEN 0e0 ELSE 100e0 * n END AS opening_balance
FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY period_from) AS n FROM (SELECT DISTINCT account_id, CAST(date_trunc('quarter', move_date) AS DATE) AS period_from FROM moves))
WHERE NOT (account_id = 'BUILDING' AND year(period_from) = 2000 AND quarter(period_from) = 2)
""", "moves")
