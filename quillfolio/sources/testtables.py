"""Adapters: the domain's tables, derived from the shared star-schema test tables.

The test tables hold no finance data, so each domain table is a fixed rule over
them (listed in README).  Money is made in whole cents, so sums agree whatever
order they are added in.  All tables grow with the data they derive from.
"""
from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.dates import fiscal_year_end, fiscal_year_of, fiscal_year_start
from ..functions.numeric import round_half_up

CURRENCY_TAGS = [
    "revenue", "gross_profit", "operating_profit", "net_profit", "total_assets", "total_equity",
    "total_liabilities", "current_assets", "current_liabilities", "long_term_borrowings",
    "short_term_borrowings", "total_debt", "net_operating_cash_flow", "capex",
]
PER_SHARE_TAGS = ["eps_basic", "navps", "nocfps", "dividend_per_share"]
TAGS = CURRENCY_TAGS + PER_SHARE_TAGS


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(key: Column, width: int) -> Column:
    """A number with zeros in front up to a width; longer ones stay whole."""
    return F.lpad(key.cast("string"), F.greatest(F.lit(width), F.length(key.cast("string"))), F.lit("0"))


def key_of(symbol: str) -> Column:
    """The number behind a symbol's letter."""
    return F.expr(f"substring({symbol}, 2)").cast("long")


def _code(prefix: str, key: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), padded(key, width))


def supplier_code(key: Column) -> Column:
    return _code("S", key, 6)


def nation_code(key: Column) -> Column:
    return _code("N", key, 2)


def _row_id() -> Column:
    """A number ordered by order, line and part: order and line, then twelve digits of the part."""
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return (line.cast("decimal(19,0)") * F.lit(Decimal(10**12)) + F.col("l_partkey").cast("decimal(19,0)")).cast("decimal(38,0)")


def _price() -> Column:
    return F.col("l_extendedprice") / F.col("l_quantity")


def _cents(value: Column) -> Column:
    return F.floor(value * 100 + F.lit(0.5)).cast("long")


class TestTables:
    """The domain's tables over one directory of test tables."""

    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return _table(self.spark, self.sf_dir, name)

    # -- ledger ---------------------------------------------------------------

    def transactions(self, account: str = "c_mktsegment") -> DataFrame:
        # Orders meet their customers first: the order lines, by far the most rows, are then dealt once.
        owned = self.raw("orders").select("o_orderkey", "o_custkey").join(
            self.raw("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")
        )
        joined = self.raw("lineitem").join(owned.select("o_orderkey", account), F.col("l_orderkey") == F.col("o_orderkey"))
        flag, status, odd = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber") % 2 == 1
        kind = (
            F.when(flag == "N", "buy").when(flag == "R", "sell").when(status == "F", "dividend")
            .when(odd, "rights").otherwise("bonus")
        )
        dividend = F.col("txn_type") == "dividend"
        priced = F.col("txn_type").isin("buy", "sell", "rights")
        gross = round_half_up(F.col("l_extendedprice") * 0.05)
        return (
            joined.withColumn("txn_type", kind)
            .withColumn("gross_amount", F.when(dividend, gross))
            .select(
                F.col(account).cast("string").alias("account_id"),
                supplier_code(F.col("l_suppkey")).alias("symbol"),
                F.to_date("l_shipdate").alias("trade_date"),
                "txn_type",
                F.when(~dividend, F.col("l_quantity")).alias("quantity"),
                F.when(priced, round_half_up(_price(), 4)).alias("price_per_share"),
                "gross_amount",
                F.when(priced, round_half_up(F.col("l_extendedprice") * 0.004)).otherwise(F.lit(0.0)).alias("commission"),
                F.when(dividend, round_half_up(F.col("gross_amount") * F.col("l_tax"))).otherwise(F.lit(0.0)).alias("tax_withheld"),
                F.when(F.col("l_linenumber") % 3 == 0, "manual").when(F.col("l_linenumber") % 3 == 1, "ledger").otherwise("statement").alias("source"),
                F.when(dividend & ~odd, F.date_sub(F.to_date("l_shipdate"), 30)).alias("record_date"),
                _row_id().alias("txn_id"),
            )
        )

    # -- prices ---------------------------------------------------------------

    def _prices(self, rows: DataFrame) -> DataFrame:
        # One number that orders a day's rows: fixed width, so that the aggregation can hash.
        at = "_at"
        order = _row_id() * F.lit(Decimal(10**11)) + F.col("l_suppkey")
        return (
            rows.withColumn("_at", order).withColumn("_p", round_half_up(_price()))
            .groupBy("symbol", F.to_date("l_shipdate").alias("trade_date"))
            .agg(
                F.min_by("_p", at).alias("open"),
                F.max("_p").alias("high"),
                F.min("_p").alias("low"),
                F.max_by("_p", at).alias("close"),
                F.sum("l_quantity").alias("volume"),
                (F.sum(_cents(F.col("l_extendedprice"))) / 100).alias("turnover"),
                F.count(F.lit(1)).alias("trade_count"),
            )
        )

    def stock_prices(self) -> DataFrame:
        """Daily prices per supplier: the symbols of the ledger."""
        return self._prices(self.raw("lineitem").withColumn("symbol", supplier_code(F.col("l_suppkey"))))

    def daily_prices(self) -> DataFrame:
        """Daily prices per nation: the symbols of the companies."""
        listed = self.raw("supplier").select("s_suppkey", nation_code(F.col("s_nationkey")).alias("symbol"))
        return self._prices(self.raw("lineitem").join(listed, F.col("l_suppkey") == F.col("s_suppkey")))

    # -- companies and figures ------------------------------------------------

    def companies(self) -> DataFrame:
        k = F.col("n_nationkey")
        return (
            self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                nation_code(k).alias("symbol"),
                F.initcap(F.replace(F.col("n_name"), F.lit("_"), F.lit(" "))).alias("short_name"),
                F.concat(F.initcap(F.replace(F.col("n_name"), F.lit("_"), F.lit(" "))), F.lit(" Mills Limited")).alias("name"),
                F.when(k % 8 != 7, F.initcap("r_name")).alias("sector"),
                F.when(k % 3 == 0, 3).when(k % 3 == 1, 6).otherwise(12).alias("fye_month"),
                F.when(k % 3 == 1, 30).otherwise(31).alias("fye_day"),
                (k % 6 != 5).alias("is_tracked"),
                (k % 9 != 8).alias("is_active"),
                F.lit(10.0).alias("face_value"),
                F.when(k % 4 == 0, "bank").otherwise("general").alias("statement_template"),
                F.when(k % 2 == 0, F.array(F.concat(F.lit("A"), k.cast("string")))).otherwise(F.array().cast("array<string>")).alias("alt_symbols"),
            )
        )

    def listings(self) -> DataFrame:
        """Ledger symbols with the company behind each and its sector."""
        return (
            self.raw("supplier").join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                supplier_code(F.col("s_suppkey")).alias("symbol"),
                nation_code(F.col("s_nationkey")).alias("company"),
                F.col("s_name").alias("name"),
                F.when(F.col("n_nationkey") % 8 != 7, F.initcap("r_name")).alias("sector"),
            )
        )

    def _sold(self) -> DataFrame:
        """Sales of each company by fiscal year."""
        company = self.companies().select("symbol", "fye_month", "fye_day")
        return (
            self.raw("lineitem")
            .join(self.raw("supplier").select("s_suppkey", nation_code(F.col("s_nationkey")).alias("symbol")), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(company, "symbol")
            .groupBy("symbol", fiscal_year_of(F.col("fye_month"), F.col("fye_day"), F.to_date("l_shipdate")).alias("fiscal_year"))
            .agg(F.sum(_cents(F.col("l_extendedprice"))).alias("cents"))
            .withColumn("k", key_of("symbol").cast("int"))
        )

    def periods(self) -> DataFrame:
        """Annual periods: consolidated ones of every fiscal year with sales, standalone ones (without figures) of some."""
        fy, k = F.col("fiscal_year"), F.col("k")
        bases = F.when((k + fy) % 4 == 0, F.array(F.lit("consolidated"), F.lit("standalone"))).otherwise(F.array(F.lit("consolidated")))
        return self._sold().join(self.companies().select("symbol", "fye_month", "fye_day"), "symbol").select(
            "symbol", "fiscal_year", F.explode(bases).alias("basis"), fiscal_year_start(F.col("fye_month"), F.col("fye_day"), fy).alias("period_start"),
            fiscal_year_end(F.col("fye_month"), F.col("fye_day"), fy).alias("period_end"), ((k + fy) % 3 != 0).alias("is_complete"),
        )

    def source_documents(self) -> DataFrame:
        """Papers of each company by the fiscal year that they report on."""
        d = F.col("doc_id")
        return self.raw("documents").select(
            "doc_id", nation_code(d % 25).alias("symbol"), (F.lit(1992) + d % 8).cast("int").alias("fiscal_year"), "source", F.md5("text").alias("title"),
        )

    def figures(self) -> DataFrame:
        """Reported figures, one wide row per (company, fiscal year)."""
        sold = self._sold().filter((F.col("k") * 3 + F.col("fiscal_year")) % 17 != 0)
        fy, kk, rev, profit = F.col("fiscal_year"), F.col("k"), F.col("revenue"), F.col("net_profit")
        shares = (kk + 1) * 10000
        return (
            sold.withColumn("revenue", F.col("cents") / 100)
            .withColumn("gross_profit", rev * (0.30 + (fy % 5) * 0.02))
            .withColumn("operating_profit", rev * (0.15 + (fy % 3) * 0.03))
            .withColumn("net_profit", rev * (0.08 + ((kk + fy) % 4) * 0.02 - F.when((kk + fy) % 11 == 0, 0.20).otherwise(0.0)))
            .withColumn("total_assets", rev * 1.5)
            .withColumn("total_equity", rev * (0.6 + (kk % 4) * 0.05))
            .withColumn("total_liabilities", F.col("total_assets") - F.col("total_equity") + F.when((kk + fy) % 13 == 0, 5e6).otherwise(0.0))
            .withColumn("current_assets", rev * 0.5)
            .withColumn("current_liabilities", F.when(kk % 7 != 3, rev * 0.25))
            .withColumn("long_term_borrowings", F.when(kk % 5 != 1, rev * 0.2))
            .withColumn("short_term_borrowings", F.when(~(kk % 5).isin(1, 2), rev * 0.1))
            .withColumn("total_debt", rev * 0.33)
            .withColumn("net_operating_cash_flow", profit * (0.7 + (fy % 4) * 0.2))
            .withColumn("capex", F.when(kk % 6 != 5, rev * -0.05))
            .withColumn("eps_basic", profit / shares)
            .withColumn("navps", F.col("total_equity") / shares * F.when((kk + fy) % 7 == 0, 1.02).otherwise(1.0))
            .withColumn("nocfps", F.col("net_operating_cash_flow") / shares)
            .withColumn("dividend_per_share", F.when((kk + fy) % 3 != 0, F.abs(profit) * 0.4 / shares))
            .select("symbol", "fiscal_year", "k", *TAGS)
        )

    def facts(self) -> DataFrame:
        """Long figures with revisions, scales and verification states."""
        pairs = ", ".join(f"'{t}', {t}" for t in TAGS)
        long = self.figures().select("symbol", "fiscal_year", "k", F.expr(f"stack({len(TAGS)}, {pairs}) as (tag, value)")).filter("value is not null")
        mark = (F.col("k") + F.col("fiscal_year") + F.length("tag")) % 4
        scale = F.when(F.col("tag").isin(CURRENCY_TAGS), "million").otherwise("unit")
        reported = F.when(F.col("tag").isin(CURRENCY_TAGS), F.col("value") / 1e6).otherwise(F.col("value"))
        revised = (F.col("k") + F.col("fiscal_year")) % 5 == 0
        rows = long.withColumn("_rev", F.explode(F.when(revised, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
        current = ~revised | (F.col("_rev") == 2)
        return rows.select(
            "symbol", "fiscal_year", "tag", F.col("_rev").alias("revision"), current.alias("is_current"),
            F.when(current, reported).otherwise(reported * 0.9).alias("value_reported"), scale.alias("scale"),
            F.when(mark == 0, "verified").when(mark == 1, "disputed").otherwise("unverified").alias("verification"),
        )

    def corporate_actions(self) -> DataFrame:
        """One action per (company, type, ex date); all kinds, some undated."""
        p, s = F.col("p_partkey"), F.col("p_size") % 5
        rows = self.raw("part").select(
            nation_code(p % 25).alias("symbol"),
            F.when(s == 0, "cash_dividend").when(s == 1, "stock_dividend").when(s == 2, "rights_issue").when(s == 3, "split").otherwise("reverse_split").alias("action_type"),
            F.when(p % 20 != 7, F.date_add(F.lit("1995-06-01").cast("date"), ((p * 37) % 2400).cast("int"))).alias("ex_date"),
            F.when(s == 0, (p % 9) * 5.0).alias("cash_pct"),
            F.when(s == 1, (p % 4) * 1.0).alias("stock_pct"),
            F.when(s == 2, 1.0).alias("rights_new"),
            F.when((s == 2) & (p % 6 != 0), 20.0 + p % 3).alias("rights_per"),
            F.when((s == 2) & (p % 2 == 0), 30.0).alias("rights_price"),
            F.when((s == 2) & (p % 4 == 0), 33.0).alias("cum_price"),
            F.when(s >= 3, F.when(s == 3, 50.0).otherwise(51.0)).alias("split_from"),
            F.when(s >= 3, F.when(s == 3, 51.0).otherwise(50.0)).alias("split_to"),
            p.alias("action_id"),
        )
        dated = rows.filter("ex_date is not null")
        kept = dated.groupBy("symbol", "action_type", "ex_date").agg(F.min_by(F.struct(*rows.columns), "action_id").alias("r")).select("r.*")
        return kept.unionByName(rows.filter("ex_date is null"))

    # -- accounts -------------------------------------------------------------

    def snapshots(self) -> DataFrame:
        """Month-end account statements with lifetime totals, from the ledger's months."""
        kind, value = F.col("txn_type"), _cents(F.col("quantity") * F.col("price_per_share"))
        months = self.transactions().groupBy("account_id", F.last_day("trade_date").alias("as_of")).agg(
            F.coalesce(F.sum(F.when(kind.isin("buy", "rights"), value)), F.lit(0)).alias("b"),
            F.coalesce(F.sum(F.when(kind == "sell", value)), F.lit(0)).alias("s"),
            F.coalesce(F.sum(F.when(kind == "dividend", _cents(F.col("gross_amount") - F.col("tax_withheld")))), F.lit(0)).alias("d"),
        )
        w = W.partitionBy("account_id").orderBy("as_of").rowsBetween(W.unboundedPreceding, W.currentRow)
        run = months.select("account_id", "as_of", *[F.sum(c).over(w).alias(c) for c in "bsd"])
        b, s, d, m = F.col("b") / 100, F.col("s") / 100, F.col("d") / 100, F.month("as_of")
        return run.select(
            "account_id", "as_of",
            (b * (0.9 + (m % 7) * 0.03) - s * 0.5).alias("market_value"),
            F.when(F.col("account_id") != "MACHINERY", b * 0.8 - s * 0.4).alias("cost_of_holdings"),
            (b * 0.1 + d).alias("cash_balance"),
            b.alias("deposit"),
            F.when(F.year("as_of") > 1997, 5000.0).otherwise(0.0).alias("share_transfer_in"),
            (s * 0.5).alias("withdraw"),
            F.when(F.year("as_of") > 1999, 2500.0).otherwise(0.0).alias("share_transfer_out"),
            d.alias("cash_dividend"),
            (s * 0.1).alias("realised_gain"),
            (b * 0.02).alias("ipo_payment"),
            (b * 0.02 - F.when(m % 4 == 0, 1000.0).otherwise(0.0)).alias("ipo_refund"),
        )

    def cash_movements(self, account: str = "c_mktsegment") -> DataFrame:
        """Dated money in and out of each account, signed as the account sees it."""
        p = F.substring("o_orderpriority", 1, 1)
        kind = (
            F.when(p == "1", "deposit").when(p == "2", "withdrawal").when(p == "3", "fee")
            .when(p == "4", "dividend").when(F.col("o_orderstatus") == "F", "ipo").otherwise("other")
        )
        amount = (
            F.when(F.col("kind") == "deposit", F.col("o_totalprice"))
            .when(F.col("kind") == "withdrawal", -round_half_up(F.col("o_totalprice") * 0.6))
            .when(F.col("kind") == "fee", -round_half_up(F.col("o_totalprice") * 0.001))
            .when(F.col("kind") == "dividend", round_half_up(F.col("o_totalprice") * 0.02))
            .otherwise(-round_half_up(F.col("o_totalprice") * 0.01))
        )
        return (
            self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .withColumn("kind", kind)
            .select(
                F.col(account).cast("string").alias("account_id"), F.to_date("o_orderdate").alias("move_date"), "kind",
                amount.alias("amount"), F.col("o_orderkey").alias("movement_id"),
            )
        )

    def targets(self) -> DataFrame:
        """Price targets on ledger symbols; half for one account, half for any."""
        span = self.stock_prices().groupBy("symbol").agg(F.min("close").alias("lo"), F.max("close").alias("hi"))
        k = F.col("s_suppkey")
        segment = F.element_at(F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")]), (k % 5 + 1).cast("int"))
        return (
            self.raw("supplier").withColumn("symbol", supplier_code(k)).join(span, "symbol")
            .select(
                k.alias("target_id"), "symbol",
                F.when(k % 2 == 1, segment).alias("account_id"),
                F.when(k % 7 != 0, F.col("lo") + (F.col("hi") - F.col("lo")) * 0.3).alias("buy_below"),
                F.when(k % 11 != 0, F.col("lo") + (F.col("hi") - F.col("lo")) * 0.7).alias("sell_above"),
            )
        )

    def ledger_imports(self) -> DataFrame:
        """Statement periods imported per account: by quarter, with gaps in some years."""
        m = self.cash_movements().select("account_id", F.trunc("move_date", "quarter").alias("period_from")).distinct()
        first = W.partitionBy("account_id").orderBy("period_from")
        n = F.row_number().over(first)
        gap = (F.year("period_from") == 2000) & (F.quarter("period_from") == 2) & (F.col("account_id") == "BUILDING")
        return (
            m.select("account_id", "period_from", F.date_sub(F.add_months("period_from", 3), 1).alias("period_to"),
                     F.when((n == 1) & (F.col("account_id") != "FURNITURE"), 0.0).otherwise(100.0 * n).alias("opening_balance"))
            .filter(~gap)
        )

    # -- dividends and statements ---------------------------------------------

    def receivables(self, account: str = "c_mktsegment") -> DataFrame:
        """Declared, unpaid dividends on month-end statements: from record date until paid."""
        x = self.transactions(account).filter("record_date is not null and txn_type = 'dividend'")
        lines = x.groupBy("account_id", "symbol", "record_date", F.last_day("record_date").alias("as_of")).agg(
            (F.sum(_cents(F.col("gross_amount"))) / 100).alias("entitlement"), F.count(F.lit(1)).alias("n"), F.max("trade_date").alias("_paid")
        ).filter("as_of < _paid")
        return lines.select(
            "account_id", "as_of", F.concat(F.lit("Company "), F.col("symbol")).alias("company_name"), "symbol",
            (F.col("n") * 100.0).alias("holding"), (F.col("entitlement") / (F.col("n") * 100)).alias("rate"), "entitlement", "record_date",
        )

    def credits(self) -> DataFrame:
        """Dividend cash credited between consecutive month-end statements."""
        w = W.partitionBy("account_id").orderBy("as_of")
        s = self.snapshots().select("account_id", "as_of", "cash_dividend")
        return s.select(
            "account_id", "as_of", F.lead("as_of").over(w).alias("next_as_of"),
            round_half_up(F.lead("cash_dividend").over(w) - F.col("cash_dividend")).alias("credited"),
        ).filter("next_as_of is not null")

    def declared(self) -> DataFrame:
        """Cash dividends declared per company, some carrying restated decimals."""
        a = self.corporate_actions().filter("action_type = 'cash_dividend' and ex_date is not null")
        k = F.col("action_id") % 6
        return a.select(
            "symbol", "ex_date", (F.col("cash_pct") / 10 + F.when(k == 0, 0.0123).otherwise(0.0)).alias("amount"), (k == 0).alias("restated"), "action_id",
        )

    def latest_statements(self) -> DataFrame:
        """Each account's latest statement.  Accounts with some first letters have none after May 2001, so that the days differ."""
        none_yet = (F.ascii("account_id") % 4 == 1) & (F.col("as_of") > F.lit("2001-05-31").cast("date"))
        rows = self.snapshots().filter(~none_yet)
        last = rows.groupBy("account_id").agg(F.max("as_of").alias("as_of"))
        return rows.join(last, ["account_id", "as_of"])

    def statement_holdings(self, statements: DataFrame) -> DataFrame:
        """A broker's holdings on each account's statement day: the ledger's, with some lines differing."""
        from ..operators.ledger import day_states

        upto = self.transactions().join(statements.select("account_id", "as_of"), "account_id").filter("trade_date <= as_of").drop("as_of")
        held = day_states(upto).groupBy("account_id", "symbol").agg(F.max_by(F.struct("q", "c"), "trade_date").alias("s")).select("account_id", "symbol", "s.*")
        k = key_of("symbol")
        return held.filter(((F.col("q") > 0) | (k % 13 == 0)) & (k % 11 != 0)).select(
            "account_id", "symbol",
            (F.col("q") + F.when(k % 9 == 0, 10.0).when(k % 9 == 1, -1.0).otherwise(0.0)).alias("quantity"),
            (F.col("c") + F.when(k % 7 == 0, 1.0).when(k % 9 == 0, F.col("c") * 0.1).otherwise(0.0)).alias("cost_amount"),
        ).filter("quantity > 0")

    def report_lines(self) -> DataFrame:
        """Dividend report lines: one per (account, symbol, record date) of the ledger's dividends."""
        k = key_of("symbol")
        rows = self.transactions().filter("record_date is not null and txn_type = 'dividend'").groupBy("account_id", "symbol", "record_date").agg(
            (F.sum(_cents(F.col("gross_amount"))) / 100).alias("gross"), F.min("txn_id").alias("line_id")
        )
        return rows.select(
            F.col("account_id").alias("report_id"), F.concat_ws("/", "account_id", "symbol", "record_date").alias("line_id"), "account_id",
            F.concat(F.lit("Supplier#"), padded(k, 9), F.when(k % 3 == 0, " Ltd.").otherwise("")).alias("company_name"),
            F.when(k % 5 == 0, "elsewhere").otherwise("broker").alias("paid_via"),
            F.when(k % 4 == 0, F.date_add("record_date", 200)).otherwise(F.col("record_date")).alias("record_date"),
            F.lit(100.0).alias("holding"), (F.col("gross") + F.when(k % 6 == 0, 1.0).otherwise(0.0)).alias("gross"),
            F.when(k % 7 != 0, round_half_up(F.col("gross") * 0.1)).alias("tax"),
        )

    # -- raw inputs -------------------------------------------------------------

    def price_file_lines(self) -> DataFrame:
        """Price files, one per company, written four ways, with repeats, junk and padding."""
        p = self.daily_prices()
        k, day, doy = key_of("symbol").cast("int"), F.datediff("trade_date", F.lit("1990-01-01").cast("date")), F.dayofyear("trade_date")
        style = k % 4

        def money(c: Column) -> Column:
            return F.when(style == 3, F.format_number(c, 2)).otherwise(_decimal(c, 2))

        def line(close: Column) -> Column:
            o, h, l, c = money(F.col("open")), money(F.col("high")), money(F.col("low")), money(close)
            vol = F.col("volume").cast("long").cast("string")
            q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
            decoy = F.lit("1.00")
            return (
                F.when(style == 0, F.concat_ws(",", F.date_format("trade_date", "yyyy-MM-dd"), "symbol", decoy, h, l, o, c, decoy, vol))
                .when(style == 1, F.concat_ws("\t", F.date_format("trade_date", "dd/MM/yyyy"), F.lower("symbol"), decoy, c, h, l, o, vol))
                .when(style == 2, F.concat_ws(";", F.date_format("trade_date", "MM/dd/yyyy"), "symbol", c, o, h, l, vol))
                .otherwise(F.concat_ws(",", q(F.date_format("trade_date", "MMM d, yyyy")), q("symbol"), q(c), q(o), q(h), q(l), q(F.concat(_decimal(F.col("volume") / 1000, 3), F.lit("K")))))
            )

        n = F.col("_n")
        junk = F.when(style == 2, "not a date;x;-").when(style == 1, "not a date\tx\t-\t-").otherwise("not a date,x,-")
        padding = F.when(style == 2, ";;;").when(style == 1, "\t\t").otherwise(",,,")
        wanted = F.array_compact(F.array(F.when(doy % 10 == 0, 0), F.lit(1), F.when(doy % 17 == 0, 2), F.when(doy % 23 == 0, 3)))
        body = p.select("*", F.explode(wanted).alias("_n")).select(
            _file_name(F.col("symbol")).alias("file"), (day * 4 + n).cast("long").alias("line_no"),
            F.when(n == 2, junk).when(n == 3, padding).otherwise(line(F.col("close") + F.when(n == 0, 100.0).otherwise(0.0))).alias("line"),
        )
        head = (
            F.when(style == 0, "DATE,TRADING CODE,LTP*,HIGH,LOW,OPENP*,CLOSEP*,YCP,VOLUME").when(style == 1, "Trade_Date\tSymbol\tPrice\tClose\tHigh\tLow\tOpen\tVol.")
            .when(style == 2, "Date;Code;Close;Open;High;Low;Volume").otherwise('"Date","Ticker","Last Price","Open","High","Low","Volume"')
        )
        heads = p.select("symbol").distinct().select(_file_name(F.col("symbol")).alias("file"), F.lit(0).cast("long").alias("line_no"), head.alias("line"))
        return heads.unionByName(body)

    def archive_pages(self) -> DataFrame:
        """Day-end HTML pages, one per company and year, the price table among others."""
        p = self.daily_prices()
        cell = lambda c: F.concat(F.lit("<td> "), c, F.lit("&nbsp;</td>"))
        money = lambda c: cell(F.format_number(F.col(c), 2) if c == "high" else _decimal(F.col(c), 2))
        row = F.concat(F.lit("<tr>"), cell(F.lit("1")), cell(F.date_format("trade_date", "yyyy-MM-dd")), cell(F.concat(F.lit("<a href='#'>"), "symbol", F.lit("</a>"))),
                       cell(F.lit("1.0")), money("high"), money("low"), money("open"), money("close"), cell(F.col("volume").cast("long").cast("string")), F.lit("</tr>"))
        head = "<tr><th>#</th><th>DATE</th><th>TRADING CODE</th><th>LTP*</th><th>HIGH</th><th>LOW</th><th>OPENP*</th><th>CLOSEP*</th><th>VOLUME</th></tr>"
        rows = p.groupBy("symbol", F.year("trade_date").alias("year")).agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
        return rows.select(
            F.concat_ws("/", "symbol", "year").alias("file"),
            F.concat(F.lit("<html><table><tr><td>Ticker</td><td>Up</td></tr><tr><td>x</td><td>1</td></tr></table><TABLE class='t'>"), F.lit(head), "rows", F.lit("</TABLE></html>")).alias("html"),
        )

    def pasted_dividends(self) -> DataFrame:
        """Pasted dividend tables, one document per company, in three shapes."""
        d = self.declared()
        k = key_of("symbol").cast("int") % 3
        ex, pay = F.col("ex_date"), F.date_add("ex_date", 30)
        amount = F.format_string("%.4f", "amount")
        td = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
        row = (
            F.when(k == 0, F.concat_ws("\t", F.date_format(ex, "MMM dd, yyyy"), amount, F.lit("Annual"), F.date_format(pay, "MMM dd, yyyy")))
            .when(k == 1, F.concat(F.lit("<tr>"), td(F.date_format(ex, "dd-MMM-yyyy")), td(amount), td(F.date_format(pay, "yyyy-MM-dd")), F.lit("</tr>")))
            .otherwise(F.concat_ws(";", F.lit("row"), F.date_format(ex, "yyyy-MM-dd"), F.lit("-"), amount, F.date_format(pay, "yyyy-MM-dd")))
        )
        docs = d.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(ex, row.alias("row")))).alias("r"))
        body = F.array_join(F.transform("r", lambda x: x["row"]), "\n")
        junk = F.when(k == 1, "<tr><td>none</td><td>-</td></tr>").otherwise("no figures here")
        return docs.select(
            F.col("symbol").alias("doc_id"),
            F.when(k == 0, F.concat(F.lit("Ex-Dividend Date\tDividend\tType\tPayment Date\n"), body, F.lit("\n"), junk))
            .when(k == 1, F.concat(F.lit("<table><tr><th>Ex Date</th><th>Cash Dividend</th><th>Pay Date</th></tr>"), body, junk, F.lit("</table>")))
            .otherwise(F.concat(body, F.lit("\n"), junk)).alias("text"),
        )

    def boards(self) -> DataFrame:
        """One JSON board per trading day, keyed by code, with a few unusable items."""
        p = self.daily_prices()
        k, day = key_of("symbol").cast("int"), F.dayofyear("trade_date")
        n = (k + day) % 40
        item = F.struct(
            F.col("open").alias("open"), F.when(n == 1, F.col("low") / 2).otherwise(F.col("high")).alias("high"), F.col("low").alias("low"),
            F.when(n == 2, 0.0).when(n == 3, F.col("high") * 1.01).when(n == 4, F.col("low") * 0.9).otherwise(F.col("close")).alias("close"),
            F.col("trade_count").alias("trades"), F.col("volume").cast("long").alias("volume"), (F.col("turnover") / 1e6).alias("value"),
            F.when(n == 5, "soon").otherwise(F.concat(F.date_format("trade_date", "yyyy-MM-dd"), F.lit(" 14:05:53"))).alias("updated_at"),
        )
        listed = p.filter(n != 6).groupBy("trade_date").agg(F.map_from_entries(F.collect_list(F.struct(F.when(k % 2 == 0, F.lower("symbol")).otherwise(F.col("symbol")), item))).alias("m"))
        return listed.select(F.date_format("trade_date", "yyyy-MM-dd").alias("board_id"), F.to_json("m").alias("payload"))

    def datasets(self) -> DataFrame:
        """Figures as arrays per tag aligned by year, one row per company."""
        f = self.figures()
        rows = f.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("fiscal_year", *TAGS))).alias("r"))
        pairs = [x for t in TAGS for x in (F.lit(t), F.col(f"r.{t}"))]
        return rows.select("symbol", F.col("r.fiscal_year").alias("fiscal_years"), F.create_map(*pairs).alias("data"))

    def ledger_lines(self) -> tuple[DataFrame, DataFrame]:
        """Printed ledger lines with a running balance, one import per customer, and the imports."""
        x = self.transactions("c_custkey").filter("txn_type in ('buy', 'sell', 'rights')")
        side = F.when(F.col("txn_type") == "sell", "sell").otherwise("buy")
        cents = F.floor(F.col("quantity") * F.col("price_per_share") * 100 + F.lit(0.5)).cast("long")
        fee = F.floor(F.col("commission") * 100 + F.lit(0.5)).cast("long")
        w = W.partitionBy("account_id").orderBy("trade_date", "symbol", "txn_id")
        # A customer trades a few dozen times, so the printed balance is one window.
        rows = x.select("account_id", "symbol", "trade_date", "txn_id", "quantity", "price_per_share", side.alias("kind"), cents.alias("a"), fee.alias("f"))
        rows = rows.withColumn("cash", F.when(F.col("kind") == "buy", -(F.col("a") + F.col("f"))).otherwise(F.col("a") - F.col("f")))
        rows = rows.withColumns({"line_no": F.row_number().over(w), "run": F.sum("cash").over(w.rowsBetween(W.unboundedPreceding, 0))})
        opening = F.lit(100000000)
        off = F.when(F.col("txn_id") % 97 == 0, 500).otherwise(0)
        lines = rows.select(
            F.col("account_id").alias("import_id"), "line_no", "account_id", F.col("trade_date").alias("line_date"), "kind", "symbol", "quantity",
            round_half_up(F.col("price_per_share")).alias("rate"), (F.col("a") / 100).alias("amount"), (F.col("f") / 100).alias("commission"),
            F.when(F.col("kind") == "buy", (F.col("a") + F.col("f") + F.when(F.col("txn_id") % 89 == 0, 7).otherwise(0)) / 100).otherwise(0.0).alias("debit"),
            F.when(F.col("kind") == "sell", (F.col("a") - F.col("f")) / 100).otherwise(0.0).alias("credit"),
            ((opening + F.col("run") + off) / 100).alias("balance"),
        )
        imports = rows.groupBy(F.col("account_id").alias("import_id")).agg(
            F.lit(1000000.0).alias("opening_balance"), ((opening + F.sum("cash")) / 100).alias("closing_balance"), (F.sum("f") / 100).alias("total_commission"),
            (F.sum(F.when(F.col("kind") == "buy", F.col("a") + F.col("f")).otherwise(0)) / 100).alias("total_debit"),
            (F.sum(F.when(F.col("kind") == "sell", F.col("a") - F.col("f")).otherwise(0)) / 100 + F.when(F.col("import_id").cast("long") % 50 == 0, 3.0).otherwise(0.0)).alias("total_credit"),
        )
        return lines, imports


def _decimal(value: Column, digits: int) -> Column:
    return value.cast(f"decimal(18,{digits})").cast("string")


def _file_name(symbol: Column) -> Column:
    return F.concat(symbol, F.lit("_Stock-Price+History (1).csv"))
