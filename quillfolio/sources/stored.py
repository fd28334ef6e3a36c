"""The stored queries: plain scans, joins and counts over the domain's tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .testtables import CURRENCY_TAGS, TAGS

# The statement templates.
TEMPLATES = ["general", "bank", "insurance", "nbfi"]

# Figures shown first for every company, in display order.
CORE_TAGS = ["revenue", "gross_profit", "operating_profit", "net_profit", "total_equity", "eps_basic", "navps", "dividend_per_share"]


def line_items(spark: SparkSession) -> DataFrame:
    """Definitions of the figures: unit, templates they apply to, and place."""
    rows = [(t, "currency" if t in CURRENCY_TAGS else "per_share", ["general"] if t == "gross_profit" else [], t in CORE_TAGS, i) for i, t in enumerate(TAGS)]
    return spark.createDataFrame(rows, "tag string, unit string, applies_to array<string>, is_core boolean, display_order int")


def applied_scale(facts: DataFrame, items: DataFrame) -> DataFrame:
    """Only money and counts take a period's scale; per-share figures stay in units."""
    scaled = F.when(F.col("unit").isin("currency", "count"), F.lit("million")).otherwise(F.lit("unit"))
    return facts.filter("is_current").join(items, "tag").withColumn("applied_scale", scaled)


def applies_to(items: DataFrame, companies: DataFrame) -> DataFrame:
    """Items each company's template shows; an empty list means every template."""
    every = F.array(*[F.lit(x) for x in TEMPLATES])
    shown = items.select("tag", "display_order", F.explode(F.when(F.size("applies_to") == 0, every).otherwise(F.col("applies_to"))).alias("statement_template"))
    return companies.select("symbol", "statement_template").join(shown, "statement_template")


def tracked_companies(companies: DataFrame, facts: DataFrame) -> DataFrame:
    periods = facts.groupBy("symbol").agg(F.count_distinct("fiscal_year").alias("periods"))
    return (
        companies.filter("is_tracked").select("symbol", "name", "sector").join(periods, "symbol", "left")
        .withColumn("periods", F.coalesce(F.col("periods"), F.lit(0))).orderBy("symbol")
    )


def company_by_symbol(companies: DataFrame, symbol: str) -> DataFrame:
    return companies.filter(F.col("symbol") == symbol.upper()).limit(1)


def company_names(companies: DataFrame) -> DataFrame:
    """What names on statements are matched against."""
    return companies.select("symbol", "name", "short_name")


def source_documents(documents: DataFrame) -> DataFrame:
    """Papers of every company, oldest fiscal year first."""
    return documents.orderBy("symbol", "fiscal_year", "doc_id")


def core_line_items(items: DataFrame) -> DataFrame:
    return items.filter("is_core").orderBy("display_order")


def period_with_facts(facts: DataFrame, symbol: str, fiscal_year: int) -> DataFrame:
    return facts.filter((F.col("symbol") == symbol) & (F.col("fiscal_year") == fiscal_year) & F.col("is_current"))


def actions_by_symbol(actions: DataFrame) -> DataFrame:
    return actions.orderBy("symbol", F.asc_nulls_last("ex_date"), "action_id")


def announced_dividends(actions: DataFrame) -> DataFrame:
    """Cash dividends with an ex date, newest first, with a restated mark from their note."""
    return (
        actions.filter((F.col("action_type") == "cash_dividend") & F.col("ex_date").isNotNull())
        .withColumn("restated", F.coalesce(F.lower("note").contains("restated"), F.lit(False)))
        .orderBy("symbol", F.desc("ex_date"))
    )


def ledger_listing(txns: DataFrame, companies: DataFrame, accounts: DataFrame) -> DataFrame:
    """Ledger rows with company, sector and account, newest first."""
    return (
        txns.join(companies.select("symbol", "name", "sector"), "symbol").join(accounts.select("account_id", "broker"), "account_id")
        .orderBy(F.desc("trade_date"), F.desc("txn_id"), "symbol")
    )


def accounts_listing(accounts: DataFrame) -> DataFrame:
    return accounts.orderBy(F.desc("is_active"), "account_id")


def quoted_members(companies: DataFrame, txns: DataFrame) -> DataFrame:
    """Active companies that are tracked or appear in the ledger."""
    traded = txns.select("symbol").distinct().withColumn("_t", F.lit(True))
    return companies.filter("is_active").join(traded, "symbol", "left").filter(F.col("is_tracked") | F.col("_t")).drop("_t")


def last_job_run(runs: DataFrame) -> DataFrame:
    cols = [c for c in runs.columns if c != "job_name"]
    return runs.groupBy("job_name").agg(F.max_by(F.struct(*cols), "started_at").alias("_r")).select("job_name", "_r.*")


def targets_listing(targets: DataFrame, companies: DataFrame, accounts: DataFrame) -> DataFrame:
    return (
        targets.join(companies.select("symbol", "name"), "symbol")
        .join(accounts.select("account_id", "broker"), "account_id", "left").orderBy("symbol", "target_id")
    )


def oldest_duplicates(rows: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Rows to drop because an older row has the same keys (missing keys are equal)."""
    first = rows.groupBy(*keys).agg(F.min(row_id).alias("keep_id")).alias("f")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}"))
    return rows.alias("r").join(first, same).filter(F.col(f"r.{row_id}") > F.col("keep_id")).select("r.*", "keep_id")
