"""Keys, windows and scales beyond the sizes of the test tables."""
import datetime as dt

from pyspark.sql import functions as F

from quillfolio.operators import fundamentals as Fu
from quillfolio.sources import board, stored
from quillfolio.sources import testtables as T


def test_long_keys_stay_apart(spark):
    rows = spark.createDataFrame([(7,), (999_999,), (1_000_000,), (1_000_001,), (123_456_789_012,)], "k long")
    got = rows.select("k", T.supplier_code(F.col("k")).alias("symbol")).withColumn("back", T.key_of("symbol")).collect()
    assert [r.symbol for r in got] == ["S000007", "S999999", "S1000000", "S1000001", "S123456789012"]
    assert all(r.k == r.back for r in got)


def test_windows_cover_the_whole_range(spark):
    d = dt.date
    ranges = spark.createDataFrame([("X", d(1980, 1, 1), d(2025, 1, 1))], "symbol string, start date, end date")
    rows = board.backfill_windows(ranges).collect()
    assert rows[0].from_date == d(1980, 1, 1) and rows[-1].to_date == d(2025, 1, 1) and len(rows) > 50
    assert all((b.from_date - a.to_date).days == 1 for a, b in zip(rows, rows[1:]))
    assert board.backfill_windows(ranges, newest=20).count() == 20
    days = spark.createDataFrame([("X", d(1980, 1, 1)), ("X", d(2025, 1, 1)), ("X", d(2025, 1, 2)), ("X", d(1979, 12, 31))], "symbol string, trade_date date")
    counted = {r.from_date: r.rows for r in board.window_coverage(board.backfill_windows(ranges), days).collect()}
    assert len(counted) == len(rows) and sum(counted.values()) == 2 and counted[d(1980, 1, 1)] == 1


def test_figures_compare_across_scales_and_added_ones_keep_theirs(spark):
    have = spark.createDataFrame([("N01", 2000, "revenue", 12_500_000.0, "unit"), ("N01", 2000, "net_profit", 2.0, "million")], "symbol string, fiscal_year int, tag string, stored double, stored_scale string")
    typed = spark.createDataFrame(
        [("N01", 2000, "revenue", "12.5", "million"), ("N01", 2000, "net_profit", "3", "million"), ("N01", 2000, "capex", "4", "million"), ("N01", 2000, "eps_basic", "1.5", "unit")],
        "symbol string, fiscal_year int, tag string, typed_text string, typed_scale string",
    )
    verdicts = Fu.verify_figures(have, typed)
    assert {r.tag: r.outcome for r in verdicts.collect()} == {"revenue": "confirmed", "net_profit": "corrected", "capex": "added", "eps_basic": "added"}
    facts = have.select("symbol", "fiscal_year", "tag", F.lit(1).alias("revision"), F.lit(True).alias("is_current"), F.col("stored").alias("value_reported"), F.col("stored_scale").alias("scale"), F.lit("unverified").alias("verification"))
    got = {(r.tag, r.revision): (r.is_current, r.value_reported, r.scale) for r in Fu.append_revisions(facts, verdicts, stored.line_items(spark)).collect()}
    assert got["capex", 1] == (True, 4.0, "million") and got["eps_basic", 1] == (True, 1.5, "unit")
    assert got["net_profit", 1][0] is False and got["net_profit", 2] == (True, 3.0, "million")
