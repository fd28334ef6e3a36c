"""The feature table brought forward day by day, and buckets of crowded values and ids."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillfolio.operators import features as Ft
from quillfolio.operators import insights as I
from quillfolio.operators import ledger as L
from quillfolio.operators import scan

D = dt.date


@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(12)
    days = [D(2023, 1, 1) + dt.timedelta(days=i) for i in range(0, 700, 3)]
    rows = [(s, d, c := round(rng.uniform(5, 20), 2), c + 1, c - 1) for s in "XY" for d in days if rng.random() < 0.9]
    rows += [("GONE", D(2023, 1, 2), 9.0, 9.5, 8.5), ("NEW", D(2024, 11, 20), 7.0, 7.5, 6.5)]
    earnings = [("X", D(2022, 5, 1), 2021, 1.0), ("X", D(2023, 6, 1), 2022, 1.5), ("X", D(2023, 6, 1), 2021, 9.0), ("X", D(2024, 11, 1), 2023, -1.0), ("Y", D(2024, 2, 1), 2023, 2.0)]
    prices = spark.createDataFrame(rows, "symbol string, trade_date date, close double, high double, low double")
    return rows, earnings, prices, spark.createDataFrame(earnings, "symbol string, from_date date, fiscal_year int, eps double")


def test_features_equal_a_plain_walk(history):
    rows, earnings, prices, known = history
    got = {(r.symbol, r.trade_date): r for r in Ft.daily_features(prices, known).collect()}
    assert len(got) == len(rows)
    for s in "XY":
        mine = sorted(r for r in rows if r[0] == s)
        for i, (_, d, close, _, _) in enumerate(mine):
            r, year = got[s, d], [x for x in mine[: i + 1] if (d - x[1]).days <= 365]
            eps = [e for e in sorted(earnings, key=lambda e: (e[1], e[2])) if e[0] == s and e[1] <= d]
            want = (close, mine[i - 1][2] if i else None, max(x[3] for x in year), min(x[4] for x in year), max(x[2] for x in mine[: i + 1]), i + 1, eps[-1][3] if eps else None)
            assert (r.close, r.ycp, r.yearly_high, r.yearly_low, r.peak, r.days, r.eps) == want and r.fall == pytest.approx(close / want[4] - 1)


def test_features_brought_forward_equal_the_whole(history):
    _, _, prices, known = history
    whole = Ft.daily_features(prices, known)
    want = sorted(map(str, whole.collect()))
    table = whole.filter("trade_date < date'2023-09-10'")
    for since, to in (("2023-09-10", "2024-10-30"), ("2024-10-30", "2024-11-19"), ("2024-11-19", "2030-01-01")):
        table = table.unionByName(Ft.advance_features(table, prices.filter(F.col("trade_date") < to), known.filter(F.col("from_date") < to), since))
    assert sorted(map(str, table.collect())) == want
    # A corrected day: advance again from it.
    fixed = prices.withColumn("close", F.when(F.col("trade_date") == "2024-10-31", F.lit(99.0)).otherwise(F.col("close")))
    again = table.filter("trade_date < date'2024-10-29'")
    assert sorted(map(str, again.unionByName(Ft.advance_features(again, fixed, known, "2024-10-29")).collect())) == sorted(map(str, Ft.daily_features(fixed, known).collect()))


def test_buckets_are_cut_by_count_where_values_crowd(spark, monkeypatch):
    monkeypatch.setattr(scan, "BUCKET_ROWS", 100)
    # All values within a billionth of each other, but for one.
    rows = spark.range(1000).select(F.concat(F.lit("S"), "id").alias("symbol"), (1 + F.col("id") * 1e-12).alias("pe")).unionByName(spark.createDataFrame([("FAR", 1e9)], "symbol string, pe double"))
    sizes = scan.ranges(rows, ["pe"], 1001).groupBy("bucket").count().collect()
    assert len(sizes) > 10 and max(r["count"] for r in sizes) <= 250
    got = {r.symbol: r for r in I.compare_with_peers(rows, ["pe"]).collect()}
    assert got["FAR"].rank == 1 and got["S0"].rank == 0 and got["S400"].cheaper_than == 600 and got["S400"].peers == 1000


def test_a_day_of_crowded_ids_is_cut_by_count(spark, monkeypatch):
    monkeypatch.setattr(scan, "BUCKET_ROWS", 100)
    ids = [*range(10**12, 10**12 + 600), 5, 10**15]
    rows = [("A", "X", D(2025, 1, 1), "buy", 300.0, 1.0, 0.0, 1)] + [("A", "X", D(2025, 1, 2), "sell", 1.0, 2.0, 0.0, i) for i in ids]
    rows += [("A", "Y", D(2025, 1, 2), "sell", 1.0, 2.0, 0.0, 7)]
    txns = spark.createDataFrame(rows, "account_id string, symbol string, trade_date date, txn_type string, quantity double, price_per_share double, commission double, txn_id long")
    txns = txns.withColumns({"gross_amount": F.lit(None).cast("double"), "tax_withheld": F.lit(0.0)})
    sales = scan.day_buckets(txns.filter("txn_type = 'sell'"), L.DAY, "txn_id").groupBy("symbol", "bucket").count().collect()
    assert max(r["count"] for r in sales) <= 200 and sum(r["count"] for r in sales) == 603
    filled = {int(r.txn_id): r.filled for r in L.sale_gains(txns).filter("symbol = 'X'").collect()}
    order = sorted(ids)
    assert [filled[i] for i in order] == [1.0] * 300 + [0.0] * 302
    assert {int(r.txn_id) for r in L.oversells(txns).collect()} == {*order[300:], 7}
