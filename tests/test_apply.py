"""Importing a ledger: hand-worked cases of what is written and what is refused, and a plain walk over random histories."""
import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from quillfolio.operators import apply as A
from quillfolio.operators import reconcile as R
from quillfolio.sources.scratch import written
from quillfolio.sources.testtables import TestTables

D = dt.date
TRADE = "account_id string, symbol string, trade_date date, txn_type string, quantity double, price_per_share double, commission double, txn_id long"
PLAN = "account_id string, period_from date, period_to date, opening_balance double, closing_balance double, confirmed boolean"
CASH = "account_id string, move_date date, kind string, amount double, movement_id long"


@pytest.fixture
def world(spark):
    """Five accounts with one opening lot, a bonus and a sale in January; every import replaces the sale by a smaller one."""
    trades, new, cash, lines = [], [], [], []
    for i, a in enumerate("ABCDE"):
        trades += [(a, "X", D(2024, 1, 1), "buy", 100.0, 10.0, 0.0, 10 * i), (a, "X", D(2025, 1, 10), "bonus", 10.0, None, 0.0, 10 * i + 1), (a, "X", D(2025, 1, 20), "sell", 30.0, 12.0, 1.0, 10 * i + 2)]
        new.append((a, "X", D(2025, 1, 21), "sell", {"B": 300.0, "E": 30.0}.get(a, 20.0), 12.0, 1.0, 10 * i + 5))
        cash += [(a, D(2024, 12, 31), "fee", -1.0, i), (a, D(2025, 1, 5), "deposit", 50.0, 100 + i)]
        lines.append((a, D(2025, 1, 6), "deposit", 55.0, 200 + i))
    new.append(("A", "NEW", D(2025, 1, 22), "buy", 5.0, 2.0, 0.0, 7))
    plans = [(a, D(2025, 1, 1), D(2025, 1, 31), 5.0, 6.0, a in "ABCD" and a != "C") for a in "ABCDE"]
    existing = spark.createDataFrame(trades, TRADE)
    seen = existing.filter("txn_type = 'sell'").filter("account_id <> 'D'").unionByName(existing.filter("account_id = 'D'").filter("txn_type = 'sell'").withColumn("txn_id", F.col("txn_id") + 1000))
    return dict(
        plans=spark.createDataFrame(plans, PLAN), existing=existing, seen=seen, remove=existing.filter("txn_type = 'sell'"), new=spark.createDataFrame(new, TRADE),
        cash=spark.createDataFrame(cash, CASH), new_cash=spark.createDataFrame(lines, CASH), periods=spark.createDataFrame([("A", D(2024, 1, 1), D(2024, 12, 31))], "account_id string, period_from date, period_to date"),
        companies=spark.createDataFrame([("X", "X Mills")], "symbol string, name string"),
    )


def test_refused_accounts_keep_every_row(world):
    out = A.apply_import(**world)
    got = {r.account_id: (r.applied, r.reason, r.symbol) for r in out["outcomes"].collect()}
    assert got == {"A": (True, None, None), "B": (False, A.OVERSOLD, "X"), "C": (False, A.UNCONFIRMED, "X"), "D": (False, A.STALE, "X"), "E": (True, None, None)}
    sales = {(r.account_id, r.txn_id) for r in out["trades"].filter("txn_type = 'sell'").collect()}
    assert sales == {("A", 5), ("B", 12), ("C", 22), ("D", 32), ("E", 45)}
    assert out["trades"].filter("txn_type in ('buy', 'bonus')").count() == 11  # the cash ledger does not show a bonus: it stays
    moves = {(r.account_id, r.movement_id) for r in out["cash"].collect()}
    assert moves == {("A", 0), ("A", 200), ("B", 1), ("B", 101), ("C", 2), ("C", 102), ("D", 3), ("D", 103), ("E", 4), ("E", 204)}
    periods = {(r.account_id, str(r.period_from), r.trades, r.cash_lines) for r in out["periods"].collect()}
    assert periods == {("A", "2024-01-01", None, None), ("A", "2025-01-01", 2, 1), ("E", "2025-01-01", 1, 1)}
    assert {(r.symbol, r.is_tracked) for r in out["companies"].collect()} == {("X", None), ("NEW", False)}


def test_a_row_that_the_preview_did_not_show_is_not_removed(world):
    world["remove"] = world["remove"].unionByName(world["existing"].filter("account_id = 'E' and txn_type = 'bonus'"))
    got = {r.account_id: r.reason for r in A.apply_import(**world)["outcomes"].collect()}
    assert got["E"] == A.UNSEEN and got["A"] is None


def test_importing_again_changes_nothing(world):
    first = A.apply_import(**world)
    trades, cash = first["trades"], first["cash"]
    now = trades.filter("txn_type in ('buy', 'sell') and trade_date >= date'2025-01-01'")
    again = A.apply_import(**{**world, "existing": trades, "cash": cash, "seen": now, "remove": now, "plans": world["plans"].filter("account_id in ('A', 'E')")})
    assert {r.account_id: r.applied for r in again["outcomes"].collect()} == {"A": True, "E": True}
    assert sorted(map(str, again["trades"].collect())) == sorted(map(str, trades.collect())) and sorted(map(str, again["cash"].collect())) == sorted(map(str, cash.collect()))


def test_changed_holdings_equal_a_plain_walk(spark):
    rng = random.Random(4)
    rows = [("A", rng.choice("XYZ"), D(2025, 1, 1) + dt.timedelta(days=rng.randrange(30)), rng.choice(["buy", "buy", "sell", "bonus", "dividend"]), float(rng.randrange(1, 9)), 1.0, 0.0, i) for i in range(150)]
    gone = [r for r in rows if rng.random() < 0.2]
    new = [(*r[:4], r[4] + 1, *r[5:7], r[7] + 1000) for r in gone if r[3] != "dividend"]
    frame = lambda x: spark.createDataFrame(x, TRADE)
    got = {r.symbol: (r.before, r.after, r.oversold_on) for r in A.changed_holdings(A.before_and_after(frame(rows), frame(gone), frame(new))).collect()}

    def walk(trades, symbol):
        held, short = 0.0, None
        for r in sorted((r for r in trades if r[1] == symbol), key=lambda r: (r[2], r[3] == "sell", r[7])):
            if r[3] == "sell":
                short = short or (r[2] if r[4] > held else None)
                held = max(0.0, held - r[4])
            elif r[3] != "dividend":
                held += r[4]
        return held, short

    after = [r for r in rows if r not in gone] + new
    assert got == {s: (walk(rows, s)[0], *walk(after, s)) for s in "XYZ"}


def test_row_ids_stay_apart_for_any_part_key(spark, tmp_path):
    lines = [(1, p, 1, 1, 5.0, 50.0, 0.0, 0.0, "N", "O", dt.datetime(2000, 1, 3)) for p in (1, 2_097_153, 20_000_000_000)]
    lines += [(600_000_000_000, 1, 1, 7, 5.0, 50.0, 0.0, 0.0, "R", "O", dt.datetime(2000, 1, 3))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 1), (600_000_000_000, 1)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "BUILDING")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    rows = TestTables(spark, str(tmp_path)).transactions()
    ids = [int(r.txn_id) for r in rows.orderBy("txn_id").collect()]
    assert len(set(ids)) == 4 and ids[-1] == (600_000_000_000 * 8 + 7) * 10**12 + 1
    assert R.replace_period(rows, rows.limit(0), "2000-01-01", "2000-12-31").count() == 4


def test_many_accounts_and_rows_without_ids_or_days(spark, world, monkeypatch):
    odd = [("A", "X", None, "buy", 7.0, 1.0, 0.0, 900), ("B", None, D(2025, 1, 3), "buy", 8.0, 1.0, 0.0, None), (None, "X", D(2025, 1, 4), "sell", 9.0, 1.0, 0.0, 902), ("Z", "X", D(2025, 1, 5), "buy", 9.0, 1.0, 0.0, 903)]
    world["existing"] = world["existing"].unionByName(spark.createDataFrame(odd, TRADE))
    for key in ("seen", "remove"):  # a row that comes twice, and one without an id
        world[key] = world[key].unionByName(world[key].filter("account_id = 'A'")).unionByName(spark.createDataFrame(odd[1:2], TRADE))
    got = []
    for few in (A.FEW_ACCOUNTS, 0):
        monkeypatch.setattr(A, "FEW_ACCOUNTS", few)
        got.append({key: sorted(map(str, df.collect())) for key, df in A.apply_import(**world).items()})
    assert got[0] == got[1] and len(got[0]["outcomes"]) == 5 and any("applied=True" in r for r in got[0]["outcomes"])


def test_written_table_leaves_no_shuffle_on_disk(spark):
    def shuffles():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return sum("shuffle_" in files.apply(i).getName() for i in range(files.size()))

    before = shuffles()
    table = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")))
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.2)
    assert shuffles() <= before and table.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"

