"""Streams give what the batch operators give over the same history."""
import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from quillfolio.operators import targets as Tg
from quillfolio.plans.daily_job import alert_run
from quillfolio.streaming.alerts import STATE_STORE, net_events, stream_alerts
from quillfolio.streaming.bars import daily_bars
from quillfolio.streaming.prices import merge_days, merge_into_store, start_price_stream, stored_days


def test_price_stream_upserts_late_and_corrected_days(spark, tmp_path):
    schema = "symbol string, trade_date date, close double, open double, high double, low double, volume double, arrived long"
    d = dt.date
    batches = [
        [("X", d(2025, 1, 2), 10.0, 9.0, 11.0, 8.0, 100.0, 1), ("X", d(2025, 1, 3), 12.0, 9.0, 13.0, 8.0, 100.0, 1)],
        [("X", d(2025, 1, 2), 10.5, None, None, None, None, 2), ("X", d(2024, 12, 31), 7.0, None, None, None, 5.0, 3), ("X", d(2024, 12, 31), 8.0, None, None, None, 6.0, 4)],
    ]
    src = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        start_price_stream(stream, str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
    store = str(tmp_path / "store")
    held = lambda: {r.trade_date: (r.close, r.open, r.volume) for r in stored_days(spark, store).collect()}
    want = {d(2025, 1, 2): (10.5, 9.0, 100.0), d(2025, 1, 3): (12.0, 9.0, 100.0), d(2024, 12, 31): (8.0, None, 6.0)}
    assert held() == want
    sink = merge_into_store(spark, store)
    sink(spark.createDataFrame(batches[1], schema), 1)  # replayed
    assert held() == want
    january = sorted((tmp_path / "store" / "month=202501").iterdir())
    sink(spark.createDataFrame([("X", d(2025, 3, 3), 5.0, None, None, None, None, 9)], schema), 2)
    assert held() == want | {d(2025, 3, 3): (5.0, None, None)}
    assert sorted((tmp_path / "store" / "month=202501").iterdir()) == january  # untouched
    sink(spark.createDataFrame([], schema), 3)
    assert held() == want | {d(2025, 3, 3): (5.0, None, None)}


def test_price_store_keeps_one_folder_a_month_and_survives_a_crash(spark, tmp_path, monkeypatch):
    schema = "symbol string, trade_date date, close double, open double, high double, low double, volume double, arrived long"
    store = str(tmp_path / "store")
    day = lambda i: dt.date(2025, 1 + i % 3, 1 + i % 20)
    rows = [("X", day(i), float(i), float(i) if i % 2 else None, None, None, None, i) for i in range(5)]
    want = {}
    for i, r in enumerate(rows):
        merge_days(spark, store, spark.createDataFrame([r], schema), i)
        want[r[1]] = (r[2], r[3] if r[3] is not None else want.get(r[1], (None, None))[1])
    assert sorted(p.name for p in (tmp_path / "store").glob("month=*")) == ["month=202501", "month=202502", "month=202503"]
    assert not list((tmp_path / "store-staged").glob("batch=*")) and all(len(list(p.glob("*.parquet"))) == 1 for p in (tmp_path / "store").glob("month=*"))
    held = lambda: {r.trade_date: (r.close, r.open) for r in stored_days(spark, store).collect()}
    assert held() == want
    # The job dies after the batch is staged, and after some months are gone: the replay finishes from the staged rows.
    late = spark.createDataFrame([("X", day(0), 99.0, None, None, None, None, 1), ("X", dt.date(2025, 2, 27), 98.0, 1.0, None, None, None, 1)], schema)

    def dies(*a):
        raise RuntimeError("lost")

    with monkeypatch.context() as lost:
        lost.setattr(type(late), "hint", dies)  # what the step after the staging begins with
        with pytest.raises(RuntimeError):
            merge_days(spark, store, late, 5)
    assert held() == want
    shutil.rmtree(tmp_path / "store" / "month=202502")
    merge_days(spark, store, late, 5)
    assert held() == want | {day(0): (99.0, want[day(0)][1]), dt.date(2025, 2, 27): (98.0, 1.0)}


@pytest.fixture
def map_state(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def test_alert_stream_of_shuffled_and_corrected_days_equals_batch(spark, map_state, tmp_path):
    rng = random.Random(2)
    rows, first = [], []
    for target in range(6):
        for side in ("buy", "sell"):
            for i in range(40):
                rows.append((target, side, dt.date(2025, 1, 1) + dt.timedelta(days=i), float(i), 90.0, rng.random() < 0.5, rng.random() < 0.7, 1))
    schema = "target_id long, side string, trade_date date, close double, level double, reached boolean, can_send boolean, arrived long"
    want = sorted(tuple(r) for r in Tg.alerts(spark.createDataFrame(rows, schema)).collect())
    # Days come in any order; some come wrong first, twice in a batch, or are replayed.
    shuffled = rng.sample(rows, len(rows))
    batches = [[], [], []]
    for r in shuffled:
        n = rng.randrange(3)
        batches[n].append(r)
        if n and rng.random() < 0.4:
            batches[rng.randrange(n)].append((*r[:3], r[3] + 0.5, r[4], not r[5], r[6], 1))
        if rng.random() < 0.2:
            batches[n].append((*r[:5], not r[5], not r[6], 0))
    batches[2] += [r for r in rng.sample(rows, 20) if r not in batches[2]]
    src = str(tmp_path / "in")
    for days in batches:
        spark.createDataFrame(days, schema).coalesce(1).write.mode("append").parquet(src)
        out = stream_alerts(spark.readStream.schema(schema).parquet(src))
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    changes = spark.read.parquet(str(tmp_path / "out"))
    got = sorted(tuple(r) for r in net_events(changes).collect())
    assert got == want and want and changes.filter("change = -1").count() > 0


def test_single_day_runs_equal_the_replay(spark, tmp_path):
    rng = random.Random(8)
    d = lambda i: dt.date(2025, 1, 1) + dt.timedelta(days=i)
    targets = spark.createDataFrame([(i, f"S{i % 3}", "A" if i % 2 else None, 9.0 if i != 4 else None, 11.0 if i != 5 else None) for i in range(6)], "target_id long, symbol string, account_id string, buy_below double, sell_above double")
    prices = [(f"S{s}", d(i), rng.choice([8.0, 9.0, 10.0, 11.0, 12.0])) for s in range(3) for i in range(7) if rng.random() < 0.8]
    held = [(a, f"S{s}", d(i), rng.choice([0.0, 5.0])) for a in ("A", None) for s in range(3) for i in (0, 2, 4)]
    closes = spark.createDataFrame(prices, "symbol string, trade_date date, close double")
    holdings = spark.createDataFrame(held, "account_id string, symbol string, trade_date date, quantity double")
    want = sorted(tuple(r) for r in Tg.alerts(Tg.target_days(targets, closes, holdings)).collect())
    got = []
    for i in [*range(4), 3, *range(4, 7)]:  # the fourth day is run twice
        now = {(a, s): q for a, s, day, q in held if day <= d(i)}
        shares = spark.createDataFrame([(*k, q) for k, q in now.items()], "account_id string, symbol string, quantity double")
        got += [tuple(r) for r in alert_run(spark, str(tmp_path / "state"), targets, closes.filter(F.col("trade_date") == F.lit(d(i))), shares, str(d(i))).collect()]
    assert sorted(set(got)) == want and {r[5] for r in want} == {"send", "rearm"}


def test_an_alert_that_reached_nobody_is_sent_again(spark):
    targets = spark.createDataFrame([(1, "X", None, 95.0, None)], "target_id long, symbol string, account_id string, buy_below double, sell_above double")
    state = spark.createDataFrame([], "target_id long, side string, alerted_on date")
    closes = spark.createDataFrame([("X", dt.date(2025, 1, 2), 94.0)], "symbol string, trade_date date, close double")
    nobody = spark.createDataFrame([], "target_id long, side string")
    events = Tg.plan_alerts(targets, state, closes, spark.createDataFrame([], "account_id string, symbol string, quantity double"))
    assert events.count() == 1 and Tg.advance_state(targets, state, events, nobody).count() == 0
    after = Tg.advance_state(targets, state, events)
    assert after.collect() == [(1, "buy", dt.date(2025, 1, 2))]
    assert Tg.advance_state(targets.filter("target_id > 1"), after, events.limit(0)).count() == 0  # the target is gone


def test_bars_stream_equals_batch(spark, tmp_path):
    ticks = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = str(tmp_path / "in")
    ticks.coalesce(1).write.parquet(src)
    stream = daily_bars(spark.readStream.schema(ticks.schema).parquet(src))
    q = stream.writeStream.format("memory").queryName("bars").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("bars").collect())) == sorted(map(tuple, daily_bars(ticks).collect()))
