"""Registered queries of the daily job."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import targets as Tg
from ..sources.scratch import scratch, written
from ..streaming.alerts import STATE_STORE, net_events, stream_alerts
from ..streaming.prices import merge_days, start_price_stream, stored_days
from .daily_job import ALERT_STATE, alert_run, ingest_day, new_alerts, store_day
from .registry import query


def _job(t):
    stored = t.daily_prices().filter("year(trade_date) < 1999").withColumn("close", F.col("close") + 1)
    return ingest_day(t.boards(), t.companies().filter("is_active"), stored)


@query("k01_daily_job_prices", "symbol trade_date:d open:4 high:4 low:4 close:4 volume:2")
def _(t):
    return _job(t)["prices"]


@query("s14_daily_job_summary", "board_id written:i skipped:i ok:b")
def _(t):
    return _job(t)["summary"]


@query("w22_new_alerts", "target_id:i side trade_date:d event")
def _(t):
    return new_alerts(written(t.targets()), written(t.stock_prices()), written(_holdings(t)), "2001-01-01")


@query("k01_job_store", "symbol trade_date:d open:4 high:4 low:4 close:4 volume:2")
def _(t):
    store = scratch(t.spark)
    held = t.daily_prices().filter("year(trade_date) < 1999").withColumns({"close": F.col("close") + 1, "arrived": F.lit(0)})
    merge_days(t.spark, store, held, "held", keep_missing=False)
    store_day(t.spark, store, t.boards(), t.companies().filter("is_active"), "boards")
    return stored_days(t.spark, store)


def _two_arrivals(t, first, second):
    """A folder that a stream reads, and what puts each of two arrivals into it."""
    folder = scratch(t.spark)
    return folder, [lambda rows=rows: rows.write.mode("append").parquet(folder) for rows in (first, second)]


@query("z1_price_stream", "symbol trade_date:d open:4 high:4 low:4 close:4 volume:2")
def _(t):
    d = F.dayofmonth("trade_date")
    prices = written(t.daily_prices().drop("trade_count", "turnover"))
    wrong, late = d % 5 == 0, d % 4 == 3
    first = prices.filter(~late).withColumns({"close": F.col("close") + F.when(wrong, 1.0).otherwise(0.0), "arrived": F.lit(1)})
    none = {c: F.when(~wrong, F.col(c)) for c in ("open", "volume")}
    second = prices.filter(wrong | late).withColumns({**none, "arrived": F.lit(2)})
    folder, arrivals = _two_arrivals(t, first, second)
    store, checkpoint = scratch(t.spark), scratch(t.spark)
    for arrive in arrivals:
        arrive()
        start_price_stream(t.spark.readStream.schema(first.schema).parquet(folder), store, checkpoint).awaitTermination()
    return stored_days(t.spark, store)


def _holdings(t):
    return Tg.daily_holdings(written(L.day_states(t.transactions()).select("account_id", "symbol", "trade_date", "q", "q_open")))


@query("w22_day_runs", "target_id:i side trade_date:d event")
def _(t):
    prices, holdings, targets = written(t.stock_prices()), written(_holdings(t)), written(t.targets())
    store, events, start = scratch(t.spark), None, F.lit("2000-06-14").cast("date")
    past = Tg.alerts(Tg.target_days(targets, prices.filter(F.col("trade_date") < start), holdings))
    none = t.spark.createDataFrame([(None, None, None)], ALERT_STATE)
    Tg.outstanding(past).unionByName(none).write.parquet(f"{store}/run=2000-06-13")
    for day in ("2000-06-14", "2000-06-15", "2000-06-16", "2000-06-16"):  # the last day is run again
        at = F.lit(day).cast("date")
        held = holdings.filter(F.col("trade_date") <= at).groupBy("account_id", "symbol").agg(F.max_by("quantity", "trade_date").alias("quantity"))
        run = alert_run(t.spark, store, targets, prices.filter(F.col("trade_date") == at), held, day)
        events = run if events is None else events.unionByName(run)
    return events.distinct()


@query("z2_alert_stream", "target_id:i side trade_date:d close:4 level:4 event")
def _(t):
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    d = F.dayofmonth("trade_date")
    days = written(Tg.target_days(written(t.targets()), written(t.stock_prices()), written(_holdings(t))))
    wrong, late = d % 5 == 0, d % 4 == 1
    first = days.filter(~late).withColumns({"reached": F.col("reached") != wrong, "close": F.col("close") + F.when(wrong, 1.0).otherwise(0.0)})
    folder, arrivals = _two_arrivals(t, first, days.filter(wrong | late))
    out, checkpoint = scratch(t.spark), scratch(t.spark)
    for arrive in arrivals:
        arrive()
        changes = stream_alerts(t.spark.readStream.schema(first.schema).parquet(folder))
        changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return net_events(t.spark.read.schema(changes.schema).parquet(out))
