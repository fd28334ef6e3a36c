"""The daily job: board in, prices merged, alerts out."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import prices as P
from ..operators import targets as Tg
from ..sources.board import read_board
from ..streaming.prices import folder_exists, merge_days

ALERT_STATE = "target_id long, side string, alerted_on date"
PRICE_COLUMNS = ["symbol", "trade_date", "open", "high", "low", "close", "volume", "turnover"]


def ingest_day(boards: DataFrame, wanted: DataFrame, stored: DataFrame) -> dict[str, DataFrame]:
    """Quotes of the boards merged over the stored days, the skips, and a summary per board.

    A wanted symbol is written or skipped; a board without a single usable quote has failed.
    """
    quotes, skips = read_board(boards, wanted)
    newest = quotes.groupBy("symbol", "trade_date").agg(F.max_by(F.struct(*PRICE_COLUMNS[2:]), "board_id").alias("_r")).select("symbol", "trade_date", "_r.*")
    return {
        "prices": P.replace_prices(stored.select(*PRICE_COLUMNS), newest),
        "skips": skips,
        "summary": _summary(boards, wanted, quotes),
    }


def _summary(boards: DataFrame, wanted: DataFrame, quotes: DataFrame) -> DataFrame:
    names = wanted.agg(F.count_distinct(F.upper("symbol"))).scalar()
    written = quotes.groupBy("board_id").agg(F.count(F.lit(1)).alias("written"))
    counts = boards.select("board_id").join(written, "board_id", "left").na.fill(0, ["written"]).withColumn("skipped", names - F.col("written"))
    return counts.withColumn("ok", F.col("written") > 0)


def store_day(spark: SparkSession, store: str, boards: DataFrame, wanted: DataFrame, run: str) -> dict[str, DataFrame]:
    """Write the boards' quotes into the price store: only the months that they touch are read and overwritten.

    A quote replaces the stored day whole; of a day on several boards the last one counts.  `run`
    names the run: one that failed is finished by running it again.
    """
    quotes, skips = read_board(boards, wanted)
    merge_days(spark, store, quotes.withColumn("arrived", F.col("board_id")), run, keep_missing=False)
    return {"skips": skips, "summary": _summary(boards, wanted, quotes)}


def alert_run(spark: SparkSession, store: str, targets: DataFrame, closes: DataFrame, holdings: DataFrame, day: str, delivered: DataFrame | None = None) -> DataFrame:
    """One run of alerts over the stored state; the events of the run.

    The state is kept a folder a run, run=<day>: a run reads the newest one before it and writes its
    own, so running a day again gives the same.  It sees that day's closes and the
    shares held, no history.
    """
    before = spark.read.schema(ALERT_STATE + ", run date").parquet(store).filter(F.col("run") < F.lit(day).cast("date")) if folder_exists(spark, store) else None
    if before is None:
        state = spark.createDataFrame([], ALERT_STATE)
    else:
        newest = before.agg(F.max("run")).scalar()
        state = before.filter(F.col("run") == newest).filter("target_id is not null").select("target_id", "side", "alerted_on")
    events = Tg.plan_alerts(targets, state, closes, holdings)
    after = Tg.advance_state(targets, state, events, delivered)
    # A run that leaves no alert outstanding still has a state: one empty row stands for it.
    none = spark.createDataFrame([(None, None, None)], ALERT_STATE)
    after.unionByName(none).write.mode("overwrite").parquet(f"{store}/run={day}")
    return events


def new_alerts(targets: DataFrame, prices: DataFrame, holdings: DataFrame, since) -> DataFrame:
    """Alerts and re-armings that fall on or after a day."""
    return Tg.alerts(Tg.target_days(targets, prices, holdings)).filter(F.col("trade_date") >= F.lit(since).cast("date"))
