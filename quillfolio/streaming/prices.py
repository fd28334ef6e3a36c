"""Daily price arrival: each batch is merged into the stored days by key.

The store is one Parquet folder partitioned by month.  A batch reads the months that it
touches, writes them whole to a staging folder, and overwrites just these
partitions from there (Spark's dynamic partition overwrite).  Late and corrected days are
accepted whenever they come (a key is replaced, not dropped), so there is no watermark.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.prices import merge_prices, replace_prices

KEY = ["symbol", "trade_date"]
FIELDS = ["close", "open", "high", "low", "volume", "turnover"]
STORED = "symbol string, trade_date date, " + ", ".join(f"{c} double" for c in FIELDS) + ", month int"


def _month(day: Column) -> Column:
    """yyyymm; 0 for a missing day."""
    return F.coalesce(F.year(day) * 100 + F.month(day), F.lit(0))


def _folder(spark: SparkSession, path: str):
    """A folder of any file system that Spark can write, and its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder_exists(spark: SparkSession, path: str) -> bool:
    folder, fs = _folder(spark, path)
    return fs.exists(folder)


def stored_days(spark: SparkSession, store: str, months: list[int] | None = None) -> DataFrame:
    """The stored days: all, or those of some months (as yyyymm), whose folders alone are read."""
    rows = spark.read.schema(STORED).parquet(store)
    return (rows if months is None else rows.filter(F.col("month").isin(months))).select(*KEY, *FIELDS)


def merge_days(spark: SparkSession, store: str, incoming: DataFrame, batch: int | str, keep_missing: bool = True) -> None:
    """Merge one batch of (symbol, trade_date, prices, arrived) into the store.

    A price column that the batch lacks is missing in all its rows.  Of a key that comes twice the row that
    arrived last counts.  `batch` names the batch's staging
    folder beside the store.  It is written whole before any month is overwritten and removed
    afterwards, so a batch that is replayed after a failure finishes from there and
    gives the same rows, whichever months had already been overwritten.
    """
    stage = f"{store.rstrip('/')}-staged/batch={batch}"
    if not folder_exists(spark, f"{stage}/_SUCCESS"):
        priced = incoming.select(*KEY, "arrived", *[(F.col(c) if c in incoming.columns else F.lit(None)).cast("double").alias(c) for c in FIELDS])
        newest = priced.groupBy(*KEY).agg(*[F.max_by(c, "arrived").alias(c) for c in FIELDS])
        merged = newest
        if folder_exists(spark, store):
            # Twelve numbers a year of the calendar, however many rows came.
            months = [r.month for r in incoming.select(_month(F.col("trade_date")).alias("month")).distinct().collect()]
            held = stored_days(spark, store, months)
            merged = merge_prices(held, newest, FIELDS) if keep_missing else replace_prices(held, newest)
        merged.withColumn("month", _month(F.col("trade_date"))).write.mode("overwrite").partitionBy("month").parquet(stage)
    rows = spark.read.schema(STORED).parquet(stage)
    # Rows of a month meet, so that it is a few files; Spark splits a month that is too large for one task.
    rows.hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(store)
    folder, fs = _folder(spark, stage)
    fs.delete(folder, True)


def merge_into_store(spark: SparkSession, store: str, keep_missing: bool = True) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink keeping the merged days under ``store``, read by ``stored_days``."""
    return lambda batch, epoch: merge_days(spark, store, batch, epoch, keep_missing)


def start_price_stream(source: DataFrame, store: str, checkpoint: str, keep_missing: bool = True) -> StreamingQuery:
    """Merge a stream of (symbol, trade_date, prices, arrived) into ``store`` until it is drained."""
    sink = merge_into_store(source.sparkSession, store, keep_missing)
    return source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
