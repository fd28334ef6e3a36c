"""The exchange's daily board (JSON keyed by code) and its archive: quotes, gaps and backfill windows."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import positive

FIELDS = ["open", "high", "low", "close", "ycp", "trades", "volume", "value", "yearly_high", "yearly_low"]

# Fixed values.
WINDOW_DAYS = 300
SLACK = 0.001


def read_board(boards: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable quotes, and a reason for every wanted symbol that a board lists without one.

    ``boards`` hold (board_id, payload); codes match whatever their case.  Money
    comes in millions, and a zero price means there was no trade.  Symbols that
    a board does not list are named for the run's own board only, the one with
    the largest board_id; an archive would give boards times symbols.
    """
    item = "struct<" + ", ".join(f"{f}: string" for f in FIELDS + ["updated_at"]) + ">"
    parsed = boards.select("board_id", F.from_json("payload", f"map<string, {item}>").alias("_m"))
    quoted = parsed.select("board_id", F.posexplode("_m").alias("_i", "_k", "_v")).groupBy("board_id", F.upper("_k").alias("symbol")).agg(F.max_by("_v", "_i").alias("_v"))
    names = wanted.select(F.upper("symbol").alias("symbol")).distinct()
    listed = quoted.filter("_v is not null").join(names, "symbol", "left_semi")
    number = {f: F.col(f"_v.{f}").try_cast("double") for f in FIELDS}
    priced = {f: positive(number[f]) for f in ("open", "high", "low", "close", "ycp", "yearly_high", "yearly_low")}
    stamp = F.regexp_extract(F.col("_v.updated_at"), r"^(\d{4}-\d{2}-\d{2})", 1)
    rows = listed.select(
        "board_id", "symbol", F.try_to_date(F.nullif(stamp, F.lit("")), "yyyy-MM-dd").alias("trade_date"),
        *[c.alias(f) for f, c in priced.items()], number["volume"].alias("volume"), number["trades"].alias("trades"),
        (F.floor(number["value"] * 1e6 * 100 + 0.5) / 100).alias("turnover"),
    )
    hi, lo, close = F.col("high"), F.col("low"), F.col("close")
    reason = (
        F.when(close.isNull(), "close missing").when(F.col("trade_date").isNull(), "day unreadable")
        .when(hi < lo, "day's high under its low").when(close > hi * (1 + SLACK), "close over the day's high").when(close < lo * (1 - SLACK), "close under the day's low")
    )
    rows = rows.withColumn("reason", reason)
    newest = parsed.filter("_m is not null").agg(F.max("board_id").alias("board_id"))
    absent = names.join(listed.filter(F.col("board_id") == newest.scalar()).select("symbol"), "symbol", "left_anti")
    missing = absent.select(newest.scalar().alias("board_id"), "symbol", F.lit("missing from the board").alias("reason")).filter("board_id is not null")
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null").select("board_id", "symbol", "reason").unionByName(missing)


def backfill_windows(ranges: DataFrame, newest: int | None = None) -> DataFrame:
    """Fetch windows per symbol, counted back from the newest day: (symbol, start, end); all of them, or the `newest` ones."""
    step = WINDOW_DAYS + 1
    n = F.floor(F.datediff("end", "start") / step) + 1
    n = (n if newest is None else F.least(n, F.lit(newest))).cast("int")
    at = ranges.filter("start <= end").select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("_i"))
    to = F.date_sub("end", (F.col("_i") * step).cast("int"))
    return at.select("symbol", F.greatest("start", F.date_sub(to, WINDOW_DAYS)).alias("from_date"), to.alias("to_date")).orderBy("symbol", "from_date")


def window_coverage(windows: DataFrame, fetched: DataFrame) -> DataFrame:
    """Rows each window brought; empty ones are before the archive starts, or gaps."""
    days = fetched.select("symbol", "trade_date").distinct()
    # Windows lie on a grid counted back from a symbol's newest one, so a day knows the number of its window.
    newest = windows.groupBy("symbol").agg(F.max("to_date").alias("_newest"))
    nth = lambda day: F.floor(F.datediff("_newest", day) / (WINDOW_DAYS + 1))
    brought = days.join(newest, "symbol").filter(F.col("trade_date") <= F.col("_newest")).withColumn("_nth", nth("trade_date"))
    held = windows.join(newest, "symbol").withColumn("_nth", nth("to_date"))
    oldest = held.groupBy("symbol").agg(F.min("from_date").alias("_oldest"))
    counts = brought.join(oldest, "symbol").filter(F.col("trade_date") >= F.col("_oldest")).groupBy("symbol", "_nth").agg(F.count(F.lit(1)).alias("rows"))
    per = held.join(counts, ["symbol", "_nth"], "left").select("symbol", "from_date", "to_date", F.coalesce("rows", F.lit(0)).alias("rows"))
    first = days.groupBy("symbol").agg(F.min("trade_date").alias("earliest"))
    j = per.join(first, "symbol", "left")
    status = F.when(F.col("rows") > 0, "filled").when(F.col("to_date") < F.col("earliest"), "before archive").otherwise("gap")
    return j.select("symbol", "from_date", "to_date", "rows", status.alias("status"))
