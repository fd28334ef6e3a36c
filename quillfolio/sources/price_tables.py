"""Daily prices from delimited files and HTML tables: columns by meaning, dates by file.

All readers end in the same place: a heading row per file and body rows of
cells, from which ``read_price_rows`` gives good rows and a full reject log.
"""
from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dates import SLASHED, read_date
from ..functions.numeric import cell_number, clean_cell
from ..functions.text import delimiter_of, html_rows, split_cells
from .scratch import written

#: A task reads fewer rows than this.
_ROWS = 2**33

# Heading names per field; earlier names win over later ones.
ALIASES = {
    "date": ["date", "tradedate", "trade date", "trading date", "time", "timestamp", "day"],
    "close": ["close", "closep", "close price", "closing price", "closeprice", "ltp", "last", "last price", "lastprice", "close*", "price"],
    "open": ["open", "openp", "open price", "openprice", "opening price"],
    "high": ["high", "highp", "high price", "day high"],
    "low": ["low", "lowp", "low price", "day low"],
    "volume": ["volume", "vol", "trade volume", "shares traded", "quantity", "qty"],
    "symbol": ["symbol", "trading code", "tradingcode", "code", "instrument", "ticker", "scrip"],
}


def once(df: DataFrame, keep: list[str], computed: dict[str, Column]) -> DataFrame:
    """Columns computed once per row, whatever is filtered on them later.

    A filter is pushed through a projection by copying its expressions into the
    condition, which for cell reading means every pattern many times over; it is
    not pushed through a generator, so the row is built by one.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in computed.items()]))))


def heading_names(cells: Column) -> Column:
    """Headings in lower case, marks as blanks."""
    def plain(cell: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(F.lower(clean_cell(cell)), "[_.]", " "), r"\s+", " "))

    return F.transform(cells, plain)


def column_index(names: Column, aliases: list[str]) -> Column:
    """Zero-based place of the first alias present; null if none is."""
    bare = F.transform(names, lambda h: F.trim(F.replace(h, F.lit("*"), F.lit(""))))

    def place(alias: str) -> Column:
        hit = lambda arr: F.nullif(F.array_position(arr, alias), F.lit(0))
        return F.least(hit(names), hit(bare)) - 1

    return F.coalesce(*[place(a) for a in aliases]).cast("int")


def read_price_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of many price files, with an order that follows each file.

    Files are read split by split; a split's place in the file and the row's
    place in the split order the lines.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_ROWS - 1)).alias("_n"), F.col("value").alias("line"),
    )
    # The split's byte offset, then the row's place within the task: one number of fixed width, so that aggregations by it can hash.
    return raw.select("file", (F.col("_at").cast("decimal(19,0)") * F.lit(Decimal(_ROWS)) + F.col("_n")).cast("decimal(38,0)").alias("line_no"), "line")


def cells_of_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Heading cells per file and body cells per line.

    A file's heading is found by its line number, a minimum that hashes, and its text joined
    back by that number; the headings, a row a file, are written to a scratch table.
    """
    rows = lines.filter(F.trim(F.regexp_replace("line", r"\s+", " ")) != "").withColumn("line", F.regexp_replace("line", "\r$", ""))
    first = rows.groupBy("file").agg(F.min("line_no").alias("line_no"))
    found = rows.join(first, ["file", "line_no"]).select("file", F.col("line").alias("_head"), F.col("line_no").alias("_at"))
    heads = written(found.withColumn("_delimiter", delimiter_of(F.col("_head"))))

    def cells(text: Column) -> Column:
        d = F.col("_delimiter")
        return F.when(d == "\t", split_cells(text, "\t")).when(d == ";", split_cells(text, ";")).otherwise(split_cells(text, ","))

    body = rows.join(heads, "file").filter("line_no > _at").select("file", "line_no", cells(F.col("line")).alias("cells"), F.col("line").alias("raw"))
    return heads.select("file", cells(F.col("_head")).alias("headings")), body


def cells_of_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same from HTML: the first table headed by a date and a closing price.

    ``pages`` hold (file, html).
    """
    def fits(table: Column) -> Column:
        names = F.transform(F.get(table, F.lit(0)), lambda h: F.trim(F.replace(F.lower(h), F.lit("*"), F.lit(""))))
        return (F.size(table) >= 2) & F.exists(names, lambda h: h == "date") & F.exists(names, lambda h: h.startswith("closep") | h.isin("close", "ltp"))

    tables = F.transform(html_rows(F.col("html")), lambda t: F.filter(t, lambda r: F.size(r) > 1))
    picked = pages.select("file", F.get(F.filter(tables, fits), F.lit(0)).alias("_t")).filter("_t is not null")
    heads = picked.select("file", F.get("_t", F.lit(0)).alias("headings"))
    body = picked.select("file", F.posexplode("_t").alias("line_no", "cells")).filter("line_no > 0")
    return heads, body.select("file", "line_no", "cells", F.array_join("cells", ",").alias("raw"))


def file_columns(heads: DataFrame) -> DataFrame:
    """Where each file keeps each field."""
    names = heads.withColumn("_names", heading_names(F.col("headings")))
    return names.select("file", *[column_index(F.col("_names"), a).alias(f"at_{f}") for f, a in ALIASES.items()])


def date_orders(body: DataFrame, columns: DataFrame) -> DataFrame:
    """Which way round each file writes slashed dates, from all of its rows."""
    cell = {"_date": clean_cell(F.get("cells", F.col("at_date")))}
    return _date_orders(once(body.join(columns.select("file", "at_date"), "file").filter("at_date is not null"), ["file"], cell))


def _date_orders(dated: DataFrame) -> DataFrame:
    cell = F.col("_date")
    part = lambda g: F.regexp_extract(cell, SLASHED, g).try_cast("int") > 12
    seen = dated.groupBy("file").agg(
        F.bool_or(part(1)).alias("_d"), F.bool_or(part(2)).alias("_m"), F.count_if(cell.rlike(SLASHED)).alias("slashed")
    )
    day, month = F.coalesce("_d", F.lit(False)), F.coalesce("_m", F.lit(False))
    return seen.select(
        "file", "slashed", (month & ~day).alias("month_first"), (day != month).alias("certain"), (day & month).alias("conflict")
    )


def read_price_rows(heads: DataFrame, body: DataFrame, fallback_symbol: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Good rows (a repeated day's later line wins) and rejects with their reason.

    Each line is cut into cells once; the cells that matter are written to a scratch
    table, from which the files' date orders and then the rows are read.
    """
    columns = file_columns(heads)
    padding = F.forall("cells", lambda c: clean_cell(c) == "")
    at = lambda field: F.get("cells", F.col(f"at_{field}"))
    symbol = F.when(F.col("at_symbol").isNotNull(), F.nullif(F.upper(clean_cell(at("symbol"))), F.lit(""))).otherwise(F.lit(fallback_symbol))
    picked = written(once(body.join(columns, "file").filter(~padding), ["file", "line_no", "raw", "at_date", "at_close"], {
        "symbol": symbol, **{f"_{f}": clean_cell(at(f)) for f in ("date", "close", "open", "high", "low", "volume")},
    }))
    orders = _date_orders(picked.filter("at_date is not null"))
    at = lambda field: F.col(f"_{field}")
    rows = once(picked.join(orders, "file", "left"), ["file", "line_no", "raw", "symbol"], {
        "trade_date": read_date(at("date"), F.coalesce("month_first", F.lit(False)), cleaned=True),
        **{f: cell_number(at(f), cleaned=True) for f in ("close", "open", "high", "low")}, "volume": F.floor(cell_number(at("volume"), cleaned=True) + 0.5),
        "_file_issue": F.when(F.col("at_date").isNull(), "date column missing").when(F.col("at_close").isNull(), "close column missing")
        .when(F.col("conflict"), "day and month order is unclear"),
    })
    reason = (
        F.when(F.col("_file_issue").isNotNull(), F.col("_file_issue")).when(F.col("trade_date").isNull(), "unreadable date")
        .when(F.col("close").isNull(), "unreadable close").when(F.col("close") <= 0, "close not positive")
    )
    rows = rows.withColumn("reason", reason)
    fields = ["close", "open", "high", "low", "volume"]
    # Column by column: numbers of fixed width keep this a hash aggregation.
    good = rows.filter("reason is null").groupBy("file", "symbol", "trade_date").agg(*[F.max_by(f, "line_no").alias(f) for f in fields])
    return good, rows.filter("reason is not null").select("file", "line_no", "raw", "reason")


def clean_rows(rows: DataFrame) -> DataFrame:
    """Re-check of rows sent back for import: each with the first rule it breaks, or null."""
    bad = lambda c: F.col(c) < 0
    reason = (
        F.when(~F.coalesce(F.col("symbol").rlike(r"^[A-Z0-9][A-Z0-9&\-.]{0,19}$"), F.lit(False)), "symbol")
        .when(F.col("trade_date").isNull(), "date").when(~F.coalesce(F.col("close") > 0, F.lit(False)), "close")
        .when(bad("open") | bad("high") | bad("low"), "negative price").when(bad("volume"), "negative volume")
    )
    return rows.withColumn("reason", reason)
