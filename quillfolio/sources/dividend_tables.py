"""Declared dividends from pasted tables, with or without headings, text or HTML."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import read_date
from ..functions.numeric import cell_number, clean_cell
from ..functions.text import cell_text, delimiter_of, html_rows, split_cells
from ..operators.dividends import looks_restated
from .price_tables import column_index, heading_names, once

# Heading names per field; earlier names win over later ones.
ALIASES = {
    "ex": ["ex-dividend date", "ex dividend date", "ex date", "ex-date", "exdate", "ex"],
    "amount": ["dividend", "cash dividend", "amount", "dividend per share", "dps", "dividend amount", "rate"],
    "payment": ["payment date", "pay date", "paid on", "payable", "payment"],
    "kind": ["type", "frequency", "kind"],
}


def table_rows(docs: DataFrame) -> DataFrame:
    """Cells of each document's table: (doc_id, pos, cells)."""
    html = F.col("text").rlike(r"(?i)<t[dr]\b")
    tables = html_rows(F.col("text"))
    widest = F.aggregate(tables, F.array().cast("array<array<string>>"), lambda best, t: F.when(F.size(t) > F.size(best), t).otherwise(best))
    loose = F.transform(
        F.regexp_extract_all("text", F.lit(r"(?is)(<tr.*?</tr>)"), 1),
        lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)(<t[dh].*?</t[dh]>)"), 1), cell_text),
    )
    rows = F.filter(F.when(F.size(widest) > 0, widest).otherwise(loose), lambda r: F.size(r) > 0)
    marked = docs.filter(html).select("doc_id", F.posexplode(rows).alias("pos", "cells"))

    lines = F.filter(F.split(F.trim("text"), r"\r?\n"), lambda l: F.trim(l) != "")
    plain = docs.filter(~html).select("doc_id", delimiter_of(F.get(lines, F.lit(0))).alias("_d"), F.posexplode(lines).alias("pos", "line"))

    def cells(d: str) -> Column:
        return F.transform(split_cells(F.col("line"), d), clean_cell)

    plain = plain.select("doc_id", "pos", F.when(F.col("_d") == ";", cells(";")).when(F.col("_d") == "\t", cells("\t")).otherwise(cells(",")).alias("cells"))
    return marked.unionByName(plain)


def read_dividends(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dividends (the first row of an ex date wins, empty amounts dropped) and unreadable rows."""
    rows = table_rows(docs)
    heads = rows.filter("pos = 0").select("doc_id", heading_names(F.col("cells")).alias("_n"))
    heads = heads.select("doc_id", *[column_index(F.col("_n"), a).alias(f"at_{f}") for f, a in ALIASES.items()])
    headed = F.col("at_ex").isNotNull() & F.col("at_amount").isNotNull()
    j = rows.join(heads, "doc_id").filter(~headed | (F.col("pos") > 0))
    at = lambda f: F.get("cells", F.col(f"at_{f}"))
    # Without headings: the first date, and the first amount above zero after it.
    j = once(j, j.columns, {"_dates": F.transform("cells", lambda c: read_date(c))})
    first = F.array_position(F.transform("_dates", lambda d: d.isNotNull()), True)
    after = F.slice("cells", F.greatest(first, F.lit(1)) + 1, F.size("cells"))
    loose_amount = F.get(F.filter(F.transform(after, lambda c: cell_number(c)), lambda v: v > 0), F.lit(0))
    loose_paid = F.get(F.filter(F.slice("_dates", F.greatest(first, F.lit(1)) + 1, F.size("cells")), lambda d: d.isNotNull()), F.lit(0))
    read = once(j, ["doc_id", "pos", "cells"], {
        "ex_date": F.when(headed, read_date(at("ex"))).otherwise(F.when(first > 0, F.get("_dates", (first - 1).cast("int")))),
        "amount": F.when(headed, cell_number(at("amount"))).otherwise(F.when(first > 0, loose_amount)),
        "payment_date": F.when(headed, read_date(at("payment"))).otherwise(F.when(first > 0, loose_paid)),
        "kind": F.when(headed, F.nullif(clean_cell(at("kind")), F.lit(""))),
    })
    ok = F.col("ex_date").isNotNull() & F.col("amount").isNotNull()
    good = read.filter(ok & (F.col("amount") > 0)).groupBy("doc_id", "ex_date").agg(F.min_by(F.struct("amount", "payment_date", "kind"), "pos").alias("_r"))
    good = good.select("doc_id", "ex_date", "_r.*").withColumn("looks_restated", looks_restated(F.col("amount")))
    return good, read.filter(~ok).select("doc_id", "pos", F.array_join("cells", " | ").alias("raw"))
