"""Matching company names by prefix of their words, refusing ties."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import name_tokens


def _prefixes(tokens):
    return F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda n: F.array_join(F.slice(tokens, F.lit(1), n), " "))


def match_companies(names: DataFrame, companies: DataFrame) -> DataFrame:
    """Symbol of the company each distinct name means, or null.

    ``names`` hold (company_name); ``companies`` hold (symbol, name, short_name).
    One name's words must begin the other's; the longest shared beginning wins
    and a tie is refused.  Every prefix is counted once, so a common first word
    never pairs all its names with all its companies.
    """
    variants = companies.select("symbol", F.explode(F.array_compact(F.array("name", "short_name", "symbol"))).alias("_v"))
    known = variants.select("symbol", name_tokens(F.col("_v")).alias("_t")).filter(F.size("_t") > 0)
    whole = known.groupBy(F.array_join("_t", " ").alias("prefix")).agg(
        F.count_distinct("symbol").alias("whole_n"), F.min("symbol").alias("whole_symbol")
    )
    begins = known.select("symbol", F.explode(_prefixes(F.col("_t"))).alias("prefix")).groupBy("prefix").agg(
        F.count_distinct("symbol").alias("begin_n"), F.min("symbol").alias("begin_symbol")
    )
    asked = names.select("company_name").distinct().withColumn("_t", name_tokens(F.col("company_name"))).filter(F.size("_t") > 0)
    tries = asked.select("company_name", F.size("_t").alias("_len"), F.posexplode(_prefixes(F.col("_t"))).alias("_i", "prefix"))
    j = tries.join(whole, "prefix", "left").join(begins, "prefix", "left")
    # All of the name's words begin a company's: that is the highest score there is.
    full = (F.col("_i") + 1 == F.col("_len")) & F.col("begin_n").isNotNull()
    best = j.groupBy("company_name").agg(
        F.max(F.when(full, F.struct(F.col("begin_n").alias("n"), F.col("begin_symbol").alias("s")))).alias("_full"),
        F.max(F.when(F.col("whole_n").isNotNull(), F.struct("_i", F.col("whole_n").alias("n"), F.col("whole_symbol").alias("s")))).alias("_part"),
    )
    n = F.when(F.col("_full").isNotNull(), F.col("_full.n")).otherwise(F.col("_part.n"))
    s = F.when(F.col("_full").isNotNull(), F.col("_full.s")).otherwise(F.col("_part.s"))
    return names.select("company_name").distinct().join(best.select("company_name", F.when(n == 1, s).alias("symbol")), "company_name", "left")
