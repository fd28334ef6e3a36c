"""Company datasets given as arrays per figure, aligned by year, to long facts."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.fundamentals import PER_SHARE_TAGS


def load_dataset(sets: DataFrame) -> DataFrame:
    """``sets`` hold (symbol, fiscal_years array, data map of tag to array): one row per figure."""
    tags = sets.select("symbol", "fiscal_years", F.explode("data").alias("tag", "values"))
    rows = tags.select("symbol", "tag", F.inline(F.arrays_zip(F.col("fiscal_years").alias("fiscal_year"), F.col("values").alias("value_reported"))))
    return rows.filter("value_reported is not null and fiscal_year is not null").select(
        "symbol", "fiscal_year", "tag", "value_reported", F.when(F.col("tag").isin(PER_SHARE_TAGS), "unit").otherwise("million").alias("scale")
    )
