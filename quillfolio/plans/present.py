"""Fix the columns, types and rounding of a result, so that it can be compared.

A spec is ``name[:kind]`` items: a digit rounds a number to that many decimals,
``i`` is a whole number, ``b`` a boolean, ``d`` a date (written ISO), and no
kind is text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


# Halves go up; the extra thousandth keeps an exact half that last-bit noise has
# pushed just under it on the same side.
HALF = 0.501


def _column(item: str) -> Column:
    name, _, kind = item.partition(":")
    if kind.isdigit():
        unit = float(10 ** int(kind))
        return (F.floor(F.col(name).cast("double") * unit + F.lit(HALF)) / unit).alias(name)
    return F.col(name).cast({"": "string", "d": "string", "i": "long", "b": "boolean"}[kind]).alias(name)


def present(df: DataFrame, spec: str) -> DataFrame:
    return df.select(*[_column(item) for item in spec.split()])
