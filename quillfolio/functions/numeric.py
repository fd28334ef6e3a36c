"""Null-safe arithmetic and number reading, as column expressions.

Missing is never zero: each helper returns null where the answer is undefined.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Reporting scales, in base currency units.
SCALE_FACTORS = {
    "unit": 1.0,
    "thousand": 1_000.0,
    "lakh": 100_000.0,
    "million": 1_000_000.0,
    "crore": 10_000_000.0,
    "billion": 1_000_000_000.0,
}

# Suffixes used for abbreviated volumes.
SUFFIX_FACTORS = {"K": 1e3, "M": 1e6, "B": 1e9}


def lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that is null for a missing or zero denominator."""
    return F.try_divide(numerator, denominator)


def growth(current: Column, previous: Column) -> Column:
    """Relative change; undefined from a base that is not positive."""
    return F.when(previous > 0, F.try_divide(current, previous) - 1)


def mean_of_known(a: Column, b: Column) -> Column:
    """Mean of two figures, or the one that is known."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise((a + b) / 2)


def cagr(first: Column, last: Column, years: Column) -> Column:
    ok = (years > 0) & (first > 0) & (last > 0)
    return F.when(ok, F.pow(F.try_divide(last, first), F.try_divide(F.lit(1.0), years)) - 1)


def round_half_up(value: Column, digits: int = 2) -> Column:
    """Round with halves going towards positive infinity."""
    unit = float(10**digits)
    return F.floor(value * unit + F.lit(0.5)) / unit


def positive(value: Column) -> Column:
    """The value if it is above zero, else null."""
    return F.when(value > 0, value)


def scale_factor(scale: Column) -> Column:
    pairs = [F.lit(x) for kv in SCALE_FACTORS.items() for x in kv]
    return F.create_map(*pairs)[scale]


def to_base(reported: Column, scale: Column) -> Column:
    return reported * scale_factor(scale)


def from_base(base: Column, scale: Column) -> Column:
    return base / scale_factor(scale)


def natural_scale(base: Column) -> Column:
    size = F.abs(base)
    return (
        F.when(size >= SCALE_FACTORS["crore"], "crore")
        .when(size >= SCALE_FACTORS["lakh"], "lakh")
        .when(base.isNotNull(), "unit")
    )


def clean_cell(text: Column) -> Column:
    """Cell text without surrounding blanks and one layer of quotes."""
    return F.regexp_replace(text, r"""^\s*["']?\s*|\s*["']?\s*$""", "")


def reported_number(text: Column) -> Column:
    """Number as printed in an annual report: commas, currency sign, (negatives)."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    bare = F.regexp_replace(trimmed, r"[(),\s৳]", "")
    value = F.when(bare.rlike(r"^-?\d*\.?\d+$"), bare.try_cast("double"))
    signed = F.when(trimmed.rlike(r"^\(.*\)$"), -F.abs(value)).otherwise(value)
    return F.when(~trimmed.isin("", "-", "—", "N/A"), signed)


def cell_number(text: Column, cleaned: bool = False) -> Column:
    """Number in a price file: commas dropped, K/M/B suffixes expanded."""
    bare = F.replace(text if cleaned else clean_cell(text), F.lit(","), F.lit(""))
    suffix = F.upper(F.regexp_extract(bare, r"^-?\d*\.?\d+\s*([KMBkmb])$", 1))
    stem = F.regexp_extract(bare, r"^(-?\d*\.?\d+)\s*[KMBkmb]$", 1).try_cast("double")
    factor = F.create_map(*[F.lit(x) for kv in SUFFIX_FACTORS.items() for x in kv])[suffix]
    # The common case first, so that most cells meet one pattern only.
    return (
        F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))
        .when(bare.isin("", "-", "N/A"), None).when(suffix != "", stem * factor)
    )


def same_number(a: Column, b: Column) -> Column:
    """Equal within one part in a billion of the larger of the two (or of one)."""
    size = F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    return (a == b) | (F.abs(a - b) / size < 1e-9)


def near(a: Column, b: Column, tolerance) -> Column:
    return F.abs(a - b) <= lit(tolerance) + 1e-9
