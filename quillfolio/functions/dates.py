"""Fiscal years, income years, trading days and date reading, as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import clean_cell

# Fixed values.
PUBLICATION_LAG_DAYS = 120
REPORTING_LAG_MONTHS = 4
CLOSE_HOUR = 18
EXCHANGE_UTC_OFFSET_HOURS = 6
MONTH_ABBREVIATIONS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def shifted_date(year: Column, month: Column, day: Column) -> Column:
    """A date whose month and day may overflow, rolling into what follows."""
    months = year * 12 + (month - 1)
    first = F.make_date(F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1))
    return F.date_add(first, (day - 1).cast("int"))


def fiscal_year_end(month: Column, day: Column, fiscal_year: Column) -> Column:
    return shifted_date(fiscal_year, month, day)


def fiscal_year_start(month: Column, day: Column, fiscal_year: Column) -> Column:
    return shifted_date(fiscal_year - 1, month, day + 1)


def fiscal_year_of(month: Column, day: Column, date: Column) -> Column:
    year = F.year(date)
    return F.when(date <= shifted_date(year, month, day), year).otherwise(year + 1)


def fiscal_quarter_start(month: Column, day: Column, fiscal_year: Column, quarter: Column) -> Column:
    start = fiscal_year_start(month, day, fiscal_year)
    return shifted_date(F.year(start), F.month(start) + (quarter - 1) * 3, F.dayofmonth(start))


def fiscal_quarter_end(month: Column, day: Column, fiscal_year: Column, quarter: Column) -> Column:
    return F.date_sub(fiscal_quarter_start(month, day, fiscal_year, quarter + 1), 1)


def latest_reported_fiscal_year(month: Column, day: Column, as_of: Column) -> Column:
    lagged = shifted_date(F.year(as_of), F.month(as_of) - REPORTING_LAG_MONTHS, F.dayofmonth(as_of))
    year = fiscal_year_of(month, day, lagged)
    return F.when(fiscal_year_end(month, day, year) <= lagged, year).otherwise(year - 1)


def fiscal_year_label(fiscal_year: Column) -> Column:
    return F.concat(F.lit("FY"), fiscal_year.cast("string"))


def fiscal_range_label(month: Column, day: Column, fiscal_year: Column) -> Column:
    fmt = "MMM yyyy"
    return F.concat(
        fiscal_year_label(fiscal_year), F.lit(" ("),
        F.date_format(fiscal_year_start(month, day, fiscal_year), fmt), F.lit(" – "),
        F.date_format(fiscal_year_end(month, day, fiscal_year), fmt), F.lit(")"),
    )


def fiscal_years_back(latest: Column, count: int) -> Column:
    return F.sequence(latest, latest - (count - 1), F.lit(-1))


def income_year(date: Column) -> Column:
    """Starting calendar year of the July-June income year a date falls in."""
    return F.year(date) - F.when(F.month(date) < 7, 1).otherwise(0)


def income_year_start(year: Column) -> Column:
    return F.make_date(year, F.lit(7), F.lit(1))


def income_year_end(year: Column) -> Column:
    return F.make_date(year + 1, F.lit(6), F.lit(30))


def income_year_label(year: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("–"), F.substring((year + 1).cast("string"), 3, 2))


def years_ago(date: Column, years: int) -> Column:
    """Same day some years back (29 February clips to the 28th)."""
    return F.add_months(date, -12 * years)


def is_trading_day(date: Column) -> Column:
    """Sunday to Thursday."""
    return F.dayofweek(date) <= 5


def _trading_days_to(date: Column) -> Column:
    """Trading days from a fixed Sunday up to and including ``date``."""
    days = F.datediff(date, F.lit("1899-12-31").cast("date")) + 1  # that Sunday is day 1
    weeks = F.floor(days / 7)
    return weeks * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(5))


def trading_days_between(start: Column, end: Column) -> Column:
    """Trading days after ``start`` up to and including ``end``; never negative."""
    return F.greatest(_trading_days_to(end) - _trading_days_to(start), F.lit(0)).cast("long")


def previous_trading_day(date: Column) -> Column:
    before = F.date_sub(date, 1)
    # Friday (6) steps back one day, Saturday (7) two.
    return F.date_sub(before, F.greatest(F.dayofweek(before) - 5, F.lit(0)))


def expected_latest_close(now: Column) -> Column:
    """Most recent session whose close should be known at a UTC timestamp."""
    local = now + F.make_dt_interval(hours=F.lit(EXCHANGE_UTC_OFFSET_HOURS))
    day = F.to_date(local)
    return F.when(is_trading_day(day) & (F.hour(local) >= CLOSE_HOUR), day).otherwise(previous_trading_day(day))


def missed_sessions(latest: Column, expected: Column) -> Column:
    return F.when(latest.isNull(), 0).otherwise(trading_days_between(latest, expected))


def freshness(latest: Column, expected: Column) -> Column:
    missed = trading_days_between(latest, expected)
    return (
        F.when(latest.isNull(), "none").when(missed == 0, "fresh").when(missed == 1, "behind").otherwise("stale")
    )


# Fixed patterns: the ways a date is written in a price or dividend table.
ISO = r"^(\d{4})-(\d{2})-(\d{2})"
DAY_NAMED_MONTH = r"^(\d{1,2})[-/ ]([A-Za-z]{3})[A-Za-z]*[-/ ](\d{4})$"
NAMED_MONTH_DAY = r"^([A-Za-z]{3})[A-Za-z]*\.?\s+(\d{1,2}),?\s+(\d{4})$"
SLASHED = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"


def _month_number(name: Column) -> Column:
    pairs = [F.lit(x) for i, m in enumerate(MONTH_ABBREVIATIONS, 1) for x in (m, i)]
    return F.create_map(*pairs)[F.lower(name)]


def _day(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def _valid_date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def read_date(text: Column, month_first: Column | None = None, cleaned: bool = False) -> Column:
    """First of ISO, named-month and slashed forms that fits; null if none does."""
    cell = text if cleaned else clean_cell(text)
    first, second = _day(cell, SLASHED, 1), _day(cell, SLASHED, 2)
    if month_first is None:
        month_first = F.lit(False)
    day = F.when(month_first, second).otherwise(first)
    month = F.when(month_first, first).otherwise(second)
    return (
        F.when(cell.rlike(ISO), F.try_to_date(F.substring(cell, 1, 10), "yyyy-MM-dd"))
        .when(
            cell.rlike(DAY_NAMED_MONTH),
            _valid_date(_day(cell, DAY_NAMED_MONTH, 3), _month_number(F.regexp_extract(cell, DAY_NAMED_MONTH, 2)), _day(cell, DAY_NAMED_MONTH, 1)),
        )
        .when(
            cell.rlike(NAMED_MONTH_DAY),
            _valid_date(_day(cell, NAMED_MONTH_DAY, 3), _month_number(F.regexp_extract(cell, NAMED_MONTH_DAY, 1)), _day(cell, NAMED_MONTH_DAY, 2)),
        )
        .when(cell.rlike(SLASHED), _valid_date(_day(cell, SLASHED, 3), month, day))
    )
