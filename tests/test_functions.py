import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillfolio.functions import dates as D
from quillfolio.functions import numeric as N
from quillfolio.functions import text as X


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def day(text):
    return F.lit(text).cast("date")


@pytest.mark.parametrize("x, want", [(2.345, 2.35), (-2.5, -2.0), (0.125, 0.13)])
def test_halves_round_up(spark, x, want):
    assert value(spark, N.round_half_up(F.lit(x), 0 if x == -2.5 else 2)) == want


def test_ratio_growth_cagr_refuse_to_invent(spark):
    assert value(spark, N.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert value(spark, N.growth(F.lit(5.0), F.lit(-1.0))) is None
    assert value(spark, N.cagr(F.lit(100.0), F.lit(121.0), F.lit(2))) == pytest.approx(0.1)
    assert value(spark, N.cagr(F.lit(0.0), F.lit(1.0), F.lit(2))) is None


@pytest.mark.parametrize("text, want", [("(1,234.5)", -1234.5), ("৳ 12", 12.0), ("—", None), ("N/A", None), ("12a", None), ("", None), (".5", 0.5)])
def test_reported_numbers(spark, text, want):
    assert value(spark, N.reported_number(F.lit(text))) == want


@pytest.mark.parametrize("text, want", [("1.02M", 1020000.0), ("261.29 k", 261290.0), ('"1,234"', 1234.0), ("-", None), ("abc", None), ("-3.5", -3.5)])
def test_cell_numbers(spark, text, want):
    assert value(spark, N.cell_number(F.lit(text))) == pytest.approx(want) if want is not None else value(spark, N.cell_number(F.lit(text))) is None


@pytest.mark.parametrize("text, month_first, want", [
    ("2026-09-22 10:00", False, "2026-09-22"), ("22-Sep-2026", False, "2026-09-22"), ("22 September 2026", False, "2026-09-22"), ("Sep 22, 2026", False, "2026-09-22"),
    ("05/09/2026", False, "2026-09-05"), ("05/09/2026", True, "2026-05-09"), ("13/13/2026", False, None), ("2026/09/22", False, None), ("22-Foo-2026", False, None),
])
def test_dates_read(spark, text, month_first, want):
    got = value(spark, D.read_date(F.lit(text), F.lit(month_first)))
    assert got == (dt.date.fromisoformat(want) if want else None)


def test_fiscal_years_abut_and_overflow(spark):
    for m, d in ((3, 31), (6, 30), (12, 31), (2, 29)):
        end = value(spark, D.fiscal_year_end(F.lit(m), F.lit(d), F.lit(2025)))
        start = value(spark, D.fiscal_year_start(F.lit(m), F.lit(d), F.lit(2026)))
        assert start == value(spark, F.date_add(D.shifted_date(F.lit(2025), F.lit(m), F.lit(d)), 1)) and end < start
    assert value(spark, D.fiscal_year_of(F.lit(6), F.lit(30), day("2025-07-01"))) == 2026
    assert value(spark, D.latest_reported_fiscal_year(F.lit(6), F.lit(30), day("2026-09-20"))) == 2025


@pytest.mark.parametrize("date, want", [("2025-07-01", 2025), ("2026-06-30", 2025), ("2026-07-01", 2026)])
def test_income_years(spark, date, want):
    assert value(spark, D.income_year(day(date))) == want


def test_trading_calendar_against_counting(spark):
    start = dt.date(2026, 9, 1)
    trading = lambda d: d.isoweekday() not in (5, 6)
    for i in range(15):
        for j in (0, 1, 5, 20):
            a, b = start + dt.timedelta(days=i), start + dt.timedelta(days=i + j)
            want = sum(trading(a + dt.timedelta(days=k)) for k in range(1, j + 1))
            assert value(spark, D.trading_days_between(F.lit(a), F.lit(b))) == want
        before = a - dt.timedelta(days=1)
        while not trading(before):
            before -= dt.timedelta(days=1)
        assert value(spark, D.previous_trading_day(F.lit(a))) == before


def test_expected_close_and_freshness(spark):
    # 12:00 UTC is 18:00 at the exchange.
    assert value(spark, D.expected_latest_close(F.lit("2026-09-21 12:00:00").cast("timestamp"))) == dt.date(2026, 9, 21)
    assert value(spark, D.expected_latest_close(F.lit("2026-09-21 11:59:00").cast("timestamp"))) == dt.date(2026, 9, 20)
    assert value(spark, D.freshness(day("2026-09-17"), day("2026-09-21"))) == "stale"
    assert value(spark, D.freshness(F.lit(None).cast("date"), day("2026-09-21"))) == "none"


def test_text(spark):
    assert value(spark, X.name_tokens(F.lit("The Square Pharma. Co. Ltd."))) == ["square", "pharma"]
    assert value(spark, X.company_from_file(F.lit("Square_Pharma Stock-Price History (2).csv"))) == "Square Pharma"
    assert value(spark, X.cell_text(F.lit("<b>A&nbsp;&amp;B</b> &hellip; "))) == "A &B"
    assert value(spark, X.split_cells(F.lit('a,"b, ""c""",,d'), ",")) == ["a", 'b, "c"', "", "d"]
    assert value(spark, X.delimiter_of(F.lit("a;b;c,d"))) == ";"
