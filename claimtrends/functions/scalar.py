"""Column expressions. All are built-in functions, so they stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    """A rule outcome that is never null: unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient where the denominator is positive, else null."""
    return F.when(denominator > 0, numerator / denominator)


def round_to(value: Column, digits: int) -> Column:
    """Round half to even after scaling, the way numpy rounds."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def ratio_or_zero(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    """Quotient rounded for display, 0 where the denominator is not positive."""
    return F.when(denominator > 0, round_to(numerator / denominator, digits)).otherwise(
        F.lit(0.0)
    )


def to_number(text: Column) -> Column:
    """Text to double, null when it is no number."""
    return text.try_cast("double")


def to_whole(text: Column, kind: str) -> Column:
    """Text to ``int`` or ``bigint``: decimals are cut (12.7 is 12, -0.9 is 0), no number is null."""
    return F.coalesce(text.try_cast(kind), text.try_cast("double").try_cast(kind))


def digits_padded(code: Column, width: int = 11) -> Column:
    """Keep the digits of a code and pad them with zeros on the left."""
    return F.lpad(F.regexp_replace(code, "[^0-9]", ""), width, "0")


def quarter_start(year: Column, quarter: Column) -> Column:
    """First day of a quarter, null for a null or impossible one."""
    usable = quarter.between(1, 4) & year.between(1, 9999)
    return F.when(usable, F.make_date(year, quarter * 3 - 2, F.lit(1)))


def quarter_index(day: Column) -> Column:
    """Quarters since the first quarter of 2000."""
    return (F.year(day) - 2000) * 4 + F.quarter(day) - 1


def next_quarter_start(day: Column, steps: Column) -> Column:
    """Start of the quarter ``steps`` after the one that starts on ``day``."""
    return F.add_months(day, steps * 3)


def calendar_quarter_end(day: Column, steps: Column) -> Column:
    """The ``steps``-th quarter end on or after ``day``."""
    return F.last_day(F.add_months(F.date_trunc("quarter", day).cast("date"), steps * 3 - 1))
