"""Calendar arithmetic on whole months and the document date formats."""

from pyspark.sql import Column, functions as F


def month_no(day) -> Column:
    """Months since year 0, so that neighbouring months differ by one."""
    day = F.col(day) if isinstance(day, str) else day
    return F.year(day) * 12 + F.month(day) - 1


def month_from_no(number) -> Column:
    """First day of the month with this number."""
    number = F.col(number) if isinstance(number, str) else number
    return F.make_date(F.floor(number / 12).cast("int"), (number % 12 + 1).cast("int"), F.lit(1))


def months_apart(earlier, later) -> Column:
    """Calendar months from one date to another; the day of the month plays no part."""
    return month_no(later) - month_no(earlier)


def stamp(day, source, month_sources) -> Column:
    """The date a citation shows: whole months for sources that only know the month."""
    return F.when(F.col(source).isin(month_sources), F.trunc(day, "MM")).otherwise(F.col(day))


def dmy(text) -> Column:
    return F.try_to_date(text, "dd-MM-yyyy")


def dmony(text) -> Column:
    return F.try_to_date(text, "dd-MMM-yyyy")


def wage_month(text) -> Column:
    """Mon-yyyy as the first day of that month."""
    return F.try_to_date(F.concat(F.lit("01-"), text), "dd-MMM-yyyy")
