"""Calendar columns."""

from pyspark.sql import Column, functions as F


def weekday0(d) -> Column:
    """Day of week with Monday = 0 … Sunday = 6."""
    return F.weekday(d).cast("int")


def iso_week(d) -> Column:
    """ISO-8601 week number (2012-12-31 is week 1)."""
    return F.weekofyear(d).cast("int")


def month_of(d) -> Column:
    return F.month(d).cast("int")


def week_start(d) -> Column:
    """Monday of the ISO week holding ``d`` as a DATE."""
    return F.to_date(F.date_trunc("week", d))


def date_text(d) -> Column:
    return F.date_format(d, "yyyy-MM-dd")
