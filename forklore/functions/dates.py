"""Date functions. ``as_of`` is always an argument, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 text with ``Z`` or an offset to a timestamp, NULL if malformed."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))


def age_in_days(moment: Column, as_of: Column) -> Column:
    return F.datediff(as_of, moment)


def whole_years_between(start: Column, end: Column) -> Column:
    """Days divided by 365, the fraction cut toward zero; leap days are not considered."""
    return (F.datediff(end, start) / F.lit(365)).cast("int")


def months_before(moment: Column, months: int = 3) -> Column:
    return F.add_months(F.to_date(moment), -months)


def year_bucket(first: Column, as_of: Column, cap: int) -> Column:
    """Full years of history, at most ``cap``."""
    return F.least(F.lit(cap), F.floor(F.months_between(as_of, first) / 12).cast("int"))


def pr_state(closed_at: Column, merged_at: Column) -> Column:
    return (
        F.when(closed_at.isNull(), "open").when(merged_at.isNull(), "closed").otherwise("merged")
    )
