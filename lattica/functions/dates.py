"""Calendar period keys and lenient date parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.numeric import col


def period_key(date: str | Column, frequency: str) -> Column:
    """The period a date falls in: D, W-FRI (weeks end on Friday) or M."""
    date = col(date)
    name = frequency.upper()
    if name == "D":
        return date
    if name == "W-FRI":
        return F.date_trunc("week", F.date_add(date, 2)).cast("date")
    if name == "M":
        return F.date_trunc("month", date).cast("date")
    raise ValueError(f"unsupported frequency {frequency!r}; use D, W-FRI or M")


def lenient_date(text: str | Column) -> Column:
    """Parse ISO, slashed or compact dates (a trailing .0 is dropped); else NULL."""
    text = F.regexp_replace(F.trim(col(text).cast("string")), r"\.0$", "")
    return F.coalesce(
        F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd")),
        F.try_to_date(text, "yyyy-MM-dd"),
        F.try_to_date(text, "yyyy/MM/dd"),
        F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"),
    )
