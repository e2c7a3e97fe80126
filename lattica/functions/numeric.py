"""Null-safe numeric column helpers (ANSI mode stays on)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: str | Column) -> Column:
    """NaN and the infinities become NULL; NULL is the only missing value."""
    value = col(value).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def ratio(top, bottom) -> Column:
    return F.try_divide(col(top), col(bottom))


def positive(value: str | Column) -> Column:
    value = col(value)
    return F.when(value > 0, value)


def any_of(terms) -> Column:
    return reduce(lambda a, b: a | b, terms)


def all_of(terms) -> Column:
    return reduce(lambda a, b: a & b, terms)


def flag(value: str | Column) -> Column:
    return F.coalesce(col(value), F.lit(False))


def paired(x: Column, y: Column) -> tuple[Column, Column]:
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def pearson(x: str | Column, y: str | Column) -> Column:
    """Pairwise-complete correlation as an aggregate; a constant side gives NULL.

    Built from moments because ``corr`` raises on a constant side in ANSI mode.
    """
    a, b = paired(col(x), col(y))
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def pearson_over(x: Column, y: Column, frame: WindowSpec) -> Column:
    a, b = paired(x, y)
    return F.try_divide(
        F.covar_samp(a, b).over(frame),
        F.stddev_samp(a).over(frame) * F.stddev_samp(b).over(frame),
    )


def at_least(count_of: Column, frame: WindowSpec, minimum: int, value: Column) -> Column:
    """Keep a rolling value only where the frame holds enough observations."""
    return F.when(F.count(count_of).over(frame) >= minimum, value)


def row_mean(columns) -> Column:
    """Mean of the non-null members of a row; NULL when all are null."""
    total = reduce(lambda a, b: a + b, [F.coalesce(col(c), F.lit(0.0)) for c in columns])
    return F.try_divide(total, present(columns).cast("double"))


def present(columns) -> Column:
    return reduce(lambda a, b: a + b, [col(c).isNotNull().cast("int") for c in columns])


def clip(value: Column, low: Column, high: Column) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once inside a lambda, where common subexpressions are not shared."""
    return F.element_at(F.transform(F.array(value), body), 1)
