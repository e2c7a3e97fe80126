"""Composite scores from oriented factor columns."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.numeric import finite, flag, present, row_mean
from lattica.functions.symbols import category_for
from lattica.operators.checks import require_columns
from lattica.operators.preprocess import DATE, zscore
from lattica.operators.sections import WHOLE, Layout


def equal_weight_composite(
    scores: DataFrame, names, minimum_valid: int, start=None, layout: Layout = WHOLE
) -> DataFrame:
    """Mean of the present scores, standardised per date, inside the universe and period."""
    names = list(names)
    count = present(names)
    work = scores.withColumns(
        {"valid_factor_count": count, "composite_raw": F.when(count >= minimum_valid, row_mean(names))}
    )
    work = zscore(work, "composite_raw", "factor_processed", DATE, layout)
    keep = flag("in_universe")
    if start is not None:
        keep = keep & (F.col("trade_date") >= F.lit(start).cast("date"))
    return work.withColumn("factor_processed", F.when(keep, F.col("factor_processed")))


def weighted_raw(weights: dict[str, float], minimum_coverage: float) -> tuple[Column, Column]:
    """(valid count, sum w x / sum |w| over present scores)."""
    active = {n: float(w) for n, w in weights.items() if float(w) != 0.0}
    values = {n: finite(n) for n in active}
    count = present(list(values.values()))
    top = sum((F.coalesce(v, F.lit(0.0)) * active[n] for n, v in values.items()), F.lit(0.0))
    bottom = sum((v.isNotNull().cast("double") * abs(active[n]) for n, v in values.items()), F.lit(0.0))
    needed = max(1, ceil(len(active) * minimum_coverage))
    return count, F.when(count >= needed, F.try_divide(top, bottom))


def signed_weight_composite(
    scores: DataFrame, weights: dict[str, float], minimum_coverage: float = 0.0, layout: Layout = WHOLE
) -> DataFrame:
    """Signed-weight score tolerant of partly missing factors; universe rows only."""
    require_columns(scores, ["trade_date", "symbol", "in_universe", *[n for n, w in weights.items() if w]])
    count, raw = weighted_raw(weights, minimum_coverage)
    work = scores.withColumns(
        {"valid_factor_count": count, "composite_raw": F.when(flag("in_universe"), raw)}
    )
    return zscore(work, "composite_raw", "factor_processed", DATE, layout)


def template_weights(factors: DataFrame, name: str = "factor") -> DataFrame:
    """Category of each factor and the weight 1/n it gets inside its category."""
    tagged = factors.select(name, category_for(name).alias("category"))
    sizes = tagged.groupBy("category").agg(F.count("*").alias("_n"))
    return tagged.join(sizes, "category").select(name, "category", (1 / F.col("_n")).alias("weight"))
