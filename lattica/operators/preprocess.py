"""Per-section preprocessing: winsorise, standardise, neutralise, rank labels.

Sections are named by ``keys``; passing ``("factor", "trade_date")`` processes
every factor of a long table in the same job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.numeric import clip, finite, positive, ratio
from lattica.operators.sections import WHOLE, Layout, add_average_rank, add_median, add_stats

# Fixed value: scales a MAD to a standard deviation under normality.
MAD_SCALE = 1.4826
DATE = ("trade_date",)


def winsorize_mad(
    df: DataFrame, value: str, out: str, n_mad: float = 5.0, keys=DATE, layout: Layout = WHOLE
) -> DataFrame:
    """Clip to median +/- n x 1.4826 x MAD; a zero or unknown MAD leaves values alone.

    NaN and infinite values are missing: they move no statistic and have no outcome.
    """
    df = df.withColumn("_value", finite(value))
    df = add_median(df, keys, "_value", "_mid", layout=layout)
    df = df.withColumn("_gap", F.abs(F.col("_value") - F.col("_mid")))
    df = add_median(df, keys, "_gap", "_mad", layout=layout)
    width = F.col("_mad") * (n_mad * MAD_SCALE)
    clipped = F.when(F.col("_mad") > 0, clip(F.col("_value"), F.col("_mid") - width, F.col("_mid") + width))
    return df.withColumn(out, F.coalesce(clipped, F.col("_value"))).drop("_value", "_mid", "_gap", "_mad")


def zscore(df: DataFrame, value: str, out: str, keys=DATE, layout: Layout = WHOLE) -> DataFrame:
    """Population z-score; a constant section has no score, NaN and infinite values are missing."""
    df = df.withColumn("_value", finite(value))
    df = add_stats(df, keys, {"_mean": F.avg("_value"), "_std": F.stddev_pop("_value")}, layout)
    return df.withColumn(out, ratio(F.col("_value") - F.col("_mean"), "_std")).drop("_value", "_mean", "_std")


def neutralize(
    df: DataFrame,
    value: str,
    out: str,
    size: str | None = "market_cap",
    industry: str | None = "industry",
    keys=DATE,
    layout: Layout = WHOLE,
) -> DataFrame:
    """Residual of ``value`` on an intercept, log size and industry dummies.

    With dummies partialled out, the regression is one slope on values demeaned
    inside the industry, so two levels of averages replace the matrix solve.
    """
    size = size if size in df.columns else None
    industry = industry if industry in df.columns else None
    keys = list(keys)
    df = df.withColumn("_x", F.ln(positive(finite(size))) if size else F.lit(0.0))
    if industry:
        df = add_stats(df, keys, {"_first": F.min(industry), "_all": F.collect_set(industry)}, layout)
        df = df.withColumn("_group", F.coalesce(industry, "_first"))
        dummies: Column = F.greatest(F.size("_all") - 1, F.lit(0))
        inner = [*keys, "_group"]
    else:
        dummies, inner = F.lit(0), keys
    valid = finite(value).isNotNull() & F.col("_x").isNotNull()
    y, x = F.when(valid, finite(value)), F.when(valid, F.col("_x"))
    df = df.withColumns({"_y": y, "_xv": x, "_columns": dummies + (2 if size else 1)})
    df = add_stats(df, inner, {"_ym": F.avg("_y"), "_xm": F.avg("_xv")}, layout)
    df = df.withColumns({"_yd": F.col("_y") - F.col("_ym"), "_xd": F.col("_xv") - F.col("_xm")})
    df = df.withColumns({"_xy": F.col("_xd") * F.col("_yd"), "_xx": F.col("_xd") * F.col("_xd")})
    df = add_stats(df, keys, {"_sxy": F.sum("_xy"), "_sxx": F.sum("_xx"), "_valid": F.count("_y")}, layout)
    slope = F.coalesce(ratio("_sxy", "_sxx"), F.lit(0.0)) if size else F.lit(0.0)
    residual = F.when(F.col("_valid") > F.col("_columns"), F.col("_yd") - slope * F.col("_xd"))
    return df.withColumn(out, residual).drop(
        "_x", "_first", "_all", "_group", "_y", "_xv", "_columns", "_ym", "_xm", "_yd", "_xd", "_xy", "_xx",
        "_sxy", "_sxx", "_valid",
    )


def preprocess(
    df: DataFrame,
    value: str = "factor",
    n_mad: float = 5.0,
    neutralize_size: bool = True,
    neutralize_industry: bool = True,
    keys=DATE,
    layout: Layout = WHOLE,
) -> DataFrame:
    """Add ``factor_winsor``, ``factor_z`` and ``factor_processed``."""
    df = winsorize_mad(df, value, "factor_winsor", n_mad, keys, layout)
    df = zscore(df, "factor_winsor", "factor_z", keys, layout)
    if not (neutralize_size or neutralize_industry):
        return df.withColumn("factor_processed", F.col("factor_z"))
    df = neutralize(
        df,
        "factor_z",
        "_residual",
        "market_cap" if neutralize_size else None,
        "industry" if neutralize_industry else None,
        keys,
        layout,
    )
    return zscore(df, "_residual", "factor_processed", keys, layout).drop("_residual")


def rank_label(df: DataFrame, value: str, out: str = "label", keys=DATE, layout: Layout = WHOLE) -> DataFrame:
    """Percent rank with shared ties, centred on zero."""
    df = add_average_rank(df, keys, value, "_rank", layout=layout)
    df = add_stats(df, keys, {"_n": F.count(value)}, layout)
    return df.withColumn(out, F.col("_rank") / F.col("_n") - 0.5).drop("_rank", "_n")
