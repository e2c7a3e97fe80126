"""Forward labels inside a symbol (and segment); nothing is bridged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.numeric import positive, ratio
from lattica.operators.checks import require_columns
from lattica.operators.factors import partition_of


def add_forward_returns(df: DataFrame, horizons=(5,), price: str = "close") -> DataFrame:
    """close(t+h) / close(t) - 1 for each horizon."""
    require_columns(df, ["trade_date", "symbol", price])
    if any(h <= 0 for h in horizons):
        raise ValueError("horizons are positive")
    ahead = W.partitionBy(*partition_of(df)).orderBy("trade_date")
    return df.withColumns(
        {f"forward_return_{h}d": ratio(F.lead(price, h).over(ahead), price) - 1 for h in horizons}
    )


def add_execution_returns(df: DataFrame, horizons=(5,), price: str = "adj_open") -> DataFrame:
    """open(t+h+1) / open(t+1) - 1: enter at the next open, leave h sessions later."""
    require_columns(df, ["trade_date", "symbol", price])
    if any(h <= 0 for h in horizons):
        raise ValueError("horizons are positive")
    ahead = W.partitionBy(*partition_of(df)).orderBy("trade_date")
    entry = positive(F.lead(price, 1).over(ahead))
    return df.withColumns(
        {
            f"next_open_return_{h}d": ratio(positive(F.lead(price, h + 1).over(ahead)), entry) - 1
            for h in horizons
        }
    )
