"""Factors that go on from where the last run ended.

The state of a run is the tail of every symbol's frame: its last rows, as many as the longest
lookback, with the returns, market means and residuals that were staged for them. A new
session needs nothing older, so a daily run reads and sorts symbols x lookback rows instead
of the whole history, and its values are those of a full run.

The state is a versioned table: a run that dies leaves the old state in place, and one that
is repeated after it was logged finds its session already there.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.factors import given, last_rows, new_factors, partition_of, required_inputs, staged, staged_columns, warmup_rows, with_factors  # noqa: F401
from lattica.sources import versions

#: Columns a panel may have besides the declared inputs that change what a factor is.
_OPTIONAL = ("research_segment", "in_universe", "amount_outside_price_range", "adj_factor", "adj_close")


def _inputs(panel: DataFrame, names: Iterable[str]) -> list[str]:
    wanted = [*required_inputs(names), *(c for c in _OPTIONAL if c in panel.columns)]
    return list(dict.fromkeys(wanted))


def _tails(rows: DataFrame, names: list[str], inputs: list[str]) -> DataFrame:
    """The last rows of every frame, with what was staged for them."""
    last = last_rows(given(rows), max(1, warmup_rows(names)))
    return last.select(*inputs, *[F.col(c).alias(f"_kept{c}") for c in staged_columns(names)])


def rolling_state(panel: DataFrame, names: Iterable[str]) -> DataFrame:
    """The state after a whole history: its last rows are staged, no factor is computed.

    Market means need every row, the state only the last ones of a frame, so that the other
    columns of older rows do not travel.
    """
    names = list(names)
    inputs = _inputs(panel, names)
    return _tails(staged(panel.select(*inputs), names, tail=max(1, warmup_rows(names))), names, inputs)


def extend_factors(state: DataFrame, rows: DataFrame, names: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """Factors of new rows, and the state after them.

    ``rows`` hold whole sessions after every session of the state; a row at or before the
    state's last session stops the job, as it would have changed values already given out.
    Values and state are computed each for itself: what is staged is cheaper to build again
    from the state than to store.
    """
    names = list(names)
    inputs = _inputs(rows, names)
    kept = [f"_kept{c}" for c in staged_columns(names)]
    last = state.agg(F.max("trade_date").alias("_last"))
    late = F.raise_error(F.concat(F.lit("a row of "), F.col("trade_date").cast("string"), F.lit(" is not after the state")))
    checked = rows.select(*inputs).join(F.broadcast(last), F.lit(True))  # one row
    fresh = checked.withColumn("trade_date", F.when(F.col("trade_date") <= F.col("_last"), late.cast("date")).otherwise(F.col("trade_date"))).drop("_last")
    both = state.select(*inputs, *kept).withColumn("_new", F.lit(False)).unionByName(fresh.withColumn("_new", F.lit(True)), allowMissingColumns=True)
    both = staged(both, names, resumed=True)
    return new_factors(both, names).select("trade_date", "symbol", *names), _tails(both, names, inputs)


def run_sessions(spark: SparkSession, path: str, rows: DataFrame, names: Iterable[str]) -> DataFrame:
    """Factors of new sessions by the state stored at ``path``, which moves on in one commit.

    Started over whole history where there is no state yet (all its rows are returned).
    Values are computed when they are read, the state at once.
    """
    names = list(names)
    if versions.latest(spark, path).number == 0:
        versions.overwrite(rolling_state(rows, names), path, dealt=True)
        return with_factors(rows.select(*_inputs(rows, names)), names).select("trade_date", "symbol", *names)
    values, state = extend_factors(versions.read(spark, path), rows, names)
    versions.overwrite(state, path, dealt=True)
    return values
