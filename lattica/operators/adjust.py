"""Price adjustment, suspension marks, limits and listing inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.numeric import finite, flag, positive, ratio
from lattica.functions.trading import PRICE_TICK_TOLERANCE, RETURN_TOLERANCE, price_limit_ratio
from lattica.operators.quality import amount_outside_range
from lattica.schema import PRICES

UNKNOWN_AGE, OLD_AGE = -1, 999_999
STATIC_FIELDS = ["adj_factor", "market_cap", "float_market_cap", "industry"]


def limit_flags(df: DataFrame, adjusted_prices: bool = False) -> DataFrame:
    """Limit prices (rounded half up to cents) and opening-at-limit flags by rule."""
    age = "listing_age_sessions" if "listing_age_sessions" in df.columns else None
    df = df.withColumn("_limit", price_limit_ratio("symbol", "trade_date", "is_st", age))
    preclose, limit = finite("preclose"), F.col("_limit")
    df = df.withColumns(
        {
            "up_limit": F.round(preclose * (1 + limit), 2),
            "down_limit": F.round(preclose * (1 - limit), 2),
            "is_no_limit_session": limit.isNull(),
        }
    )
    if adjusted_prices:
        move = ratio("open", "preclose") - 1
        up, down = F.abs(move - limit) <= RETURN_TOLERANCE, F.abs(move + limit) <= RETURN_TOLERANCE
    else:
        up = F.abs(F.col("open") - F.col("up_limit")) <= PRICE_TICK_TOLERANCE
        down = F.abs(F.col("open") - F.col("down_limit")) <= PRICE_TICK_TOLERANCE
    return df.withColumns(
        {
            "is_limit_up": F.coalesce(up, F.lit(False)),
            "is_limit_down": F.coalesce(down, F.lit(False)),
            "limit_status_known": preclose.isNotNull(),
        }
    ).drop("_limit")


def adjusted_open(df: DataFrame) -> DataFrame:
    """Derive ``adj_close`` from the factor and ``adj_open`` from the close scale."""
    if "adj_close" not in df.columns:
        scale = F.col("adj_factor") if "adj_factor" in df.columns else F.lit(1.0)
        df = df.withColumn("adj_close", F.col("close") * scale)
    if "adj_open" not in df.columns:
        df = df.withColumn("adj_open", F.col("open") * ratio("adj_close", positive("close")))
    return df


def fill_suspensions(df: DataFrame) -> DataFrame:
    """Mark explicitly suspended bars without a close at the previous close."""
    so_far = W.partitionBy("symbol").orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    have = set(df.columns)
    halted = flag("is_suspended") & F.col("close").isNull()
    previous = F.last("close", ignorenulls=True).over(so_far)
    changes: dict[str, Column] = {c: F.when(halted, previous).otherwise(F.col(c)) for c in PRICES}
    if "adj_close" in have:
        adjusted = F.last("adj_close", ignorenulls=True).over(so_far)
        for c in ("adj_open", "adj_high", "adj_low", "adj_close"):
            if c in have:
                changes[c] = F.when(halted, adjusted).otherwise(F.col(c))
    for c in ("volume", "amount"):
        changes[c] = F.when(halted, F.lit(0.0)).otherwise(F.col(c))
    for c in STATIC_FIELDS:
        if c in have:
            changes[c] = F.last(c, ignorenulls=True).over(so_far)
    changes["was_suspension_filled"] = halted
    return df.withColumns(changes)


def normalized_to_latest(df: DataFrame) -> DataFrame:
    """Prices on the scale of each symbol's last factor, or the supplied adjusted ones."""
    have = set(df.columns)
    if "adj_close" in have:
        changes = {c: F.col(f"adj_{c}") for c in PRICES if f"adj_{c}" in have}
    else:
        factor = F.col("adj_factor") if "adj_factor" in have else F.lit(1.0)
        whole = W.partitionBy("symbol").orderBy("trade_date").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        scale = ratio(factor, F.last(factor, ignorenulls=True).over(whole))
        changes = {c: F.col(c) * scale for c in PRICES}
    return df.withColumns({**changes, "price_is_adjusted": F.lit(True)})


def asof_factors(bars: DataFrame, events: DataFrame, value: str = "adj_factor", default: float = 1.0) -> DataFrame:
    """Latest dated factor on or before each bar, found in one ordered pass per symbol."""
    bars = bars.drop(value)
    columns = [c for c in bars.columns if c not in ("trade_date", "symbol")]
    empty = [F.lit(None).cast(bars.schema[c].dataType).alias(c) for c in columns]
    left = bars.select("trade_date", "symbol", *columns, F.lit(None).cast("double").alias("_event"), F.lit(1).alias("_side"))
    right = events.select("trade_date", "symbol", *empty, F.col(value).cast("double").alias("_event"), F.lit(0).alias("_side"))
    so_far = W.partitionBy("symbol").orderBy("trade_date", "_side").rowsBetween(W.unboundedPreceding, 0)
    return (
        left.unionByName(right)
        .withColumn(value, F.coalesce(F.last("_event", ignorenulls=True).over(so_far), F.lit(default)))
        .where("_side = 1")
        .drop("_event", "_side")
    )


def with_listing_age(df: DataFrame, sessions: DataFrame, basics: DataFrame) -> DataFrame:
    """Sessions since listing: -1 unknown, 999999 when listed before the calendar starts.

    ``basics`` has ``symbol`` and ``list_date``. ``df`` carries ``session_idx``.
    """
    first = sessions.agg(F.min("trade_date").alias("_first"))
    starts = (
        basics.select("symbol", "list_date")
        .join(first, F.lit(True))
        .withColumn("_in_calendar", F.coalesce(F.col("list_date") >= F.col("_first"), F.lit(False)))
    )
    # index of the first session on or after the listing date, resolved on distinct dates
    marks = sessions.select(F.col("trade_date").alias("at"), "session_idx", F.lit(1).alias("side"))
    asks = starts.where("_in_calendar").select(F.col("list_date").alias("at")).distinct().select(
        "at", F.lit(None).cast("int").alias("session_idx"), F.lit(0).alias("side")
    )
    ahead = W.orderBy(F.desc("at"), F.desc("side")).rowsBetween(W.unboundedPreceding, 0)
    index = (
        marks.unionByName(asks)
        .withColumn("list_idx", F.last("session_idx", ignorenulls=True).over(ahead))
        .where("side = 0")
        .select(F.col("at").alias("list_date"), "list_idx")
    )
    per_symbol = starts.join(F.broadcast(index), "list_date", "left").select("symbol", "list_date", "list_idx", "_in_calendar")
    age = (
        F.when(F.col("_in_calendar"), F.col("session_idx") - F.col("list_idx"))
        .when(F.col("list_date").isNotNull(), F.lit(OLD_AGE))
        .otherwise(F.lit(UNKNOWN_AGE))
    )
    return (
        df.drop("list_date")
        .join(per_symbol, "symbol", "left")
        .withColumn("listing_age_sessions", age)
        .drop("list_idx", "_in_calendar")
    )


def inferred_listing(df: DataFrame, quiet_days: int = 30) -> DataFrame:
    """Listing date read off the panel when a symbol first appears well after its start."""
    start = df.agg(F.min("trade_date").alias("_start"))
    by_symbol = W.partitionBy("symbol")
    seen = df.withColumns(
        {
            "_first": F.min("trade_date").over(by_symbol),
            "_age": F.row_number().over(by_symbol.orderBy("trade_date")) - 1,
        }
    ).join(F.broadcast(start), F.lit(True))
    late = F.col("_first") > F.date_add("_start", quiet_days)
    return seen.withColumns(
        {
            "listing_age_sessions": F.when(late, F.col("_age")).otherwise(F.lit(OLD_AGE)),
            "list_date": F.when(late, F.col("_first")),
            "list_date_quality": F.when(late, "first_observed_in_full_history").otherwise("precedes_history_or_unknown"),
        }
    ).drop("_first", "_age", "_start")


def price_chain(raw: DataFrame, sessions: DataFrame, basics: DataFrame) -> DataFrame:
    """Adjusted panel from raw bars by the exchange-preclose chain.

    A segment ends at a missing session or an unusable multiplier; the factor starts
    at 1 in each segment and multiplies previous close / preclose along it. Suspended
    bars are marked first, from their own preclose before an earlier close.
    """
    by_symbol = W.partitionBy("symbol").orderBy("trade_date")
    so_far = by_symbol.rowsBetween(W.unboundedPreceding, 0)
    dated = raw.join(F.broadcast(sessions), "trade_date")  # one row per session
    dated = with_listing_age(dated, sessions, basics)
    halted = flag("is_suspended") & flag("is_suspended_known")
    mark = F.coalesce(positive("close"), F.when(halted, positive("preclose")))
    dated = dated.withColumns({"_halted": halted, "_mark": F.last(mark, ignorenulls=True).over(so_far)})
    filled = F.lit(False)
    changes: dict[str, Column] = {}
    for c in [*PRICES, "preclose"]:
        needs = F.col("_halted") & F.coalesce(F.col(c) <= 0, F.lit(True))
        changes[c] = F.when(needs, F.col("_mark")).otherwise(F.col(c))
        filled = filled | needs
    for c in ("volume", "amount"):
        needs = F.col("_halted") & F.col(c).isNull()
        changes[c] = F.when(needs, F.lit(0.0)).otherwise(F.col(c))
        filled = filled | needs
    marked = dated.withColumns({**changes, "was_suspension_filled": filled})
    multiplier = finite(ratio(F.lag("close").over(by_symbol), "preclose"))
    gap = F.col("session_idx") - F.lag("session_idx").over(by_symbol)
    chained = marked.withColumns({"_multiplier": multiplier, "_step": gap})
    usable = (F.col("_step") == 1) & (F.col("_multiplier") > 0)
    chained = chained.withColumn("_broken", ~F.coalesce(usable, F.lit(False)))
    chained = chained.withColumn("research_segment", F.sum(F.col("_broken").cast("long")).over(so_far))
    in_segment = W.partitionBy("symbol", "research_segment").orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    link = F.when(F.col("_broken"), F.lit(1.0)).otherwise(F.col("_multiplier"))
    chained = chained.withColumn("adj_factor", F.product(link).over(in_segment))
    chained = chained.withColumns({f"adj_{c}": F.col(c) * F.col("adj_factor") for c in [*PRICES, "preclose"]})
    chained = chained.drop("_halted", "_mark", "_multiplier", "_step", "_broken")
    return _limit_status(chained)


def _limit_status(df: DataFrame) -> DataFrame:
    """Supplied limits win over derived ones; say where the limit status is known."""
    none = F.lit(None).cast("double")
    up = F.col("up_limit") if "up_limit" in df.columns else none
    down = F.col("down_limit") if "down_limit" in df.columns else none
    df = df.withColumns({"_up": up, "_down": down})
    df = limit_flags(df)
    supplied = F.coalesce((F.col("_up") > 0) & (F.col("_down") > 0), F.lit(False))
    df = df.withColumns(
        {
            "up_limit": F.when(supplied, F.col("_up")).otherwise(F.col("up_limit")),
            "down_limit": F.when(supplied, F.col("_down")).otherwise(F.col("down_limit")),
            "_supplied": supplied,
        }
    )
    plausible = (F.col("high") <= F.col("up_limit") + 0.011) & (F.col("low") >= F.col("down_limit") - 0.011)
    ruled = flag("is_st_known") & (F.col("preclose") > 0) & (F.col("listing_age_sessions") >= 5) & plausible
    fresh = F.col("is_no_limit_session") & F.col("listing_age_sessions").between(0, 4)
    no = F.lit(False)
    df = df.withColumn("limit_status_known", F.col("_supplied") | F.coalesce(ruled, no) | F.coalesce(fresh, no))
    at_up = F.abs(F.col("open") - F.col("up_limit")) <= PRICE_TICK_TOLERANCE
    at_down = F.abs(F.col("open") - F.col("down_limit")) <= PRICE_TICK_TOLERANCE
    return df.withColumns(
        {
            "is_limit_up": F.col("limit_status_known") & F.coalesce(at_up, no),
            "is_limit_down": F.col("limit_status_known") & F.coalesce(at_down, no),
            "amount_outside_price_range": amount_outside_range(),
        }
    ).drop("_up", "_down", "_supplied")
