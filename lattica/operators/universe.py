"""Point-in-time universe mask and index membership."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.numeric import all_of, flag
from lattica.operators.calendars import effective_dates
from lattica.operators.checks import require_columns
from lattica.schema import KNOWN


@dataclass(frozen=True)
class UniverseRule:
    min_listed_days: int = 120
    exclude_st: bool = True
    exclude_suspended: bool = True
    min_amount: float = 0.0
    require_known_status: bool = False
    require_index_membership: bool = False


def apply_universe(df: DataFrame, rule: UniverseRule | None = None) -> DataFrame:
    """Add ``in_universe`` from what was observable on each date."""
    rule = rule or UniverseRule()
    require_columns(df, ["trade_date", "symbol", "amount"])
    have = set(df.columns)
    age = (
        F.col("listing_age_sessions") + 1
        if "listing_age_sessions" in have
        else F.row_number().over(W.partitionBy("symbol").orderBy("trade_date"))
    )
    tests = [F.coalesce(age >= rule.min_listed_days, F.lit(False))]
    if "is_usable_market_data" in have:
        tests.append(flag("is_usable_market_data"))
    if rule.exclude_st and "is_st" in have:
        tests.append(~flag("is_st"))
    if rule.exclude_suspended and "is_suspended" in have:
        tests.append(~flag("is_suspended"))
    if rule.min_amount > 0:
        tests.append(F.coalesce("amount", F.lit(0.0)) >= rule.min_amount)
    if rule.require_known_status:
        tests += [flag(c) if c in have else F.lit(False) for c in KNOWN]
    if rule.require_index_membership:
        require_columns(df, ["in_index"])
        tests.append(flag("in_index"))
    return df.withColumn("in_universe", all_of(tests))


def attach_membership(market: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Membership and weight from the latest snapshot on or before each date."""
    require_columns(snapshots, ["trade_date", "symbol"])
    weight = F.col("weight") if "weight" in snapshots.columns else F.lit(0.0)
    effective = effective_dates(market, snapshots)
    # a snapshot that lists a symbol twice counts once, with its larger weight
    members = snapshots.groupBy(F.col("trade_date").alias("snapshot_date"), "symbol").agg(
        F.max(weight).alias("_weight"), F.lit(True).alias("_in")
    )
    return (
        market.join(F.broadcast(effective), "trade_date", "left")  # one row per session
        .join(members, ["snapshot_date", "symbol"], "left")
        .withColumn("in_index", flag("_in"))
        .withColumn("index_weight", F.coalesce("_weight", F.lit(0.0)))
        .drop("_in", "_weight", "snapshot_date")
    )


def attach_shared_memberships(
    market: DataFrame, snapshots: DataFrame, labels: dict[str, str], union_name: str, allow_partial: bool = False
) -> DataFrame:
    """Membership, completeness and effective date for each index, plus their union.

    ``labels`` maps index code to column label. Completeness belongs to a snapshot
    date, so it is resolved on the calendar before the panel is touched.
    """
    if not allow_partial and "snapshot_complete" in snapshots.columns:
        if snapshots.where(~flag("snapshot_complete")).limit(1).collect():
            raise ValueError("incomplete snapshots define a download scope only; pass allow_partial to use them")
    complete = flag("snapshot_complete") if "snapshot_complete" in snapshots.columns else F.lit(True)
    out = market
    for code, label in labels.items():
        own = snapshots.where(F.col("index_code") == code)
        whole = own.groupBy(F.col("trade_date").alias("snapshot_date")).agg(F.min(complete).alias("_complete"))
        dates = (
            effective_dates(market, own)
            .join(whole, "snapshot_date", "left")
            .select(
                "trade_date",
                F.col("snapshot_date").alias(f"{label}_membership_date"),
                flag("_complete").alias(f"{label}_membership_complete"),
            )
        )
        members = own.select(
            F.col("trade_date").alias(f"{label}_membership_date"), "symbol", F.lit(True).alias("_in")
        ).distinct()
        out = (
            out.join(F.broadcast(dates), "trade_date", "left")  # one row per session
            .join(members, [f"{label}_membership_date", "symbol"], "left")
            .withColumn(f"in_{label}", flag("_in"))
            .drop("_in")
        )
    either = F.lit(False)
    for label in labels.values():
        either = either | F.col(f"in_{label}")
    return out.withColumn(union_name, either)


def attach_membership_backfilled(market: DataFrame, snapshots: DataFrame) -> DataFrame:
    """As-of membership that falls back to the earliest snapshot, with a quality label."""
    earliest = snapshots.agg(F.min("trade_date").alias("_earliest"))
    effective = (
        effective_dates(market, snapshots)
        .join(earliest, F.lit(True))
        .select(
            "trade_date",
            F.coalesce("snapshot_date", "_earliest").alias("snapshot_date"),
            F.when(F.col("snapshot_date").isNull(), "earliest_snapshot_backfill")
            .otherwise("point_in_time_snapshot")
            .alias("membership_quality"),
        )
    )
    members = snapshots.select(F.col("trade_date").alias("snapshot_date"), "symbol", F.lit(True).alias("_in")).distinct()
    return (
        market.join(F.broadcast(effective), "trade_date", "left")  # one row per session
        .join(members, ["snapshot_date", "symbol"], "left")
        .withColumn("in_index", flag("_in"))
        .drop("_in", "snapshot_date")
    )


def snapshot_violations(snapshots: DataFrame, sizes: dict[str, int], pattern: str, allow_one_missing: bool = False) -> DataFrame:
    """Problems per ``(index_code, request_date)``; a clean snapshot yields no row."""
    want = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    slack = 1 if allow_one_missing else 0
    per = snapshots.groupBy("index_code", "request_date").agg(
        F.count("*").alias("rows"),
        F.countDistinct("symbol").alias("symbols"),
        F.countDistinct("trade_date").alias("dates"),
        F.max("trade_date").alias("latest"),
        F.count_if(F.col("trade_date").isNull() | F.col("symbol").isNull()).alias("nulls"),
        F.count_if(~F.col("symbol").rlike(pattern)).alias("bad_symbols"),
    )
    expected = F.try_element_at(want, F.col("index_code"))
    reasons = F.concat_ws(
        ";",
        F.when(expected.isNull(), "UNSUPPORTED_INDEX"),
        F.when(F.col("nulls") > 0, "NULL_KEY"),
        F.when(~F.col("rows").between(expected - slack, expected), "WRONG_SIZE"),
        F.when(F.col("symbols") < F.col("rows"), "DUPLICATE_SYMBOL"),
        F.when(F.col("dates") != 1, "SEVERAL_DATES"),
        F.when(F.col("latest") > F.col("request_date"), "FUTURE_SNAPSHOT"),
        F.when(F.col("bad_symbols") > 0, "BAD_SYMBOL"),
    )
    return per.withColumn("reasons", reasons).where("reasons <> ''").select("index_code", "request_date", "rows", "reasons")


def effective_conflicts(snapshots: DataFrame) -> DataFrame:
    """Index dates that arrived with different member sets under different requests.

    A request's set is reduced to a count and an order-free hash sum, so no member
    list is ever collected.
    """
    member = F.xxhash64("symbol").cast("decimal(38,0)")
    per = (
        snapshots.select("index_code", "trade_date", "request_date", "symbol")
        .distinct()
        .groupBy("index_code", "trade_date", "request_date")
        .agg(F.count("*").alias("n"), F.sum(member).alias("h"))
    )
    return (
        per.groupBy("index_code", "trade_date")
        .agg(F.countDistinct("n", "h").alias("member_sets"))
        .where("member_sets > 1")
    )


def replace_slices(old: DataFrame, new: DataFrame, slice_keys, row_keys) -> DataFrame:
    """Refreshed slices replace old ones entirely, removals included."""
    kept = old.join(new.select(*slice_keys).distinct(), list(slice_keys), "left_anti")
    return kept.unionByName(new.dropDuplicates(list(row_keys)), allowMissingColumns=True)


def incomplete_snapshots(snapshots: DataFrame) -> DataFrame:
    return snapshots.where(~flag("snapshot_complete")).select("index_code", "trade_date").distinct()
