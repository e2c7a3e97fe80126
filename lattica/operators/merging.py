"""Source merges, priority dedupe, slice and gap operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.numeric import any_of, finite, flag, positive, ratio
from lattica.operators.checks import assert_unique, require_columns
from lattica.schema import ACTIVITY_TOLERANCE, KEYS, MERGE_FIELDS, PRICE_TOLERANCE, PRICES


def by_priority(df: DataFrame, keys=tuple(KEYS), priority: str = "priority", order=()) -> DataFrame:
    """Keep the highest-priority row of each key; among equals the last in ``order``.

    An aggregate, not a window: rows combine before the shuffle, so a key repeated
    in a third of the input never lands in one task whole. Rows equal in all of
    that are settled by content, so the outcome does not depend on task order.
    """
    values = [c for c in df.columns if c not in keys and c != priority]
    row = F.struct(F.col(priority), *[F.col(c).alias(f"_o_{c}") for c in order], F.xxhash64(*values).alias("_order"), *[F.col(c) for c in values])
    best = df.groupBy(*keys).agg(F.max(row).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in [priority, *values]]).select(*df.columns)


def union_sources(sources: list[tuple[int, DataFrame]]) -> DataFrame:
    """UNION ALL of sources with drifting columns, each carrying its priority."""
    out: DataFrame | None = None
    for priority, frame in sources:
        part = frame.withColumn("priority", F.lit(priority))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


def upsert(base: DataFrame, changes: DataFrame, keys=tuple(KEYS)) -> DataFrame:
    """Last write wins on the key: the higher ``priority``, then the later ``arrival``.

    Stored rows without a priority stand below every change; a change without one has 0.
    ``arrival`` is the sequence a
    write is stored with; where neither side carries one, or both carry the same, the
    change is the later. Changes without one come after everything stored. Replaying an
    old numbered write therefore changes nothing.
    """
    both, order = stacked(base, changes)
    return by_priority(both, keys, order=order).drop("_later")


def stacked(base: DataFrame, changes: DataFrame) -> tuple[DataFrame, list[str]]:
    """Stored rows and changes as one table, and the columns that settle equal priorities."""
    if "priority" not in base.columns:
        base = base.withColumn("priority", F.lit(-1))
    given = F.coalesce("priority", F.lit(0)) if "priority" in changes.columns else F.lit(0)
    changes = changes.withColumn("priority", given)
    if "arrival" in base.columns and "arrival" not in changes.columns:
        newest = base.agg((F.coalesce(F.max("arrival"), F.lit(-1)) + 1).cast("long").alias("arrival"))
        changes = changes.join(F.broadcast(newest), F.lit(True))  # one row
    both = base.withColumn("_later", F.lit(0)).unionByName(changes.withColumn("_later", F.lit(1)), allowMissingColumns=True)
    order = [c for c in ("arrival", "_later") if c in both.columns]
    return both, order


def merge_sources(a: DataFrame, b: DataFrame, fields=tuple(MERGE_FIELDS), names=("A", "B"), check: bool = True) -> DataFrame:
    """Full outer one-to-one merge: A's field where present, else B's, with provenance.

    Every further column of either source is carried (valuation, turnover, limits, raw
    status); one that both have is A's where present. States come from B alone.
    """
    if check:
        assert_unique(a, KEYS, names[0])
        assert_unique(b, KEYS, names[1])
    every_state = ("is_st", "is_suspended", "is_st_known", "is_suspended_known")
    taken = {*KEYS, *fields, *every_state}
    more_a, more_b = ([c for c in df.columns if c not in taken] for df in (a, b))
    shared = [c for c in more_a if c in more_b]
    left = a.select(*KEYS, *[F.col(c).alias(f"{c}_a") for c in fields], F.lit(True).alias("_in_a"), *more_a)
    states = [c for c in every_state if c in b.columns]
    right = b.select(
        *KEYS, *[F.col(c).alias(f"{c}_b") for c in fields], F.lit(True).alias("_in_b"), *states,
        *[F.col(c).alias(f"_b_{c}") if c in shared else F.col(c) for c in more_b],
    )
    merged = left.join(right, KEYS, "full")
    columns: dict[str, Column] = {c: F.coalesce(c, f"_b_{c}") for c in shared}
    for c in fields:
        columns[c] = F.coalesce(f"{c}_a", f"{c}_b")
        columns[f"{c}_source"] = (
            F.when(F.col(f"{c}_a").isNotNull(), names[0])
            .when(F.col(f"{c}_b").isNotNull(), names[1])
            .otherwise("missing")
        )
    for c in every_state:
        columns[c] = flag(c) if c in states else F.lit(False)
    merged = merged.withColumns(columns)
    limits = "up_limit" in a.columns and "down_limit" in a.columns
    known_limit = (
        F.coalesce((F.col("up_limit") > 0) & (F.col("down_limit") > 0), F.lit(False)) if limits else F.lit(False)
    )
    presence = (
        F.when(flag("_in_a") & flag("_in_b"), "both").when(flag("_in_a"), "left_only").otherwise("right_only")
    )
    return merged.withColumns(
        {
            "source_presence": presence,
            "status_source": F.when(F.col("is_st_known") & F.col("is_suspended_known"), names[1]).otherwise("unknown"),
            "limit_status_known": known_limit,
            "price_adjustment": F.lit("raw"),
            "research_ready": F.lit(False),
        }
    ).drop("_in_a", "_in_b", *[f"_b_{c}" for c in shared])


def compare_sources(merged: DataFrame, fields=tuple(MERGE_FIELDS)) -> DataFrame:
    """Per field: overlap, differences beyond tolerance, beyond 1 ppm, largest gap."""
    measures = []
    for c in fields:
        a, b = F.col(f"{c}_a"), F.col(f"{c}_b")
        gap = F.abs(a - b)
        tolerance = ACTIVITY_TOLERANCE if c in ("volume", "amount") else PRICE_TOLERANCE
        measures += [
            F.count(gap).alias(f"{c}__overlap"),
            F.count_if(gap > tolerance).alias(f"{c}__different"),
            F.count_if((gap > tolerance) & (gap > F.abs(a) * 1e-6)).alias(f"{c}__ppm"),
            F.max(gap).alias(f"{c}__largest"),
        ]
    wide = merged.agg(*measures)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("field"),
                F.col(f"{c}__overlap").alias("overlap"),
                F.col(f"{c}__different").alias("different"),
                F.col(f"{c}__ppm").alias("different_over_ppm"),
                F.col(f"{c}__largest").alias("max_abs_difference"),
            )
            for c in fields
        ]
    )
    return wide.select(F.inline(rows))


def staging_counters(merged: DataFrame, a_name: str = "A", b_name: str = "B") -> DataFrame:
    """Yearly counters of the merged staging table."""
    missing = any_of(F.col(c).isNull() for c in PRICES)
    halted = flag("is_suspended") & flag("is_suspended_known")
    no = F.lit(False)
    bad = (
        any_of(F.coalesce(F.col(c) <= 0, no) for c in PRICES)
        | (missing & ~halted)
        | F.coalesce(F.col("high") < F.greatest("open", "close", "low"), no)
        | F.coalesce(F.col("low") > F.least("open", "close", "high"), no)
        | any_of(F.coalesce(F.col(c) < 0, no) for c in ("volume", "amount"))
    )
    average = ratio("amount", positive("volume"))
    checkable = average.isNotNull() & (F.col("low") > 0) & (F.col("high") > 0)
    outside = checkable & ((average < F.col("low") - 0.011) | (average > F.col("high") + 0.011))
    return merged.groupBy(F.year("trade_date").alias("year")).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("close_source") == a_name).alias("close_from_a"),
        F.count_if(F.col("close_source") == b_name).alias("close_from_b"),
        F.count_if(bad).alias("invalid_rows"),
        F.count_if(missing & halted).alias("suspended_without_prices"),
        F.count_if(outside).alias("amount_outside_range"),
    )


def feature_matrix(tables: dict[str, DataFrame], value: str = "factor") -> DataFrame:
    """Full outer join of factor tables as one union and one aggregation."""
    if not tables:
        raise ValueError("no factor tables")
    names = list(tables)
    long: DataFrame | None = None
    for name, frame in tables.items():
        require_columns(frame, [*KEYS, value])
        part = frame.select(*KEYS, F.lit(name).alias("_name"), F.col(value).alias("_value"))
        long = part if long is None else long.unionByName(part)
    picks = [F.max(F.when(F.col("_name") == n, F.col("_value"))).alias(n) for n in names]
    return long.groupBy(*KEYS).agg(*picks)


def raw_with_adjusted(raw: DataFrame, adjusted: DataFrame) -> DataFrame:
    """Inner one-to-one pairing of raw and adjusted bars; the factor is their ratio."""
    fields = [*PRICES, "preclose"]
    side = adjusted.select(*KEYS, *[F.col(c).alias(f"adj_{c}") for c in fields if c in adjusted.columns])
    return raw.join(side, KEYS, "inner").withColumn("adj_factor", ratio("adj_close", "close"))


# --- sessions a symbol should have but does not -------------------------------


def listed_ranges(sessions: DataFrame, master: DataFrame, start, end) -> DataFrame:
    """First and last expected session index per symbol, from listing to the day
    before delisting, inside ``[start, end]``."""
    first = F.greatest(F.lit(start).cast("date"), F.coalesce("list_date", F.lit(start).cast("date")))
    last = F.least(F.lit(end).cast("date"), F.coalesce(F.date_sub("delist_date", 1), F.lit(end).cast("date")))
    spans = master.select("symbol", first.alias("_from"), last.alias("_to"))
    index = sessions.select("trade_date", "session_idx")
    edges = spans.select(F.col("_from").alias("at"), F.lit("f").alias("kind")).unionByName(
        spans.select(F.col("_to").alias("at"), F.lit("t").alias("kind"))
    ).distinct()
    marks = index.select(F.col("trade_date").alias("at"), F.lit("s").alias("kind"), "session_idx")
    both = marks.unionByName(edges.withColumn("session_idx", F.lit(None).cast("int")))
    ordered = W.orderBy("at")
    after = F.last("session_idx", ignorenulls=True).over(W.orderBy(F.desc("at")).rangeBetween(W.unboundedPreceding, 0))
    before = F.last("session_idx", ignorenulls=True).over(ordered.rangeBetween(W.unboundedPreceding, 0))
    numbered = both.withColumn("at", F.unix_date("at")).withColumns({"_after": after, "_before": before})
    heads = numbered.where("kind = 'f'").select(F.date_from_unix_date("at").alias("_from"), F.col("_after").alias("first_idx"))
    tails = numbered.where("kind = 't'").select(F.date_from_unix_date("at").alias("_to"), F.col("_before").alias("last_idx"))
    return (
        spans.join(F.broadcast(heads), "_from", "left")  # one row per distinct date
        .join(F.broadcast(tails), "_to", "left")
        .where("first_idx <= last_idx")
        .select("symbol", "first_idx", "last_idx")
    )


def gap_islands(expected: DataFrame, observed: DataFrame, sessions: DataFrame, collapse_above: int | None = None) -> DataFrame:
    """Contiguous runs of missing sessions per symbol.

    ``expected`` gives ``(symbol, first_idx, last_idx)``. Runs are the holes between
    consecutive observed sessions (plus both edges), so the symbol x session grid
    is never built. The runs are exact; ``request_start`` and ``request_end`` say what to
    ask a vendor for: the run itself, or one covering span for a symbol with more than
    ``collapse_above`` runs.
    """
    seen = (
        observed.select("symbol", "trade_date")
        .distinct()
        .join(F.broadcast(sessions), "trade_date")  # one row per session
        .join(expected, "symbol")
        .where(F.col("session_idx").between(F.col("first_idx"), F.col("last_idx")))
        .select("symbol", "session_idx")
    )
    edges = expected.select("symbol", F.explode(F.array(F.col("first_idx") - 1, F.col("last_idx") + 1)).alias("session_idx"))
    by_symbol = W.partitionBy("symbol").orderBy("session_idx")
    runs = (
        seen.unionByName(edges)
        .withColumn("_next", F.lead("session_idx").over(by_symbol))
        .where(F.col("_next") - F.col("session_idx") > 1)
        .select(
            "symbol",
            (F.col("session_idx") + 1).alias("start_idx"),
            (F.col("_next") - 1).alias("end_idx"),
            (F.col("_next") - F.col("session_idx") - 1).cast("long").alias("missing_sessions"),
        )
    )
    whole = W.partitionBy("symbol")
    folded = F.count("*").over(whole) > (collapse_above if collapse_above is not None else 1 << 62)
    runs = runs.withColumns(
        {
            "_first": F.when(folded, F.min("start_idx").over(whole)).otherwise(F.col("start_idx")),
            "_last": F.when(folded, F.max("end_idx").over(whole)).otherwise(F.col("end_idx")),
        }
    )
    days = sessions.select("trade_date", "session_idx")
    for index, name in (("start_idx", "start_date"), ("end_idx", "end_date"), ("_first", "request_start"), ("_last", "request_end")):
        runs = runs.join(F.broadcast(days.withColumnsRenamed({"trade_date": name, "session_idx": index})), index)  # calendar
    return runs.select("symbol", "start_date", "end_date", "missing_sessions", "start_idx", "end_idx", "request_start", "request_end")


def missing_by_year(islands: DataFrame, sessions: DataFrame) -> DataFrame:
    """Missing sessions per symbol and year with their first and last date."""
    years = sessions.groupBy(F.year("trade_date").alias("year")).agg(
        F.min("session_idx").alias("_lo"), F.max("session_idx").alias("_hi")
    )
    # a run is cut at year ends through its own list of years; no range join
    spans = islands.withColumn(
        "year", F.explode(F.sequence(F.year("start_date"), F.year("end_date")))
    ).join(F.broadcast(years), "year")
    cut = spans.select(
        "symbol", "year", F.greatest("start_idx", "_lo").alias("_s"), F.least("end_idx", "_hi").alias("_e")
    ).where("_s <= _e")
    per = cut.groupBy("symbol", "year").agg(
        F.sum(F.col("_e") - F.col("_s") + 1).cast("long").alias("missing_sessions"),
        F.min("_s").alias("_s"),
        F.max("_e").alias("_e"),
    )
    days = F.broadcast(sessions.select("trade_date", "session_idx"))
    return (
        per.join(days.withColumnsRenamed({"trade_date": "first_missing", "session_idx": "_s"}), "_s")
        .join(days.withColumnsRenamed({"trade_date": "last_missing", "session_idx": "_e"}), "_e")
        .select("symbol", "year", "missing_sessions", "first_missing", "last_missing")
    )


def request_ranges(cached: DataFrame, symbols: DataFrame, start, end, include_suffix: bool = True) -> DataFrame:
    """Prefix and suffix ranges a cached partition lacks; everything when it is empty."""
    start, end = F.lit(start).cast("date"), F.lit(end).cast("date")
    span = cached.groupBy("symbol").agg(F.min("trade_date").alias("_lo"), F.max("trade_date").alias("_hi"))

    def piece(condition, a, b):
        return F.when(condition & (a <= b), F.struct(a.alias("start_date"), b.alias("end_date")))

    pieces = [
        piece(F.col("_lo").isNull(), start, end),
        piece(F.col("_lo") > start, start, F.date_sub("_lo", 1)),
    ]
    if include_suffix:
        pieces.append(piece(F.col("_hi") < end, F.date_add("_hi", 1), end))
    return (
        symbols.select("symbol")
        .join(span, "symbol", "left")
        .select("symbol", F.explode(F.array_compact(F.array(*pieces))).alias("_r"))
        .select("symbol", "_r.start_date", "_r.end_date")
    )


# --- corporate events -----------------------------------------------------------


def reconcile_events(events: DataFrame, prices: DataFrame, sessions: DataFrame) -> DataFrame:
    """Check each event date's preclose against (previous close - cash) / (1 + bonus)."""
    by_symbol = W.partitionBy("symbol").orderBy("trade_date")
    step = F.col("session_idx") - F.lag("session_idx").over(by_symbol)
    market = (
        prices.select("symbol", "trade_date", "close", "preclose")
        .join(F.broadcast(sessions), "trade_date")
        .withColumns({"_step": step, "_previous": F.lag("close").over(by_symbol)})
        .select(
            "symbol",
            F.col("trade_date").alias("ex_date"),
            F.when(F.col("_step") == 1, F.col("_previous")).alias("previous_close"),
            "preclose",
        )
    )
    per = events.groupBy("symbol", "ex_date").agg(
        F.count("*").alias("event_count"),
        F.min("supported").alias("all_events_supported"),
        F.coalesce(F.sum(F.when(F.col("kind") == "CA", F.col("amount_per_share"))), F.lit(0.0)).alias("cash_per_share"),
        F.coalesce(F.sum(F.when(F.col("kind") == "SD", F.col("amount_per_share"))), F.lit(0.0)).alias("bonus_ratio"),
    )
    joined = per.join(market, ["symbol", "ex_date"], "left")
    eligible = F.coalesce(
        F.col("all_events_supported")
        & (F.col("previous_close") > 0)
        & (F.col("preclose") > 0)
        & (F.col("cash_per_share") < F.col("previous_close")),
        F.lit(False),
    )
    expected = F.when(eligible, ratio(F.col("previous_close") - F.col("cash_per_share"), 1 + F.col("bonus_ratio")))
    joined = joined.withColumn("expected_preclose", expected)
    joined = joined.withColumn("absolute_error", F.abs(F.col("expected_preclose") - F.col("preclose")))
    status = (
        F.when(~eligible, "NOT_COMPARABLE")
        .when(F.col("absolute_error") <= 0.0151, "MATCH_WITHIN_TICK_TOLERANCE")
        .otherwise("REVIEW_DIFFERENCE")
    )
    return joined.withColumn("status", status)


def reference_price_changes(bars: DataFrame, sessions: DataFrame, tolerance: float = 0.0051) -> DataFrame:
    """Bars whose preclose departs from the previous adjacent session's close."""
    by_symbol = W.partitionBy("symbol").orderBy("trade_date")
    stepped = bars.join(F.broadcast(sessions), "trade_date").withColumns(
        {
            "_step": F.col("session_idx") - F.lag("session_idx").over(by_symbol),
            "previous_close": F.lag("close").over(by_symbol),
        }
    )
    moved = (F.col("_step") == 1) & (F.col("preclose") > 0) & (
        F.abs(F.col("previous_close") - F.col("preclose")) > tolerance
    )
    return stepped.where(moved).select("trade_date", "symbol", "previous_close", "preclose")


def finite_columns(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: finite(c) for c in columns})
