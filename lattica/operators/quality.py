"""Panel normalisation, row codes, validation and the audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.numeric import all_of, any_of, finite, flag, positive, ratio
from lattica.operators.calendars import trailing_sessions
from lattica.operators.checks import duplicate_keys, require_columns
from lattica.schema import ACTIVITY, KEYS, KNOWN, NUMERIC, PRICES, REQUIRED, STATES

# Fixed values of the audit.
JUMP_LIMIT = 0.25
IMPORTANT_MISSING_LIMIT = 0.01
IMPORTANT_FIELDS = ["adj_factor", "market_cap", "industry"]
RECENT_SESSIONS = 60
MINIMUM_INDEX_MEDIAN = 10


def normalize_panel(df: DataFrame) -> DataFrame:
    """Midnight dates, numeric columns, defaulted flags; no row is dropped."""
    require_columns(df, REQUIRED)
    have = set(df.columns)
    changes: dict[str, Column] = {
        "trade_date": F.to_date("trade_date"),
        "symbol": F.col("symbol").cast("string"),
    }
    for name in NUMERIC:
        if name in have:
            changes[name] = finite(F.expr(f"try_cast(`{name}` AS DOUBLE)"))
    for name in STATES + KNOWN:
        changes[name] = flag(F.col(name).cast("boolean")) if name in have else F.lit(False)
    if "adj_factor" not in have:
        changes["adj_factor"] = F.lit(1.0)
    if "list_date" in have:
        changes["list_date"] = F.to_date("list_date")
    if "industry" not in have:
        changes["industry"] = F.lit("UNKNOWN")
    return df.withColumns(changes)


def bad_ohlc() -> Column:
    """Non-positive price, or a high/low that other prices cross; NULLs do not count."""
    return F.coalesce(
        any_of(F.coalesce(F.col(c) <= 0, F.lit(False)) for c in PRICES)
        | F.coalesce(F.col("high") < F.greatest("open", "close", "low"), F.lit(False))
        | F.coalesce(F.col("low") > F.least("open", "close", "high"), F.lit(False)),
        F.lit(False),
    )


def negative_activity() -> Column:
    return any_of(F.coalesce(F.col(c) < 0, F.lit(False)) for c in ACTIVITY)


def validate_panel(df: DataFrame) -> DataFrame:
    """One row of violation counts and panel facts."""
    numbers = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "long", "integer", "float")]
    missing = sum((F.avg(F.col(c).isNull().cast("double")) for c in numbers), F.lit(0.0)) / max(1, len(numbers))
    facts = df.agg(
        F.count("*").alias("rows"),
        F.countDistinct("symbol").alias("symbols"),
        F.min("trade_date").alias("start_date"),
        F.max("trade_date").alias("end_date"),
        missing.alias("missing_ratio"),
        F.count_if(any_of(F.col(c) <= 0 for c in PRICES)).alias("nonpositive_prices"),
        F.count_if(F.col("high") < F.greatest("open", "close", "low")).alias("high_too_low"),
        F.count_if(F.col("low") > F.least("open", "close", "high")).alias("low_too_high"),
        F.count_if(negative_activity()).alias("negative_activity"),
    )
    repeated = duplicate_keys(df, KEYS).agg(F.count("*").alias("duplicate_keys"))
    return facts.join(repeated, F.lit(True))


def missing_code(columns) -> Column:
    """Why a bar is incomplete: SUSPENDED, PROVIDER_GAP, ADJUSTMENT_GAP or OK."""
    raw_missing = any_of(F.col(c).isNull() for c in PRICES + ACTIVITY)
    adjusted = [c for c in ("adj_open", "adj_close") if c in columns]
    adjusted_missing = any_of(F.col(c).isNull() for c in adjusted) if len(adjusted) == 2 else F.lit(True)
    return (
        F.when(flag("is_suspended"), "SUSPENDED")
        .when(raw_missing, "PROVIDER_GAP")
        .when(adjusted_missing, "ADJUSTMENT_GAP")
        .otherwise("OK")
    )


def classify_missing(df: DataFrame) -> DataFrame:
    return df.withColumn("missing_reason", missing_code(df.columns)).withColumn(
        "is_usable_market_data", F.col("missing_reason").isin("OK", "SUSPENDED")
    )


def supplied_limit_flags(df: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """At-limit flags from supplied limits, only where the limit status is known."""
    known = flag("limit_status_known")
    return df.withColumns(
        {
            "is_limit_up": known & F.coalesce(F.col("open") >= F.col("up_limit") * (1 - tolerance), F.lit(False)),
            "is_limit_down": known & F.coalesce(F.col("open") <= F.col("down_limit") * (1 + tolerance), F.lit(False)),
        }
    )


def amount_outside_range() -> Column:
    """Average traded price further than 0.011 from the day's range (unknown is no)."""
    average = ratio("amount", positive("volume"))
    return F.coalesce((average < F.col("low") - 0.011) | (average > F.col("high") + 0.011), F.lit(False))


def daily_coverage(df: DataFrame) -> DataFrame:
    suspended = F.sum(flag("is_suspended").cast("long")) if "is_suspended" in df.columns else F.count("*")
    return df.groupBy("trade_date").agg(
        F.countDistinct("symbol").alias("symbols"),
        F.avg(F.col("amount").isNull().cast("double")).alias("amount_missing"),
        suspended.alias("suspended"),
    )


def null_ratios(df: DataFrame) -> DataFrame:
    """``(column, ratio)`` from a single pass."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    return shares.unpivot([], list(df.columns), "column", "ratio")


def _issue_rows(wide: DataFrame, issues: list[tuple[str, str, Column]]) -> DataFrame:
    rows = F.array(
        *[
            F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), count.cast("long").alias("count"))
            for severity, code, count in issues
        ]
    )
    return wide.select(F.inline(rows)).where("count > 0")


def audit_panel(
    df: DataFrame,
    sessions: DataFrame | None = None,
    required_coverage: float = 0.99,
    expected_latest_symbols: int | None = None,
    dual_prices: bool = False,
) -> DataFrame:
    """Coded issues ``(severity, code, count)``; nothing is repaired silently."""
    missing = sorted(set(REQUIRED) - set(df.columns))
    spark = df.sparkSession
    if missing:
        return spark.createDataFrame([("ERROR", "MISSING_COLUMNS", len(missing))], "severity string, code string, count long")
    have = set(df.columns)
    member = flag("in_index") if "in_index" in have else F.lit(True)
    active = ~flag("is_suspended") if "is_suspended" in have else F.lit(True)
    adjusted = F.col("close") * (F.col("adj_factor") if "adj_factor" in have else F.lit(1.0))

    # Jumps carry the last seen price over missing closes first, unlike factor returns.
    by_symbol = W.partitionBy("symbol").orderBy("trade_date")
    carried = F.last(adjusted, ignorenulls=True).over(by_symbol.rowsBetween(W.unboundedPreceding, 0))
    work = df.withColumn("_carried", carried)
    work = work.withColumn("_jump", F.abs(ratio("_carried", F.lag("_carried").over(by_symbol)) - 1) > JUMP_LIMIT)

    counts = [
        F.count("*").alias("rows"),
        F.count_if(F.col("trade_date").isNull()).alias("invalid_dates"),
        F.count_if(bad_ohlc()).alias("invalid_ohlc"),
        F.count_if(negative_activity()).alias("negative_activity"),
        F.count_if(active & any_of(F.col(c).isNull() for c in PRICES + ACTIVITY)).alias("active_missing"),
        F.count_if("_jump").alias("jumps"),
        *[
            (F.avg(flag(c).cast("double")) if c in have else F.lit(0.0)).alias(f"cover_{c}")
            for c in KNOWN
        ],
        *[
            (F.avg(F.col(c).isNull().cast("double")) if c in have else F.lit(1.0)).alias(f"null_{c}")
            for c in IMPORTANT_FIELDS
        ],
    ]
    dual = {"open", "close", "adj_open", "adj_close"}
    dual_missing = sorted(dual - have)
    if dual_prices and not dual_missing:
        counts.append(F.max(((F.col("adj_open") <= 0) | (F.col("adj_close") <= 0)).cast("int")).alias("bad_adjusted"))
    wide = work.agg(*counts)
    # Everything counted per key or per date comes from one grouping of the panel.
    keyed = df.groupBy(*KEYS).agg(F.count("*").alias("rows"), F.sum(member.cast("long")).alias("members"))
    named = (F.col("members") > 0) & F.col("symbol").isNotNull()
    daily = keyed.groupBy("trade_date").agg(
        F.sum(F.col("rows") - 1).alias("repeated"),
        F.sum("members").alias("n"),
        F.count_if(named).alias("symbols"),
    )
    wide = wide.join(
        daily.agg(
            F.coalesce(F.sum("repeated"), F.lit(0)).alias("duplicates"),
            F.coalesce(F.max_by("symbols", "trade_date"), F.lit(0)).alias("latest_symbols"),
            F.median(F.when(F.col("n") > 0, F.col("n"))).alias("member_median"),
            F.count_if(F.col("n") == 0).alias("empty_dates"),
        ),
        F.lit(True),
    )

    issues: list[tuple[str, str, Column]] = [
        ("ERROR", "DUPLICATE_KEYS", F.col("duplicates")),
        ("ERROR", "INVALID_DATES", F.col("invalid_dates")),
        ("ERROR", "INVALID_OHLC", F.col("invalid_ohlc")),
        ("ERROR", "NEGATIVE_ACTIVITY", F.col("negative_activity")),
        ("ERROR", "MISSING_ACTIVE_MARKET_DATA", F.col("active_missing")),
        ("WARNING", "LARGE_ADJUSTED_JUMPS", F.col("jumps")),
        (
            "WARNING",
            "IMPORTANT_MISSING",
            sum(((F.col(f"null_{c}") > IMPORTANT_MISSING_LIMIT).cast("int") for c in IMPORTANT_FIELDS), F.lit(0)),
        ),
    ]
    if dual_prices:
        issues.append(("ERROR", "RAW_ADJUSTED_PRICE_MISSING", F.lit(len(dual_missing))))
        if not dual_missing:
            issues.append(("ERROR", "INVALID_ADJUSTED_PRICE", F.col("bad_adjusted")))
    for name in KNOWN:
        cover = F.col(f"cover_{name}")
        short = F.when(cover < required_coverage, F.floor((1 - cover) * F.col("rows"))).otherwise(F.lit(0))
        issues.append(("ERROR", f"LOW_{name.upper()}", short))
    if "in_index" in have:
        thin = F.coalesce(F.col("member_median") < MINIMUM_INDEX_MEDIAN, F.lit(True))
        issues.append(("ERROR", "INDEX_MEMBERSHIP_EMPTY", F.when(thin, F.col("empty_dates")).otherwise(F.lit(0))))
    if sessions is not None:
        absent = sessions.select("trade_date").join(daily.select("trade_date"), "trade_date", "left_anti")
        wide = wide.join(absent.agg(F.count("*").alias("absent_dates")), F.lit(True))
        issues.append(("ERROR", "MISSING_TRADE_DATES", F.col("absent_dates")))
        latest = df.join(df.agg(F.max("trade_date").alias("trade_date")), "trade_date", "left_semi")
        recent = recent_gaps(df, sessions, latest.where(member).select("symbol").distinct())
        wide = wide.join(recent.agg(F.coalesce(F.sum("gaps"), F.lit(0)).alias("recent_gaps")), F.lit(True))
        issues.append(("ERROR", "RECENT_SYMBOL_DATE_GAPS", F.col("recent_gaps")))
    if expected_latest_symbols is not None:
        short = F.greatest(F.lit(0), F.lit(expected_latest_symbols) - F.col("latest_symbols"))
        issues.append(("ERROR", "INCOMPLETE_LATEST_CROSS_SECTION", short))
    return _issue_rows(wide, issues)


def recent_gaps(df: DataFrame, sessions: DataFrame, symbols: DataFrame, count: int = RECENT_SESSIONS) -> DataFrame:
    """Sessions of the trailing window each symbol lacks since its first row.

    Counted as required minus observed, so no symbol x session grid is built.
    """
    window = trailing_sessions(sessions, count).select("trade_date")
    rows = df.join(symbols, "symbol", "left_semi")
    inside = F.broadcast(window.withColumn("_inside", F.lit(True)))  # one row per session of the window
    per_symbol = (
        rows.join(inside, "trade_date", "left")
        .groupBy("symbol")
        .agg(F.min("trade_date").alias("first_date"), F.count_distinct(F.when(F.col("_inside"), F.col("trade_date"))).alias("observed"))
        .join(window.agg(F.array_sort(F.collect_list("trade_date")).alias("_window")), F.lit(True))  # one row
    )
    required = F.size(F.filter("_window", lambda d: d >= F.col("first_date")))
    return per_symbol.select("symbol", (required - F.col("observed")).cast("long").alias("gaps"))


def audit_summary(df: DataFrame) -> DataFrame:
    """Panel facts that accompany the issue list."""
    member = flag("in_index") if "in_index" in df.columns else F.lit(True)
    latest = df.join(df.agg(F.max("trade_date").alias("trade_date")), "trade_date", "left_semi")
    return df.agg(
        F.count("*").alias("rows"),
        F.countDistinct("symbol").alias("symbols"),
        F.min("trade_date").alias("start_date"),
        F.max("trade_date").alias("end_date"),
        F.countDistinct("trade_date").alias("trade_dates"),
    ).join(latest.where(member).agg(F.countDistinct("symbol").alias("latest_symbols")), F.lit(True))


def acceptance(df: DataFrame, source_rows: DataFrame, member: str = "in_index", complete: str = "membership_complete") -> DataFrame:
    """Dataset acceptance row: row count, distinct keys, latest and member figures."""
    latest = df.agg(F.max("trade_date").alias("trade_date"))
    keyed = df.groupBy(*KEYS).agg(F.count("*").alias("n")).agg(F.count("*").alias("distinct_keys"))
    facts = df.agg(
        F.count("*").alias("rows"),
        F.count_if(flag(member) & ~flag("limit_status_known")).alias("unknown_limit_member_rows"),
        F.countDistinct(F.when(~flag(complete), F.col("trade_date"))).alias("incomplete_sessions"),
    )
    last = df.join(latest, "trade_date", "left_semi").agg(
        F.count("*").alias("latest_rows"), F.count_if(flag(member)).alias("latest_members")
    )
    out = facts.join(keyed, F.lit(True)).join(last, F.lit(True)).join(source_rows, F.lit(True))
    return out.withColumn(
        "accepted", (F.col("rows") == F.col("distinct_keys")) & (F.col("rows") == F.col("source_rows"))
    )


def window_completeness(
    df: DataFrame, required: DataFrame, sessions: DataFrame, target, lookback: int = 121
) -> DataFrame:
    """Per required symbol: absent sessions, broken rows and latest status in the window.

    ``required`` has ``symbol`` and optionally ``list_date``; expected sessions are
    counted from a broadcast array of the ``lookback`` window dates.
    """
    target = F.lit(target).cast("date") if not isinstance(target, Column) else target
    window = trailing_sessions(sessions.where(F.col("trade_date") <= target), lookback)
    dates = window.agg(F.array_sort(F.collect_list("trade_date")).alias("_dates"))
    fields = ["open", "high", "low", "close", "preclose", "adj_close"]
    broken = (
        any_of(finite(c).isNull() for c in fields + ACTIVITY)
        | any_of(F.col(c) <= 0 for c in fields)
        | negative_activity()
        | bad_ohlc()
        | (~flag("is_suspended") & any_of(F.col(c) <= 0 for c in ACTIVITY))
    )
    if "amount_outside_price_range" in df.columns:
        broken = broken | F.coalesce(F.col("amount_outside_price_range"), F.lit(True))
    states_known = all_of(flag(c) for c in KNOWN) & all_of(F.col(c).isNotNull() for c in STATES)
    wanted = required if "list_date" in required.columns else required.withColumn("list_date", F.lit(None).cast("date"))
    rows = (
        df.drop("list_date")
        .join(F.broadcast(window.select("trade_date")), "trade_date", "left_semi")  # one row per session of the window
        .withColumn("_broken", F.coalesce(broken, F.lit(True)))
        .withColumn("_known", states_known)
        .join(wanted, "symbol")
        .where(F.col("list_date").isNull() | (F.col("trade_date") >= F.col("list_date")))
    )
    seen = rows.groupBy("symbol").agg(
        F.countDistinct("trade_date").alias("_observed"),
        F.count_if("_broken").alias("invalid_rows"),
        F.max((F.col("trade_date") == target).cast("int")).alias("_latest"),
        F.max(F.when(F.col("trade_date") == target, F.col("_known").cast("int"))).alias("_known"),
    )
    expected = F.size(F.filter("_dates", lambda d: F.col("list_date").isNull() | (d >= F.col("list_date"))))
    return (
        wanted.join(seen, "symbol", "left")
        .join(dates, F.lit(True))
        .select(
            "symbol",
            (expected - F.coalesce("_observed", F.lit(0))).cast("long").alias("missing_sessions"),
            F.coalesce("invalid_rows", F.lit(0)).alias("invalid_rows"),
            (F.coalesce("_latest", F.lit(0)) == 0).alias("missing_latest"),
            F.coalesce(F.col("_known") == 0, F.lit(False)).alias("unknown_status"),
        )
        .withColumn(
            "complete",
            (F.col("missing_sessions") == 0)
            & (F.col("invalid_rows") == 0)
            & ~F.col("missing_latest")
            & ~F.col("unknown_status"),
        )
    )
