"""Vendor layouts to the canonical bar layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.dates import lenient_date
from lattica.functions.numeric import flag
from lattica.functions.symbols import vendor_to_symbol
from lattica.operators.checks import assert_empty, assert_unique, require_columns
from lattica.schema import KEYS, VENDOR_A_NAMES, VENDOR_A_NUMBERS, VENDOR_B_NAMES

# Vendor C units.
SHARES_PER_LOT = 100.0
AMOUNT_UNIT = 1000.0
MARKET_VALUE_UNIT = 10_000.0


def strict_number(name: str, columns) -> Column:
    """Empty text is missing; any other non-number is an error (ANSI cast)."""
    if name not in columns:
        return F.lit(None).cast("double")
    text = F.col(name).cast("string")
    return F.when(F.trim(text) == "", F.lit(None)).otherwise(text).cast("double")


def normalize_vendor_a(raw: DataFrame, check: bool = True) -> DataFrame:
    """Text bars with ``sh.600000`` codes and '0'/'1' status columns."""
    df = raw.withColumnsRenamed(VENDOR_A_NAMES)
    have = set(df.columns)
    if "adjustflag" in have and check:
        assert_empty(df.where(~F.col("adjustflag").eqNullSafe("3")), "adjusted prices in a raw-price source")
    if "symbol" not in have:
        df = df.withColumn("symbol", vendor_to_symbol("code"))
    out = {"trade_date": F.to_date("trade_date")}
    out.update({c: strict_number(c, have) for c in VENDOR_A_NUMBERS})
    for source, state, on in (("tradestatus", "is_suspended", "0"), ("isST", "is_st", "1")):
        if source in have:
            out[f"{state}_known"] = F.coalesce(F.col(source).isin("0", "1"), F.lit(False))
            out[state] = F.coalesce(F.col(source) == on, F.lit(False))
        else:
            for c in (state, f"{state}_known"):
                out[c] = flag(c) if c in have else F.lit(False)
    states = ["is_st", "is_st_known", "is_suspended", "is_suspended_known"]
    result = df.withColumns(out).select(*KEYS, *VENDOR_A_NUMBERS, *states)
    if check:
        assert_empty(result.where("trade_date IS NULL OR symbol IS NULL"), "null stock or date")
        assert_unique(result, KEYS, "vendor A")
    return result


def normalize_vendor_b(raw: DataFrame, symbol_map: DataFrame, check: bool = True) -> DataFrame:
    """Exchange archive: numeric codes padded to six and mapped to symbols.

    ``symbol_map`` is ``(code, symbol)``.
    """
    df = raw.withColumnsRenamed(VENDOR_B_NAMES)
    padded = F.col("stkcd").cast("string")
    padded = F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), 6 - F.length(padded))), padded)
    df = df.withColumn("code", padded).join(symbol_map, "code", "left")
    numbers = [c for c in VENDOR_B_NAMES.values() if c != "trade_date"]
    have = set(df.columns)
    result = df.withColumns(
        {"trade_date": F.to_date("trade_date"), **{c: strict_number(c, have) for c in numbers}}
    ).select(*KEYS, *numbers)
    if check:
        assert_empty(result.where("trade_date IS NULL OR symbol IS NULL"), "unmapped symbol or date")
        assert_unique(result, KEYS, "vendor B")
    return result


def normalize_vendor_c(
    daily: DataFrame,
    factors: DataFrame,
    basics: DataFrame | None = None,
    master: DataFrame | None = None,
    limits: DataFrame | None = None,
    suspended: DataFrame | None = None,
    st_list: DataFrame | None = None,
    tolerance: float = 1e-6,
) -> DataFrame:
    """Per-date tables keyed by ``(trade_date, ts_code)``; volumes in lots.

    A table passed as None is unknown and its known-flag is False. Suspended codes
    without a bar become placeholder rows.
    """
    keys = ["trade_date", "ts_code"]
    frame = daily
    if suspended is not None:
        absent = suspended.select(*keys).distinct().join(daily.select(*keys), keys, "left_anti")
        frame = daily.unionByName(absent, allowMissingColumns=True)
    frame = frame.join(factors.select(*keys, "adj_factor"), keys, "left")
    if basics is not None:
        frame = (
            frame.join(basics.select(*keys, "turnover_rate", "total_mv", "circ_mv"), keys, "left")
            .withColumn("market_cap", F.col("total_mv") * MARKET_VALUE_UNIT)
            .withColumn("float_market_cap", F.col("circ_mv") * MARKET_VALUE_UNIT)
            .drop("total_mv", "circ_mv")
        )
    if master is not None:
        frame = frame.join(master.select("ts_code", "name", "industry", "list_date"), "ts_code", "left")
    no = F.lit(False)
    if limits is not None:
        frame = frame.join(limits.select(*keys, "up_limit", "down_limit"), keys, "left")
        up = F.coalesce(F.col("open") >= F.col("up_limit") * (1 - tolerance), no)
        down = F.coalesce(F.col("open") <= F.col("down_limit") * (1 + tolerance), no)
    else:
        up = down = no
    frame = frame.withColumns({"is_limit_up": up, "is_limit_down": down, "limit_status_known": F.lit(limits is not None)})
    for state, listed in (("is_suspended", suspended), ("is_st", st_list)):
        if listed is None:
            frame = frame.withColumns({state: no, f"{state}_known": no})
        else:
            marks = listed.select(*keys).distinct().withColumn("_mark", F.lit(True))
            frame = (
                frame.join(marks, keys, "left")
                .withColumns({state: flag("_mark"), f"{state}_known": F.lit(True)})
                .drop("_mark")
            )
    return (
        frame.withColumns({"volume": F.col("vol") * SHARES_PER_LOT, "amount": F.col("amount") * AMOUNT_UNIT})
        .drop("vol")
        .withColumnRenamed("ts_code", "symbol")
    )


def normalize_events(raw: DataFrame) -> DataFrame:
    """Distribution events: dates in mixed formats, nine labelled issues."""
    require_columns(raw, ["stkcd", "disttyp", "exdistdt", "annodt", "paydt", "amount", "roprc"])
    code = F.regexp_replace(F.col("stkcd").cast("string"), r"\.0$", "")
    code = F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), 6 - F.length(code))), code)
    shaped = raw.select(
        code.alias("_code"),
        F.concat(code, F.when(code.startswith("6"), ".SH").otherwise(".SZ")).alias("symbol"),
        F.upper(F.trim("disttyp")).alias("kind"),
        lenient_date("exdistdt").alias("ex_date"),
        lenient_date("annodt").alias("announcement_date"),
        lenient_date("paydt").alias("payment_date"),
        F.expr("try_cast(amount AS DOUBLE)").alias("amount_per_share"),
        F.expr("try_cast(roprc AS DOUBLE)").alias("rights_price"),
    )
    keys = ["symbol", "ex_date", "kind"]
    repeated = shaped.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg((F.count("*") > 1).alias("_repeated"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    marked = shaped.join(repeated, same).drop(*[f"_{k}" for k in keys])
    amount = F.col("amount_per_share")
    # labels in their declared order
    labels = [
        ("unsupported_symbol", ~F.col("_code").rlike(r"^[036]\d{5}$")),
        ("unsupported_kind", ~F.coalesce(F.col("kind").isin("CA", "SD"), F.lit(False))),
        ("invalid_ex_date", F.col("ex_date").isNull()),
        ("unknown_announcement", F.col("announcement_date").isNull()),
        ("announcement_after_ex_date", F.col("announcement_date") > F.col("ex_date")),
        ("unknown_payment_date", F.col("payment_date").isNull()),
        ("payment_before_ex_date", F.col("payment_date") < F.col("ex_date")),
        ("invalid_amount", amount.isNull() | F.isnan(amount) | (F.abs(amount) == float("inf")) | (amount < 0)),
        ("duplicate_event", F.col("_repeated")),
    ]
    issues = F.concat_ws(";", *[F.when(test, label) for label, test in labels])
    return marked.withColumn("issues", issues).withColumn("supported", F.col("issues") == "").drop("_code", "_repeated")


def extract_violations(
    df: DataFrame, columns, code: str, date: str, windows: DataFrame, codes: DataFrame, row_limit: int, daily_key: bool = True
) -> DataFrame:
    """Counts of what an extract must not contain, one row per partition requested or delivered.

    ``windows`` is ``(partition, start_date, end_date)``, one row per partition;
    ``codes`` is the requested list, ``(code)``. ``df`` carries ``partition``. A partition
    nobody requested is refused; a requested one without rows is listed with 0.
    """
    extra = sorted(set(df.columns) ^ (set(columns) | {"partition"}))
    if extra:
        raise ValueError(f"unexpected or missing columns: {extra}")
    keyed = df.groupBy("partition", code, date).agg(F.count("*").alias("_n"))
    asked = codes.select(F.col("code").alias(code), F.lit(True).alias("_asked")).distinct()
    wanted = windows.withColumn("_wanted", F.lit(True))
    joined = keyed.join(wanted, "partition", "full").join(asked, code, "left")
    outside = ~F.coalesce(F.col(date).between(F.col("start_date"), F.col("end_date")), F.lit(False))
    zero = F.lit(0)
    n = F.coalesce("_n", zero)
    counts = joined.groupBy("partition").agg(
        F.sum(n).alias("rows"),
        F.max("_wanted").isNull().alias("unrequested_partition"),
        F.sum(F.when(F.col("_asked").isNull(), n).otherwise(zero)).alias("unrequested_codes"),
        F.sum(F.when(outside, n).otherwise(zero)).alias("dates_outside"),
        F.sum(F.coalesce(F.col("_n") - 1, zero) if daily_key else zero).alias("duplicate_rows"),
    )
    clean = (
        ~F.col("unrequested_partition")
        & (F.col("unrequested_codes") == 0)
        & (F.col("dates_outside") == 0)
        & (F.col("duplicate_rows") == 0)
        & (F.col("rows") <= row_limit)
    )
    return counts.withColumn("over_limit", F.col("rows") > row_limit).withColumn("accepted", clean)
