"""Bar panels built from the given order tables.

``lineitem`` plays the tape: a supplier is a symbol, a ship date a session, and
unit price x quantity a trade. Bars are a hash aggregation with map-side combine
(order keys are packed into one long so that open and close need no sort).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.sections import Layout, add_positions

DAY_OF_WEEK_SHIFT = 1 << 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def section_layout(spark: SparkSession, sf_dir: str) -> Layout:
    """A date holds at most one row per supplier; the count comes from file footers."""
    return Layout.for_bound(table(spark, sf_dir, "supplier").count())


def symbol_of(key: str | Column) -> Column:
    """Supplier key to an exchange-style code spread over four boards."""
    key = F.col(key) if isinstance(key, str) else key
    text = key.cast("string")
    digits = F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), 3 - F.length(text))), text)
    board = key % 4
    head = F.when(board == 0, "600").when(board == 1, "000").when(board == 2, "300").otherwise("688")
    tail = F.when(board.isin(1, 2), ".SZ").otherwise(".SH")
    return F.concat(head, digits, tail)


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security master: symbol, market value, industry."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return (
        table(spark, sf_dir, "supplier")
        .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"), "left")  # 25 nations
        .select(
            symbol_of("s_suppkey").alias("symbol"),
            F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("market_cap"),
            F.concat(F.lit("IND"), F.col("n_regionkey")).alias("industry"),
        )
    )


def _bars(lines: DataFrame, date: Column, order: Column) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    grouped = (
        lines.select(
            date.alias("trade_date"),
            "l_suppkey",
            price.alias("p"),
            order.alias("k"),
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            "l_tax",
        )
        .groupBy("trade_date", "l_suppkey")
        .agg(
            F.min_by("p", "k").alias("open"),
            F.max("p").alias("high"),
            F.min("p").alias("low"),
            F.max_by("p", "k").alias("close"),
            F.sum("l_quantity").alias("volume"),
            F.sum("l_extendedprice").alias("amount"),
            (F.max("l_discount") >= 0.0999).alias("is_st"),
            (F.min("l_quantity") <= 1).alias("is_suspended"),
            (1 + F.max("l_tax")).alias("adj_factor"),
        )
    )
    return grouped.select("trade_date", symbol_of("l_suppkey").alias("symbol"), *grouped.columns[2:])


def _within_order() -> Column:
    return F.col("l_orderkey") * 8 + F.col("l_linenumber")


def daily_bars(lines: DataFrame) -> DataFrame:
    return _bars(lines, F.to_date("l_shipdate"), _within_order())


def weekly_bars(lines: DataFrame) -> DataFrame:
    """One bar per week, dated on its Monday; lines are ordered by day first."""
    week = F.date_trunc("week", "l_shipdate").cast("date")
    day = F.weekday("l_shipdate").cast("long") * DAY_OF_WEEK_SHIFT
    return _bars(lines, week, day + _within_order())


#: Columns of a panel from which ``derived`` builds the others that factors read.
PLAIN = ["trade_date", "symbol", "open", "high", "low", "close", "volume", "amount", "adj_factor", "market_cap"]


def derived() -> dict[str, Column]:
    return {
        "turnover_rate": F.col("volume") / 100,
        "adj_open": F.col("open") * F.col("adj_factor"),
        "adj_close": F.col("close") * F.col("adj_factor"),
        "book_value": F.col("amount") * 0.8,
        "net_profit_ttm": F.col("amount") * 0.05,
    }


def _enrich(bars: DataFrame, master: DataFrame) -> DataFrame:
    return bars.join(master, "symbol", "left").select(
        "trade_date",
        *[c for c in bars.columns if c != "trade_date"],
        "market_cap",
        "industry",
        *[value.alias(name) for name, value in derived().items()],
        F.lit(True).alias("is_st_known"),
        F.lit(True).alias("is_suspended_known"),
        F.lit(True).alias("limit_status_known"),
    )


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enrich(daily_bars(table(spark, sf_dir, "lineitem")), securities(spark, sf_dir))


def weekly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enrich(weekly_bars(table(spark, sf_dir, "lineitem")), securities(spark, sf_dir))


def monthly_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index constituents: each month's top half by amount, effective the next month."""
    lines = table(spark, sf_dir, "lineitem")
    month = F.date_trunc("month", "l_shipdate").cast("date")
    totals = lines.groupBy(month.alias("month"), "l_suppkey").agg(F.sum("l_extendedprice").alias("amount"))
    totals = totals.select("month", symbol_of("l_suppkey").alias("symbol"), "amount")
    ranked = add_positions(
        totals, ["month"], "amount", descending=True, position="_pos", total="_n",
        layout=section_layout(spark, sf_dir),
    )
    return ranked.where(F.col("_pos") * 2 <= F.col("_n")).select(
        F.add_months("month", 1).alias("trade_date"),
        "symbol",
        F.round(F.col("amount") / 1000, 2).alias("weight"),
    )


def adjustment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated adjustment factors: one per symbol and month, known on the month's first day."""
    lines = table(spark, sf_dir, "lineitem")
    month = F.date_trunc("month", "l_shipdate").cast("date")
    return lines.groupBy(month.alias("trade_date"), "l_suppkey").agg(
        (1 + F.max("l_discount")).alias("adj_factor")
    ).select("trade_date", symbol_of("l_suppkey").alias("symbol"), "adj_factor")


def vendor_bars(spark: SparkSession, sf_dir: str, vendor: str) -> DataFrame:
    """Overlapping second source: A sees orders 0,1 (mod 3), B sees orders 1,2."""
    lines = table(spark, sf_dir, "lineitem")
    seen = F.col("l_orderkey") % 3 < 2 if vendor == "A" else F.col("l_orderkey") % 3 > 0
    bars = daily_bars(lines.where(seen))
    return bars.withColumn("preclose", F.col("open"))
