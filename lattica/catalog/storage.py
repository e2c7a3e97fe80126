"""Scan, sink, streaming and user-factor queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.catalog.base import SNAPSHOTS, VENDOR_A, VENDOR_B, query, symbol_sql, with_daily, with_weekly
from lattica.catalog.research import r, rounded, sig_sql, signals
from lattica.operators import factors, merging
from lattica.operators.calendars import session_list
from lattica.plans.panel import daily_bars, daily_panel, monthly_snapshots, symbol_of, table, vendor_bars, weekly_panel
from lattica.schema import BAR
from lattica.session import scratch_path, settle
from lattica.sources import readers, versions, writers
from lattica.sources.hashtree import hash_tree, tree_differences
from lattica.streaming import latest
from lattica.streaming.ingest import ingest_bars

DAILY_VIEW = "SELECT trade_date, symbol, round(close, 9) AS close, volume FROM daily"
CSV = T.StructType(
    [
        T.StructField("trade_date", T.DateType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)


def plain(spark, sf):
    return daily_bars(table(spark, sf, "lineitem")).select("trade_date", "symbol", "close", "volume")


@query("csv_round_trip", with_daily(DAILY_VIEW))
def csv_round_trip(spark, sf):
    path = writers.write_table(plain(spark, sf), scratch_path(spark, "bars") + ".csv")
    return readers.read_table(spark, path, CSV).withColumn("close", F.round("close", 9))


@query("parquet_round_trip", with_daily(DAILY_VIEW))
def parquet_round_trip(spark, sf):
    path = writers.write_table(plain(spark, sf), scratch_path(spark, "bars") + ".parquet")
    return readers.read_table(spark, path).withColumn("close", F.round("close", 9))


@query(
    "report_csv",
    with_daily("SELECT trade_date, symbol, volume FROM daily"),
)
def report_csv(spark, sf):
    compact = plain(spark, sf).withColumn("trade_date", F.date_format("trade_date", "yyyyMMdd"))
    path = writers.write_table(compact, scratch_path(spark, "report") + ".csv")
    out = readers.read_report(spark, path, ["trade_date", "symbol", "volume"])
    return out.select("trade_date", "symbol", F.col("volume").cast("double").alias("volume"))


@query(
    "drifting_schema",
    with_daily(
        """SELECT trade_date, symbol, round(close, 9) AS close, CASE WHEN year(trade_date) >= 1999 THEN volume END AS volume FROM daily"""
    ),
)
def drifting_schema(spark, sf):
    bars = plain(spark, sf)
    old = writers.write_table(bars.where("trade_date < '1999-01-01'").drop("volume"), scratch_path(spark, "old") + ".parquet")
    new = writers.write_table(bars.where("trade_date >= '1999-01-01'"), scratch_path(spark, "new") + ".parquet")
    return readers.read_drifting(spark, [old, new]).select("trade_date", "symbol", F.round("close", 9).alias("close"), "volume")


@query(
    "warmup_scan",
    with_daily(
        """, s AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS idx FROM (SELECT DISTINCT trade_date FROM daily)),
      f AS (SELECT min(idx) - 20 AS lo FROM s WHERE trade_date >= DATE '1999-06-01')
      SELECT trade_date, symbol, round(amount, 2) AS amount, round(close, 9) AS close FROM daily WHERE trade_date >= (SELECT trade_date FROM s, f WHERE idx = lo) AND trade_date <= DATE '1999-12-31'"""
    ),
)
def warmup_scan(spark, sf):
    out = readers.load_for_factors(daily_panel(spark, sf), ["amihud_20", "reversal_5"], "1999-06-01", "1999-12-31")
    return out.select("trade_date", "symbol", F.round("amount", 2).alias("amount"), F.round("close", 9).alias("close"))


@query("research_panel", with_daily("SELECT trade_date, symbol, round(close, 9) AS close, is_st FROM daily"))
def research_panel(spark, sf):
    manifest = table(spark, sf, "lineitem").agg(F.count("*").alias("rows")).select(
        F.when(F.col("rows") > 0, "ready").otherwise("empty").alias("status"), (F.col("rows") > 0).alias("price_research_ready")
    )
    out = readers.load_research(daily_panel(spark, sf), manifest)
    return out.select("trade_date", "symbol", F.round("close", 9).alias("close"), "is_st")


@query("date_bounds", with_daily("SELECT min(trade_date) AS first_date, max(trade_date) AS last_date FROM daily"))
def date_bounds(spark, sf):
    return readers.date_bounds(plain(spark, sf))


@query(
    "load_scores",
    sig_sql(
        """ SELECT trade_date, symbol, round(reversal_5, 6) AS reversal_5, round(close, 9) AS close FROM sig WHERE trade_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"""
    ),
)
def load_scores(spark, sf):
    out = readers.load_scores(
        signals(spark, sf), weekly_panel(spark, sf), ["reversal_5"], "1998-01-01", "1998-12-31", factors.REGISTRY, ("close",)
    )
    return out.select("trade_date", "symbol", r("reversal_5"), F.round("close", 9).alias("close"))


@query(
    "latest_snapshot",
    sig_sql(
        """ SELECT trade_date, symbol, round(volatility_20, 6) AS volatility_20 FROM sig WHERE trade_date = (SELECT max(trade_date) FROM sig) AND volatility_20 IS NOT NULL"""
    ),
)
def latest_snapshot(spark, sf):
    return rounded(readers.latest_snapshot(signals(spark, sf), "volatility_20"), ["volatility_20"])


@query(
    "load_symbols",
    with_daily(
        f"""SELECT trade_date, symbol, round(close, 9) AS close, volume FROM daily WHERE trade_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'
      AND symbol IN (SELECT {symbol_sql('s_suppkey')} FROM supplier WHERE s_acctbal > 5000)"""
    ),
)
def load_symbols(spark, sf):
    wanted = table(spark, sf, "supplier").where("s_acctbal > 5000").select(symbol_of("s_suppkey").alias("symbol"))
    return readers.load_symbols(plain(spark, sf), wanted, "1997-01-01", "1999-12-31").withColumn("close", F.round("close", 9))


@query(
    "staging_manifest",
    with_daily(
        """SELECT year(trade_date) AS year, count(*) AS rows, min(trade_date) AS min_date, max(trade_date) AS max_date, count(DISTINCT symbol) AS codes_present,
      0::BIGINT AS null_trade_date, 0::BIGINT AS null_symbol, 0::BIGINT AS null_close, count(*) FILTER (WHERE volume % 7 = 0) AS null_volume FROM daily GROUP BY 1"""
    ),
)
def staging_manifest(spark, sf):
    bars = plain(spark, sf).withColumn("volume", F.when(F.col("volume") % 7 != 0, F.col("volume")))
    path = writers.write_by_year(bars, scratch_path(spark, "staging"))
    staged = spark.read.parquet(path).select("trade_date", "symbol", "close", "volume", "year")
    return writers.partition_manifest(staged, "year")


@query(
    "manifest_rollup",
    with_daily(
        """, m AS (SELECT year(trade_date) AS year, count(*) AS rows, min(trade_date) AS lo, max(trade_date) AS hi FROM daily GROUP BY 1)
      SELECT count(*) AS partitions, CAST(sum(rows) AS BIGINT) AS rows, min(lo) AS min_date, max(hi) AS max_date, 0::BIGINT AS empty_partitions FROM m"""
    ),
)
def manifest_rollup(spark, sf):
    bars = plain(spark, sf).withColumn("year", F.year("trade_date"))
    return writers.manifest_rollup(writers.partition_manifest(bars, "year"))


@query(
    "missing_codes",
    f"""WITH {VENDOR_A}, req AS (SELECT y.year, {symbol_sql('c_custkey')} AS symbol FROM customer, (SELECT DISTINCT year(l_shipdate) AS year FROM lineitem) y)
    SELECT year, symbol FROM req ANTI JOIN (SELECT DISTINCT year(trade_date) AS year, symbol FROM vendor_a) a USING (year, symbol)""",
)
def missing_codes(spark, sf):
    bars = vendor_bars(spark, sf, "A").withColumn("year", F.year("trade_date"))
    years = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year")).distinct()
    listed = years.agg(F.collect_list("year").alias("_years"))  # calendar years
    requested = table(spark, sf, "customer").select(symbol_of("c_custkey").alias("symbol")).join(
        F.broadcast(listed), F.lit(True)
    ).select(F.explode("_years").alias("year"), "symbol")
    return writers.missing_codes(bars, requested, "year")


@query("canonical_panel", with_daily("SELECT trade_date, symbol, round(close, 9) AS close, is_st FROM daily"))
def canonical_panel(spark, sf):
    columns = ["trade_date", "symbol", "open", "high", "low", "close", "volume", "amount", "is_st"]
    path = writers.write_canonical(daily_panel(spark, sf), scratch_path(spark, "canonical"), columns)
    return spark.read.parquet(path).select("trade_date", "symbol", F.round("close", 9).alias("close"), "is_st")


UPSERT = f"""WITH {VENDOR_A}, {VENDOR_B}, u AS (SELECT trade_date, symbol, close, volume, 1 AS priority, 0 AS arrival FROM vendor_a
      UNION ALL SELECT trade_date, symbol, close, volume, 7, 1 FROM vendor_b WHERE year(trade_date) >= 2000
      UNION ALL SELECT trade_date, symbol, close * 2, volume, 7, 2 FROM vendor_b WHERE volume % 3 = 0
      UNION ALL SELECT trade_date, symbol, close * 3, volume, 7, 3 FROM vendor_b WHERE volume % 6 = 0
      UNION ALL SELECT trade_date, symbol, close * 4, volume, 1, 4 FROM vendor_b WHERE volume % 5 = 0)
    SELECT trade_date, symbol, round(close, 9) AS close, volume FROM u QUALIFY row_number() OVER (PARTITION BY trade_date, symbol ORDER BY priority DESC, arrival DESC) = 1"""


def arrivals(spark, sf):
    """A first load, one of a better source, two corrections of it, and a late row of the lesser source."""
    a, b = (vendor_bars(spark, sf, v).select("trade_date", "symbol", "close", "volume") for v in ("A", "B"))
    b = settle(b)  # four of the loads come from it
    scaled = lambda every, times: b.where(F.col("volume") % every == 0).withColumn("close", F.col("close") * times)
    loads = [(1, a), (7, b.where("trade_date >= '2000-01-01'")), (7, scaled(3, 2)), (7, scaled(6, 3)), (1, scaled(5, 4))]
    return [df.withColumn("priority", F.lit(priority)) for priority, df in loads]


@query("upsert", UPSERT)
def upsert(spark, sf):
    """Writes are numbered as they arrive; the second is then replayed and must change nothing."""
    writes = [df.withColumn("arrival", F.lit(n).cast("long")) for n, df in enumerate(arrivals(spark, sf))]
    table = writes[0]
    for write in [*writes[1:], writes[1]]:
        table = merging.upsert(table, write)
    return table.select("trade_date", "symbol", F.round("close", 9).alias("close"), "volume")


@query("upsert_years", UPSERT)
def upsert_years(spark, sf):
    path = scratch_path(spark, "upsert")
    for write in arrivals(spark, sf):
        writers.upsert_years(spark, path, write)
    return spark.read.parquet(path).select("trade_date", "symbol", F.round("close", 9).alias("close"), "volume")


@query("upsert_versions", UPSERT)
def upsert_versions(spark, sf):
    """Loads are commits of a versioned table; each is tried again under its number, which changes nothing."""
    path = scratch_path(spark, "versions")
    for number, write in enumerate(arrivals(spark, sf)):
        write = settle(write)
        for _ in range(2):
            versions.upsert_version(write, path, rows_per_file=20_000, writer=("loads", number))
    return versions.read(spark, path).select("trade_date", "symbol", F.round("close", 9).alias("close"), "volume")


@query(
    "version_history",
    f"""WITH {VENDOR_A}, {VENDOR_B}, a AS (SELECT trade_date, symbol, close FROM vendor_a), b AS (SELECT trade_date, symbol, close FROM vendor_b), k AS (SELECT trade_date, symbol FROM a UNION SELECT trade_date, symbol FROM b)
    SELECT 1 AS version, 'append' AS operation, (SELECT count(*) FROM a) AS rows, (SELECT round(sum(close), 2) FROM a) AS total
    UNION ALL SELECT 2, 'upsert', (SELECT count(*) FROM k), (SELECT round(sum(coalesce(b.close, a.close)), 2) FROM k LEFT JOIN a USING (trade_date, symbol) LEFT JOIN b USING (trade_date, symbol))
    UNION ALL SELECT 3, 'overwrite', (SELECT count(*) FROM b), (SELECT round(sum(close), 2) FROM b)""",
)
def version_history(spark, sf):
    """Every version stays readable: frames opened at each of three commits, read after the last."""
    path = scratch_path(spark, "versions")
    a, b = (vendor_bars(spark, sf, v).select("trade_date", "symbol", "close").withColumn("priority", F.lit(1)) for v in ("A", "B"))
    steps = [lambda: versions.append(a, path, 20_000), lambda: versions.upsert_version(b, path, 20_000), lambda: versions.overwrite(b, path, 20_000)]
    opened = None
    for step in steps:
        number = step()
        rows = versions.read(spark, path).agg(F.count("*").alias("rows"), F.round(F.sum("close"), 2).alias("total")).withColumn("version", F.lit(number))
        opened = rows if opened is None else opened.unionByName(rows)
    return opened.join(versions.history(spark, path).select("version", "operation"), "version").select(F.col("version").cast("int").alias("version"), "operation", "rows", "total")


@query(
    "warmup_files",
    with_daily(
        f""", s AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS idx FROM (SELECT DISTINCT trade_date FROM daily)),
      f AS (SELECT min(idx) - 20 AS lo FROM s WHERE trade_date >= DATE '1999-06-01')
      SELECT trade_date, symbol, round(amount, 2) AS amount, round(close, 9) AS close, TRUE AS few_files FROM daily WHERE trade_date >= (SELECT trade_date FROM s, f WHERE idx = lo) AND trade_date <= DATE '1999-12-31'
      AND symbol IN (SELECT {symbol_sql('s_suppkey')} FROM supplier WHERE s_acctbal > 8000)"""
    ),
)
def warmup_files(spark, sf):
    """The warm-up scan of some symbols through the file list; ``few_files``: under a third of the files are opened."""
    path = scratch_path(spark, "panel")
    versions.append(daily_panel(spark, sf), path, rows_per_file=500)
    wanted = table(spark, sf, "supplier").where("s_acctbal > 8000").select(symbol_of("s_suppkey").alias("symbol"))
    out = readers.load_version_for_factors(spark, path, ["amihud_20", "reversal_5"], "1999-06-01", "1999-12-31", wanted)
    live = versions.files(spark, path, versions.latest(spark, path)).count()
    return out.select("trade_date", "symbol", F.round("amount", 2).alias("amount"), F.round("close", 9).alias("close"), F.lit(len(out.inputFiles()) * 3 < live).alias("few_files"))


@query(
    "write_once",
    f"""WITH {SNAPSHOTS} SELECT count(*) AS rows, 'BEFORE_LIVE_START' AS early, 'RECORDED' AS first, 'VERIFIED_EXISTING' AS again, 'REFUSED' AS changed, 'REFUSED' AS widened FROM snapshots WHERE trade_date = (SELECT max(trade_date) FROM snapshots)""",
)
def write_once(spark, sf):
    snapshots = monthly_snapshots(spark, sf)
    last = snapshots.agg(F.max("trade_date").alias("trade_date"))
    latest = settle(snapshots.join(F.broadcast(last), "trade_date", "left_semi"))
    root = scratch_path(spark, "live")
    early = writers.write_once(latest, root, "2001-01-01", live_start="2001-06-01")
    first = writers.write_once(latest, root, "2001-12-01")
    again = writers.write_once(latest.orderBy(F.desc("symbol")), root, "2001-12-01")
    try:
        changed = writers.write_once(latest.withColumn("weight", F.col("weight") + 1), root, "2001-12-01")
    except RuntimeError:
        changed = "REFUSED"
    try:
        widened = writers.write_once(latest.withColumn("note", F.lit(1)), root, "2001-12-01")
    except RuntimeError:
        widened = "REFUSED"
    return spark.read.parquet(f"{root}/2001-12-01").agg(F.count("*").alias("rows")).select(
        "rows", F.lit(early).alias("early"), F.lit(first).alias("first"), F.lit(again).alias("again"), F.lit(changed).alias("changed"),
        F.lit(widened).alias("widened"),
    )


@query(
    "fingerprint",
    with_daily("SELECT count(*) AS rows, TRUE AS order_free, TRUE AS duplicates_count, TRUE AS change_seen, TRUE AS moved_null_seen FROM daily"),
)
def fingerprint(spark, sf):
    bars = settle(plain(spark, sf))
    own = writers.fingerprint(bars)
    tag = lambda df, name: writers.fingerprint(df).select(F.struct("rows", "content", "layout").alias(name))
    shuffled = tag(bars.repartition(5, "volume"), "a")
    doubled = tag(bars.unionByName(bars.where("volume % 7 = 0")), "b")
    changed = tag(bars.withColumn("volume", F.when(F.col("volume") % 50 == 7, F.col("volume") + 1).otherwise(F.col("volume"))), "c")
    gaps = lambda lost, kept: bars.withColumns({lost: F.lit(None).cast("double"), kept: F.col("close")})
    left, right = tag(gaps("open", "high"), "d"), tag(gaps("high", "open"), "e")  # one value, NULL before or after it
    joined = own
    for other in (shuffled, doubled, changed, left, right):
        joined = joined.join(other, F.lit(True))  # single rows
    return joined.select(
        "rows", (F.col("a.content") == F.col("content")).alias("order_free"), (F.col("b.content") != F.col("content")).alias("duplicates_count"),
        (F.col("c.content") != F.col("content")).alias("change_seen"), (F.col("d.content") != F.col("e.content")).alias("moved_null_seen"),
    )


@query(
    "fingerprint_ranges",
    with_daily(
        """SELECT year(trade_date) AS year, substr(symbol, 1, 4) AS range, count(*) AS rows_a, count(*) FILTER (WHERE NOT (volume = 1 AND NOT is_st)) AS rows_b, TRUE AS same_after_repair
      FROM daily GROUP BY 1, 2 HAVING bool_or(volume = 1) OR bool_or(volume = 2)"""
    ),
)
def fingerprint_ranges(spark, sf):
    """Rows of volume 1 lost or altered, those of volume 2 altered: the trees name their years and symbol ranges."""
    bars = settle(daily_panel(spark, sf).select("trade_date", "symbol", "close", "volume", "is_st"))
    damaged = bars.where("NOT (volume = 1 AND NOT is_st)").withColumn("close", F.when(F.col("volume") <= 2, F.col("close") + 1).otherwise(F.col("close")))
    tree, other = settle(hash_tree(bars)), settle(hash_tree(damaged))
    repaired = hash_tree(bars.repartition("volume")).exceptAll(tree).agg((F.count("*") == 0).alias("same_after_repair"))
    return tree_differences(tree, other).join(repaired, F.lit(True))  # one row


@query(
    "version_match",
    with_weekly("SELECT count(*) AS rows, 'MATCH' AS own, 'REFUSED' AS other FROM weekly"),
)
def version_match(spark, sf):
    panel = settle(weekly_panel(spark, sf))
    manifest = writers.fingerprint(panel).select(F.concat_ws("-", "rows", "content").alias("dataset_id"))
    other = writers.fingerprint(panel.where("volume > 10")).select(F.concat_ws("-", "rows", "content").alias("dataset_id"))

    def check(a, b) -> str:
        try:
            writers.require_match(a, b)
            return "MATCH"
        except ValueError:
            return "REFUSED"

    return panel.agg(F.count("*").alias("rows")).select(
        "rows", F.lit(check(manifest, manifest)).alias("own"), F.lit(check(manifest, other)).alias("other")
    )


@query(
    "stream_ingest",
    f"""WITH {VENDOR_A}, {VENDOR_B}, u AS (SELECT trade_date, symbol, close, volume, 1 AS priority, 0 AS arrival FROM vendor_a UNION ALL SELECT trade_date, symbol, close, volume, 2, 1 FROM vendor_b
      UNION ALL SELECT trade_date, symbol, close * 2, volume, 2, 2 FROM vendor_b WHERE volume % 3 = 0 UNION ALL SELECT trade_date, symbol, close * 3, volume, 2, 3 FROM vendor_b WHERE volume % 6 = 0)
    SELECT trade_date, symbol, round(close, 9) AS close, volume, priority FROM u QUALIFY row_number() OVER (PARTITION BY trade_date, symbol ORDER BY priority DESC, arrival DESC) = 1""",
)
def stream_ingest(spark, sf):
    """Two vendors and two corrections arrive as files; all of it is then replayed and must change nothing."""
    root = scratch_path(spark, "stream")

    def arrive(priority, bars):
        rows = bars.withColumn("priority", F.lit(priority)).select(*BAR.names)
        rows.write.mode("append").option("compression", "zstd").parquet(f"{root}/inbox")
        ingest_bars(spark, f"{root}/inbox", f"{root}/table", f"{root}/progress").awaitTermination()

    arrive(1, vendor_bars(spark, sf, "A"))
    arrive(2, vendor_bars(spark, sf, "B"))
    b = spark.read.schema(BAR).parquet(f"{root}/inbox").where("priority = 2")  # the files so far: what is corrected
    for every, times in ((3, 2), (6, 3)):
        arrive(2, b.where(F.col("volume") % every == 0).withColumn("close", F.col("close") * times))
    ingest_bars(spark, f"{root}/inbox", f"{root}/table", f"{root}/replay").awaitTermination()
    return versions.read(spark, f"{root}/table").select(
        "trade_date", "symbol", F.round("close", 9).alias("close"), "volume", "priority"
    )


@query(
    "stream_state",
    f"""WITH {VENDOR_A}, {VENDOR_B}, u AS (SELECT trade_date, symbol, close, volume, 1 AS priority, 4 AS sequence FROM vendor_a UNION ALL SELECT trade_date, symbol, close, volume, 2, 1 FROM vendor_b
      UNION ALL SELECT trade_date, symbol, close * 2, volume, 2, 3 FROM vendor_b WHERE volume % 3 = 0 UNION ALL SELECT trade_date, symbol, close * 3, volume, 2, 2 FROM vendor_b WHERE volume % 6 = 0)
    SELECT trade_date, symbol, round(close, 9) AS close, volume, priority, sequence AS arrival FROM u QUALIFY row_number() OVER (PARTITION BY trade_date, symbol ORDER BY priority DESC, sequence DESC) = 1""",
)
def stream_state(spark, sf):
    """Numbered files arrive out of order and again; state per symbol lets only changes through."""
    root = scratch_path(spark, "stream")
    names = [f.name for f in BAR]
    b = settle(vendor_bars(spark, sf, "B"))
    scaled = lambda every, times: b.where(F.col("volume") % every == 0).withColumn("close", F.col("close") * times)
    writes = {4: (1, vendor_bars(spark, sf, "A")), 1: (2, b), 3: (2, scaled(3, 2)), 2: (2, scaled(6, 3))}
    for number in (3, 4, 1, 2, 3):
        priority, bars = writes[number]
        rows = bars.withColumn("priority", F.lit(priority)).select(*names, F.lit(number).cast("long").alias("sequence"))
        rows.write.mode("append").option("compression", "zstd").parquet(f"{root}/inbox")
        latest.keep_latest(latest.numbered_stream(spark, f"{root}/inbox", None), f"{root}/table", f"{root}/late", f"{root}/progress", 40_000).awaitTermination()
    return versions.read(spark, f"{root}/table").select("trade_date", "symbol", F.round("close", 9).alias("close"), "volume", "priority", F.col("arrival").cast("int").alias("arrival"))


@query(
    "stream_late_rows",
    f"""WITH {VENDOR_A}, {VENDOR_B}, newest AS (SELECT symbol, max(trade_date) AS last FROM vendor_a GROUP BY 1),
      j AS (SELECT b.*, b.trade_date < last - 365 AS late FROM vendor_b b LEFT JOIN newest USING (symbol))
    SELECT CASE WHEN late THEN 'late' ELSE 'kept' END AS outcome, count(*) AS rows FROM (SELECT late FROM j WHERE late
      UNION ALL SELECT FALSE FROM (SELECT trade_date, symbol FROM vendor_a UNION SELECT trade_date, symbol FROM j WHERE NOT coalesce(late, FALSE))) GROUP BY 1""",
)
def stream_late_rows(spark, sf):
    """The second vendor's rows over a year behind a symbol's newest session are set aside and counted."""
    root = scratch_path(spark, "stream")
    names = [f.name for f in BAR]
    for number, vendor in enumerate("AB"):
        rows = vendor_bars(spark, sf, vendor).withColumn("priority", F.lit(number)).select(*names, F.lit(number).cast("long").alias("sequence"))
        rows.write.mode("append").parquet(f"{root}/inbox")
        latest.keep_latest(latest.numbered_stream(spark, f"{root}/inbox", None), f"{root}/table", f"{root}/late", f"{root}/progress", 365).awaitTermination()
    count = lambda name, outcome: versions.read(spark, f"{root}/{name}").agg(F.count("*").alias("rows")).select(F.lit(outcome).alias("outcome"), "rows")
    return count("table", "kept").unionByName(count("late", "late"))


# --- user factors ---------------------------------------------------------------------------


def trailing_spread(frame):
    """A user's pandas factor: ten-row mean of the daily range over the close."""
    spread = (frame["high"] - frame["low"]) / frame["close"]
    return spread.rolling(10, min_periods=10).mean()


@query(
    "pandas_factor",
    with_weekly(
        """, x AS (SELECT *, (high - low) / close AS v FROM weekly)
      SELECT trade_date, symbol, round(CASE WHEN count(v) OVER w >= 10 THEN avg(v) OVER w END, 6) AS factor FROM x
      WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""
    ),
)
def pandas_factor(spark, sf):
    out = factors.pandas_factor(weekly_panel(spark, sf), "trailing_spread", ["high", "low", "close"], trailing_spread)
    return out.select("trade_date", "symbol", F.round(F.nanvl("factor", F.lit(None).cast("double")), 6).alias("factor"))


@query(
    "factor_contract",
    with_weekly(
        """, x AS (SELECT (high - low) / close AS v, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS rn FROM weekly)
      SELECT count(*) AS rows, 0::BIGINT AS infinite_values, count(*) FILTER (WHERE rn >= 10) AS known_values, TRUE AS passed FROM x"""
    ),
)
def factor_contract(spark, sf):
    out = factors.pandas_factor(weekly_panel(spark, sf), "trailing_spread", ["high", "low", "close"], trailing_spread)
    return factors.contract_report(out)


@query(
    "look_ahead_check",
    with_weekly(
        """SELECT 'reversal_20' AS factor, count(*) AS rows, 0::BIGINT AS changed_rows, TRUE AS passed FROM weekly WHERE trade_date <= DATE '2000-06-30'"""
    ),
)
def look_ahead_check(spark, sf):
    panel = settle(weekly_panel(spark, sf))
    report = factors.look_ahead_report(panel, lambda p: factors.compute_factor(p, "reversal_20"), "2000-06-30")
    return report.select(F.lit("reversal_20").alias("factor"), "rows", "changed_rows", "passed")


@query(
    "set_difference",
    with_daily(
        f""", {SNAPSHOTS} SELECT CAST(o_orderdate AS DATE) AS trade_date FROM orders EXCEPT SELECT trade_date FROM daily"""
    ),
)
def set_difference(spark, sf):
    expected = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("trade_date")).distinct()
    return expected.join(session_list(plain(spark, sf)).select("trade_date"), "trade_date", "left_anti")
