"""Factor diagnostics grouped by any keys, so one job covers every factor."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.numeric import finite, pearson, ratio
from lattica.operators.calendars import rebalance_dates, trailing_sessions
from lattica.operators.labels import add_forward_returns
from lattica.operators.moments import mean_spearman
from lattica.operators.sections import WHOLE, Layout, add_average_rank, add_positions, add_stats

DATE = ("trade_date",)


def melt_factors(df: DataFrame, names, keep) -> DataFrame:
    """Wide score table to ``(keep..., factor, value)`` without a shuffle."""
    return df.unpivot(list(keep), list(names), "factor", "value")


def information_coefficient(
    df: DataFrame,
    x: str,
    y: str,
    by=DATE,
    method: str = "spearman",
    min_observations: int = 10,
    name: str = "ic",
    layout: Layout = WHOLE,
) -> DataFrame:
    """One correlation per section, NULL where it is too thin or one side is constant."""
    if method not in ("spearman", "pearson"):
        raise ValueError("method is spearman or pearson")
    by = list(by)
    a, b = finite(x), finite(y)
    both = a.isNotNull() & b.isNotNull()
    tie = ["symbol"] if "symbol" in df.columns else []
    work = df.select(*by, *tie, F.when(both, a).alias("_a"), F.when(both, b).alias("_b"))
    left, right = "_a", "_b"
    if method == "spearman":
        work = add_average_rank(work, by, "_a", "_ra", layout=layout)
        work = add_average_rank(work, by, "_b", "_rb", layout=layout)
        left, right = "_ra", "_rb"
    n = F.count("_a")
    found = pearson(left, right)
    if method == "spearman":
        found = _rank_correlation(F.col("_ra"), F.col("_rb"))
    value = F.when(n >= min_observations, found)
    return work.groupBy(*by).agg(value.alias(name), n.alias("pairs"))


def _rank_correlation(a: Column, b: Column) -> Column:
    """Correlation of average ranks (NULL together) as an aggregate; NULL for a constant side.

    Doubled ranks are whole numbers, and a section's ranks add up to n(n+1)/2. Sums of products
    are whole too, exact below 2^53 (some 180,000 rows): a correlation of 0 is 0 and not the
    last bit of a running mean, which a count of positive values would take for one.
    """
    x, y, n = a * 2, b * 2, F.count(a).cast("double")
    middle = n * (n + 1) * (n + 1)
    both, left, right = (F.sum(p) - middle for p in (x * y, x * x, y * y))
    return F.try_divide(both, F.sqrt(left) * F.sqrt(right))


def summarize_ic(ic: DataFrame, by=(), periods_per_year: float | Column = 252 / 5, value: str = "ic") -> DataFrame:
    """mean, sample std, annualised ICIR, win rate and count of the non-null ICs."""
    v = F.col(value)
    scale = periods_per_year if isinstance(periods_per_year, Column) else F.lit(float(periods_per_year))
    return (
        ic.groupBy(*by)
        .agg(
            F.avg(v).alias("mean_ic"),
            F.stddev_samp(v).alias("ic_std"),
            F.avg((v > 0).cast("double")).alias("win_rate"),
            F.count(v).alias("observations"),
        )
        .withColumn("icir", ratio("mean_ic", "ic_std") * F.sqrt(scale))
    )


def annual_ic(ic: DataFrame, by=(), value: str = "ic") -> DataFrame:
    v = F.col(value)
    return (
        ic.where(v.isNotNull())
        .groupBy(*by, F.year("trade_date").alias("year"))
        .agg(
            F.avg(v).alias("mean_ic"),
            F.stddev_samp(v).alias("ic_std"),
            F.avg((v > 0).cast("double")).alias("win_rate"),
            F.count("*").alias("days"),
        )
    )


def ic_decay(
    df: DataFrame, factor: str, horizons=(1, 5, 10, 20), price: str = "close", min_observations: int = 10,
    layout: Layout = WHOLE,
) -> DataFrame:
    """Mean IC per forward horizon; all horizons share one label pass."""
    labeled = add_forward_returns(df, horizons, price)
    columns = [f"forward_return_{h}d" for h in horizons]
    long = labeled.select("trade_date", "symbol", factor, *columns).unpivot(
        ["trade_date", "symbol", factor], columns, "_label", "_future"
    )
    long = long.withColumn("horizon", F.regexp_extract("_label", r"(\d+)", 1).cast("int"))
    ic = information_coefficient(
        long, factor, "_future", ("horizon", "trade_date"), min_observations=min_observations, layout=layout
    )
    parts = ic.groupBy("horizon").agg(
        F.avg("ic").alias("mean_ic"),
        F.stddev_samp("ic").alias("ic_std"),
        F.avg((F.col("ic") > 0).cast("double")).alias("win_rate"),
        F.count("ic").alias("observations"),
    )
    return parts.withColumn("icir", ratio("mean_ic", "ic_std") * F.sqrt(F.lit(252.0) / F.col("horizon")))


def assign_quantiles(
    df: DataFrame, value: str, groups: int = 5, by=DATE, out: str = "quantile", layout: Layout = WHOLE
) -> DataFrame:
    """Group 1..g by first-come rank; thin or constant sections get NULL.

    Group edges are the linear quantiles of the ranks, in integer arithmetic.
    """
    if groups < 2:
        raise ValueError("groups must be at least 2")
    df = add_positions(df, by, value, position="_pos", total="_n", layout=layout)
    df = add_stats(df, list(by), {"_low": F.min(value), "_high": F.max(value)}, layout)
    place = F.ceil(F.try_divide((F.col("_pos") - 1) * groups, F.col("_n") - 1))
    enough = (F.col("_n") >= groups) & (F.col("_low") < F.col("_high"))
    return df.withColumn(
        out, F.when(enough & F.col("_pos").isNotNull(), F.greatest(F.lit(1), place).cast("int"))
    ).drop("_pos", "_n", "_low", "_high")


def quantile_returns(
    df: DataFrame, factor: str, future: str, groups: int = 5, by=DATE, layout: Layout = WHOLE
) -> DataFrame:
    """Mean label per section and group. Groups never depend on the label."""
    by = list(by)
    work = df.select(*by, "symbol", finite(factor).alias("_f"), finite(future).alias("_y"))
    work = assign_quantiles(work, "_f", groups, by, layout=layout).where("quantile IS NOT NULL")
    return (
        work.groupBy(*by, "quantile")
        .agg(
            F.avg("_y").alias("mean_return"),
            F.count("*").alias("assigned_count"),
            F.count("_y").alias("observed_count"),
        )
        .withColumn("label_coverage", F.col("observed_count") / F.col("assigned_count"))
    )


def top_minus_bottom(groups: DataFrame, by=()) -> DataFrame:
    """Spread between the mean of the highest and the lowest group present."""
    means = groups.groupBy(*by, "quantile").agg(F.avg("mean_return").alias("_m"))
    return means.groupBy(*by).agg(
        F.when(F.count("*") >= 2, F.max_by("_m", "quantile") - F.min_by("_m", "quantile")).alias("top_minus_bottom")
    )


def rank_autocorrelation(
    df: DataFrame, factor: str, by=(), min_observations: int = 10, layout: Layout = WHOLE
) -> DataFrame:
    """Correlation of today's percent rank with each symbol's previous one."""
    keys = [*by, "trade_date"]
    work = df.select(*keys, "symbol", F.col(factor).alias("_v"))
    work = add_average_rank(work, keys, "_v", "_r", layout=layout)
    work = add_stats(work, keys, {"_n": F.count("_v")}, layout)
    work = work.withColumn("_rank", F.col("_r") / F.col("_n"))
    before = F.lag("_rank").over(W.partitionBy(*by, "symbol").orderBy("trade_date"))
    work = work.withColumn("_before", before)
    pairs = F.count_if(F.col("_rank").isNotNull() & F.col("_before").isNotNull())
    return work.groupBy(*keys).agg(
        F.when(pairs >= min_observations, pearson("_rank", "_before")).alias("rank_autocorrelation")
    )


def top_group_turnover(
    df: DataFrame, factor: str, top_fraction: float = 0.2, frequency: str = "W-FRI", layout: Layout = WHOLE
) -> DataFrame:
    """1 - overlap with the previous top group at rebalance dates."""
    if not 0 < top_fraction < 1:
        raise ValueError("top_fraction is between 0 and 1")
    dates = rebalance_dates(df, frequency).select("trade_date")
    work = df.join(F.broadcast(dates), "trade_date", "left_semi").where(F.col(factor).isNotNull())
    work = work.select("trade_date", "symbol", factor)
    work = add_positions(work, DATE, factor, descending=True, position="_pos", total="_n", layout=layout)
    size = F.greatest(F.lit(1), F.ceil(F.col("_n") * top_fraction))
    top = work.where(F.col("_pos") <= size)
    counts = top.groupBy("trade_date").agg(F.count("*").alias("_size"))
    # one row per rebalance date
    order = W.orderBy("trade_date")
    steps = counts.select(
        "trade_date",
        F.row_number().over(order).alias("_step"),
        F.lag("_size").over(order).alias("_previous"),
    )
    held = top.select("trade_date", "symbol").join(F.broadcast(steps), "trade_date")
    again = F.lag("_step").over(W.partitionBy("symbol").orderBy("_step")) == F.col("_step") - 1
    return (
        held.withColumn("_again", F.coalesce(again, F.lit(False)))
        .groupBy("trade_date", "_previous")
        .agg(F.count_if("_again").alias("_kept"))
        .where(F.col("_previous").isNotNull())
        .select("trade_date", (1 - F.col("_kept") / F.col("_previous")).alias("top_group_turnover"))
    )


def stability_table(ic: DataFrame, recent_windows=(), by=("factor",), value: str = "ic") -> DataFrame:
    """Mean IC by calendar year and by trailing session window.

    ``ic`` holds one row per (factor, session), NULL ICs included: the sessions of
    a recent window are the table's own dates.
    """
    by = list(by)
    v = F.col(value)
    measures = [
        F.avg(v).alias("mean_ic"),
        F.avg((v > 0).cast("double")).alias("win_rate"),
        F.count(v).alias("observations"),
    ]
    yearly = (
        ic.where(v.isNotNull())
        .groupBy(*by, F.concat(F.lit("year_"), F.year("trade_date")).alias("window"))
        .agg(F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"), *measures)
    )
    if not recent_windows:
        return yearly
    sessions = ic.select("trade_date").distinct()
    ranked = sessions.withColumn("_back", F.row_number().over(W.orderBy(F.desc("trade_date"))))
    windows = F.array(*[F.lit(int(n)) for n in recent_windows])
    # at most (windows x sessions) rows, bounded by the calendar
    member = ranked.select("trade_date", F.explode(windows).alias("_length"), "_back").where("_back <= _length")
    bounds = member.groupBy("_length").agg(
        F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date")
    )
    recent = (
        ic.join(F.broadcast(member.select("trade_date", "_length")), "trade_date")
        .groupBy(*by, "_length")
        .agg(*measures)
        .join(F.broadcast(bounds), "_length")
        .select(
            *by,
            F.concat(F.lit("recent_"), F.col("_length"), F.lit("d")).alias("window"),
            "start_date",
            "end_date",
            "mean_ic",
            "win_rate",
            "observations",
        )
    )
    return yearly.unionByName(recent)


def hac_mean(
    series: DataFrame, value: str, lags: int = 4, by=(), sessions: DataFrame | None = None
) -> DataFrame:
    """Newey-West mean with Bartlett weights; a missing session keeps its slot.

    Rows are one per session and group, so a group is bounded by the calendar.
    """
    if lags < 0:
        raise ValueError("lags is not negative")
    by = list(by)
    work = series.select(*by, "trade_date", finite(value).alias("_v"))
    if sessions is not None:
        slots = sessions.select("trade_date")
        if by:
            slots = work.select(*by).distinct().join(slots, F.lit(True))
        work = slots.join(work, [*by, "trade_date"], "left")
    work = add_stats(work, by, {"_mean": F.avg("_v")})
    work = work.withColumn("_e", F.coalesce(F.col("_v") - F.col("_mean"), F.lit(0.0)))
    order = W.partitionBy(*by).orderBy("trade_date")
    work = work.withColumns({f"_l{k}": F.lag("_e", k).over(order) for k in range(1, lags + 1)})
    sums = work.groupBy(*by).agg(
        F.count("*").alias("_slots"),
        F.count("_v").alias("hac_observations"),
        F.avg("_v").alias("_mean"),
        F.sum(F.col("_e") * F.col("_e")).alias("_s0"),
        *[F.sum(F.col("_e") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, lags + 1)],
    )
    n = F.col("hac_observations")
    used = F.least(F.lit(lags), F.col("_slots") - 1)
    spread = F.col("_s0")
    for k in range(1, lags + 1):
        weight = F.when(F.lit(k) <= used, 2 * (1 - F.lit(float(k)) / (used + 1))).otherwise(F.lit(0.0))
        spread = spread + weight * F.coalesce(f"_s{k}", F.lit(0.0))
    enough = n >= 2
    se = F.sqrt(F.try_divide(F.greatest(spread, F.lit(0.0)), n * (n - 1)))
    return sums.select(
        *by,
        F.when(enough, F.col("_mean")).alias("hac_mean"),
        F.when(enough, se).alias("hac_se"),
        F.when(enough, ratio("_mean", se)).alias("hac_t"),
        F.when(enough, F.col("_mean") - 1.96 * se).alias("hac_ci_low"),
        F.when(enough, F.col("_mean") + 1.96 * se).alias("hac_ci_high"),
        F.when(enough, used).otherwise(F.lit(lags)).cast("long").alias("hac_lags"),
        n.alias("hac_observations"),
    )


def factor_correlation(df: DataFrame, names, layout: Layout = WHOLE) -> DataFrame:
    """Spearman matrix per date on pairwise-complete rows, averaged over dates.

    A date that fits one task is solved there: its rows travel once, whatever the number of
    pairs. Larger dates explode each row into its pairs and are ranked in ranges; the
    diagonal then needs no ranking: it is 1 where some date has two distinct values.
    """
    names = list(names)
    if layout.splits == 1:
        return mean_spearman(df, names)
    pairs = [
        F.struct(F.lit(a).alias("factor_a"), F.lit(b).alias("factor_b"), F.col(a).alias("x"), F.col(b).alias("y"))
        for a, b in combinations(names, 2)
    ]
    spread = df.groupBy("trade_date").agg(*[(F.min(n) < F.max(n)).alias(n) for n in names])
    varied = spread.agg(*[F.max(n).alias(n) for n in names])
    own = [
        F.struct(F.lit(n).alias("factor_a"), F.lit(n).alias("factor_b"), F.when(F.col(n), F.lit(1.0)).alias("correlation"))
        for n in names
    ]
    diagonal = varied.select(F.inline(F.array(*own)))
    if not pairs:
        return diagonal
    long = df.select("trade_date", "symbol", F.inline(F.array(*pairs)))
    daily = information_coefficient(
        long.where("x IS NOT NULL AND y IS NOT NULL"),
        "x",
        "y",
        ("factor_a", "factor_b", "trade_date"),
        min_observations=1,
        layout=layout,
    )
    half = daily.groupBy("factor_a", "factor_b").agg(F.avg("ic").alias("correlation"))
    mirror = half.select(
        F.col("factor_b").alias("factor_a"), F.col("factor_a").alias("factor_b"), "correlation"
    )
    return half.unionByName(mirror).unionByName(diagonal)


def coverage_gate(
    df: DataFrame, value: str, minimum: float, by=DATE, universe: str = "in_universe", layout: Layout = WHOLE
) -> DataFrame:
    """Null a factor on dates where too few universe members have a value."""
    inside = F.coalesce(F.col(universe), F.lit(False))
    share = F.avg(F.when(inside, F.col(value).isNotNull().cast("double")))
    df = add_stats(df, list(by), {"coverage": share}, layout)
    low = F.coalesce(F.col("coverage") < minimum, F.lit(False))
    return df.withColumn(value, F.when(~low, F.col(value)))


def coverage_table(df: DataFrame, value: str, minimum: float, by=DATE, universe: str = "in_universe") -> DataFrame:
    inside = F.coalesce(F.col(universe), F.lit(False))
    share = F.avg(F.when(inside, F.col(value).isNotNull().cast("double")))
    return df.groupBy(*by).agg(share.alias("coverage")).withColumn(
        "meets_threshold", F.coalesce(F.col("coverage") >= minimum, F.lit(False))
    )


def recent_mask(sessions: DataFrame, count: int) -> DataFrame:
    return trailing_sessions(sessions, count).select("trade_date")
