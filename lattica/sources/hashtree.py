"""A tree of content digests by year and symbol range: which part of two versions differs.

A leaf covers the rows of one year whose symbols begin alike. Digests are sums of row hashes,
so a node is the sum of its children: one scan gives the leaves, everything above is added
up, and the tree of a new year joins that of the old ones. A tree is as small as years times
symbol ranges and is kept beside its version; comparing two versions reads only the trees,
from the root down to the leaves that differ.

Two 64-bit hashes of a row are summed as decimals. That finds drift and damage; it is no
proof against rows made up to collide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Leading characters of a symbol at each level below the year.
WIDTHS = (1, 4)
_SUMS = ("rows", "content", "check")
_KEY = ("level", "year", "range")


def hash_tree(df: DataFrame, date: str = "trade_date", code: str = "symbol", widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """``(level, year, range, rows, content, check)``: the root (level 0), years, and symbol ranges.

    Rows are a bag: their order does not count, repeated rows do. Columns are taken by name; a
    NULL differs from every value, and its place counts. Rows without a date or a symbol are
    in the year and range of their own (NULL, empty).
    """
    columns = sorted(df.columns)
    gaps = [F.isnull(c) for c in columns]
    layout = F.lit(",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in columns))
    wide = lambda h: F.sum(h.cast("decimal(38,0)"))
    leaf = df.groupBy(F.year(date).alias("year"), F.substring(F.coalesce(code, F.lit("")), 1, widths[-1]).alias("range")).agg(
        F.count("*").alias("rows"), wide(F.xxhash64(layout, *gaps, *columns)).alias("content"), wide(F.xxhash64(*columns[::-1], *gaps, layout)).alias("check")
    )
    year = [F.lit(None).cast("int"), F.col("year"), *[F.col("year")] * len(widths)]
    name = [F.lit(""), F.lit(""), *[F.substring("range", 1, w) for w in widths]]
    above = F.array(*[F.struct(F.lit(k).alias("level"), y.alias("year"), n.alias("range")) for k, (y, n) in enumerate(zip(year, name, strict=True))])
    nodes = leaf.select(F.inline(above), *_SUMS)  # each leaf once for each level: a tree's own size
    return nodes.groupBy(*_KEY).agg(*[F.sum(c).cast(leaf.schema[c].dataType).alias(c) for c in _SUMS])


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes of one level that are not the same in both: ``(level, year, range, rows_a, rows_b)``."""
    left, right = (t.select(*_KEY, F.struct(*_SUMS).alias(side)) for t, side in ((a, "_a"), (b, "_b")))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in _KEY]
    both = left.alias("l").join(right.alias("r"), same[0] & same[1] & same[2], "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    key = [F.coalesce(F.col(f"l.{c}"), F.col(f"r.{c}")).alias(c) for c in _KEY]
    return both.select(*key, F.coalesce("_a.rows", F.lit(0)).alias("rows_a"), F.coalesce("_b.rows", F.lit(0)).alias("rows_b"))


def tree_differences(a: DataFrame, b: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """The leaves in which two trees differ: ``(year, range, rows_a, rows_b)``; none if nothing does.

    Each level is compared only below the nodes that differ above it.
    """
    found = _differ(a.where("level = 0"), b.where("level = 0"))
    for level in range(1, len(widths) + 2):
        above = found.select(F.col("year").alias("_year"), F.col("range").alias("_range"))
        name = F.substring("range", 1, widths[level - 3]) if level > 2 else F.lit("")
        year = F.col("year") if level > 1 else F.lit(None).cast("int")
        below = [
            t.where(F.col("level") == level).join(F.broadcast(above), year.eqNullSafe(F.col("_year")) & (name == F.col("_range")), "left_semi")  # nodes of a tree
            for t in (a, b)
        ]
        found = _differ(*below)
    return found.select("year", "range", "rows_a", "rows_b")
