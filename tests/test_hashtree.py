"""Where two versions of a panel differ, and that nothing else is named."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lattica.session import settle
from lattica.sources.hashtree import hash_tree, tree_differences

ROWS = [(dt.date(2020 + y, m, 1), f"{c}{s:03d}.X", float(m), None if m % 5 else 1.0) for y in range(3) for m in range(1, 13) for c in "67" for s in (1, 2, 15, 151)]


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame([*ROWS, ROWS[0], (None, None, 1.0, 1.0)], "trade_date date, symbol string, close double, volume double").cache()


def named(a, b):
    return sorted((r.year or 0, r.range, r.rows_a, r.rows_b) for r in tree_differences(settle(hash_tree(a)), settle(hash_tree(b))).collect())


def test_same_rows_in_any_order(panel):
    assert named(panel, panel.repartition(7).select("volume", "symbol", "close", "trade_date")) == []


@pytest.mark.parametrize(
    "change, wanted",
    [
        (lambda p: p.withColumn("close", F.when((F.col("symbol") == "7015.X") & (F.col("trade_date") == "2021-04-01"), -1.0).otherwise(F.col("close"))), [(2021, "7015", 12, 12)]),
        (lambda p: p.where("not (symbol = '6151.X' and trade_date = '2022-12-01') or symbol is null"), [(2022, "6151", 12, 11)]),
        (lambda p: p.unionByName(p.where("symbol = '6002.X' and trade_date = '2020-02-01'")), [(2020, "6002", 12, 13)]),
        (lambda p: p.withColumn("volume", F.when(F.col("symbol").isNull(), None).otherwise(F.col("volume"))), [(0, "", 1, 1)]),
        (lambda p: p.distinct(), [(2020, "6001", 13, 12)]),
        (lambda p: p.where("year(trade_date) <> 2021 or symbol is null"), [(2021, r, 12, 0) for r in sorted({s[:4] for _, s, _, _ in ROWS})]),
    ],
)
def test_the_differing_range_is_named(panel, change, wanted):
    assert named(panel, change(panel)) == wanted


def test_parents_add_up(panel):
    tree = settle(hash_tree(panel))
    rows = {level: sum(r["rows"] for r in tree.where(F.col("level") == level).collect()) for level in range(4)}
    assert set(rows.values()) == {len(ROWS) + 2}
    assert {r.level: r["count"] for r in tree.groupBy("level").count().collect()} == {0: 1, 1: 4, 2: 7, 3: 25}
