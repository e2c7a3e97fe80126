"""Best-fit-decreasing sharding of indivisible groups.

Groups (all copies of one text) are taken from the largest down; each enters the shard with
the least room that still holds it, found in a balanced tree of remaining room. The packing
needs only how many groups have each size, so it works on that histogram: groups of one size
are interchangeable and go into a shard in bulk. A histogram of group sizes has at most
sqrt(2 * total bytes) rows, whatever the number of documents; Spark counts it, and deals the
groups of each size to the shards by their rank within the size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.tables import ranked, staged

ROWS_PER_BUCKET = 50_000


class RoomTree:
    """Balanced search tree (a treap) of (room, shard); finds the tightest shard that fits."""

    def __init__(self):
        self.root = None

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def add(self, room: int, shard: int) -> None:
        key = (room, shard)
        left, right = self._split(self.root, key)
        node = [key, zlib.crc32(repr(key).encode()), None, None]
        self.root = self._merge(self._merge(left, node), right)

    def take(self, room: int) -> tuple[int, int] | None:
        """Remove and return the (room, shard) with the least room of at least ``room``."""
        left, right = self._split(self.root, (room, -1))
        if right is None:
            self.root = left
            return None
        path = right
        while path[2] is not None:
            path = path[2]
        found = path[0]
        _, rest = self._split(right, (found[0], found[1] + 1))
        self.root = self._merge(left, rest)
        return found


def best_fit_decreasing(histogram: Iterable[tuple[int, int]], capacity: int) -> list[tuple[int, int, int]]:
    """(size, groups, shard) runs, largest sizes first; sizes above the capacity get a shard each.

    In a run of equal sizes the shard just filled stays the tightest until it can take no
    more, so filling it in bulk is what one-by-one best fit does.
    """
    tree, runs, opened = RoomTree(), [], 0
    for size, count in sorted(histogram, reverse=True):
        while count:
            found = tree.take(size)
            if found is None:
                found, opened = (max(capacity, size), opened), opened + 1
            room, shard = found
            n = min(count, room // size)
            runs.append((size, n, shard))
            tree.add(room - n * size, shard)
            count -= n
    return runs


def _used(runs: list[tuple[int, int, int]]) -> int:
    return 1 + max((shard for _, _, shard in runs), default=-1)


def balanced(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Best fit with the least capacity that needs no more than ``shards`` shards.

    A group above its fair share of what is left takes a shard alone, so that the others
    still share the remaining shards evenly.
    """
    left = sorted(histogram)
    total, free, alone = sum(s * n for s, n in left), shards, []
    while free > 1 and left and left[-1][0] * free >= total:
        size, n = left.pop()
        alone.append((size, 1, shards - free))
        total, free = total - size, free - 1
        if n > 1:
            left.append((size, n - 1))
    if not left:
        return alone
    low = max(-(-total // free), left[-1][0])
    good, step = low, 1
    while _used(runs := best_fit_decreasing(left, good)) > free:
        low, good, step = good + 1, good + step, step * 2
    while low < good:
        middle = (low + good) // 2
        tried = best_fit_decreasing(left, middle)
        if _used(tried) <= free:
            good, runs = middle, tried
        else:
            low = middle + 1
    return alone + [(size, n, shard + shards - free) for size, n, shard in runs]


def shard_groups(groups: DataFrame, size: str, key: str, shards: int | None = 16, capacity: int | None = None) -> DataFrame:
    """``groups`` (one row per group) with a ``shard`` column.

    With ``capacity`` the number of shards of that fixed size is minimised; otherwise
    ``shards`` shards of nearly equal size are filled. ``key`` identifies a group, sizes are
    at least 1. Ties of size are dealt by key.
    """
    histogram = [(int(r[0]), int(r[1])) for r in groups.groupBy(size).count().collect()]
    runs = best_fit_decreasing(histogram, capacity) if capacity else balanced(histogram, shards)
    ranges: dict[int, list[tuple[int, int]]] = {}
    for s, n, shard in runs:
        mine = ranges.setdefault(s, [])
        mine.append(((mine[-1][0] if mine else 0) + n, shard))
    spark = groups.sparkSession
    dealt = spark.createDataFrame(list(ranges.items()), f"{size} long, _runs array<struct<upto: long, shard: int>>")
    buckets = max(16, sum(n for _, n in histogram) // ROWS_PER_BUCKET)
    numbered = ranked(groups, [size], [key], "_rank", buckets).join(dealt, size)
    fits = F.filter("_runs", lambda run: run["upto"] > F.col("_rank"))
    return numbered.withColumn("shard", fits[0]["shard"]).drop("_runs", "_rank")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every document's shard and its slot there, under the law of near-equal bytes.

    A document weighs the UTF-8 bytes of its text plus 1 (null text: 1). Equal texts, null
    and empty alike, form one group and share a shard. Slots run from 0 without gaps in each
    shard. Null or repeated ids are rows like any other. An empty table gives an empty one.
    Columns: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = staged(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("_text_key"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("_text_key").agg(F.sum("size").alias("_group_size"))
    placed = shard_groups(groups, "_group_size", "_text_key", shards).select("_text_key", "shard")
    joined = rows.join(placed, "_text_key")
    buckets = max(16, rows.count() // ROWS_PER_BUCKET)
    slots = ranked(joined, ["shard"], ["doc_id", "_text_key"], "slot", buckets)
    return slots.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
