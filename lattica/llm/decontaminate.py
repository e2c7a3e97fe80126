"""Benchmark decontamination over suffix arrays of the training text.

Every shard of documents (a block of a task) is turned into a suffix array of its words. The
suffixes of all test items are searched in it together: an interval of the array is narrowed
word by word by bisection, which gives each test suffix its longest verbatim match and, from
the interval, the places. A place where a whole window of an item matches marks its words.
Documents are only scanned; nothing is shuffled.

Items are sent to the tasks in parts of a fixed size bound, so a benchmark of any size is
handled: with several parts, what each part found is merged per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.textkit import LOWER, blocks, byte_set, owners, packed, ragged, span_hashes, spans

WINDOW = 10
SHARD_BYTES = 4 << 20
ITEM_BOUND = 32 << 20
#: Bytes of words after lower-casing A-Z: all but the stated ranges, so both cases here (fixed values).
WORD = ~byte_set(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of texts, and the number before each text."""
    hashes, before = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    total = 0
    for first, last in blocks(starts):
        base = starts[first]
        part = raw[base : starts[last]]
        begin, end, own = spans(part, starts[first : last + 1] - base, WORD)
        hashes.append(span_hashes(part, begin, end, LOWER))
        before.append(total + own[1:])
        total += len(begin)
    return np.concatenate(hashes), np.concatenate(before)


@dataclass
class Items:
    """Test items as word hashes end to end."""

    ids: list[str]
    words: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[object, str | None]]) -> Items:
        words, before = word_hashes(*packed(pa.array([r[1] for r in rows], pa.string())))
        return cls(["" if r[0] is None else str(r[0]) for r in rows], words, before)


def suffix_array(words: np.ndarray, before: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word places in the order of the ``depth`` words from there, by prefix doubling.

    Words order by hash; a document's end comes before every word. Also returned: the rank of
    each word (0 past the last, at least one place) and the sorted distinct hashes.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = words[order][1:] != words[order][:-1]
    rank = np.zeros(n, np.int64)
    rank[order] = np.cumsum(fresh)
    distinct, first_rank = words[order][fresh], rank
    end = np.repeat(before[1:], np.diff(before))
    known = 1
    while known < depth and not fresh.all():
        ahead = np.arange(n) + known
        key = (rank << 32) | np.where(ahead < end, rank[np.minimum(ahead, n - 1)], 0)
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh[1:] = key[1:] != key[:-1]
        rank = np.zeros(n, np.int64)
        rank[order] = np.cumsum(fresh)
        known *= 2
    return order, first_rank, distinct


def search(words: np.ndarray, before: np.ndarray, items: Items, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every test suffix: matched words (up to ``depth``), its interval, and the suffix array."""
    m = len(items.words)
    matched, low, high = np.zeros(m, np.int64), np.zeros(m, np.int64), np.full(m, len(words))
    if len(words) == 0 or m == 0:
        return matched, low, high, np.zeros(0, np.int64)
    order, rank, distinct = suffix_array(words, before, depth)
    place = np.searchsorted(distinct, items.words).clip(0, len(distinct) - 1)
    wanted = np.where(distinct[place] == items.words, place + 1, -1)
    item_end = np.repeat(items.before[1:], np.diff(items.before))
    text_end = np.repeat(before[1:], np.diff(before))
    active = np.arange(m)
    for d in range(depth):
        active = active[active + d < item_end[active]]
        target = wanted[active + d]
        active, target = active[target > 0], target[target > 0]
        if len(active) == 0:
            break

        def at(index: np.ndarray, d: int = d) -> np.ndarray:
            here = order[index]
            return np.where(here + d < text_end[here], rank[np.minimum(here + d, len(rank) - 1)], 0)

        left = _bisect(at, low[active], high[active], target)
        right = _bisect(at, left, high[active], target + 1)
        some = right > left
        active, left, right = active[some], left[some], right[some]
        low[active], high[active], matched[active] = left, right, d + 1
    return matched, low, high, order


def _bisect(at, low: np.ndarray, high: np.ndarray, target: np.ndarray) -> np.ndarray:
    """First place of each interval whose value is at least the target."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        less = at(middle) < target[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
        open_ = open_[low[open_] < high[open_]]
    return low


def _window_hits(words: np.ndarray, before: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, item) of every occurrence of an item's window in the words of a shard."""
    matched, low, high, order = search(words, before, items)
    sizes = np.diff(items.before)
    item = owners(items.before)
    need = np.minimum(sizes, WINDOW)[item]
    inside = np.arange(len(item)) - items.before[:-1][item]
    whole = np.flatnonzero((matched >= need) & (inside + need <= sizes[item]))
    times = (high - low)[whole]
    places = order[np.repeat(low[whole], times) + ragged(times)]
    return places, np.repeat(need[whole], times), np.repeat(item[whole], times)


def longest_matches(words: np.ndarray, before: np.ndarray, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(text, text word, item, item word, words): verbatim matches of a window or more that
    cannot be extended to the left or right."""
    places, need, item = _window_hits(words, before, items)
    found = set()
    text = np.searchsorted(before, places, "right") - 1
    for place, t, k in zip(places.tolist(), text.tolist(), item.tolist(), strict=True):
        mine = items.words[items.before[k] : items.before[k + 1]]
        n = min(len(mine), WINDOW)
        for j in np.flatnonzero(mine[: len(mine) - n + 1] == words[place]).tolist():
            if not np.array_equal(mine[j : j + n], words[place : place + n]):
                continue
            a, b, size = place, j, n
            while a > before[t] and b > 0 and words[a - 1] == mine[b - 1]:
                a, b, size = a - 1, b - 1, size + 1
            while a + size < before[t + 1] and b + size < len(mine) and words[a + size] == mine[b + size]:
                size += 1
            found.add((t, a - int(before[t]), k, b, size))
    return sorted(found)


@dataclass
class Found:
    """What a batch of documents has of the items, by document."""

    n_words: np.ndarray
    marks: list[tuple[np.ndarray, np.ndarray]]  # (first word, length) in the document
    items: list[set[str]]


def scan(batch: pa.RecordBatch, items: Items) -> Found:
    raw, starts = packed(batch.column("text"))
    n = len(starts) - 1
    nothing = np.zeros(0, np.int64)
    found = Found(np.zeros(n, np.int64), [(nothing, nothing)] * n, [set() for _ in range(n)])
    for first, last in blocks(starts, SHARD_BYTES):
        base = starts[first]
        words, before = word_hashes(raw[base : starts[last]], starts[first : last + 1] - base)
        found.n_words[first:last] = np.diff(before)
        places, lengths, item = _window_hits(words, before, items)
        if len(places) == 0:
            continue
        text = np.searchsorted(before, places, "right") - 1
        order = np.argsort(text, kind="stable")
        cuts = np.flatnonzero(np.diff(text[order], prepend=-1))
        for rows in np.split(order, cuts[1:]):
            t = int(text[rows[0]])
            spans_ = np.unique(np.stack([places[rows] - before[t], lengths[rows]], 1), axis=0)
            found.marks[first + t] = (spans_[:, 0], spans_[:, 1])
            found.items[first + t] = {items.ids[k] for k in set(item[rows].tolist())}
    return found


def _covered(n_words: int, first: np.ndarray, length: np.ndarray) -> int:
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + length, -1)
    return int((np.cumsum(edge)[:n_words] > 0).sum())


def _digest(ids: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def item_parts(benchmark: DataFrame, bound: int = ITEM_BOUND) -> list:
    """The items as broadcasts of at most ``bound`` bytes of text each (a longer item by itself)."""
    spark = benchmark.sparkSession
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total * 2 // bound)) if total > bound else 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    sent = []
    for k in range(n):
        rows = [(r[0], r[1]) for r in benchmark.where(part == k).select("item_id", "text").collect()]
        sent.append(spark.sparkContext.broadcast(Items.of(rows)))
    return sent


def contamination(docs: DataFrame, benchmark: DataFrame, bound: int = ITEM_BOUND) -> DataFrame:
    """Per document: words, words inside occurrences of item windows, and the items found.

    Null or wordless texts have no words and no hits; null or wordless items have no windows;
    a null item id is listed as an empty string. Items that share an id count once. Repeated
    document rows are judged each. An empty benchmark contaminates nothing.
    Columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.
    """
    sent = item_parts(benchmark, bound)
    if len(sent) > 1:
        return _merged(docs, sent)
    only = sent[0]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scan(batch, only.value)
            hits = [_covered(int(n), *m) if len(m[0]) else 0 for n, m in zip(found.n_words, found.marks, strict=True)]
            empty = _digest(set())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(found.n_words),
                    pa.array(hits, pa.int64()),
                    pa.array([len(s) for s in found.items], pa.int64()),
                    pa.array([_digest(s) if s else empty for s in found.items]),
                    pa.array([h > 0 for h in hits]),
                ],
                [c.split()[0] for c in RESULT.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(judge, RESULT)


def _merged(docs: DataFrame, sent: list) -> DataFrame:
    """The same from several item parts: marks and items of a row are brought together."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    from lattica.llm.tables import staged

    rows = staged(rows, "numbered")
    schema = "_row long, doc_id long, n_words long, first array<long>, length array<long>, items array<string>"

    def one(part):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = scan(batch, part.value)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_row"),
                        batch.column("doc_id").cast(pa.int64()),
                        pa.array(found.n_words),
                        pa.array([m[0] for m in found.marks], pa.list_(pa.int64())),
                        pa.array([m[1] for m in found.marks], pa.list_(pa.int64())),
                        pa.array([sorted(s) for s in found.items], pa.list_(pa.string())),
                    ],
                    ["_row", "doc_id", "n_words", "first", "length", "items"],
                )

        return find

    every = None
    for part in sent:
        mine = rows.mapInArrow(one(part), schema)
        every = mine if every is None else every.unionByName(mine)

    def merge(table: pa.Table) -> pa.Table:
        n_words = table.column("n_words")[0].as_py()
        first, length = (np.array([x for v in table.column(c).to_pylist() for x in v], np.int64) for c in ("first", "length"))
        items = {x for v in table.column("items").to_pylist() for x in v}
        hit = _covered(n_words, first, length)
        return pa.table(
            [table.column("doc_id")[:1], [n_words], [hit], [len(items)], [_digest(items)], [hit > 0]],
            names=[c.split()[0] for c in RESULT.split(", ")],
        )

    return every.groupBy("_row").applyInArrow(merge, RESULT)


def decontaminated(docs: DataFrame, benchmark: DataFrame, bound: int = ITEM_BOUND) -> DataFrame:
    """``docs`` without the rows in which a window of an item occurs; all columns as they were."""
    kept = docs
    for part in item_parts(benchmark, bound):

        def keep(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = scan(batch, part.value)
                yield batch.filter(pa.array([len(m[0]) == 0 for m in found.marks], pa.bool_()))

        kept = kept.mapInArrow(keep, kept.schema)
    return kept
