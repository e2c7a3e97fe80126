"""Ranked lexical search by best-first document intervals over range-maximum tables.

Documents are scanned once into a table of the terms that the items ask for. Shards of that
table become posting lists, each with a sparse table of range maxima over its impacts. For an
item, an interval of documents is bounded by the sum, over the item's terms, of the largest
impact in the interval. The interval with the highest bound is taken first and split at the
document with the largest single impact; that document is scored, and the two rests are
bounded anew. When no bound reaches the k-th best score so far, the rest is never looked at.
A shard gives its best k per item, and the best of all shards are ranked by a window.

Items are sent to the tasks in parts of a bounded size, as many passes as it takes.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.tables import staged
from lattica.llm.textkit import LOWER, blocks, byte_set, distinct_spans, owners, packed, ragged, spans

#: Bytes of terms before A-Z are lower-cased: all but the stated ranges (fixed values).
TERM = ~byte_set(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Length normalisation in hundredths (fixed value), and the scale of an impact.
_B, _SCALE = 75, 1_000_000_000
SHARD_POSTINGS = 1 << 21
ITEM_BOUND = 8 << 20
#: Intervals of one item that are split in one round.
_AT_ONCE = 8


def text_terms(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, begin and end of every term, and the number before each text."""
    begin, end, before = spans(raw, starts, TERM)
    return LOWER[raw], begin, end, before


@dataclass
class Items:
    """Some items: their ids, distinct terms and how often each item asks for a term."""

    ids: list[object]
    raw: np.ndarray  # terms end to end
    end: np.ndarray
    term: np.ndarray  # per (item, distinct term)
    times: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[object, str | None]]) -> Items:
        low, begin, end, own = text_terms(*packed(pa.array([r[1] for r in rows], pa.string())))
        data = low.tobytes()
        words = [data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        known: dict[bytes, int] = {}
        number = [known.setdefault(w, len(known)) for w in words]
        asked = [Counter(number[a:b]) for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
        return cls(
            [r[0] for r in rows],
            np.frombuffer(b"".join(known), np.uint8),
            np.cumsum([len(w) for w in known]).astype(np.int64),
            np.array([t for c in asked for t in c], np.int64),
            np.array([n for c in asked for n in c.values()], np.int64),
            np.concatenate([[0], np.cumsum([len(c) for c in asked])]).astype(np.int64),
        )

    def postings(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For a block of texts: all terms of each, and (text, item term, occurrences) sorted by text."""
        low, begin, end, own = text_terms(raw, starts)
        size, n = len(self.raw), len(self.end)
        first = np.concatenate([np.zeros(1, np.int64), self.end[:-1]])[:n]
        # Items' terms and the block's are numbered together, by their bytes.
        number, _ = distinct_spans(np.concatenate([self.raw, low]), np.concatenate([first, begin + size]), np.concatenate([self.end, end + size]))
        place = np.full(int(number.max(initial=-1)) + 1, -1)
        place[number[:n]] = np.arange(n)
        term = place[number[n:]]
        asked = np.flatnonzero(term >= 0)
        key, tf = np.unique(owners(own)[asked] * max(n, 1) + term[asked], return_counts=True)
        return np.diff(own), key // max(n, 1), key % max(n, 1), tf


_INDEX = "doc_id long, n long, terms binary, tfs binary"


def _index(items):
    """Rows with a term: their length in terms and the items' terms they hold."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts = packed(batch.column("text"))
            ids = batch.column("doc_id").cast(pa.int64())
            for first, last in blocks(starts, 4 << 20):
                base = starts[first]
                n, text, term, tf = items.value.postings(raw[base : starts[last]], starts[first : last + 1] - base)
                at = pa.py_buffer((np.searchsorted(text, np.arange(last - first + 1)) * 4).astype(np.int32))
                lists = [pa.Array.from_buffers(pa.binary(), last - first, [None, at, pa.py_buffer(x.astype("<i4"))]) for x in (term, tf)]
                rows = pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])
                yield rows.filter(pa.array(n > 0))

    return scan


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = np.frombuffer(packed(batch.column("terms"))[0].tobytes(), "<i4")
        found = np.bincount(terms)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["term", "df"])


class Shard:
    """Posting lists of some documents with a sparse table of range maxima."""

    def __init__(self, n_docs: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.n_docs = n_docs
        order = np.argsort(term * n_docs + doc)
        self.key = (term * n_docs + doc)[order]
        self.doc, self.impact = doc[order], impact[order]
        longest = int(np.diff(np.flatnonzero(np.diff(term[order], prepend=-1, append=-1))).max(initial=1))
        # best[k][i]: the place of the largest impact among i, .., i + 2**k - 1; lists are never left.
        self.best = [np.arange(len(order), dtype=np.int32)]
        for k in range(longest.bit_length() - 1):
            here = self.best[-1]
            ahead = here[np.minimum(np.arange(len(here)) + (1 << k), len(here) - 1)]
            self.best.append(np.where(self.impact[ahead] > self.impact[here], ahead, here))
        self.best = np.stack(self.best)

    def place(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The first posting of a term at or after a document."""
        return np.searchsorted(self.key, term * self.n_docs + doc)

    def largest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of the largest impact of every non-empty range of postings."""
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        a, b = self.best[k, low], self.best[k, high - (1 << k)]
        return np.where(self.impact[b] > self.impact[a], b, a)


class Search:
    """The best ``k`` documents of a shard for every item."""

    def __init__(self, shard: Shard, term: np.ndarray, gain: np.ndarray, before: np.ndarray, k: int):
        self.shard, self.term, self.gain, self.before, self.k = shard, term, gain, before, k
        self.splits = 0

    def bounds(self, flat: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bound of each interval, given its terms' ranges of postings, and where to split it."""
        value, doc = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        some = np.flatnonzero(high > low)
        best = self.shard.largest(low[some], high[some])
        value[some] = self.gain[flat[some]] * self.shard.impact[best]
        doc[some] = self.shard.doc[best]
        total = np.add.reduceat(value, own)
        top = np.flatnonzero(value == np.repeat(np.maximum.reduceat(value, own), np.diff(np.append(own, len(value)))))
        top = top[np.searchsorted(top, own)]
        return total, doc[top]

    def expand(self, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = (self.before[1:] - self.before[:-1])[item]
        return np.repeat(self.before[item], size) + ragged(size), np.cumsum(size) - size

    def run(self) -> list[list[tuple[int, int]]]:
        """Per item (score, document), best first; all that tie with the k-th are there."""
        n = len(self.before) - 1
        results: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        best: list[list[int]] = [[] for _ in range(n)]
        heaps: list[list[tuple[int, int, int, int]]] = [[] for _ in range(n)]
        active = np.flatnonzero(np.diff(self.before) > 0)
        if len(active) == 0 or self.shard.n_docs == 0 or len(self.shard.key) == 0:
            return results
        flat, own = self.expand(active)
        term = self.term[flat]
        total, split = self.bounds(flat, own, self.shard.place(term, 0), self.shard.place(term + 1, 0))
        for i, b, x in zip(active.tolist(), total.tolist(), split.tolist(), strict=True):
            if b > 0:
                heaps[i].append((-b, 0, self.shard.n_docs, x))
        live = [i for i in active.tolist() if heaps[i]]
        while live:
            taken = []
            for i in live:
                heap, least = heaps[i], best[i][0] if len(best[i]) == self.k else 1
                for _ in range(_AT_ONCE):
                    if not heap or -heap[0][0] < least:
                        break
                    _, low, high, x = heapq.heappop(heap)
                    taken.append((i, low, high, x))
                else:
                    continue
                if heap and -heap[0][0] < least:
                    heap.clear()  # no document in there can reach the k-th best
            if not taken:
                break
            self.splits += len(taken)
            item, low, high, x = np.array(taken, np.int64).T
            flat, own = self.expand(item)
            size = np.diff(np.append(own, len(flat)))
            term = self.term[flat]
            at = self.shard.place(term, np.repeat(x, size))
            hit = self.shard.key[np.minimum(at, len(self.shard.key) - 1)] == term * self.shard.n_docs + np.repeat(x, size)
            score = np.add.reduceat(np.where(hit, self.gain[flat] * self.shard.impact[np.minimum(at, len(self.shard.key) - 1)], 0), own)
            left, left_x = self.bounds(flat, own, self.shard.place(term, np.repeat(low, size)), at)
            right, right_x = self.bounds(flat, own, at + hit, self.shard.place(term, np.repeat(high, size)))
            for i, a, z, m, s, lb, lx, rb, rx in zip(item.tolist(), low.tolist(), high.tolist(), x.tolist(), score.tolist(), left.tolist(), left_x.tolist(), right.tolist(), right_x.tolist(), strict=True):
                kept = best[i]
                if len(kept) < self.k:
                    heapq.heappush(kept, s)
                    results[i].append((s, m))
                elif s >= kept[0]:
                    heapq.heapreplace(kept, s)
                    results[i].append((s, m))
                least = kept[0] if len(kept) == self.k else 1
                if lb >= least and lb > 0:
                    heapq.heappush(heaps[i], (-lb, a, m, lx))
                if rb >= least and rb > 0:
                    heapq.heappush(heaps[i], (-rb, m + 1, z, rx))
            live = [i for i in live if heaps[i]]
        least = [max(kept[0], 1) if len(kept) == self.k else 1 for kept in best]
        return [sorted((r for r in found if r[0] >= enough), reverse=True) for found, enough in zip(results, least, strict=True)]


def _shards(batches: Iterator[pa.RecordBatch], postings: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches brought together to about so many postings."""
    group, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            group.append(part)
            size += len(packed(part.column("terms"))[0]) // 4
            if size >= postings:
                yield group
                group, size = [], 0
    if group:
        yield group


_FOUND = "item long, doc_id long, score long"


def _search(items, weight: np.ndarray, n_docs: int, n_terms: int, k: int, postings: int):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = items.value
        gain = weight[asked.term] * asked.times
        for group in _shards(batches, postings):
            table = pa.Table.from_batches(group).combine_chunks()
            # Neighbours of like length have like impacts, which keeps the bounds of intervals close.
            table = table.take(pa.array(np.argsort(table.column("n").to_numpy(), kind="stable")))
            term, at = packed(table.column("terms"))
            tf = np.frombuffer(packed(table.column("tfs"))[0].tobytes(), "<i4").astype(np.int64)
            doc = np.repeat(np.arange(table.num_rows), np.diff(at) // 4)
            norm = 100 - _B + (_B * table.column("n").to_numpy() * n_docs) // n_terms
            impact = (_SCALE * tf) // (1000 * tf + 8 * norm[doc])
            shard = Shard(table.num_rows, doc, np.frombuffer(term.tobytes(), "<i4").astype(np.int64), impact)
            found = Search(shard, asked.term, gain, asked.before, k).run()
            ids = table.column("doc_id").to_pylist()
            rows = [(i, ids[d], s) for i, some in enumerate(found) for s, d in some]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["item", "doc_id", "score"])

    return best


def _parts(items: DataFrame, bound: int) -> Iterator[list[tuple[object, str | None]]]:
    """The items in parts of at most ``bound`` bytes of text (a longer one is a part of its own)."""
    part, size = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        more = len((row[1] or "").encode())
        if part and size + more > bound:
            yield part
            part, size = [], 0
        part.append((row[0], row[1]))
        size += more
    if part:
        yield part


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, bound: int = ITEM_BOUND, postings: int = SHARD_POSTINGS) -> DataFrame:
    """The ``k`` documents of highest score for every item: item_id, rank, doc_id, score.

    Only scores above 0 are ranked; equal scores go by ascending doc_id (null last). Null texts
    have no terms. Every row of ``items`` is ranked by itself and every row of ``docs`` is a
    document, repeated ids included. Items without terms and empty tables give no rows.
    """
    spark = docs.sparkSession
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long"
    every = None
    for part in _parts(items, bound):
        sent = spark.sparkContext.broadcast(Items.of(part))
        index = staged(docs.select("doc_id", "text").mapInArrow(_index(sent), _INDEX), "postings")
        n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if n_docs == 0:
            continue
        weight = np.zeros(len(sent.value.end), np.int64)
        counts = index.select("terms").mapInArrow(_document_counts, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        for term, df in counts.collect():  # at most one row for each term of this part
            weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        found = index.mapInArrow(_search(sent, weight, n_docs, n_terms, k, postings), _FOUND)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(sent.value.ids)], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        mine = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        every = mine if every is None else every.unionByName(mine)
    return every if every is not None else spark.createDataFrame([], schema)
